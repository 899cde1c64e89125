"""Processed marks, live adjusted counts, and mail written as files."""

import datetime as dt
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maillake.operators.counters import unread_adjusted
from maillake.sinks import mailfiles
from maillake.sources import mailbox
from maillake.streaming import jobs, live

AT = dt.datetime(2024, 1, 1)


def marks_of(events, ignore=False):
    """Plain state machine: events (id, kind, minute, deleted, payload) of each batch in order."""
    state, out = {}, []
    for i, kind, minute, deleted, payload in events:
        processed, known, gone, held = state.get(i, (False, False, False, None))
        run = False
        if kind == "mail":
            known, gone, held = True, deleted, payload
            run = not gone and (ignore or not processed)
        elif kind == "set":
            processed = True
        else:
            processed, run = False, known and not gone
        if run:
            processed = True
            out.append((i, AT + dt.timedelta(minutes=minute), kind, held))
        state[i] = (processed, known, gone, held)
    return out, state


class Box:
    """A landing folder with a stream of marks over it."""

    def __init__(self, spark, path, ignore=False):
        self.spark, self.path, self.ignore = spark, str(path), ignore

    def land(self, events):
        rows = [(i, k, AT + dt.timedelta(minutes=m), d, p) for i, k, m, d, p in events]
        self.spark.createDataFrame(rows, live.EVENT_SCHEMA).write.mode("append").parquet(self.path + "/land")
        return self.run()

    def run(self):
        stream = jobs.landing_stream(self.spark, self.path + "/land", live.EVENT_SCHEMA)
        live.run_process_once(stream, self.path + "/ck", self.path + "/data", self.ignore)
        return sorted(tuple(r) for r in self.spark.read.parquet(self.path + "/data").collect())


@pytest.mark.parametrize("ignore", [False, True])
def test_marks_against_a_plain_state_machine(spark, tmp_path, ignore):
    """Three starts of the stream; set, clear and process again, deleted mail, commands before mail."""
    rnd, box, events = random.Random(4), Box(spark, tmp_path, ignore), []
    for batch in range(3):
        part = [(str(rnd.randrange(12)), rnd.choice(["mail", "mail", "set", "clear"]), batch * 100 + m, False, None) for m in range(60)]
        part = [(i, k, m, k == "mail" and rnd.random() < 0.2, f"p{m}" if k == "mail" else None) for i, k, m, _, _ in part]
        events += part
        got = box.land(part)
    want, state = marks_of(events, ignore)
    assert got == sorted(want)
    assert {r.id: (r.processed, r.known, r.deleted) for r in live.marks(spark, box.path + "/ck").collect()} == {i: s[:3] for i, s in state.items()}


def test_commands_for_all_messages(spark, tmp_path):
    box = Box(spark, tmp_path)
    assert len(box.land([(str(i), "mail", i, False, f"m{i}") for i in range(5)])) == 5
    for kind, more in (("clear", 5), ("set", 0), ("clear", 5)):
        before = len(box.run())
        rows = live.command_all(spark, box.path + "/ck", kind, F.lit(AT)).collect()
        assert len(box.land([(r.id, r.kind, 50, False, None) for r in rows])) == before + more
    with pytest.raises(ValueError):
        live.command_all(spark, box.path + "/ck", "mail", F.lit(AT))


def test_mail_and_commands_are_one_stream(spark):
    mail = spark.createDataFrame([(7, AT, False, "x")], "id int, at timestamp_ntz, deleted boolean, payload string")
    commands = spark.createDataFrame([(7, "clear", AT)], "id int, kind string, at timestamp_ntz")
    assert sorted(tuple(r) for r in live.events(mail, commands).collect()) == [("7", "clear", AT, False, None), ("7", "mail", AT, False, "x")]


SCHEMA = "rowid long, message_id string, mailbox string, flags int, removed boolean, event_ts timestamp_ntz"


def adjusted_batch(spark, events):
    """A11 and A12 of the latest rows by the batch operators, folder by folder."""
    latest = {}
    for r in events:
        if r[0] not in latest or r[5] >= latest[r[0]][5]:
            latest[r[0]] = r
    rows = [(i, m, f, ord(b)) for i, m, b, f, gone, _ in latest.values() if not gone]
    folders = spark.createDataFrame([(ord(b), None) for b in "ABC"], "rowid long, source long")
    none = spark.createDataFrame([], "message_rowid long, mailbox_id long")
    got = unread_adjusted(spark.createDataFrame(rows, "rowid long, message_id string, flags int, mailbox long"), folders, none)
    return {chr(r.mailbox_id): (r.unread_count, r.unread_count_adjusted_for_duplicates) for r in got.collect()}


def test_live_adjusted_unread_is_the_batch_answer(spark, tmp_path, monkeypatch):
    """Inserts, moves, flag changes, removals, shared and missing ids; each batch is stopped at some write and tried again."""
    from pyspark.sql.readwriter import DataFrameWriter

    rnd, st, cn, events = random.Random(9), str(tmp_path / "st"), str(tmp_path / "cn"), []
    write = DataFrameWriter.parquet
    for epoch in range(4):
        part = [(rnd.randrange(30), rnd.choice(["a", "b", "c", None]), rnd.choice("ABC"), rnd.choice([0, 0, 1, 2]), rnd.random() < 0.2,
                 AT + dt.timedelta(minutes=rnd.randrange(epoch * 20, epoch * 30 + 10), seconds=n)) for n in range(40)]
        events += part
        batch = spark.createDataFrame(part, SCHEMA)
        stop = ("references", "rows", "all", "manifest")[epoch]

        def stopping(self, path, *a, **k):
            if f"/{stop}/epoch={epoch}" in path:
                raise RuntimeError("stopped")
            return write(self, path, *a, **k)

        with monkeypatch.context() as m:
            m.setattr(DataFrameWriter, "parquet", stopping)
            with pytest.raises(RuntimeError):
                live.counters_batch_writer(st, cn, buckets=4, message_id="message_id")(batch, epoch)
        for _ in range(2):      # tried again, then once more
            live.counters_batch_writer(st, cn, buckets=4, message_id="message_id")(batch, epoch)
        got = {r.mailbox: (r.unread_count, r[live.ADJUSTED]) for r in live.current_counters(spark, st, cn).collect()}
        want = adjusted_batch(spark, events)
        assert {b: x for b, x in got.items() if x != (0, 0)} == want
    assert sorted(os.listdir(st + "/manifest")) == ["epoch=2", "epoch=3"]
    refs = live.BucketedState(spark, st, 4).read("references", range(4))
    assert all(r.n > 0 for r in refs.collect())


def test_a_batch_opens_its_buckets_only(spark, tmp_path):
    state = live.BucketedState(spark, str(tmp_path / "s"), 8)
    rows = spark.range(100).withColumn("_bucket", state.bucket(F.col("id")))
    state.write("t", rows, range(8), 0)
    state.commit(0)
    state = live.BucketedState(spark, str(tmp_path / "s"), 3)       # an existing table keeps its number
    assert state.buckets == 8
    assert {f.split("_bucket=")[1][0] for f in state.read("t", [2, 5]).inputFiles()} == {"2", "5"}
    state.write("t", rows.filter("false"), [2], 1)
    state.commit(1)
    assert live.BucketedState(spark, str(tmp_path / "s"), 8).read("t", [2]) is None


def test_mail_files_are_written_once(spark, tmp_path):
    """K4: retried writes and tasks leave no double file, other bytes are not overwritten."""
    rows = [(i, i % 3 == 0, f"Subject: {i}\n\nGröße".encode("iso-8859-1" if i % 2 else "utf-8")) for i in range(40)]
    df = spark.createDataFrame(rows, "n int, privileged boolean, content binary").repartition(5)
    name = F.concat(F.when(F.col("privileged"), "priv").otherwise("reg"), F.format_string("/s%06d.eml", "n"))
    out = str(tmp_path / "out")
    for _ in range(2):
        mailfiles.write_files(df, out, name, F.col("content"))
        found = {f"{d}/{f}": open(f"{out}/{d}/{f}", "rb").read() for d in ("reg", "priv") for f in os.listdir(f"{out}/{d}")}
        assert found == {f"{'priv' if p else 'reg'}/s{i:06d}.eml": c for i, p, c in rows}
        assert sorted(os.listdir(out)) == ["_SUCCESS", "priv", "reg"]
    with pytest.raises(Exception, match="holds other bytes"):
        mailfiles.write_files(df.withColumn("content", F.lit(b"x")), out, name, F.col("content"))
    assert open(f"{out}/priv/s000000.eml", "rb").read() == rows[0][2] and not [x for x in os.listdir(out) if "staging" in x]


def test_mailboxes_are_files_in_order(spark, tmp_path):
    rows = [(f"b{0 if i % 3 else i % 7}", i, f"From a Mon Nov  1 08:00:00 2010\nSubject: {i}\n\nx") for i in range(300)]
    df = spark.createDataFrame(rows, "box string, i int, value string").repartition(6)
    done = mailfiles.write_mailboxes(df, str(tmp_path / "m"), "box", ["i"], "value")
    assert {r.file: r.messages for r in done.collect()} == Counter(b for b, _, _ in rows)
    for box in {b for b, _, _ in rows}:
        got = mailbox.read_mbox(spark, str(tmp_path / "m" / box)).orderBy("seq").collect()
        assert [r.raw.split("\n")[0] for r in got] == [f"Subject: {i}" for b, i, _ in rows if b == box]
    whole = (tmp_path / "m" / "b0").read_bytes()
    mailfiles.write_mailboxes(df, str(tmp_path / "m"), "box", ["i"], "value", drop_last=9)
    assert (tmp_path / "m" / "b0").read_bytes() == whole[:-9]
