"""Sinks by write-then-read; streaming jobs on landed files (batch = stream)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from maillake.sinks import writers
from maillake.sources import mailbox, messages
from maillake.streaming import jobs


def test_mbox_round_trip(spark, mbox_file, tmp_path):
    m = messages.parse_messages(mailbox.read_mbox(spark, mbox_file))
    src = m.select("raw", F.lit("x@y.example").alias("envelope_from"),
                   F.col("date_sent").alias("envelope_date"))
    out = str(tmp_path / "out_mbox")
    writers.write_mbox(src, out)
    back = messages.parse_messages(mailbox.read_mbox(spark, out))
    assert sorted(r.message_id for r in back.collect()) == sorted(r.message_id for r in m.collect())


def test_flat_load_rejects_and_refuses_second_load(spark, tmp_path):
    df = spark.createDataFrame([("d", "a", "b", "s"), (None, None, None, None)],
                               "message_date string, sender_email string, rcpt_email string, subject string")
    p, r = str(tmp_path / "flat"), str(tmp_path / "rej")
    writers.write_flat(df, p, r)
    assert spark.read.parquet(p).count() == 1 and spark.read.parquet(r).count() == 1
    try:
        writers.write_flat(df, p)
        raise AssertionError("second load must fail")
    except Exception as e:  # noqa: BLE001
        assert "already exists" in str(e).lower() or "PATH_ALREADY_EXISTS" in str(e)


def test_dot_json_tally_lists(spark, tmp_path):
    edges = spark.createDataFrame([("a@x", "b@x", 3)], "src string, dst string, n long")
    writers.write_dot(edges, str(tmp_path / "dot"))
    assert spark.read.text(str(tmp_path / "dot")).first().value == '"a@x" -> "b@x" [label="3",fontsize=24];'
    writers.write_json_reports({"Top": edges}, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first().value == \
        '{"title":"Top","src":"a@x","dst":"b@x","n":3}'
    f = spark.createDataFrame([("Ann", "a@x")], "name string, email string")
    writers.append_tally(f, str(tmp_path / "tally"), ["name", "email"], date="2020-01-02")
    writers.append_tally(f, str(tmp_path / "tally"), ["name", "email"], date="2020-01-03")
    t = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tally"))
    assert t.columns == ["date", "name", "email"] and t.count() == 2
    writers.append_list_entries(spark.createDataFrame([("@x.example",)], "entry string"),
                                str(tmp_path / "list"))
    assert spark.read.text(str(tmp_path / "list")).first().value == "@x.example"


def test_live_counters_two_batches(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    schema = "rowid long, mailbox string, flags int, removed boolean, event_ts timestamp_ntz"
    t0 = dt.datetime(2020, 1, 1)
    b1 = spark.createDataFrame([(1, "A", 0, False, t0), (2, "A", 1, False, t0)], schema)
    b1.coalesce(1).write.parquet(str(land / "b1"))
    ck, st, cn = str(tmp_path / "ck"), str(tmp_path / "state"), str(tmp_path / "counters")
    stream =spark.readStream.schema(b1.schema).option("recursiveFileLookup", "true").parquet(str(land))
    jobs.run_available_now(stream, ck, writer=jobs.counters_batch_writer(st, cn))
    # second batch: message 1 moves to B and is read; message 2 is removed
    t1 = dt.datetime(2020, 1, 2)
    spark.createDataFrame([(1, "B", 1, False, t1), (2, "A", 1, True, t1)], schema) \
        .coalesce(1).write.parquet(str(land / "b2"))
    jobs.run_available_now(stream, ck, writer=jobs.counters_batch_writer(st, cn))
    c = spark.read.parquet(f"{cn}/log")
    last = {r.mailbox: (r.total_count, r.unseen_count) for r in
            c.filter(F.col("epoch") == c.agg(F.max("epoch")).first()[0]).collect()}
    assert last == {"A": (0, 0), "B": (1, 0)}
    cur = {r.mailbox: r.total_count for r in jobs.current_counters(spark, st, cn).collect()}
    assert cur == {"A": 0, "B": 1}
    # a late event older than the stored state changes nothing
    spark.createDataFrame([(1, "A", 0, False, t0)], schema).coalesce(1).write.parquet(str(land / "b3"))
    jobs.run_available_now(stream, ck, writer=jobs.counters_batch_writer(st, cn))
    cur = {r.mailbox: r.total_count for r in jobs.current_counters(spark, st, cn).collect()}
    assert cur == {"A": 0, "B": 1}


def test_archive_once_batch_equals_stream(spark, tmp_path):
    land = tmp_path / "arrivals"
    rows = [(i, f"id{i % 5}" if i % 7 else None, i % 3, dt.datetime(2020, 1, 1 + i % 20), f"raw{i % 4}")
            for i in range(100)]
    df = spark.createDataFrame(rows, "rowid long, message_id string, flags int, ts timestamp_ntz, raw string")
    df.repartition(4).write.parquet(str(land))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(land))
    arch = jobs.archive_once(stream, "message_id", F.sha2("raw", 256))
    out = str(tmp_path / "archived")
    jobs.run_available_now(arch, str(tmp_path / "ck"), out_dir=out)
    got = sorted(r.dedup_key for r in spark.read.parquet(out).collect())
    batch = (df.filter(F.col("flags").bitwiseAND(2) == 0)
             .select(F.coalesce("message_id", F.concat(F.lit("#"), F.sha2("raw", 256))).alias("k"))
             .distinct())
    assert got == sorted(r.k for r in batch.collect())


def test_late_mail_is_archived(spark, tmp_path):
    land = tmp_path / "late"
    land.mkdir()
    schema = "message_id string, flags int, ts timestamp_ntz, raw string"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(land))
    for n, (i, year) in enumerate([("a", 2024), ("b", 2024), ("c", 2020), ("a", 2019)]):
        spark.createDataFrame([(i, 0, dt.datetime(year, 1, 1), "x")], schema).write.parquet(str(land / str(n)))
        jobs.run_available_now(jobs.archive_once(stream, "message_id", F.sha2("raw", 256)), str(tmp_path / "ck2"), out_dir=str(tmp_path / "arch2"))
    assert sorted(r.message_id for r in spark.read.parquet(str(tmp_path / "arch2")).collect()) == ["a", "b", "c"]


def test_triage_skips_deleted_mail_and_trashes_what_rules_delete(spark, tmp_path):
    df = spark.createDataFrame([(1, ["\\DELETED"], "x"), (2, ["\\Seen"], "spam"), (3, None, "x")], "rowid int, imap_flags array<string>, s string")
    rules = [jobs.Rule(F.col("s") == "spam", folder="Junk", add_flags=["\\Deleted"])]
    write = jobs.triage_batch_writer(str(tmp_path / "t"), rules)
    for _ in range(2):                  # the same epoch again changes nothing
        write(df, 0)
    got = {r.rowid: r.target_folder for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {2: "Trash", 3: "INBOX"} and spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_counters_survive_retries_at_every_step_and_other_defaults(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    schema = "rowid long, mailbox string, flags int, removed boolean, event_ts timestamp_ntz"
    first = spark.createDataFrame([(i, "A", 0, False, dt.datetime(2020, 1, 1)) for i in range(8)], schema)
    moved = spark.createDataFrame([(i, "B", 1, False, dt.datetime(2020, 1, 2)) for i in range(8)], schema)
    want = {"A": (0, 0), "B": (8, 0)}
    write = DataFrameWriter.parquet

    def counters(st, cn):
        return {r.mailbox: (r.total_count, r.unseen_count) for r in jobs.current_counters(spark, st, cn).collect()}

    for step in ("rows", "all", "log", "manifest"):     # the run stops before this write of epoch 1
        st, cn = str(tmp_path / f"{step}-st"), str(tmp_path / f"{step}-cn")
        jobs.counters_batch_writer(st, cn, buckets=4)(first, 0)

        def stopping(self, path, *a, step=step, **k):
            if f"/{step}/epoch=1" in path:
                raise RuntimeError("stopped")
            return write(self, path, *a, **k)

        with monkeypatch.context() as m:
            m.setattr(DataFrameWriter, "parquet", stopping)
            with pytest.raises(RuntimeError):
                jobs.counters_batch_writer(st, cn, buckets=7)(moved, 1)
        assert counters(st, cn) == {"A": (8, 8)}
        for buckets in (9, 64):                         # tried again, then once more
            jobs.counters_batch_writer(st, cn, buckets=buckets)(moved, 1)
            assert counters(st, cn) == want, step
