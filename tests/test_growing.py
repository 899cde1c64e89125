"""Mailboxes that grow between batches of a stream."""

import io
import os
import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from maillake.plans.registry import CATALOG
from maillake.sources import mailbox, messages
from maillake.streaming import growing, jobs

FROM = "From a@x.example Mon Nov  1 08:00:00 2010\n"


def mail(i: int, body: str = "") -> str:
    return f"{FROM}Message-ID: <{i}@x>\nSubject: s{i}\n\n{body or f'body {i}'}\nFromage is no mark\n\n"


def split(data: bytes) -> list[bytes]:
    """Messages as a batch read has them."""
    parts = (b"\n" + data).split(growing.MARK)[1:]
    return [b"From " + p for p in parts]


def test_ranges_give_each_message_once():
    rnd = random.Random(2)
    for _ in range(300):
        data = "".join(rnd.choice(["From a\n", "\n", "x", "From ", "\nFrom b\n", "F", "\nFro"]) for _ in range(rnd.randint(0, 30))).encode()
        want = split(data)
        for width in (1, 3, 7, 1000):
            got = [m for a in range(0, len(data), width) for m in growing.messages(io.BytesIO(data), 0, a, min(len(data), a + width), len(data), True)]
            assert [m for _, m in got] == want and all(data[o:o + len(m)] == m for o, m in got)


def test_blocks_of_any_size(monkeypatch):
    data = ("stray\n" + "".join(mail(i, "y" * (i % 37)) for i in range(40))).encode()
    for block in (1, 5, 64):
        monkeypatch.setattr(growing, "BLOCK", block)
        assert [m for _, m in growing.messages(io.BytesIO(data), 0, 0, len(data), len(data), True)] == split(data)
        for size in range(0, len(data), 41):
            last = (b"\n" + data[:size]).rfind(growing.MARK)
            assert growing.whole_end(io.BytesIO(data), size, 0) == max(last, 0)


def drain(spark, box, out, **kw):
    stream = messages.parse_messages(growing.mail_stream(spark, str(box), **kw))
    jobs.run_available_now(stream.select("path", "message_id", "subject", "body"), f"{out}/_checkpoint", out_dir=f"{out}/data")
    return sorted(((r.message_id, r.subject, r.body) for r in spark.read.parquet(f"{out}/data").collect()), key=str)


def batch(spark, box, **kw):
    m = messages.parse_messages(mailbox.read_mbox(spark, str(box), **kw))
    return sorted(((r.message_id, r.subject, r.body) for r in m.collect()), key=str)


@pytest.mark.parametrize("split_bytes", [97, 1 << 20])
def test_a_mailbox_that_grows_inside_a_message(spark, tmp_path, split_bytes):
    box, whole = tmp_path / "box", "".join(mail(i, "Größe " * (i % 9)) for i in range(60)).encode()
    box.mkdir()
    (box / "a.mbox").write_bytes(whole[:1501])          # inside a message
    (box / "other.txt").write_text(mail(99))
    first = drain(spark, box, tmp_path / "out", split_bytes=split_bytes)
    known = batch(spark, box / "a.mbox")
    assert 0 < len(first) == len(known) - 1 and set(first) <= set(known)
    assert drain(spark, box, tmp_path / "out", split_bytes=split_bytes) == first       # nothing new
    (box / "a.mbox").write_bytes(whole)
    (box / "b.mbox").write_text(mail(100) + mail(101))
    second = drain(spark, box, tmp_path / "out", split_bytes=split_bytes)
    assert len(second) == 60 - 1 + 1
    for f in box.iterdir():
        os.utime(f, (time.time() - 900,) * 2)
    assert drain(spark, box, tmp_path / "out", split_bytes=split_bytes, settle_seconds=600) == batch(spark, box, glob="*.mbox")
    with open(box / "b.mbox", "a") as f:                # after a settled end
        f.write(mail(102) + mail(103))
    assert len(drain(spark, box, tmp_path / "out", split_bytes=split_bytes, settle_seconds=600)) == 63
    with pytest.raises(StreamingQueryException, match="settled"):       # a.mbox ended with a message that nothing follows
        drain(spark, box, tmp_path / "out", split_bytes=split_bytes)


def test_mail_that_is_no_utf8(spark, tmp_path):
    box = tmp_path / "a.mbox"
    box.write_bytes((mail(1) + mail(2, "Größe")).encode("iso-8859-1") + mail(3, "Größe").encode())
    out = str(tmp_path / "out")
    jobs.run_available_now(growing.mail_stream(spark, str(box), settle_seconds=0), out + "/_checkpoint", out_dir=out + "/data")
    columns = ("envelope", "raw", "raw_is_bytes")
    got = sorted(tuple(r) for r in spark.read.parquet(out + "/data").select(*columns).collect())
    assert got == sorted(tuple(r) for r in mailbox.read_mbox(spark, str(box)).select(*columns).collect())
    assert sorted(x[-1] for x in got) == [False, False, True]


def test_a_mailbox_that_shrinks_is_an_error(spark, tmp_path):
    box = tmp_path / "a.mbox"
    box.write_text(mail(1) + mail(2) + mail(3))
    assert len(drain(spark, box, tmp_path / "out")) == 2
    box.write_text(mail(1) + mail(2))
    with pytest.raises(StreamingQueryException, match="shrank"):
        drain(spark, box, tmp_path / "out")


def test_polling_follows_a_mailbox(spark, tmp_path):
    """The stream wakes up by itself and takes what has been appended."""
    box, out = tmp_path / "a.mbox", str(tmp_path / "out")
    box.write_text(mail(1) + mail(2))
    q = jobs.run_polling(growing.mail_stream(spark, str(box)), out + "/_checkpoint", out_dir=out + "/data", seconds=1)
    try:
        with open(box, "a") as f:
            f.write(mail(3) + mail(4))
        end = time.time() + 60
        while time.time() < end:
            try:
                n = spark.read.parquet(out + "/data").count()
            except Exception:  # noqa: BLE001 - nothing written yet
                n = 0
            if n == 3:
                break
            time.sleep(0.5)
        assert n == 3 and q.isActive
    finally:
        q.stop()


def test_request_mail_is_read_once_a_batch(spark, tmp_path, monkeypatch):
    """The steps on a batch take its stored mail: none reads the mailbox anew, or runs in the stage of its readers."""
    d, reads = str(tmp_path / "tables"), tmp_path / "reads"
    reads.mkdir()
    tables = {"customer": [(i, f"Customer#{i}", 0, "MACHINERY" if i % 3 else "BUILDING", 1.0) for i in range(1, 9)],
              "supplier": [(1, "Supplier#1", 0)], "nation": [(0, "PERU")]}
    schemas = {"customer": "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double",
               "supplier": "s_suppkey long, s_name string, s_nationkey int", "nation": "n_nationkey int, n_name string"}
    for name, rows in tables.items():
        spark.createDataFrame(rows, schemas[name]).write.parquet(f"{d}/{name}.parquet")
    read, folder = growing._Reader.read, str(reads)

    def counted(self, partition):
        import uuid

        open(f"{folder}/{partition.begin}-{uuid.uuid4().hex}", "w").close()
        yield from read(self, partition)

    monkeypatch.setattr(growing._Reader, "read", counted)
    got = CATALOG["stream_request_mail"](spark, d).collect()
    assert sorted((r.request_id, r.status) for r in got) == [(i, "ok" if i % 3 else "error") for i in range(1, 9)]
    assert len(os.listdir(reads)) == len({x.split("-")[0] for x in os.listdir(reads)}) == 2       # two batches


def test_a_reader_holds_little_mail(tmp_path):
    """Mail of any size leaves the reader in batches of about 1 MB, so its memory does not follow the range."""
    box = tmp_path / "a.mbox"
    box.write_text("".join(mail(i, "x" * 900) for i in range(4000)))
    size = box.stat().st_size
    batches = list(growing._Reader({"path": str(box)}).read(growing._Range(str(box), 0, size, 0, size, True)))
    assert sum(b.num_rows for b in batches) == 4000
    assert all(sum(len(x) for x in b.column(4).to_pylist()) <= 1 << 20 for b in batches)


def test_formats_with_a_file_for_every_message(spark, tmp_path):
    box, out = tmp_path / "box", str(tmp_path / "out")
    (box / "cur").mkdir(parents=True)

    def drained():
        s = growing.mail_stream(spark, str(box), "maildir")
        jobs.run_available_now(s.drop("file_time"), out + "/_checkpoint", out_dir=out + "/data")
        return sorted(tuple(r) for r in spark.read.parquet(out + "/data").select("raw", F.array_join("imap_flags", " ")).collect())

    (box / "cur" / "1;2,S").write_text("Subject: one\n\nx\n")
    assert drained() == [("Subject: one\n\nx\n", "\\Seen")]
    (box / "cur" / "2;2,").write_text("Subject: two\n\nx\n")
    (box / "cur" / "3;2,F").write_bytes(b"")
    assert drained() == sorted(tuple(r) for r in mailbox.read_maildir(spark, str(box)).select("raw", F.array_join("imap_flags", " ")).collect())
    with pytest.raises(ValueError, match="no stream"):
        growing.mail_stream(spark, str(box), "rmail")
