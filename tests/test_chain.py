"""Mail bytes by the reader's word, files of discovery, unknown files, sources of a digest, index with senders."""

import csv
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from maillake.functions import mime
from maillake.operators import discovery, pages, wishes
from maillake.sinks import writers
from maillake.sources import mailbox, messages
from maillake.streaming import jobs


def one_body(spark, tmp_path, data: bytes) -> str:
    (tmp_path / "cur").mkdir()
    (tmp_path / "cur" / "m;2,S").write_bytes(data)
    m = messages.parse_messages(mailbox.read_maildir(spark, str(tmp_path)), "maildir").withColumn("id", F.lit(1))
    return mime.choose_body(mime.mime_parts(m, "id", "headers", "body"), "id").first().text


@pytest.mark.parametrize("text", ["le CAFÉ» est", "Ã©", "plain", "Größe 東京", "Ã©Â"])
@pytest.mark.parametrize("declared, used", [("utf-8", "utf-8"), ("iso-8859-1", "iso-8859-1"), ("utf-8", "iso-8859-1"), ("iso-8859-1", "utf-8")])
def test_bytes_are_decoded_once(spark, tmp_path, text, declared, used):
    """8bit bodies: the declared charset reads the bytes; bytes that are no UTF-8 are read as ISO-8859-1."""
    data = text.encode(used, "ignore")
    got = one_body(spark, tmp_path, f"From: a@x\nContent-Type: text/plain; charset={declared}\nContent-Transfer-Encoding: 8bit\n\n".encode() + data)
    try:
        want = data.decode(declared)
    except UnicodeDecodeError:
        want = data.decode("iso-8859-1")
    assert got == want


def test_discovery_files_hold_the_original_bytes(spark, tmp_path):
    (tmp_path / "in" / "cur").mkdir(parents=True)
    mails = {f"m{i}": (f"From: {'boss' if i % 2 else 'a'}@x\nMessage-ID: <id-{i // 2 if i < 4 else i}@example>\nSubject: s, \"q\" {i}\n\nGröße secret {i}\n"
                       .encode("iso-8859-1" if i % 3 else "utf-8")) for i in range(7)}
    for name, data in mails.items():
        (tmp_path / "in" / "cur" / f"{name};2,S").write_bytes(data)
    m = messages.parse_messages(mailbox.read_maildir(spark, str(tmp_path / "in")), "maildir")
    hits = discovery.discovery(m, raw="raw", to=F.col("to"), cc=F.col("cc"), from_=F.col("from_"), subject=F.col("subject"), date=F.col("date_header"),
                               message_id=F.col("message_id"), original_file=F.col("path"), order=["path"], search_pattern="secret",
                               privileged_pattern="boss", keep=["raw", "raw_is_bytes"])
    out = str(tmp_path / "out")
    writers.write_discovery(hits, out)
    kept = [d for i, d in enumerate(mails.values()) if i not in (1, 3)]         # the ids of 0 and 2 once more
    got = {f"{d}/{f}": open(f"{out}/{d}/{f}", "rb").read() for d in ("reg", "priv") for f in os.listdir(f"{out}/{d}")}
    assert got == {f"{'priv' if b'boss' in data else 'reg'}/s{n + 1:06d}.eml": data for n, data in enumerate(kept)}
    rows = [r for f in os.listdir(out + "/preport") if f.endswith(".csv") for r in csv.DictReader(open(f"{out}/preport/{f}"), escapechar="\\")]
    assert sorted(int(r["snum"]) for r in rows) == [n + 1 for n, d in enumerate(kept) if b"boss" in d]
    with pytest.raises(Exception, match="exists"):
        writers.write_discovery(hits, out)


def test_unknown_files_are_reported(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("x.mbox", "a/y.PDF", "a/z.eml", "a/noext", "w.tar.gz"):
        (tmp_path / name).write_text("1234")
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.length) for r in mailbox.unknown_files(spark, str(tmp_path)).collect()}
    assert got == {"y.PDF": ("pdf", 4), "z.eml": ("single message", 4), "noext": ("unknown", 4), "w.tar.gz": ("archive", 4)}


def test_read_mail_passes_options(spark, tmp_path):
    (tmp_path / "c.mbox").write_bytes(b"From a Mon Nov  1 08:00:00 2010\r\nSubject: one\r\n\r\nx\r\nFrom b Mon Nov  1 08:00:00 2010\r\nSubject: two\r\n\r\ny\r\n")
    (tmp_path / "d.txt").write_text("From a\nSubject: no\n\n")
    got = mailbox.read_mail(spark, str(tmp_path), "mbox", crlf=True, glob="*.mbox").collect()
    assert [r.raw for r in got] == ["Subject: one\r\n\r\nx", "Subject: two\r\n\r\ny\r\n"]


def test_sources_of_a_digest(spark):
    rows = [(1, "News (The Daily)", "x"), (2, "News", "From the TIMES: https://w.example/a"), (3, "News", "at HTTPS://u.example/ or https://V.example:8/b"),
            (4, "News", None), (5, "News (a) b", "none")]
    df = spark.createDataFrame(rows, "rowid int, subject string, body string")
    d = wishes.digest_with_bodies(df, df.filter("false"), ["news"], ["spam"], {"the times": "Times"}).orderBy("item").collect()
    assert [(r.item, r.source, r.body) for r in d] == [(i + 1, s, rows[i][2]) for i, s in enumerate(["The Daily", "Times", "v.example", None, None])]


def test_term_index_lines_name_the_sender(spark):
    pg = spark.createDataFrame([(1, "Meeting with Ann Doe today."), (2, "Talk with Ann Doe again."), (3, "no names here")], "page int, text string")
    who = spark.createDataFrame([(1, "Roe, Bob")], "page int, sender string")
    index = pages.term_index_with_senders(pg, who)
    lines = [r.value for r in writers.term_index_html(index).filter("k = 'ann doe'").orderBy("i").collect()]
    assert lines == ["<h3>Ann Doe</h3>", "&nbsp;&nbsp;&nbsp;<a href='page/1'>[page 1]</a> Roe, Bob<br>", "&nbsp;&nbsp;&nbsp;<a href='page/2'>[page 2]</a> ?<br>"]
    plain = [r.value for r in writers.term_index_html(pages.term_index(pg)).filter("k = 'ann doe' AND i = 1").collect()]
    assert plain == ["&nbsp;&nbsp;&nbsp;<a href='page/1'>[page 1]</a><br>"]


def test_only_wanted_mail_meets_its_body(spark):
    triaged = spark.createDataFrame([(1, True), (2, False), (3, True)], "rowid int, wants_full boolean")
    bodies = spark.createDataFrame([(i, f"body {i}") for i in (1, 2, 4)], "rowid int, raw string")
    got = jobs.full_pass(triaged, bodies, "rowid", lambda b: b.withColumn("sha", F.sha2("raw", 256)))
    assert [tuple(r) for r in got.collect()] == [(1, "body 1", hashlib.sha256(b"body 1").hexdigest())]


def test_a_folder_is_summed_in_parts(spark):
    import pandas as pd

    from maillake.plans import hooks

    seen = spark.sparkContext.accumulator(0)

    def partial(p):
        return p.groupby("folder")["size"].agg(["count", "sum"]).reset_index().rename(columns={"count": "n", "sum": "bytes"})

    def merge(p):
        seen.add(1)
        return pd.DataFrame({"folder": [p["folder"].iloc[0]], "n": [int(p["n"].sum())], "bytes": [int(p["bytes"].sum())]})

    schema = "folder string, n long, bytes long"
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 7)).alias("folder"), F.col("id").alias("size"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.folder: (r.n, r.bytes) for r in hooks.per_mailbox(df.repartition(4), "folder", partial, schema, merge, schema, merge, parts=8).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for i in range(4000):
        f = "hot" if i % 3 == 0 else f"f{i % 7}"
        n, b = want.get(f, (0, 0))
        want[f] = (n + 1, b + i)
    assert got == want and seen.value > len(want)


def test_address_books_in_one_read(spark, tmp_path):
    from maillake.operators import contacts
    from maillake.sources import tables

    for b, n in (("b2", 3), ("a1", 2), ("c3", 1)):
        spark.createDataFrame([(i, f"F{b}{i}", None if i else "L") for i in range(n)], "pk long, first string, last string").write.parquet(f"{tmp_path}/{b}/records")
        spark.createDataFrame([(f"{b}{i}@x", i % n, i) for i in range(4)], "address string, owner long, seq long").write.parquet(f"{tmp_path}/{b}/emails")
    (tmp_path / "zz").mkdir()
    books = tables.read_address_books(spark, f"{tmp_path}/[a-c]*")
    want = contacts.union_books([contacts.book_emails(r, e, i) for i, (r, e) in enumerate(books)])
    got = tables.read_all_books(spark, f"{tmp_path}/[a-c]*")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() == 12


def test_page_tables_and_day_counts(spark, tmp_path):
    from maillake.sources import tables

    for i, t in enumerate(("pages", "page_spans", "page_links")):
        spark.range(i + 1).write.parquet(f"{tmp_path}/{t}")
    assert {k: v.count() for k, v in tables.read_page_tables(spark, f"{tmp_path}/").items()} == {"pages": 1, "page_spans": 2, "page_links": 3}
    writers.write_day_counts(spark.createDataFrame([("2020-01-01", 3), ("2020-01-02", 0)], "date string, n long"), f"{tmp_path}/days")
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"{tmp_path}/days").collect())) == [("2020-01-01", "3"), ("2020-01-02", "0")]
