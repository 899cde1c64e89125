"""Other mailbox formats, table sources, hooks and header-based wishes on generated files."""

import pandas as pd
from pyspark.sql import functions as F

from maillake.functions import headers as H
from maillake.operators import routes, wishes
from maillake.plans import hooks
from maillake.sources import mailbox, messages, tables

MSG = "From: A <a@x.example>\nTo: b@x.example\nSubject: {s}\nMessage-ID: <{s}@x>\n\nbody {s}\n"


def _ids(df):
    return sorted(r.m for r in df.select(H.header(H.parse_headers(F.col("raw")), "message-id").alias("m")).collect())


def test_maildir(spark, tmp_path):
    for sub in ("cur", "new", "tmp"):
        (tmp_path / "md" / sub).mkdir(parents=True)
    (tmp_path / "md" / "cur" / "1.host!2,FS").write_text(MSG.format(s="one"))
    (tmp_path / "md" / "new" / "2.host").write_text(MSG.format(s="two"))
    (tmp_path / "md" / "tmp" / "3.host").write_text(MSG.format(s="three"))
    (tmp_path / "md" / "cur" / "4.host!2,").write_text("")
    df = mailbox.read_mail(spark, str(tmp_path / "md"), "maildir")
    assert _ids(df) == ["<one@x>", "<two@x>"]
    fl = {r.path.rsplit("/", 1)[-1]: r.imap_flags for r in df.collect()}
    assert fl["1.host!2,FS"] == ["\\Flagged", "\\Seen"]
    assert fl["2.host"] == ["\\Recent"]


def test_mh_emlx(spark, tmp_path):
    (tmp_path / "mh").mkdir()
    (tmp_path / "mh" / "1").write_text(MSG.format(s="m1"))
    (tmp_path / "mh" / "2").write_text(MSG.format(s="m2"))
    (tmp_path / "mh" / ".mh_sequences").write_text("unseen: 2\n")
    assert _ids(mailbox.read_mail(spark, str(tmp_path / "mh"), "mh")) == ["<m1@x>", "<m2@x>"]
    (tmp_path / "em").mkdir()
    body = MSG.format(s="e1")
    (tmp_path / "em" / "5.emlx").write_text(f"{len(body.encode())}\n{body}<?xml version=\"1.0\"?><plist/>")
    df = mailbox.read_mail(spark, str(tmp_path / "em"), "emlx")
    assert df.first().raw == body


def test_rmail_and_mmdf(spark, tmp_path):
    rm = "BABYL OPTIONS:\nVersion: 5\n" + "".join(
        f"\x1f\x0c\n1,,\n{MSG.format(s=s)}" for s in ("r1", "r2", "r3"))
    (tmp_path / "RMAIL").write_text(rm)
    assert _ids(mailbox.read_mail(spark, str(tmp_path / "RMAIL"), "rmail")) == ["<r1@x>", "<r2@x>", "<r3@x>"]
    mm = "".join(f"\x01\x01\x01\x01\n{MSG.format(s=s)}\x01\x01\x01\x01\n" for s in ("a1", "a2"))
    (tmp_path / "box.mmdf").write_text(mm)
    assert _ids(mailbox.read_mail(spark, str(tmp_path / "box.mmdf"), "mmdf")) == ["<a1@x>", "<a2@x>"]


def test_configured_mailboxes_and_pdf_skip(spark, tmp_path):
    (tmp_path / "a.mbox").write_text(f"From x Mon Nov  1 08:00:00 2010\n{MSG.format(s='k1')}")
    rm = "BABYL OPTIONS:\n" + f"\x1f\x0c\n1,,\n{MSG.format(s='k2')}"
    (tmp_path / "RMAIL").write_text(rm)
    (tmp_path / "scan.pdf").write_text(rm)
    df = mailbox.read_configured(spark, {"inbox": (str(tmp_path / "a.mbox"), "mbox"),
                                         "old": (str(tmp_path / "RMAIL"), "rmail")})
    assert sorted((r.mailbox, r.seq >= 0) for r in df.collect()) == [("inbox", True), ("old", True)]
    assert mailbox.read_rmail(spark, str(tmp_path / "scan.pdf")).count() == 0


def test_rmail_many_small_files_share_a_partition(spark, tmp_path):
    d = tmp_path / "rm"
    d.mkdir()
    for f in ("one", "two", "three"):
        (d / f"{f}.rmail").write_text("BABYL OPTIONS:\nVersion: 5\n" + "".join(
            f"\x1f\x0c\n1,,\n{MSG.format(s=f + str(i))}" for i in range(2)))
    df = mailbox.read_rmail(spark, str(d))
    assert _ids(df) == sorted(f"<{f}{i}@x>" for f in ("one", "two", "three") for i in range(2))


def test_crlf_mbox(spark, tmp_path):
    text = "".join(f"From a@x Mon Nov  1 08:00:00 2010\r\n{MSG.format(s=s)}".replace("\n", "\r\n")
                   .replace("\r\r\n", "\r\n") for s in ("c1", "c2"))
    (tmp_path / "crlf.mbox").write_bytes(text.encode())
    df = mailbox.read_mbox(spark, str(tmp_path / "crlf.mbox"), crlf=True)
    assert _ids(df) == ["<c1@x>", "<c2@x>"]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "geo.csv").write_text("Date Created,Latitude,Longitude,Path,Other\n"
                                      "2020:01:01 10:00:00 +01,1.5,2.5,a.jpg,z\n")
    g = tables.read_geotags(spark, str(tmp_path / "geo.csv")).first()
    assert (g.date_created, g.latitude, g.path) == ("2020:01:01 10:00:00 +01", "1.5", "a.jpg")
    (tmp_path / "ad.csv").write_text("Ann,Bee,a@x.example\n")
    assert tables.read_addressees(spark, str(tmp_path / "ad.csv")).first().email == "a@x.example"
    (tmp_path / "dh.csv").write_text("Day,Time,Result\n2020-06-01, 10, 5\n")
    r = tables.read_day_hour_report(spark, str(tmp_path / "dh.csv")).first()
    assert str(r.day) == "2020-06-01" and r.result == 5
    (tmp_path / "tally.tsv").write_text("date\tname\temail\n2020-01-01\tAnn\ta@x\n")
    assert tables.read_tally(spark, str(tmp_path / "tally.tsv")).first().line == "Ann <a@x>"


def test_hooks(spark):
    df = spark.createDataFrame([("A", 3), ("A", 5), ("B", 1)], "folder string, size long")
    doubled = hooks.per_message(df, lambda p: p.assign(size=p["size"] * 2), df.schema)
    assert sorted(r.size for r in doubled.collect()) == [2, 6, 10]

    def partial(p: pd.DataFrame) -> pd.DataFrame:
        g = p.groupby("folder")["size"].agg(["count", "sum"]).reset_index()
        return g.rename(columns={"count": "n", "sum": "bytes"})

    def combine(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"folder": [p["folder"].iloc[0]], "n": [int(p["n"].sum())],
                             "bytes": [int(p["bytes"].sum())]})
    sch = "folder string, n long, bytes long"
    out = {r.folder: (r.n, r.bytes) for r in hooks.per_mailbox(
        df.repartition(3), "folder", partial, sch, combine, sch).collect()}
    assert out == {"A": (2, 8), "B": (1, 1)}


def test_received_routing_and_header_flags(spark, tmp_path):
    raw = ("Received: from mx1.a.example (mx1.a.example [192.0.2.10])\n\tby mx2.b.example; Mon, 1 Nov 2010 08:00:00 +0000\n"
           "Received: from client.c.example ([198.51.100.7]) by mx1.a.example; Mon, 1 Nov 2010 07:59:00 +0000\n"
           "Received-SPF: pass (sender ok)\nX-Spam-Flag: YES\nFrom: a@x\nSubject: s\n\n"
           "BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:Lunch\nDTSTART:20101102T120000Z\nEND:VEVENT\nEND:VCALENDAR\n"
           "see https://www.c.example/path?q=1 and http://d.example\n")
    df = spark.createDataFrame([(1, raw)], "rowid long, raw string").withColumn("headers", H.parse_headers(F.col("raw")))
    got = {r.hop: (r.from_host, r.by_host, r.ip) for r in routes.routing_table(df).collect()}
    assert got == {0: ("mx1.a.example", "mx2.b.example", "192.0.2.10"),
                   1: ("client.c.example", "mx1.a.example", "198.51.100.7")}
    r = df.select(wishes.lacks_spf(F.col("headers")).alias("nospf"),
                  wishes.flagged_spam(F.col("headers")).alias("spam")).first()
    assert (r.nospf, r.spam) == (False, True)
    ev = wishes.calendar_events(df.select("rowid", F.col("raw").alias("text")), "rowid").first()
    assert (ev.summary, ev.dtstart) == ("Lunch", "20101102T120000Z")
    hosts = sorted(r.host for r in wishes.urls(df, "rowid", "raw").collect())
    assert hosts == ["d.example", "www.c.example"]


def test_attachments_hash_match(spark):
    parts = spark.createDataFrame([(1, b"abc"), (2, b"abc"), (3, b"xyz")], "id long, content binary")
    h = wishes.attachment_hashes(parts, "id")
    assert wishes.same_attachments(h, "id").first().messages == 2
    known = spark.createDataFrame([(r.sha256,) for r in h.filter("id = 3").collect()], "sha256 string")
    assert [r.id for r in wishes.known_attachments(h, known).collect()] == [3]


def test_parse_messages_defaults(spark, tmp_path):
    p = tmp_path / "x.mbox"
    p.write_text("From a Mon Nov  1 08:00:00 2010\nSubject: only subject\n\nbody\n"
                 "From b Mon Nov  1 08:00:00 2010\nFrom: \"Last, First\" <lf@x.example>, c@x.example\n"
                 "Date: 1 Nov 10 08:00 EST\n\nb2\n")
    m = messages.parse_messages(mailbox.read_mbox(spark, str(p))).orderBy("seq").collect()
    assert m[0].from_ is None and m[0].date_sent is None
    assert str(m[1].date_sent) == "2010-11-01 13:00:00" and m[1].tz_offset_min == -300
    addr = spark.createDataFrame([(m[1].from_,)], "v string").select(
        H.parse_address(F.col("v")).alias("a"), H.parse_addresses(F.col("v")).alias("all")).first()
    assert (addr.a.name, addr.a.email) == ("Last, First", "lf@x.example")
    assert [x.email for x in addr.all] == ["lf@x.example", "c@x.example"]
