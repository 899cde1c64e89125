"""Golden answers on the generated four-message mailbox (FIXTURES.md section 1)."""

from pyspark.sql import functions as F

from maillake.functions import headers as H
from maillake.functions.text import normalized_subject
from maillake.operators import dedup, stats, timegrid
from maillake.sources import mailbox, messages
from tests import mailfixtures


def _msgs(spark, path):
    return messages.parse_messages(mailbox.read_mbox(spark, path))


def test_s1_count(spark, mbox_file):
    assert mailbox.read_mbox(spark, mbox_file).count() == 4


def test_s1_split_invariance(spark, tmp_path):
    p = mailfixtures.write_many(tmp_path / "many.mbox", 2000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("8k", "64k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = mailbox.read_mbox(spark, p)
            ids = df.select(H.header(H.parse_headers(F.col("raw")), "message-id").alias("m"))
            assert ids.count() == 2000
            assert ids.distinct().count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_u1_multi_path(spark, tmp_path):
    a = mailfixtures.write_four_message_mbox(tmp_path / "a.mbox")
    b = mailfixtures.write_four_message_mbox(tmp_path / "b.mbox")
    assert mailbox.read_mbox(spark, [a, b]).count() == 8
    assert mailbox.scan_directory(spark, str(tmp_path)).count() == 8


def test_p1_unfolding(spark, mbox_file):
    subj = [r.subject for r in _msgs(spark, mbox_file).orderBy("seq").collect()]
    assert subj[3] == "Best way to update fields"


def test_a1_receivers_raw(spark, mbox_file):
    m = _msgs(spark, mbox_file)
    receivers = m.select(F.lit(0).alias("type"), F.explode(F.concat(
        H.header_all(F.col("headers"), "to"), H.header_all(F.col("headers"), "cc"))).alias("address_id"))
    # raw header texts are their own ids here
    names = (m.select(F.col("from_").alias("rowid")).union(receivers.select("address_id")).distinct()
             .withColumn("address", F.col("rowid")))
    got = {r.value: r.n for r in stats.header_counts(
        m.select(F.col("from_").alias("sender"), "subject"), receivers, names).filter("header = 'to_cc'").collect()}
    assert got == {"list@l.example": 2, "list user <list@l.example>": 1,
                   "list-group <list@l.example>": 1}


def test_a2_a3_parsed(spark, mbox_file):
    m = _msgs(spark, mbox_file)
    rc = m.select(H.parse_address(F.col("from_"))["email"].alias("src"),
                  H.parse_address(F.col("to"))["email"].alias("dst"))
    per_dst = {r.dst: r.n for r in rc.groupBy("dst").agg(F.count("*").alias("n")).collect()}
    assert per_dst == {"list@l.example": 4}
    edges = rc.groupBy("src", "dst").count().collect()
    assert len(edges) == 4 and all(r["count"] == 1 and r.dst == "list@l.example" for r in edges)


def test_p13_normalized(spark, mbox_file):
    m = _msgs(spark, mbox_file)
    got = {r.k: r.n for r in m.groupBy(normalized_subject(F.col("subject")).alias("k"))
           .agg(F.count("*").alias("n")).collect()}
    assert len(got) == 3 and got["filtering results?"] == 2


def test_a5_local_and_utc(spark, mbox_file):
    m = messages.header_local_time(_msgs(spark, mbox_file))
    local = {(r.ring, r.division): r.n for r in timegrid.grid_long(m, "date_local", timegrid.WEEKDAY_BY_HOUR).collect()}
    assert local == {(0, 8): 1, (0, 15): 1, (0, 17): 1, (0, 18): 1}
    utc = {(r.ring, r.division): r.n for r in timegrid.grid_long(m, "date_sent", timegrid.WEEKDAY_BY_HOUR).collect()}
    assert utc == {(0, 8): 1, (0, 17): 1, (0, 19): 2}


def test_p34_seen(spark, mbox_file):
    m = _msgs(spark, mbox_file)
    assert m.filter(F.array_contains("imap_flags", "\\Seen")).count() == 4


def test_w3_duplicates(spark, tmp_path):
    one = messages.parse_messages(mailbox.read_mbox(
        spark, mailfixtures.write_four_message_mbox(tmp_path / "one.mbox")))
    two = messages.parse_messages(mailbox.read_mbox(
        spark, mailfixtures.write_four_message_mbox(tmp_path / "two.mbox", copies=2)))

    def prep(m):
        return m.select(F.lit(0).alias("mailbox"), "message_id",
                        F.monotonically_increasing_id().alias("rowid"), F.lit(1).alias("flags"))
    assert dedup.dedup_keep_newest(prep(one)).count() == 0
    assert dedup.dedup_keep_newest(prep(two)).count() == 4


def test_star_schema(spark, mbox_file):
    from maillake.plans.sequential import global_row_number
    m = global_row_number(_msgs(spark, mbox_file), ["path", "file_block_start", "seq"], name="rowid")
    star = messages.star_schema(m)
    assert star["messages"].count() == 4
    assert star["subjects"].count() == 4
    assert star["recipients"].count() == 4
    addrs = {r.address for r in star["addresses"].collect()}
    assert "list@l.example" in addrs and "ann1@g.example" in addrs


def test_ingest_then_report(spark, mbox_file, tmp_path):
    """Mailbox -> stored star schema -> titled SQL report over the store."""
    from maillake.plans import ingest, reports
    from maillake.sources import tables
    root = str(tmp_path / "store")
    ingest.ingest_mailbox(spark, mbox_file, root)
    store = tables.read_store(spark, root)
    assert set(store) >= {"messages", "subjects", "addresses", "recipients", "message_text"}
    assert store["messages"].filter("sent_month = '2010-11'").count() == 4
    reports.register_views({"s_messages": store["messages"], "s_addresses": store["addresses"]})
    res = reports.titled(spark, [("Top senders", "SELECT a.address AS key, count(*) AS n FROM s_messages m "
                                                 "JOIN s_addresses a ON m.sender_id = a.rowid "
                                                 "GROUP BY a.address ORDER BY n DESC, key DESC LIMIT 10")])
    got = {r.key: r.n for r in res["Top senders"].collect()}
    assert got == {"ann1@g.example": 1, "bea2@g.example": 1, "cy3@g.example": 1, "di4@g.example": 1}
    try:
        ingest.ingest_mailbox(spark, mbox_file, root)
        raise AssertionError("a second load into the same store must fail unless zapped")
    except Exception as e:  # noqa: BLE001
        assert "exist" in str(e).lower()
    ingest.ingest_mailbox(spark, mbox_file, root, zap=True)


def test_mime_body(spark, mbox_file):
    from maillake.functions.mime import choose_body, mime_parts
    m = _msgs(spark, mbox_file).select("seq", "headers", "body")
    parts = mime_parts(m, "seq", "headers", "body")
    best = {r.seq: r.text.strip() for r in choose_body(parts, "seq").collect()}
    assert sorted(best.values()) == sorted(["> earlier text\nAnswer one.", "How do I filter?",
                                            "> How do I filter?\nUse a query.", "Plain body here."])
