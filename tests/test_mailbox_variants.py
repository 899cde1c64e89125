"""Mailbox edge cases listed in FIXTURES.md (variants of the four-message mailbox)."""

from pyspark.sql import functions as F

from maillake.functions import headers as H
from maillake.functions.mime import choose_body, mime_parts, with_decoded_words
from maillake.sources import mailbox, messages


def _parse(spark, path):
    return messages.parse_messages(mailbox.read_mbox(spark, str(path))).orderBy("file_block_start", "seq")


def test_unescaped_and_escaped_from_lines(spark, tmp_path):
    p = tmp_path / "v.mbox"
    p.write_text("From a Mon Nov  1 08:00:00 2010\nSubject: one\n\nline\n>From the escaped line\n"
                 "From b Mon Nov  1 08:00:00 2010\nSubject: two\n\nFrom here on it splits\n")
    m = _parse(spark, p).collect()
    # An unescaped body line starting "From " opens a record, as the reference's reader does.
    assert [r.subject for r in m] == ["one", "two", None]
    assert ">From the escaped line" in m[0].body


def test_no_trailing_newline_and_missing_headers(spark, tmp_path):
    p = tmp_path / "v.mbox"
    p.write_text("From a Mon Nov  1 08:00:00 2010\nTo: x@y\n\nno newline at end")
    r = _parse(spark, p).first()
    assert r.from_ is None and r.subject is None and r.message_id is None and r.date_sent is None
    assert r.body == "no newline at end"


def test_addresses_repeated_headers_and_quoted_comma(spark, tmp_path):
    p = tmp_path / "v.mbox"
    p.write_text("From a Mon Nov  1 08:00:00 2010\nTo: a@x, \"Doe, Jo\" <jo@x>\nTo: b@x\nCc: c@x\nCc: d@x\n\nb\n")
    m = _parse(spark, p)
    r = m.select(F.concat(H.header_all(F.col("headers"), "to"), H.header_all(F.col("headers"), "cc")).alias("all"),
                 H.parse_addresses(H.header(F.col("headers"), "to")).alias("to1")).first()
    assert r.all == ['a@x, "Doe, Jo" <jo@x>', "b@x", "c@x", "d@x"]
    assert [(a.name, a.email) for a in r.to1] == [("", "a@x"), ("Doe, Jo", "jo@x")]
    rc = messages.recipient_rows(m.withColumn("message_rowid", F.lit(1)))
    assert sorted((x.type, x.position, x.address) for x in rc.collect()) == [
        (0, 0, "a@x"), (0, 1, "jo@x"), (1, 0, "c@x")]


def test_python_only_on_rows_that_need_it(spark):
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import LongType
    import pandas as pd
    from maillake.functions.mime import only_where, with_decoded_words

    @pandas_udf(LongType())
    def batch_size(s: pd.Series) -> pd.Series:
        return pd.Series([len(s)] * len(s))
    df = spark.range(1000).repartition(1)
    out = only_where(df, F.col("id") < 10, {"x": batch_size("id")}, {"x": F.lit(-1).cast("long")})
    assert out.agg(F.max("x")).first()[0] == 10          # Python saw the 10 rows only
    vals = spark.createDataFrame([("=?UTF-8?Q?caf=C3=A9?=",), ("plain",), (None,)], "s string")
    got = {r.s: r.d for r in with_decoded_words(vals, "s", "d").collect()}
    assert got == {"=?UTF-8?Q?caf=C3=A9?=": "café", "plain": "plain", None: None}


def test_nested_multipart_and_attachment(spark, tmp_path):
    import base64
    from maillake.functions.mime import attachments
    att = base64.b64encode(b"PDFDATA").decode()
    raw = ("From a Mon Nov  1 08:00:00 2010\nSubject: nested\n"
           'Content-Type: multipart/mixed; boundary="OUT"\n\npreamble\n'
           "--OUT\nContent-Type: multipart/alternative; boundary=IN\n\n"
           "--IN\nContent-Type: text/html\n\n<html><body>H</body></html>\n"
           "--IN\nContent-Type: text/plain\n\nPlain text\n--IN--\n"
           "--OUT\nContent-Type: application/pdf; name=\"a.pdf\"\nContent-Disposition: attachment; filename=\"a.pdf\"\n"
           f"Content-Transfer-Encoding: base64\n\n{att}\n--OUT--\n")
    p = tmp_path / "n.mbox"
    p.write_text(raw)
    m = _parse(spark, p).select("seq", "headers", "body")
    parts = mime_parts(m, "seq", "headers", "body")
    kinds = sorted((r.part_no, r.content_type) for r in parts.collect())
    assert kinds == [("0.0", "text/html"), ("0.1", "text/plain"), ("1", "application/pdf")]
    assert choose_body(parts, "seq").first().text.strip() == "Plain text"
    a = attachments(m, "seq", "headers", "body").first()
    assert (a.filename, bytes(a.content)) == ("a.pdf", b"PDFDATA")


def test_rfc2047_latin1_html_and_bad_date(spark, tmp_path):
    p = tmp_path / "v.mbox"
    body_html = "<html><body><div>Hello &amp; bye</div></body></html>"
    p.write_bytes(
        ("From a Mon Nov  1 08:00:00 2010\nSubject: =?ISO-8859-1?Q?Caf=E9_cr=E8me?=\n"
         "Date: not a date\nContent-Type: text/html\n\n" + body_html + "\n"
         "From b Mon Nov  1 08:00:00 2010\nSubject: plain\nContent-Type: text/plain; charset=ISO-8859-1\n"
         "Content-Transfer-Encoding: quoted-printable\n\nna=EFve caf=E9\n").encode("latin-1"))
    m = _parse(spark, p)
    rows = with_decoded_words(m, "subject", "s").select("seq", "s", "date_sent").collect()
    assert rows[0].s == "Café crème" and rows[0].date_sent is None
    parts = mime_parts(m.select("file_block_start", "seq", "headers", "body")
                       .withColumn("id", F.concat_ws(":", "file_block_start", "seq")), "id", "headers", "body")
    texts = sorted(r.text.strip() for r in choose_body(parts, "id").collect())
    assert texts == ["Hello & bye", "naïve café"]


def test_rfc2047_words_hold_the_whole_text(spark):
    import __spark_entry__ as E
    from maillake.functions.mime import decoded_utf8_words, utf8_words

    texts = ["one line", "first\nsecond\r\n\tthird  \n", "Größe 東京\n" * 300, "🙂" * 100, "=?UTF-8?B?YQ==?= ?=\n=?", "", None, "\n\n", "x" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("words", utf8_words(F.col("text")))
    rows = with_decoded_words(df.withColumn("here", decoded_utf8_words(F.col("words"))), "words", "python").collect()
    assert {r.id: r.here for r in rows} == {r.id: r.python for r in rows} == dict(enumerate(texts))
    assert all(len(w) <= 75 and w.startswith("=?UTF-8?B?") for r in rows if r.words for w in r.words.split("\r\n "))
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: r.text for r in E.queries()["rfc2047_text"](spark, sf).collect()} == docs
    assert any("\n" in t for t in docs.values())
