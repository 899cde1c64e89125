"""Mail whose bytes are not UTF-8, any nesting depth, every transfer encoding."""

import base64
import quopri

import pytest
from pyspark.sql import functions as F

from maillake.functions import mime
from maillake.functions.text import fold_weights
from maillake.sources import mailbox, messages

TEXT = "Größe café niño\nzweite Zeile = ok\n"


def message(charset: str, encoding: str) -> bytes:
    data = TEXT.encode(charset)
    body = {"8bit": data, "base64": base64.encodebytes(data), "quoted-printable": quopri.encodestring(data)}[encoding]
    return (f"From: a@x\nSubject: s\nMIME-Version: 1.0\nContent-Type: text/plain; charset={charset}\n"
            f"Content-Transfer-Encoding: {encoding}\n\n").encode() + body


def texts(spark, m):
    parts = mime.mime_parts(m.withColumn("id", F.concat_ws(":", "path", "file_block_start", "seq")), "id", "headers", "body")
    return sorted(r.text.strip() for r in mime.choose_body(parts, "id").collect())


@pytest.mark.parametrize("charset", ["utf-8", "iso-8859-1", "windows-1252", "utf-16"])
def test_charsets_and_encodings(spark, tmp_path, charset):
    encodings = ["base64", "quoted-printable"] + (["8bit"] if charset != "utf-16" else [])
    (tmp_path / "cur").mkdir()
    for e in encodings:
        (tmp_path / "cur" / f"m-{e};2,S").write_bytes(message(charset, e))
    m = messages.parse_messages(mailbox.read_maildir(spark, str(tmp_path)), "maildir")
    assert texts(spark, m) == [TEXT.strip()] * len(encodings)
    encodings = encodings[:1] if charset == "utf-16" else encodings      # an mbox's last line feed is half a character
    box = tmp_path / "m.mbox"
    box.write_bytes(b"".join(b"From a Mon Nov  1 08:00:00 2010\n" + message(charset, e) + b"\n" for e in encodings))
    assert texts(spark, messages.parse_messages(mailbox.read_mbox(spark, str(box)))) == [TEXT.strip()] * len(encodings)


def test_emlx_counts_bytes(spark, tmp_path):
    data = message("iso-8859-1", "8bit")
    (tmp_path / "1.emlx").write_bytes(str(len(data)).encode() + b"\n" + data + b"<plist>tail</plist>")
    m = messages.parse_messages(mailbox.read_emlx(spark, str(tmp_path)), "emlx")
    assert texts(spark, m) == [TEXT.strip()]


@pytest.mark.parametrize("depth", [1, 4, 5, 10])
def test_parts_at_any_depth(spark, depth):
    body, kind = "Content-Type: text/plain\n\ndeep\n", "text/plain"
    for i in range(depth):
        body = f"Content-Type: multipart/mixed; boundary=b{i}x\n\n--b{i}x\n{body}\n--b{i}x\nContent-Type: text/html\n\n<html>level {i}\n--b{i}x--\n"
    raw = spark.createDataFrame([(1, "From: a\n" + body)], "id int, raw string")
    m = raw.select("id", messages.H.parse_headers(F.col("raw")).alias("headers"), messages.H.body_text(F.col("raw")).alias("body"))
    got = mime.mime_parts(m, "id", "headers", "body").collect()
    assert len(got) == depth + 1 and [r.text.strip() for r in got if r.content_type == "text/plain"] == ["deep"]
    assert mime.choose_body(mime.mime_parts(m, "id", "headers", "body"), "id").first().text.strip() == "deep"


def test_attachments_are_decoded_before_hashing(spark):
    raw = ("From: a\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: text/plain\n\nx\n--q\n"
           "Content-Type: application/x; name=f.bin\nContent-Disposition: attachment; filename=f.bin\n"
           "Content-Transfer-Encoding: quoted-printable\n\na=3Db=00=FF\n--q--\n")
    df = spark.createDataFrame([(1, raw)], "id int, raw string")
    m = df.select("id", messages.H.parse_headers(F.col("raw")).alias("headers"), messages.H.body_text(F.col("raw")).alias("body"))
    assert bytes(mime.attachments(m, "id", "headers", "body").first().content).rstrip(b"\n") == b"a=b\x00\xff"


def test_text_before_the_first_message_is_none(spark, tmp_path):
    (tmp_path / "a.mbox").write_text("stray text\nmore\nFrom a Mon Nov  1 08:00:00 2010\nSubject: one\n\nx\n")
    (tmp_path / "b.mbox").write_text("From a Mon Nov  1 08:00:00 2010\nSubject: two\n\nx\nFrom b Mon Nov  1 08:00:00 2010\nSubject: three\n\ny\n")
    m = messages.parse_messages(mailbox.read_mbox(spark, str(tmp_path), glob="*.mbox"))
    assert sorted(r.subject for r in m.collect()) == ["one", "three", "two"]


def test_charset_guess_scores_every_encoding(spark):
    def plain(b):
        best, top = "ascii", 0.0
        if all(x < 128 for x in b):
            return best
        for enc in mime.GUESS_ENCODINGS:
            try:
                s = b.decode(enc)
            except UnicodeDecodeError:
                continue
            if not s:
                continue
            score = sum(weights.get(c, 0) + (2 if c in mime.GUESS_ALPHABET else 0) for c in s) / len(s)
            if score > top:
                best, top = enc, score
        return best

    weights = fold_weights()
    values = [TEXT.encode(e, "ignore") for e in ("latin_1", "cp1252", "cp437", "cp850", "mac_latin2", "utf_16", "cp037", "utf8")]
    values += [b"plain", b"", bytes(range(128, 256)), b"\x81\x8d abc", b"\xff\xfe", "Übung".encode("cp852") * 50]
    assert mime.guess_charsets(values, weights) == [plain(v) for v in values]
