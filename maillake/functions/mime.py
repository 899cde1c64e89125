"""MIME decoding helpers.

The common case stays in the JVM (single-level multipart split on the
boundary, base64 with ``unbase64``).  Python runs only where Spark has no
built-in -- RFC 2047 words, quoted-printable, charset guessing -- and only
on the rows that need it (a ``when`` guard), as Arrow-batched pandas UDFs.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from maillake.functions.text import fold_weights, html_to_text


@pandas_udf(StringType())
def _decode_rfc2047(values: pd.Series) -> pd.Series:
    from email.header import decode_header, make_header

    def one(v):
        if v is None:
            return None
        try:
            return str(make_header(decode_header(v)))
        except Exception:  # noqa: BLE001 - undecodable words stay as they are
            return v
    return values.map(one)


def only_where(df: DataFrame, need: Column, python_cols: dict, jvm_cols: dict) -> DataFrame:
    """Run Python-backed columns only on the rows that need them.

    Spark lifts a pandas UDF out of a ``when`` and feeds it every row, so the
    gate has to be a filter: the rows matching ``need`` get ``python_cols``,
    the others ``jvm_cols`` (same names), and the two branches are unioned.
    """
    cond = F.coalesce(need, F.lit(False))
    py = df.filter(cond).withColumns(python_cols)
    jvm = df.filter(~cond).withColumns(jvm_cols)
    return py.unionByName(jvm)


def with_decoded_words(df: DataFrame, col: str, out: str) -> DataFrame:
    """``out`` = ``col`` with RFC 2047 words decoded; only values holding ``=?`` go to Python."""
    return only_where(df, F.col(col).contains("=?"), {out: _decode_rfc2047(F.col(col))},
                      {out: F.col(col)})


def utf8_words(text: Column) -> Column:
    """A text of any length as UTF-8 base64 words, each of whole characters and 75 long at most, on folded lines."""
    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,11}"), F.lit(0))      # 44 bytes at most: one line of base64
    words = F.transform(pieces, lambda x: F.concat(F.lit("=?UTF-8?B?"), F.base64(F.encode(x, "UTF-8")), F.lit("?=")))
    return F.array_join(words, "\r\n ")


def decoded_utf8_words(words: Column) -> Column:
    """The text of ``utf8_words`` without Python: for values of such words only, others go to ``with_decoded_words``."""
    pieces = F.regexp_extract_all(words, F.lit(r"=\?UTF-8\?B\?([A-Za-z0-9+/=]*)\?="), F.lit(1))
    return F.array_join(F.transform(pieces, lambda x: F.decode(F.unbase64(x), "UTF-8")), "")


# Charsets that built-in functions decode; parts in others go to Python.
JVM_CHARSETS = ("utf-8", "utf8", "us-ascii", "ascii", "iso-8859-1", "latin-1", "latin1")
_LATIN_CHARSETS = ("iso-8859-1", "latin-1", "latin1")


@pandas_udf(StringType())
def _decode_bytes(values: pd.Series, encodings: pd.Series, charsets: pd.Series) -> pd.Series:
    """Text of part bodies: undo quoted-printable, then the charset (unknown ones and bad bytes as UTF-8 with marks)."""
    import quopri

    out = []
    for v, enc, cs in zip(values, encodings, charsets):
        if v is None:
            out.append(None)
            continue
        raw = quopri.decodestring(bytes(v)) if enc == "quoted-printable" else bytes(v)
        try:
            out.append(raw.decode(cs or "utf-8", "replace"))
        except LookupError:
            out.append(raw.decode("utf-8", "replace"))
    return pd.Series(out)


def octets(text: Column, is_bytes: Column) -> Column:
    """The bytes behind a text of a raw message; ``is_bytes``: it has one character for each byte, as the readers say."""
    return F.when(is_bytes, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))


def is_no_text(raw: Column) -> Column:
    """Whether raw mail bytes are no valid UTF-8, so that ``as_text`` gives one character for each byte."""
    return ~F.is_valid_utf8(raw.cast("string"))


def as_text(raw: Column) -> Column:
    """Raw mail bytes as text: UTF-8 if they are valid, else ISO-8859-1 (lossless, one character per byte)."""
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(raw, "ISO-8859-1"))


def content_type(headers_value: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(headers_value, F.lit("text/plain")), ";", 1)))


def param(headers_value: Column, name: str) -> Column:
    v = F.regexp_extract(F.coalesce(headers_value, F.lit("")), rf'(?i){name}="?([^";]+)"?', 1)
    return F.when(v != "", v)


LAZY_DEPTH = 4       # nesting levels opened within the row; deeper mail is followed to its end


def _is_open(node: Column) -> Column:
    """Whether a node is a multipart with a boundary."""
    from maillake.functions.headers import header

    ct = header(node["h"], "content-type")
    return content_type(ct).startswith("multipart/") & param(ct, "boundary").isNotNull()


def _children(node: Column) -> Column:
    """The parts between a multipart node's boundaries; preamble and text after the closing boundary are none."""
    from maillake.functions.headers import body_text, header, parse_headers

    boundary = param(header(node["h"], "content-type"), "boundary")
    pieces = F.split(node["b"], F.concat(F.lit("\\Q--"), boundary, F.lit("\\E")))
    numbered = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p, i: F.struct(p.alias("p"), i.alias("i")))

    def child(x):
        part = F.regexp_replace(x["p"], r"^\r?\n", "")
        return F.struct(F.concat(node["path"], F.array(x["i"])).alias("path"), parse_headers(part).alias("h"), body_text(part).alias("b"))

    return F.transform(F.filter(numbered, lambda x: ~x["p"].startswith("--")), child)


def mime_leaves(df: DataFrame, id_col: str, headers: str, body: str) -> DataFrame:
    """All leaf parts of each message, depth first like ``Message.walk()``, at any depth.

    Output: (id, part_path ARRAY<INT>, part_no, content_type, charset,
    disposition, filename, encoding, raw_body, raw_is_bytes).  ``LAZY_DEPTH`` levels are opened as
    expressions within the row, then one explode gives the leaves: one scan, no shuffle.
    A multipart node's body is split on its boundary (``\\Q..\\E`` quoting).  Mail nested deeper
    names as many boundaries; only if there is such mail are further levels opened, one
    by one (checkpointed), until none is left.  ``raw_is_bytes`` comes from the readers;
    without that column raw mail is text.
    """
    from maillake.functions.headers import header
    from maillake.session import ensure_checkpoint_dir

    is_bytes = F.coalesce(F.col("raw_is_bytes"), F.lit(False)) if "raw_is_bytes" in df.columns else F.lit(False)
    node = F.struct(F.array().cast("array<int>").alias("path"), F.col(headers).alias("h"), F.col(body).alias("b"))

    def opened(nodes: Column) -> Column:
        return F.flatten(F.transform(nodes, lambda x: F.when(_is_open(x), _children(x)).otherwise(F.array(x))))

    nodes = F.array(node)
    for _ in range(LAZY_DEPTH):
        nodes = opened(nodes)
    found = df.select(F.col(id_col), is_bytes.alias("raw_is_bytes"), F.explode(nodes).alias("x"))
    if not df.filter(F.regexp_count(F.col(body), F.lit("(?i)boundary=")) >= LAZY_DEPTH).isEmpty():
        ensure_checkpoint_dir(df.sparkSession)
        level, found = found.checkpoint(), None
        while True:
            done = level.filter(~_is_open(F.col("x")))
            found = done if found is None else found.unionByName(done)
            more = level.filter(_is_open(F.col("x")))
            if more.isEmpty():
                break
            level = more.select(id_col, "raw_is_bytes", F.explode(_children(F.col("x"))).alias("x")).checkpoint()
    ct_val, disp = header(F.col("x.h"), "content-type"), header(F.col("x.h"), "content-disposition")
    return found.select(
        id_col, F.col("x.path").alias("part_path"), F.array_join(F.col("x.path").cast("array<string>"), ".").alias("part_no"),
        content_type(ct_val).alias("content_type"), param(ct_val, "charset").alias("charset"),
        F.lower(F.trim(F.substring_index(F.coalesce(disp, F.lit("")), ";", 1))).alias("disposition"),
        F.coalesce(param(disp, "filename"), param(ct_val, "name")).alias("filename"),
        header(F.col("x.h"), "content-transfer-encoding").alias("encoding"), F.col("x.b").alias("raw_body"), "raw_is_bytes")


def _transfer(encoding: Column) -> Column:
    return F.lower(F.trim(F.coalesce(encoding, F.lit(""))))


def _unbase64(body: Column) -> Column:
    return F.unbase64(F.regexp_replace(body, r"\s", ""))


def mime_parts(df: DataFrame, id_col: str, headers: str, body: str) -> DataFrame:
    """P9 input: text of every leaf part (id, part_path, part_no, content_type, charset, text).

    Parts are decoded by their charset.  7bit, 8bit and base64 parts in UTF-8, ASCII or
    ISO-8859-1 stay in the JVM (bytes that are no UTF-8 are read as ISO-8859-1).  Quoted-printable parts
    and other charsets go to Python; the other rows send it a null, so that the texts are read once.
    """
    leaves = mime_leaves(df, id_col, headers, body).withColumn("_enc", _transfer(F.col("encoding")))
    cs = F.lower(F.trim(F.coalesce(F.col("charset"), F.lit("utf-8"))))
    data = F.when(F.col("_enc") == "base64", _unbase64(F.col("raw_body"))).otherwise(octets(F.col("raw_body"), F.col("raw_is_bytes")))
    python = (F.col("_enc") == "quoted-printable") | ~cs.isin(*JVM_CHARSETS)
    jvm_text = F.when(cs.isin(*_LATIN_CHARSETS), F.decode(data, "ISO-8859-1")).otherwise(as_text(data))
    out = (leaves.withColumn("_jvm", F.when(~python, jvm_text))
           .withColumn("text", F.coalesce("_jvm", _decode_bytes(F.when(python, data), F.col("_enc"), cs))))
    return out.select(id_col, "part_path", "part_no", "content_type", "charset", "text")


@pandas_udf(BinaryType())
def _unquote(values: pd.Series) -> pd.Series:
    import quopri

    return values.map(lambda v: None if v is None else quopri.decodestring(bytes(v)))


def attachments(df: DataFrame, id_col: str, headers: str, body: str) -> DataFrame:
    """Attachment leaves with their decoded bytes (R13 input): (id, part_no, filename, content)."""
    leaves = mime_leaves(df, id_col, headers, body)
    att = leaves.filter((F.col("disposition") == "attachment") | F.col("filename").isNotNull()).withColumn("_enc", _transfer(F.col("encoding")))
    data = octets(F.col("raw_body"), F.col("raw_is_bytes"))
    content = F.when(F.col("_enc") == "base64", _unbase64(F.col("raw_body"))).otherwise(data)
    out = only_where(att, F.col("_enc") == "quoted-printable", {"content": _unquote(data)}, {"content": content})
    return out.select(id_col, "part_no", "filename", "content")


def choose_body(parts: DataFrame, id_col: str) -> DataFrame:
    """P9 + P10: per message the text of the preferred leaf part: text/plain first,
    then text/html (converted to text); multipart containers skipped."""
    leaf = parts.filter(~F.col("content_type").startswith("multipart/"))
    rank = (F.when(F.col("content_type") == "text/plain", F.lit(0))
            .when(F.col("content_type") == "text/html", F.lit(1)))
    cand = leaf.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    best = cand.groupBy(id_col).agg(
        F.min_by(F.struct("content_type", "text"), F.struct("_rank", "part_path")).alias("_b"))
    txt = F.when(F.col("_b.content_type") == "text/html", html_to_text(F.col("_b.text")))\
        .otherwise(F.col("_b.text"))
    return best.select(id_col, F.col("_b.content_type").alias("content_type"), txt.alias("text"))


# --- P18: charset guess ------------------------------------------------------
# The candidate encodings, in the reference's order, and the
# characters that score 2 each.
GUESS_ENCODINGS = ["utf8", "latin_1", "cp037", "cp437", "cp850", "cp852", "cp863", "cp865",
                   "cp1140", "cp1250", "cp1252", "iso8859_15", "mac_latin2", "utf_16"]
GUESS_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ :!,"


def _score_tables(weights: dict[str, int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """For each single-byte encoding: the score of every byte, and whether the byte means a character."""
    single = [e for e in GUESS_ENCODINGS if e not in ("utf8", "utf_16")]
    score, known = np.zeros((len(single), 256)), np.ones((len(single), 256), dtype=bool)
    for n, enc in enumerate(single):
        for b in range(256):
            ch = bytes([b]).decode(enc, "ignore")
            known[n, b] = bool(ch)
            score[n, b] = weights.get(ch, 0) + (2 if ch and ch in GUESS_ALPHABET else 0)
    return single, score, known


def guess_charsets(values: list[bytes], weights: dict[str, int]) -> list[str]:
    """The candidate encoding whose text scores most per character, of each value (none above 0: ascii).

    Single-byte encodings are scored for all values at once: the values' byte counts times
    the table of byte scores.  UTF-8 and UTF-16 texts are decoded and scored on their own.
    """
    single, score, known = _score_tables(weights)
    counts = np.stack([np.bincount(np.frombuffer(v, np.uint8), minlength=256) for v in values]) if values else np.zeros((0, 256))
    lengths = np.maximum(counts.sum(axis=1), 1)
    means = np.where(counts @ (~known).T > 0, -1.0, (counts @ score.T) / lengths[:, None])
    column = {enc: means[:, n] for n, enc in enumerate(single)}
    for enc in ("utf8", "utf_16"):
        column[enc] = np.array([_mean_score(v, enc, weights) for v in values])
    table = np.stack([column[enc] for enc in GUESS_ENCODINGS], axis=1)
    best = table.argmax(axis=1)                 # the first of equals, in the candidates' order
    ascii_only = (counts[:, 128:].sum(axis=1) == 0) | (table.max(axis=1) <= 0)
    return ["ascii" if a else GUESS_ENCODINGS[k] for a, k in zip(ascii_only, best)]


def _mean_score(value: bytes, enc: str, weights: dict[str, int]) -> float:
    try:
        text = value.decode(enc)
    except UnicodeDecodeError:
        return -1.0
    found = Counter(text)
    return sum(n * (weights.get(c, 0) + (2 if c in GUESS_ALPHABET else 0)) for c, n in found.items()) / len(text) if text else -1.0


@pandas_udf(StructType([StructField("charset", StringType()), StructField("text", StringType())]))
def _guess(values: pd.Series) -> pd.DataFrame:
    data = [b"" if v is None else bytes(v) for v in values]
    rows = [(None, None) if v is None else (enc, b.decode(enc, "replace"))
            for v, b, enc in zip(values, data, guess_charsets(data, fold_weights()))]
    return pd.DataFrame(rows, columns=["charset", "text"])


def with_guessed_charset(df: DataFrame, raw_col: str, out: str) -> DataFrame:
    """P18 as a frame operation: ASCII / valid UTF-8 rows are settled in the JVM,
    only the rest are routed (by a filter) to the Python scorer."""
    raw = F.col(raw_col)
    decoded = raw.cast("string")
    utf8_ok = F.coalesce(F.is_valid_utf8(decoded), F.lit(False))
    ascii_ok = ~decoded.rlike("[^\\x00-\\x7F]")
    jvm = F.when(raw.isNull(), F.lit(None)).when(
        ascii_ok, F.struct(F.lit("ascii").alias("charset"), decoded.alias("text"))).otherwise(
        F.struct(F.lit("utf8").alias("charset"), decoded.alias("text")))
    return only_where(df, raw.isNotNull() & ~utf8_ok, {out: _guess(raw)}, {out: jvm})

