"""Mailbox files as splittable Spark sources.

Every reader returns the raw record frame
``raw_messages(path, file_block_start, seq, envelope, raw, raw_is_bytes, ...)``:

* mbox / MMDF / RMAIL / Babyl are read with Spark's text source and a
  custom record separator, so a single large mailbox file is split across
  tasks (the line reader handles records that straddle a split boundary);
* Maildir / MH / .emlx are one file per message (``binaryFile``), which
  also gives the file time for the internal date.

``seq`` is the record's index inside its split; ``(path, file_block_start,
seq)`` orders records within a file without any one-partition window.

``raw`` is text if the record's bytes are valid UTF-8.  Other records have one character
for each byte (ISO-8859-1), and ``raw_is_bytes`` says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maillake.functions import flags as FL
from maillake.functions.mime import as_text, is_no_text

# --- fixed values: record separators of the delimited formats ----------------
MBOX_SEP = "\nFrom "
MBOX_SEP_CRLF = "\r\nFrom "
MMDF_SEP = "\x01\x01\x01\x01\n"
RMAIL_SEP = "\x1f\x0c"
# ----------------------------------------------------------------------------

#: Files up to which a table of one short row per file is broadcast to the records.
MAX_BROADCAST_FILES = 100_000

RAW_COLUMNS = ["path", "file_block_start", "seq", "envelope", "raw", "raw_is_bytes"]


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _delimited(spark: SparkSession, paths, sep: str, glob: str | None,
               recursive: bool) -> DataFrame:
    r = spark.read.option("lineSep", sep).option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.text(_paths(paths))
    pid = F.spark_partition_id().cast("long")
    return df.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("file_block_start"),
        (F.monotonically_increasing_id() - F.shiftleft(pid, 33)).alias("seq"),
        # the text source passes bytes through; those that are no UTF-8 become ISO-8859-1
        F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
        .alias("record"), (~F.is_valid_utf8("value")).alias("raw_is_bytes"))


def _per_file(table: DataFrame, records: DataFrame) -> DataFrame:
    """A table of at most one row per file read, marked for broadcast if the file listing bounds it."""
    return F.broadcast(table) if len(records.inputFiles()) <= MAX_BROADCAST_FILES else table


def read_mbox(spark: SparkSession, paths: str | Sequence[str], crlf: bool = False,
              glob: str | None = None, recursive: bool = False) -> DataFrame:
    """One row per message; split on lines that start with ``From ``.

    The separator eats ``\\nFrom ``, so every record starts with (the rest
    of) its envelope line; the first record of a file still carries the
    ``From `` itself.  ``envelope`` = that line, ``raw`` = the message.
    """
    df = _delimited(spark, paths, MBOX_SEP_CRLF if crlf else MBOX_SEP, glob, recursive)
    rec = F.col("record")
    nl = "\r\n" if crlf else "\n"
    # Text before a file's first ``From `` line is no message.  Only the first record of a
    # file's first split can be such text, and it then lacks the ``From `` that a file's
    # first message still has.  Splits are read in order, so it has that split's lowest number.
    starts = (df.filter(F.col("file_block_start") == 0).groupBy(F.col("path").alias("_path")).agg(F.min("seq").alias("_s0"),
              F.min_by(rec.startswith("From "), "seq").alias("_ok")).filter(~F.col("_ok")))
    odd = (F.col("path") == F.col("_path")) & (F.col("seq") == F.col("_s0")) & (F.col("file_block_start") == 0)
    df = df.join(_per_file(starts, df), odd, "left_anti")
    first_line = F.substring_index(rec, nl, 1)
    env = F.regexp_replace(first_line, "^From ", "")
    raw = F.substr(rec, F.length(first_line) + len(nl) + 1)
    return (df.filter(F.length(F.trim(rec)) > 0)
            .select("path", "file_block_start", "seq", env.alias("envelope"), raw.alias("raw"), "raw_is_bytes"))


def scan_directory(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.mbox`` below ``root`` (recursive)."""
    return read_mbox(spark, root, glob="*.mbox", recursive=True)


#: What the first bytes or the name of a file that is no mbox say about it.
_KINDS = ((r"(?i)\.pdf$", "pdf"), (r"(?i)\.emlx?$", "single message"), (r"(?i)\.(zip|gz|tgz|bz2|xz|7z)$", "archive"),
          (r"(?i)\.(jpe?g|png|gif|tiff?|bmp)$", "image"), (r"(?i)\.(csv|tsv|txt|html?|json|xml)$", "text"))


def unknown_files(spark: SparkSession, root: str) -> DataFrame:
    """The files below ``root`` that ``scan_directory`` does not read: ``path, length, kind`` ('unknown' for other names).

    Names and sizes only: no file is opened.
    """
    f = _files(spark, root, None).select("path", "length")
    kind = F.coalesce(*[F.when(F.col("path").rlike(rx), F.lit(k)) for rx, k in _KINDS], F.lit("unknown"))
    return f.filter(~F.col("path").endswith(".mbox")).withColumn("kind", kind)


def read_mmdf(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    """S6 MMDF: messages between ``^A^A^A^A`` lines."""
    df = _delimited(spark, paths, MMDF_SEP, glob, False)
    return (df.filter(F.length(F.trim(F.col("record"))) > 0)
            .select("path", "file_block_start", "seq", F.lit(None).cast("string").alias("envelope"),
                    F.col("record").alias("raw"), "raw_is_bytes"))


def read_rmail(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    """S5 RMAIL / Babyl: split on ``\\x1f\\x0c``; segment 0 of each file (the file
    header) is dropped; each segment loses its text through the first newline
    at index >= 2 (the label line)."""
    df = _delimited(spark, paths, RMAIL_SEP, glob, False)
    # Segment 0 of a file = the first record of its first split.  Several small
    # files can share a Spark partition, so ``seq`` (index inside the split)
    # is compared with the smallest one seen for that file's first split; the
    # per-file table has one row per file.
    starts = (df.filter(F.col("file_block_start") == 0)
              .groupBy("path").agg(F.min("seq").alias("_s0")))
    df = df.join(_per_file(starts, df), "path", "left")
    first = (F.col("file_block_start") == 0) & (F.col("seq") == F.col("_s0"))
    body = F.expr("substr(record, locate('\\n', record, 3) + 1)")
    # PDF files found while walking a mail folder are not mail.
    return (df.filter(~first & ~F.lower(F.col("path")).endswith(".pdf"))
            .select("path", "file_block_start", "seq",
                    F.lit(None).cast("string").alias("envelope"), body.alias("raw"), "raw_is_bytes"))


def _files(spark: SparkSession, paths, glob: str | None, recursive: bool = True) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(_paths(paths))


def _one_message(f: DataFrame, raw: Column, seq: Column, content: Column, *more: Column) -> DataFrame:
    return f.select("path", F.lit(0).cast("long").alias("file_block_start"), seq.cast("long").alias("seq"),
                    F.lit(None).cast("string").alias("envelope"), raw.alias("raw"), is_no_text(content).alias("raw_is_bytes"),
                    F.col("modificationTime").cast("timestamp_ntz").alias("file_time"), *more)


def maildir_rows(f: DataFrame) -> DataFrame:
    """Messages of Maildir files (batch or stream): flags from ``:2,<letters>``; empty files are skipped."""
    f = f.filter(F.col("path").rlike(r"/(cur|new)/[^/]+$") & (F.col("length") > 0))
    # Hadoop paths cannot contain ':', so maildirs kept on distributed storage
    # use ';' or '!' as the info separator (a common maildir setting); all
    # three are accepted.
    letters = F.regexp_extract(F.col("path"), r"[:;!]2,([A-Za-z]*)$", 1)
    flags = FL.imap_flags(letters, "maildir")
    flags = F.when(F.col("path").rlike(r"/new/[^/]+$"),
                   F.array_union(flags, F.array(F.lit(FL.RECENT)))).otherwise(flags)
    return _one_message(f, as_text(F.col("content")), F.lit(0), F.col("content"), flags.alias("imap_flags"))


def mh_rows(f: DataFrame) -> DataFrame:
    """Messages of MH files (batch or stream): the file's number is its place."""
    f = f.filter(F.col("path").rlike(r"/[0-9]+$") & (F.col("length") > 0))
    return _one_message(f, as_text(F.col("content")), F.regexp_extract("path", r"/([0-9]+)$", 1), F.col("content"))


def emlx_rows(f: DataFrame) -> DataFrame:
    """Messages of .emlx files (batch or stream).

    The first line is dropped; the message is cut at the stated byte count
    when the count parses (the trailing property list is not mail text).
    """
    data = F.col("content")
    # the count line is ASCII, so its length in characters is that in bytes
    first = F.substring_index(F.decode(F.substring(data, 1, 64), "ISO-8859-1"), "\n", 1)
    rest = F.substring(data, F.length(first) + 2, F.length(data))
    n = F.trim(first).try_cast("int")
    mail = F.when(n.isNotNull(), F.substring(rest, F.lit(1), n)).otherwise(rest)
    return _one_message(f, as_text(mail), F.lit(0), mail)


def read_maildir(spark: SparkSession, root: str) -> DataFrame:
    """S3: one file per message under ``cur/`` and ``new/``."""
    return maildir_rows(_files(spark, root, None))


def read_mh(spark: SparkSession, root: str) -> DataFrame:
    """S6 MH: numbered files, one message each."""
    return mh_rows(_files(spark, root, None))


def read_emlx(spark: SparkSession, root: str) -> DataFrame:
    """``.emlx`` = a byte-count line, the message, then a property list."""
    return emlx_rows(_files(spark, root, "*.emlx"))


#: Formats with a file for every message: file name pattern, and files -> messages.
FILE_ROWS = {"maildir": (None, maildir_rows), "mh": (None, mh_rows), "emlx": ("*.emlx", emlx_rows)}

READERS = {
    "mbox": read_mbox, "mmdf": read_mmdf, "rmail": read_rmail, "babyl": read_rmail,
    "maildir": read_maildir, "mh": read_mh, "emlx": read_emlx,
}


def register_format(name: str, reader) -> None:
    """Users may add a format (name -> reader(spark, path) -> raw frame)."""
    READERS[name] = reader


def read_mail(spark: SparkSession, path: str | Sequence[str], fmt: str = "mbox", **options) -> DataFrame:
    """Read a mailbox in the named format; ``options`` are the reader's (``crlf``, ``glob``, ``recursive``)."""
    try:
        reader = READERS[fmt]
    except KeyError:
        raise ValueError(f"unknown mailbox format {fmt!r}; known: {sorted(READERS)}") from None
    return reader(spark, path, **options)


def read_configured(spark: SparkSession, mailboxes: dict[str, tuple[str, str]]) -> DataFrame:
    """S6 configuration sections: ``{name: (path, format)}`` -> one raw frame with a
    ``mailbox`` column (U1: the union of every named mailbox)."""
    out = None
    for name, (path, fmt) in mailboxes.items():
        part = read_mail(spark, path, fmt).select(F.lit(name).alias("mailbox"), *RAW_COLUMNS)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no mailboxes configured")
    return out


def raw_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)
