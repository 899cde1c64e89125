"""Discovery (evidence) selection: search, privilege split, de-dup, serials, report.

SURVEY F3, F4, P14, P16, W6, W7, K4, K5.  Works on whole raw texts: the
regex search runs over the full message, never a prefix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maillake.functions.predicates import any_header_matches
from maillake.functions.text import ellipsis, line_count
from maillake.operators.dedup import dedup_keep_first
from maillake.plans.sequential import global_row_number
from maillake.session import ensure_checkpoint_dir

REPORT_COLUMNS = ["snum", "query", "to", "cc", "from", "subject", "date", "message-id",
                  "lines", "original file"]


def search_hits(df: DataFrame, raw: str, pattern: str) -> DataFrame:
    """rows whose raw text matches ``pattern`` anywhere (ignore case);
    ``query`` = the first matched text."""
    rx = pattern if pattern.startswith("(?i)") else "(?i)" + pattern
    m = F.regexp_extract(F.col(raw), rx, 0)
    return df.withColumn("query", m).filter(F.col(raw).rlike(rx))


def discovery(df: DataFrame, *, raw: str, to: Column, cc: Column, from_: Column,
              subject: Column, date: Column, message_id: Column, original_file: Column,
              order: Sequence[str], search_pattern: str, privileged_pattern: str,
              min_id_len: int = 6, keep: Sequence[str] = ()) -> DataFrame:
    """F3 + F4 + W7 + W6 + K5 columns.

    Hits are de-duplicated on Message-ID (ids of ``min_id_len`` chars or
    fewer never de-duplicate), numbered 1..n in scan ``order`` and split into
    privileged / regular by a case-sensitive search on To, From or Cc.  ``keep`` names columns of
    ``df`` that the result has as well, such as the raw text for ``write_discovery``.
    """
    hits = search_hits(df, raw, search_pattern)
    cols = hits.select(
        *[F.col(c) for c in order if c != "query"],
        F.col("query"),
        to.alias("_to"), cc.alias("_cc"), from_.alias("_from"), subject.alias("_subject"),
        date.alias("_date"), message_id.alias("_mid"), line_count(F.col(raw)).cast("long").alias("_lines"),
        original_file.alias("_file"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    # The hits are a (small, narrow) subset of the mail: checkpoint them once so
    # the de-dup branches and the numbering do not re-run the text search.
    ensure_checkpoint_dir(df.sparkSession)
    cols = cols.checkpoint(eager=True)
    kept = dedup_keep_first(cols, "_mid", list(order), min_id_len)
    numbered = global_row_number(kept, list(order), name="snum")
    priv = any_header_matches([F.col("_to"), F.col("_from"), F.col("_cc")], privileged_pattern)
    return numbered.select(
        F.col("snum"), F.col("query"),
        ellipsis(F.col("_to")).alias("to"), ellipsis(F.col("_cc")).alias("cc"),
        F.col("_from").alias("from"), F.col("_subject").alias("subject"),
        F.col("_date").alias("date"), F.col("_mid").alias("message_id"),
        F.col("_lines").alias("lines"), F.col("_file").alias("original_file"),
        priv.alias("privileged"), *[F.col(f"_keep_{c}").alias(c) for c in keep])


def report_frame(hits: DataFrame) -> DataFrame:
    """K5: the report's ten columns under the reference's header names."""
    names = dict(zip(["snum", "query", "to", "cc", "from", "subject", "date", "message_id",
                      "lines", "original_file"], REPORT_COLUMNS))
    return hits.select(*[F.col(k).alias(v) for k, v in names.items()])
