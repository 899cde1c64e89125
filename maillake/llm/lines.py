"""Line de-duplication by site-relative frequency, in DataFrame functions only.

A line is boilerplate of its host if the share of the host's pages that contain it exceeds
a ratio (and it stands on a least number of pages, so that a host of two copies loses
nothing).  Boilerplate lines are dropped from every page of that host.

Scale: a page's distinct lines become 8-byte hashes before anything is shuffled, and
counts are combined map-side, so a hot host or line is only many partial counts.  A host's
boilerplate list is bounded: with ratio r it holds fewer than (mean distinct lines a page) / r
lines.  All hosts' lists together are broadcast only if their counted lines stay under
``BROADCAST_LINES``; beyond that the pages meet them in a shuffled join on the host, whose
hot partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maillake.llm.common import free_names
from maillake.session import ensure_checkpoint_dir

RATIO = 0.1
MIN_PAGES = 5
BROADCAST_LINES = 200_000       # 8 bytes each, and the hosts' names

BLANKS = " \t\r"


def line_keys(text: Column) -> Column:
    """Hashes of the lines of a text; null for blank ones.  Blanks at a line's ends do not count."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x, F.lit(BLANKS)) != "", F.xxhash64(F.trim(x, F.lit(BLANKS)))))


def boilerplate(df: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, key, pages, host_pages`` of every boilerplate line; a null host is a host of its own."""
    pages = (df.select(host.alias("host"), F.explode(F.array_distinct(F.array_compact(line_keys(text)))).alias("key"))
             .groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages))
    totals = df.groupBy(host.alias("total_host")).agg(F.count(F.lit(1)).alias("host_pages"))
    return (pages.join(totals, F.col("host").eqNullSafe(F.col("total_host")))
            .filter(F.col("pages") > F.lit(ratio) * F.col("host_pages"))
            .select("host", "key", "pages", "host_pages"))


def drop_boilerplate(df: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, kept_col: str | None = None,
                     counts: tuple[str, str] | None = None) -> DataFrame:
    """The rows of ``df`` without the boilerplate lines of their host.

    The shortened text replaces ``text_col``, or goes to ``kept_col``; ``counts`` names two
    more columns, the lines of the text and those dropped.  Blank lines are never dropped.
    A text that loses nothing is returned as it was, a null text stays null (0 lines), an
    empty one empty; rows with null hosts form one host; repeated rows count as pages of
    their own.  Other columns keep their names and values, whatever they are.
    """
    ensure_checkpoint_dir(df.sparkSession)
    found = boilerplate(df, host, F.col(text_col), ratio, min_pages).select("host", "key").checkpoint()
    small = found.count() <= BROADCAST_LINES
    host_name, own, keys, bad = free_names(df, "__host", "__own", "__keys", "__bad")
    lists = found.groupBy(F.col("host").alias(host_name)).agg(F.collect_list("key").alias(keys))
    joined = df.withColumn(own, host).join(F.broadcast(lists) if small else lists, F.col(own).eqNullSafe(F.col(host_name)), "left")
    text = F.col(text_col)
    joined = joined.withColumn(bad, F.when(F.col(keys).isNotNull() & text.isNotNull(),
                                           F.array_intersect(line_keys(text), F.col(keys))))
    hit = F.coalesce(F.size(bad) > 0, F.lit(False))
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: (F.trim(x, F.lit(BLANKS)) == "") | ~F.array_contains(F.col(bad), F.xxhash64(F.trim(x, F.lit(BLANKS)))))
    out = {kept_col or text_col: F.when(hit, F.array_join(kept, "\n")).otherwise(text)}
    if counts:
        out[counts[0]] = F.coalesce(F.when(text.isNotNull(), F.size(lines)), F.lit(0)).cast("long")
        out[counts[1]] = F.when(hit, F.size(lines) - F.size(kept)).otherwise(0).cast("long")
    return joined.withColumns(out).drop(own, host_name, keys, bad)
