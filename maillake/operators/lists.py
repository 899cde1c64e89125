"""Address lists and replacement lists as joins.

A list file is a table ``(line_no, entry)`` (or ``(line_no, original,
replacement)``).  Containment "some entry is a substring of the value" is a
theta condition; instead of a nested-loop join it runs as an exact q-gram
equi-join: every entry is keyed by one of its q-grams (the one rarest among
the entries), every value is exploded to all its q-grams, the equi-join
yields candidates, and ``instr`` verifies them.  q depends on the entry's length (``GRAMS``), so
a short entry does not make the grams of long ones short.  Any occurrence of an entry
in a value contains that entry's key gram, so no match is lost; the list is
never collected, and AQE broadcasts the entry side when its runtime size is
small.  Regex lists (match at the start) are small configuration: their
size is checked before they are compiled into one expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAMS = (8, 4, 2, 1)       # lengths of key grams: an entry has the longest that is not beyond its own
REGEX_BATCH = 500          # patterns compiled into one expression


def read_list_file(spark: SparkSession, path: str) -> DataFrame:
    """One entry per line; blank lines dropped; ``line_no`` keeps file order."""
    # Line numbers only need to follow file order (first / last entry wins),
    # so no window is needed: split start x 10^10 + position inside the task, as
    # a decimal, which holds any file size.  Every split is numbered by its own
    # task, however long the list.
    pid = F.spark_partition_id().cast("long")
    local = F.monotonically_increasing_id() - F.shiftleft(pid, 33)
    raw = spark.read.text(path).select(
        "value", (F.col("_metadata.file_block_start").cast("decimal(20,0)") * F.lit(10 ** 10) + local).cast("decimal(38,0)").alias("line_no"))
    return (raw.select("line_no", F.trim(F.col("value")).alias("entry"))
            .filter(F.col("entry") != ""))


def read_replacement_file(spark: SparkSession, path: str) -> DataFrame:
    """``original :: replacement`` lines (split on the first ``::``)."""
    lines = read_list_file(spark, path).filter(F.col("entry").contains("::"))
    return lines.select("line_no",
                        F.trim(F.substring_index("entry", "::", 1)).alias("original"),
                        F.trim(F.expr("substr(entry, instr(entry, '::') + 2)")).alias("replacement"))


def _grams(col: str, q: Column) -> Column:
    """All grams of a length of a string; none if it is shorter."""
    c = F.col(col)
    return F.when(F.length(c) >= q, F.transform(F.sequence(F.lit(1), F.length(c) - q + 1), lambda p: F.substring(c, p, q))).otherwise(F.array().cast("array<string>"))


def _gram_length(entry: Column) -> Column:
    return F.coalesce(*[F.when(F.length(entry) >= q, F.lit(q)) for q in GRAMS])


def _key_grams(entries: DataFrame, entry: str) -> DataFrame:
    """One key gram per entry: the gram least frequent among all entries' grams."""
    grams = entries.select("*", F.posexplode(_grams(entry, _gram_length(F.col(entry)))).alias("_gpos", "_gram"))
    freq = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_gfreq"))
    ranked = grams.join(freq, "_gram")
    return ranked.groupBy(*entries.columns).agg(F.min_by("_gram", F.struct("_gfreq", "_gpos")).alias("_gram"))


def substring_matches(values: DataFrame, value_col: str, entries: DataFrame,
                      entry_col: str = "entry") -> DataFrame:
    """Pairs (value, entry row) where the entry occurs in the value, over distinct values.

    Output columns: ``value_col`` + the entries' columns.  Callers join the
    per-value result back on the value text (an equi-join; AQE splits a hot
    value).  Values are read once, for the grams of all lengths that the entries have.
    """
    e = entries.filter(F.col(entry_col).isNotNull() & (F.length(entry_col) > 0))
    used = e.agg(F.collect_set(_gram_length(F.col(entry_col)))).first()[0]      # four lengths at most
    dv = values.select(value_col).filter(F.col(value_col).isNotNull()).distinct()
    if not used:
        return dv.join(e, F.lit(False), "inner")
    every = F.array_distinct(F.concat(*[_grams(value_col, F.lit(q)) for q in sorted(used)]))
    cand = dv.select(value_col, F.explode(every).alias("_gram")).join(_key_grams(e, entry_col), "_gram").drop("_gram")
    return cand.filter(F.instr(F.col(value_col), F.col(entry_col)) > 0)


def list_contains(values: DataFrame, value_col: str, entries: DataFrame,
                  out: str = "listed", entry_col: str = "entry") -> DataFrame:
    """flag = some entry is a substring of the value (NULL value -> false)."""
    hits = (substring_matches(values, value_col, entries.select(entry_col), entry_col)
            .select(value_col).distinct().withColumn(out, F.lit(True)))
    return (values.join(hits, value_col, "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(False))))


#: What a pattern may hold that reaches beyond it in a joined one: group numbers and names, flags, quoting.
_OWN_SCOPE = re.compile(r"\\[1-9kQE]|\(\?[a-zA-Z<-]")


def regex_list_expr(value: Column, patterns: list[str]) -> Column:
    """J8 regex mode: some pattern matches at the start of the value.  Lists of any length.

    Patterns are joined into few expressions; one with a back-reference, a named group, inline flags or quoting is
    matched by itself.
    """
    alone = [p for p in patterns if _OWN_SCOPE.search(p)]
    joined = [p for p in patterns if not _OWN_SCOPE.search(p)]
    hit = F.lit(False)
    for i in range(0, len(joined), REGEX_BATCH):
        hit = hit | value.rlike("^(?:" + "|".join(f"(?:{p})" for p in joined[i:i + REGEX_BATCH]) + ")")
    for p in alone:
        hit = hit | value.rlike(f"^(?:{p})")
    return F.coalesce(hit, F.lit(False))


def regex_first_match(value: Column, patterns: list[str]) -> Column:
    """Index (0-based, file order) of the first pattern matching at the start, else NULL."""
    if not patterns:
        return F.lit(None).cast("int")
    return F.coalesce(*[F.when(value.rlike("^(?:" + p + ")"), F.lit(i)) for i, p in enumerate(patterns)])


def replace_lookup(values: DataFrame, value_col: str, repl: DataFrame, partial: bool = True,
                   out: str = "replaced") -> DataFrame:
    """Exact hit (a repeated original: the last line wins), else -- with ``partial`` --
    the first line (file order) whose original occurs in the value, else the value."""
    exact = (repl.groupBy("original").agg(F.max_by("replacement", "line_no").alias("_exact"))
             .withColumnRenamed("original", value_col))
    r = values.join(exact, value_col, "left")
    if partial:
        hits = (substring_matches(values, value_col,
                                  repl.select("line_no", "original", "replacement"), "original")
                .groupBy(value_col).agg(F.min_by("replacement", "line_no").alias("_partial")))
        r = r.join(hits, value_col, "left")
    else:
        r = r.withColumn("_partial", F.lit(None).cast("string"))
    return (r.withColumn(out, F.when(F.col(value_col).isNull(), F.lit(None))
                         .otherwise(F.coalesce("_exact", "_partial", value_col)))
            .drop("_exact", "_partial"))


def regex_replace_lookup(values: DataFrame, value_col: str, originals: list[str],
                         replacements: list[str], out: str = "replaced") -> DataFrame:
    """J9 regex mode: the first pattern (file order) matching at the start gives the replacement."""
    idx = regex_first_match(F.col(value_col), originals)
    rep = F.element_at(F.array(*[F.lit(r) for r in replacements]), idx + 1) if replacements \
        else F.lit(None)
    return values.withColumn(out, F.when(idx.isNull(), F.col(value_col)).otherwise(rep))
