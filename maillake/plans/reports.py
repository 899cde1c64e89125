"""Titled SQL reports and listing lines.

A report is ``(title, SQL text)``; the SQL runs on temporary views of the
mail tables through ``spark.sql`` (so Catalyst plans it like any query) and
the results come back as DataFrames keyed by title, never as driver rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The reference's report list: (title, SQL) over the flat message table.
DEFAULT_REPORTS = [
    ("Top senders", "SELECT sender_email AS key, count(*) AS n FROM ml_flat "
                    "GROUP BY sender_email ORDER BY n DESC, key DESC LIMIT 10"),
    ("Top subjects", "SELECT subject AS key, count(*) AS n FROM ml_flat "
                     "GROUP BY subject ORDER BY n DESC, key DESC LIMIT 10"),
]
TOTAL_SQL = "SELECT count(*) AS n FROM ml_flat"


def register_views(views: Mapping[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def titled(spark: SparkSession, reports: Sequence[tuple[str, str]]) -> dict[str, DataFrame]:
    """Title -> DataFrame of its SQL."""
    return {title: spark.sql(sql) for title, sql in reports}


def select_one(spark: SparkSession, sql: str, args: Mapping | None = None):
    """First column of the first row (a single bounded value), or None."""
    row = spark.sql(sql, args=dict(args or {})).first()
    return None if row is None else row[0]


def as_long_table(results: Mapping[str, DataFrame]) -> DataFrame:
    """K6 shape: (title, key, n) rows of all reports."""
    out = None
    for title, df in results.items():
        part = df.select(F.lit(title).alias("title"), F.col("key").cast("string").alias("key"),
                         F.col("n").cast("long").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def run_titled(v) -> DataFrame:
    """The registered report query: flat view, report list, plus the X6 total row."""
    a = v.addresses.select(F.col("rowid").alias("sender"), F.col("address").alias("sender_email"))
    flat = v.messages.select("rowid", "sender", "subject").join(a, "sender", "left")
    import uuid
    spark = v.spark
    # A view name of our own, so a user's views (or a concurrent call) are untouched.
    view = f"ml_flat_{uuid.uuid4().hex[:12]}"
    register_views({view: flat})
    res = titled(spark, [(t, sql.replace("ml_flat", view)) for t, sql in DEFAULT_REPORTS])
    total = select_one(spark, TOTAL_SQL.replace("ml_flat", view))
    long = as_long_table(res)
    tot = spark.range(1).select(F.lit("Total").alias("title"), F.lit(None).cast("string").alias("key"),
                                F.lit(total).cast("long").alias("n"))
    return long.unionByName(tot)


def summary_line(index: Column, sender: Column, date: Column, subject: Column) -> Column:
    """``%2s`` index, sender cut/padded to 25 - len(index), ``MM/DD/YYYY HH:MM``,
    subject cut/padded to 35, single spaces between."""
    idx = F.when(F.length(index) < 2, F.lpad(index, 2, " ")).otherwise(index)
    width = F.lit(25) - F.length(idx)
    frm = F.rpad(F.substring(sender, F.lit(1), width), width, F.lit(" "))
    when = F.coalesce(F.date_format(date, "MM/dd/yyyy HH:mm"), F.lit("No date         "))
    subj = F.rpad(F.substring(subject, 1, 35), 35, " ")
    return F.concat_ws(" ", idx, frm, when, subj)
