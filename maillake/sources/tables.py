"""Table and CSV sources.  Fixed schemas, no inference;
column subsets are pruned at the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STAR_TABLES = ["messages", "subjects", "addresses", "recipients", "mailboxes", "labels", "threads",
               "attachments", "message_text", "keywords", "message_keywords"]

GEOTAG_SCHEMA = "`Date Created` string, Latitude string, Longitude string, Path string"
ADDRESSEE_SCHEMA = "first string, last string, email string"
DAY_HOUR_SCHEMA = "Day string, Time string, Result long"


def read_store(spark: SparkSession, root: str, tables: Sequence[str] = STAR_TABLES) -> dict[str, DataFrame]:
    """The star-schema tables written by ``sinks.writers.write_star`` (those present)."""
    out = {}
    for t in tables:
        path = f"{root.rstrip('/')}/{t}"
        try:
            out[t] = spark.read.parquet(path)
        except AnalysisException as e:        # a store need not have every table; any other error is one
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return out


def read_jdbc_table(spark: SparkSession, url: str, table: str, **props) -> DataFrame:
    """S8 over a database: needs the JDBC driver jar on the cluster's class path."""
    return spark.read.jdbc(url, table, properties=dict(props))


def read_address_books(spark: SparkSession, pattern: str, fmt: str = "parquet"
                       ) -> list[tuple[DataFrame, DataFrame]]:
    """Every book matching ``pattern`` (one folder per book holding its
    ``records`` (pk, first, last) and ``emails`` (address, owner, seq) tables),
    in sorted path order; feed them to ``contacts.book_emails`` with their ordinal."""
    books = []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    for root in sorted(x.getPath().toString() for x in found or ()):
        rec = spark.read.format(fmt).load(f"{root}/records")
        em = spark.read.format(fmt).load(f"{root}/emails")
        books.append((rec, em))
    return books


def read_all_books(spark: SparkSession, pattern: str) -> DataFrame:
    """S9 + J4: the entries of every Parquet book matching ``pattern``, in two reads whatever their number.

    The columns are those of ``contacts.book_emails``; a book's number is its place among the folders in path order.
    """
    def read(table: str) -> DataFrame:
        df = spark.read.parquet(f"{pattern.rstrip('/')}/{table}")
        return df.withColumn("_root", F.regexp_replace("_metadata.file_path", f"/{table}/[^/]*$", ""))

    records, emails = read("records"), read("emails")
    books = records.select("_root").union(emails.select("_root")).distinct()        # a row a book
    books = books.withColumn("book", F.row_number().over(Window.orderBy("_root")) - 1)
    e = emails.select("_root", F.col("address").alias("email"), F.col("owner").alias("pk"), "seq")
    return (records.select("_root", "pk", "first", "last").join(e, ["_root", "pk"]).join(books, "_root")
            .select("first", "last", "email", F.struct("book", "pk", "seq").alias("ord")))


def read_geotags(spark: SparkSession, path: str) -> DataFrame:
    """The four used columns of a geotag CSV, as strings (checked later by P26)."""
    df = spark.read.option("header", True).schema(GEOTAG_SCHEMA).csv(path)
    return df.select(F.col("`Date Created`").alias("date_created"), F.col("Latitude").alias("latitude"),
                     F.col("Longitude").alias("longitude"), F.col("Path").alias("path"))


def read_addressees(spark: SparkSession, path: str) -> DataFrame:
    """``first,last,email`` lines (no header)."""
    return spark.read.schema(ADDRESSEE_SCHEMA).csv(path)


def read_day_hour_report(spark: SparkSession, path: str) -> DataFrame:
    """``Day, Time, Result`` with the day parsed to a date and its weekday."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True) \
        .schema(DAY_HOUR_SCHEMA).csv(path)
    day = F.coalesce(F.try_to_timestamp(F.col("Day"), F.lit("yyyy-MM-dd")),
                     F.try_to_timestamp(F.col("Day"), F.lit("M/d/yyyy")))
    return df.select(F.to_date(day).alias("day"), F.col("Time").alias("time"),
                     F.col("Result").alias("result"))


def read_page_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """``pages``, ``page_spans`` and ``page_links`` Parquet tables."""
    return {t: spark.read.parquet(f"{root.rstrip('/')}/{t}") for t in ("pages", "page_spans", "page_links")}


def read_tally(spark: SparkSession, path: str, name_col: str = "name", email_col: str = "email"
               ) -> DataFrame:
    """Tab-separated tally -> ``name <email>`` lines, and their two parts."""
    t = spark.read.option("sep", "\t").option("header", True).csv(path)
    return t.select(F.format_string("%s <%s>", F.col(name_col), F.col(email_col)).alias("line"), F.col(name_col).alias("name"), F.col(email_col).alias("email"))
