"""Mailbox -> stored star schema.

Text mailboxes cannot push filters down, so they are converted once:
read (splittable) -> parse (projection only) -> dense message ids in file
order -> dimensions -> Parquet tables.  The fact table is partitioned by
send month so later date filters prune whole folders of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maillake.plans.sequential import global_row_number
from maillake.session import ensure_checkpoint_dir
from maillake.sources import mailbox, messages


#: Splits up to which their offsets are broadcast to the rows (about 100 bytes each).
MAX_BROADCAST_SPLITS = mailbox.MAX_BROADCAST_FILES


def numbered_by_split(raw: DataFrame, name: str = "rowid") -> DataFrame:
    """Dense numbers 1..N in file order, without moving a row.

    Rows are in order inside their split already.  A first pass over the record numbers
    counts each (path, split) and notes its first row's position in the task; the running
    total over the splits, one row each, gives every row its number by a broadcast join.
    File splits are planned alike in both passes (same files, same settings).  Mail with
    more splits than ``MAX_BROADCAST_SPLITS`` (one file per message, mostly) is numbered by
    a range sort of its keys instead.
    """
    at = raw.withColumn("_at", F.monotonically_increasing_id())
    splits = at.groupBy("path", "file_block_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")).checkpoint()
    if splits.count() > MAX_BROADCAST_SPLITS:
        return global_row_number(raw, ["path", "file_block_start", "seq"], name=name)
    before = Window.orderBy("path", "file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(F.col("path").alias("_path"), F.col("file_block_start").alias("_block"), "_first",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = at.join(F.broadcast(offsets), (F.col("path") == F.col("_path")) & (F.col("file_block_start") == F.col("_block")))
    return joined.withColumn(name, F.col("_offset") + F.col("_at") - F.col("_first") + 1).drop("_at", "_path", "_block", "_first", "_offset")


def parsed_mailbox(spark: SparkSession, path: str, fmt: str = "mbox") -> DataFrame:
    """Parsed messages with dense ids in file order; the numbers are given to the raw records, before parsing."""
    ensure_checkpoint_dir(spark)
    raw = numbered_by_split(mailbox.read_mail(spark, path, fmt))
    return messages.parse_messages(raw, fmt)


MONTH_PARTS = 16        # tasks that write one month


def ingest_mailbox(spark: SparkSession, path: str, root: str, fmt: str = "mbox",
                   zap: bool = False) -> dict[str, DataFrame]:
    """Write messages / subjects / addresses / recipients / message_text under ``root``."""
    msgs = parsed_mailbox(spark, path, fmt)
    star = messages.star_schema(msgs)
    fact = (star["messages"]
            .join(msgs.select("rowid", "message_id", "in_reply_to", "bytes", "imap_flags",
                              "tz_offset_min"), "rowid")
            .withColumn("sent_month", F.coalesce(F.date_format("date_sent", "yyyy-MM"), F.lit("unknown"))))
    text = msgs.select(F.col("rowid").alias("message_rowid"), F.col("body").alias("full_text"))
    mode = "overwrite" if zap else "errorifexists"
    base = root.rstrip("/")
    # a month's rows go to a few tasks, not a file of every task to every month
    fact = fact.repartition("sent_month", F.pmod("rowid", F.lit(MONTH_PARTS)))
    fact.write.mode(mode).partitionBy("sent_month").parquet(f"{base}/messages")
    for name in ("subjects", "addresses", "recipients"):
        star[name].write.mode(mode).parquet(f"{base}/{name}")
    text.write.mode(mode).parquet(f"{base}/message_text")
    return {t: spark.read.parquet(f"{base}/{t}")
            for t in ("messages", "subjects", "addresses", "recipients", "message_text")}
