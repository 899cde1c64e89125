"""Report aggregates: top senders / recipients / flows, header counts, mail per day.

SURVEY A1-A4, A13, A14, J1-J3, F1, F2, W1, W2.  Every function takes and
returns DataFrames; counts are algebraic aggregates, so Spark combines them
map-side before the shuffle and a hot sender costs no more than a cold one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maillake.functions.predicates import is_deleted, is_me, within_days
from maillake.plans.sequential import global_row_number
from maillake.session import ensure_checkpoint_dir, shuffle_partitions

ROWS_A_TASK = 1 << 20           # recipients whose flows one task counts


def top_n(df: DataFrame, keys: Sequence[str], n: int, count_col: str = "n",
          reference_extra_row: bool = False) -> DataFrame:
    """Count per key, highest count first, ties broken by key descending.

    The reference prints one row more than asked (the break is tested after
    printing); ``reference_extra_row=True`` reproduces that.  ``limit`` after
    ``orderBy`` plans as TakeOrderedAndProject: each task keeps its own top n,
    only n rows per task reach the final merge.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
    order = [F.col(count_col).desc()] + [F.col(k).desc_nulls_last() for k in keys]
    return counted.orderBy(*order).limit(n + 1 if reference_extra_row else n)


def with_sender_address(messages: DataFrame, addresses: DataFrame,
                        name: str = "sender_email") -> DataFrame:
    """J1 (first half): messages left-joined to the address dimension."""
    a = addresses.select(F.col("rowid").alias("_aid"), F.col("address").alias(name))
    return messages.join(a, messages["sender"] == a["_aid"], "left").drop("_aid")


def top_senders(messages: DataFrame, addresses: DataFrame, n: int = 10) -> DataFrame:
    """A2: messages per sender address, top n.  A NULL sender is its own group."""
    m = messages.select("sender")
    # Aggregate on the id first (partial aggregation, narrow), then attach the
    # address to the n survivors only.
    by_id = m.groupBy("sender").agg(F.count(F.lit(1)).alias("n"))
    named = with_sender_address(by_id, addresses)
    return (named.select("sender_email", "n")
            .groupBy("sender_email").agg(F.sum("n").cast("long").alias("n"))
            .orderBy(F.col("n").desc(), F.col("sender_email").desc_nulls_last())
            .limit(n))


def recipient_addresses(recipients: DataFrame, addresses: DataFrame,
                        types: Sequence[int] = (0, 1)) -> DataFrame:
    """Recipients (To = 0, Cc = 1 by default) with their address text."""
    a = addresses.select(F.col("rowid").alias("_aid"), F.col("address").alias("rcpt_email"))
    r = recipients.filter(F.col("type").isin(list(types)))
    return r.join(a, r["address_id"] == a["_aid"], "left").drop("_aid")


def top_recipients(recipients: DataFrame, addresses: DataFrame, n: int = 10) -> DataFrame:
    """A2: messages per recipient address (To and Cc), top n."""
    by_id = (recipients.filter(F.col("type").isin(0, 1))
             .groupBy("address_id").agg(F.count(F.lit(1)).alias("n")))
    a = addresses.select(F.col("rowid").alias("address_id"), F.col("address").alias("rcpt_email"))
    return (by_id.join(a, "address_id", "left")
            .groupBy("rcpt_email").agg(F.sum("n").cast("long").alias("n"))
            .orderBy(F.col("n").desc(), F.col("rcpt_email").desc_nulls_last())
            .limit(n))


def _numbered_addresses(addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``rowid, no``, one row for each address row) and (``no, address``): every address text has one number, in the order of the texts."""
    a = addresses.select("rowid", "address").checkpoint()
    names = global_row_number(a.select("address").filter("address IS NOT NULL").distinct(), ["address"], name="no").checkpoint()
    return a.join(names, "address", "left").select("rowid", "no").checkpoint(), names


def _numbered_flows(messages: DataFrame, recipients: DataFrame, ids: DataFrame) -> DataFrame:
    """``src_no, dst_no, n``: flows by the numbers of their addresses (null: no address), so that no text is shuffled or grouped.

    The joins hash the smaller side and sort nothing.  Most flows have a message or two, so they are not combined
    before the shuffle; it has a part for every ``ROWS_A_TASK`` recipients, whatever the session's number.
    """
    parts = max(shuffle_partitions(messages.sparkSession), recipients.count() // ROWS_A_TASK + 1)
    ids = ids.hint("shuffle_hash")
    m = (messages.select(F.col("rowid").alias("message_rowid"), "sender")
         .join(ids.select(F.col("rowid").alias("sender"), F.col("no").alias("src_no")), "sender", "left").select("message_rowid", "src_no"))
    r = (recipients.filter(F.col("type").isin(0, 1)).select("message_rowid", "address_id")
         .join(ids.select(F.col("rowid").alias("address_id"), F.col("no").alias("dst_no")), "address_id", "left").select("message_rowid", "dst_no"))
    return (r.join(m.hint("shuffle_hash"), "message_rowid").select("src_no", "dst_no").repartition(parts, "src_no", "dst_no")
            .groupBy("src_no", "dst_no").agg(F.count(F.lit(1)).alias("n")))


def _with_names(numbered: DataFrame, names: DataFrame) -> DataFrame:
    src = names.select(F.col("no").alias("src_no"), F.col("address").alias("src"))
    dst = names.select(F.col("no").alias("dst_no"), F.col("address").alias("dst"))
    return (numbered.join(src, "src_no", "left").join(dst, "dst_no", "left")
            .select("src", "dst", "n"))


def flows(messages: DataFrame, recipients: DataFrame, addresses: DataFrame) -> DataFrame:
    """A3: (sender address, recipient address) -> message count.

    Counted by the numbers of the addresses, so that each flow is counted once and then meets its two texts.
    """
    ensure_checkpoint_dir(messages.sparkSession)
    ids, names = _numbered_addresses(addresses)
    return _with_names(_numbered_flows(messages, recipients, ids), names)


def top_flows(messages: DataFrame, recipients: DataFrame, addresses: DataFrame,
              n: int = 30) -> DataFrame:
    """A3 + W1: the first ``n`` flows; numbers sort as their texts do, so only these meet the texts."""
    ensure_checkpoint_dir(messages.sparkSession)
    ids, names = _numbered_addresses(addresses)
    first = (_numbered_flows(messages, recipients, ids)
             .orderBy(F.col("n").desc(), F.col("src_no").desc_nulls_last(), F.col("dst_no").desc_nulls_last()).limit(n))
    return (_with_names(first, names)
            .orderBy(F.col("n").desc(), F.col("src").desc_nulls_last(), F.col("dst").desc_nulls_last()))


def header_counts(messages: DataFrame, recipients: DataFrame, addresses: DataFrame) -> DataFrame:
    """A1: counts of From text, Subject text and To-or-Cc text (U2 = bag union).

    Long form ``(header, value, n)``.  Senders and recipients are counted by id, so only
    distinct ids meet the address text; ids with the same text are added up.
    """
    senders = messages.groupBy(F.col("sender").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("from").alias("header"), "id", "n")
    rcpts = (recipients.filter(F.col("type").isin(0, 1)).groupBy(F.col("address_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit("to_cc").alias("header"), "id", "n"))
    a = addresses.select(F.col("rowid").alias("id"), F.col("address").alias("value"))
    named = senders.unionByName(rcpts).join(a, "id", "left").groupBy("header", "value").agg(F.sum("n").alias("n"))
    subjects = messages.groupBy(F.col("subject").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return named.unionByName(subjects.select(F.lit("subject").alias("header"), "value", "n"))


def me_ids(addresses: DataFrame, me: Sequence[str], not_me: Sequence[str]) -> DataFrame:
    """rows of the address dimension that are "me"."""
    return addresses.filter(is_me(F.col("address"), me, not_me))


def messages_per_day(messages: DataFrame, addresses: DataFrame, me: Sequence[str],
                     not_me: Sequence[str], asof: str, days: int = 365) -> DataFrame:
    """A4: messages per day in the last ``days`` days that were not sent by me.

    J2 is ``sender NOT IN (me)``: the anti join drops NULL senders as NOT IN does.
    """
    mine = me_ids(addresses, me, not_me).select(F.col("rowid").alias("sender"))
    recent = messages.filter(within_days(F.col("date_sent"), asof, days)
                             & F.col("sender").isNotNull())
    return (recent.join(mine, "sender", "left_anti")
            .groupBy(F.to_date("date_sent").alias("date"))
            .agg(F.count(F.lit(1)).alias("n")))


def message_listing(messages: DataFrame, addresses: DataFrame, asof: str,
                    days: int = 365, n: int = 100) -> DataFrame:
    """J1 + W2: date, sender address and subject of recent mail, by date, first n.

    The reference orders by date only; rowid is added so ties are stable.  The first n are
    taken before they meet the addresses.
    """
    recent = messages.filter(within_days(F.col("date_sent"), asof, days))
    first = (recent.select("rowid", F.to_date("date_sent").alias("date"), "sender", "subject")
             .orderBy("date", "rowid").limit(n))
    return with_sender_address(first, addresses, "address").select("rowid", "date", "address", "subject").orderBy("date", "rowid")


def folder_status(messages: DataFrame) -> DataFrame:
    """Per folder message count, total size and highest sequence number."""
    return messages.groupBy("mailbox").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum("bytes").cast("long").alias("total_bytes"),
        F.max("rowid").alias("max_seq"))


def copy_totals(messages: DataFrame) -> DataFrame:
    """Per folder, messages copied (not deleted), expunged (deleted) and bytes copied."""
    d = is_deleted(F.col("flags"))
    return messages.groupBy("mailbox").agg(
        F.count_if(~d).alias("copied"),
        F.count_if(d).alias("expunged"),
        F.sum(F.when(~d, F.col("bytes")).otherwise(F.lit(0))).cast("long").alias("bytes_copied"))


def day_counts_with_holidays(day_counts: DataFrame, holidays: DataFrame) -> DataFrame:
    """Each holiday with its day's count; a day without mail counts 0.

    ``holidays(day date, name string)`` is a small list file (checked size).
    """
    return (holidays.join(day_counts.withColumnRenamed("date", "day"), "day", "left")
            .select("day", "name", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def count_col(c: str | Column = "*") -> Column:
    return F.count(F.lit(1)) if c == "*" else F.count(c)
