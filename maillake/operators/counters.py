"""Mailbox counters as the store's triggers keep them (steady state).

SURVEY A11, A12, J10, J11, J12.  The triggers update counts one message at
a time; here the same numbers come from one grouped aggregate over folder
membership.  J11's OR join (base folder OR label folder) is written as a
UNION of two equi-joins so that both halves are hash/sort-merge joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maillake.functions.predicates import is_deleted, is_seen, is_unread


def membership(messages: DataFrame, mailboxes: DataFrame, labels: DataFrame) -> DataFrame:
    """(mailbox_id, message columns) for each folder a message counts in.

    Base: mailboxes.rowid = m.mailbox and the folder has no source.
    Label: a label row (message, label folder) whose folder's source = m.mailbox.
    """
    m = messages.select("rowid", "message_id", "flags", "mailbox")
    base_ids = mailboxes.filter(F.col("source").isNull()).select(F.col("rowid").alias("mailbox"))
    base = (m.join(base_ids, "mailbox", "left_semi")
            .select(F.col("mailbox").alias("mailbox_id"), "rowid", "message_id", "flags"))
    lab_dirs = mailboxes.filter(F.col("source").isNotNull()).select(
        F.col("rowid").alias("mailbox_id"), F.col("source").alias("mailbox"))
    lab = (labels.select(F.col("message_rowid").alias("rowid"), "mailbox_id")
           .join(lab_dirs, "mailbox_id")
           .join(m, ["rowid", "mailbox"])
           .select("mailbox_id", "rowid", "message_id", "flags"))
    return base.unionByName(lab)


def mailbox_counters(messages: DataFrame, mailboxes: DataFrame, labels: DataFrame) -> DataFrame:
    """Total / unseen / deleted / unread per folder."""
    mem = membership(messages, mailboxes, labels)
    f = F.col("flags")
    return mem.groupBy("mailbox_id").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(~is_seen(f)).alias("unseen_count"),
        F.count_if(is_deleted(f)).alias("deleted_count"),
        F.count_if(is_unread(f)).alias("unread_count"))


def unread_adjusted(messages: DataFrame, mailboxes: DataFrame, labels: DataFrame) -> DataFrame:
    """Unread count where each non-NULL Message-ID counts once per folder.

    Two-level aggregation: (folder, id) first -- map-side combined, so a hot
    id costs one partial row per task -- then per folder.
    """
    mem = membership(messages, mailboxes, labels).filter(is_unread(F.col("flags")))
    per_id = mem.groupBy("mailbox_id", "message_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_id.groupBy("mailbox_id").agg(
        F.sum("_n").cast("long").alias("unread_count"),
        (F.count_if(F.col("message_id").isNotNull())
         + F.coalesce(F.sum(F.when(F.col("message_id").isNull(), F.col("_n"))), F.lit(0)))
        .cast("long").alias("unread_count_adjusted_for_duplicates"))


def orphan_subjects(subjects: DataFrame, messages: DataFrame) -> DataFrame:
    """Subject rows no message refers to."""
    used = messages.select(F.col("subject_id").alias("rowid"))
    return subjects.join(used, "rowid", "left_anti")


def orphan_addresses(addresses: DataFrame, messages: DataFrame,
                     recipients: DataFrame) -> DataFrame:
    """Addresses that are neither a sender nor a recipient (two anti joins)."""
    senders = messages.select(F.col("sender").alias("rowid"))
    rcpts = recipients.select(F.col("address_id").alias("rowid"))
    return addresses.join(senders, "rowid", "left_anti").join(rcpts, "rowid", "left_anti")


def fix_dangling(messages: DataFrame, col: str = "fuzzy_ancestor") -> DataFrame:
    """A thread ancestor that names no stored message becomes -1."""
    have = messages.select(F.col("rowid").alias("_anc"), F.lit(True).alias("_ok"))
    j = messages.join(have, messages[col] == have["_anc"], "left")
    return (j.withColumn(col, F.when(F.col(col).isNull() | F.col("_ok"), F.col(col)).otherwise(F.lit(-1)))
            .drop("_anc", "_ok"))


def cascade_delete(child: DataFrame, deleted_ids: DataFrame,
                   child_key: str = "message_rowid") -> DataFrame:
    """Child rows that survive deleting the given message ids (ON DELETE CASCADE)."""
    d = deleted_ids.select(F.col("rowid").alias(child_key))
    return child.join(d, child_key, "left_anti")
