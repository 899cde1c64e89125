"""Star-schema load: dimensions, surrogate ids, fact table.

Surrogate ids are dense integers: existing dimension rows keep their ids,
new keys (``left_anti`` to the existing rows) get ``max(id) + 1 ...`` in key
order from the range-partitioned numbering, so a re-run over the same input
adds nothing (idempotent) and no 64-bit hash collision can merge two keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maillake.functions.text import normalized_subject
from maillake.plans.sequential import global_row_number


def build_dimension(values: DataFrame, keys: Sequence[str], existing: DataFrame | None = None,
                    id_col: str = "rowid") -> DataFrame:
    """U4: insert-if-new.  Returns the full dimension (existing rows + new rows)."""
    distinct = values.select(*keys).dropDuplicates(list(keys))
    if existing is None:
        numbered = global_row_number(distinct, list(keys), name="_n")
        return numbered.select(F.col("_n").alias(id_col), *keys)
    new = distinct.join(existing.select(*keys), list(keys), "left_anti")
    numbered = global_row_number(new, list(keys), name="_n")
    # The existing maximum is one number: read it once on the driver.
    top_id = existing.agg(F.max(id_col)).first()[0] or 0
    added = numbered.select((F.col("_n") + F.lit(top_id)).alias(id_col), *keys)
    return existing.select(id_col, *keys).unionByName(added)


def subjects_dimension(messages_flat: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    dim = build_dimension(messages_flat.filter(F.col("subject").isNotNull()), ["subject"],
                          None if existing is None else existing.select("rowid", "subject"))
    return dim.withColumn("normalized_subject", normalized_subject(F.col("subject")))


def addresses_dimension(emails: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Addresses keyed by (address, comment=''), as the loader inserts them."""
    vals = emails.filter(F.col("address").isNotNull()).withColumn("comment", F.lit(""))
    dim = build_dimension(vals, ["address", "comment"],
                          None if existing is None else existing.select("rowid", "address", "comment"))
    return dim


def star_load(messages_flat: DataFrame, subjects: DataFrame | None = None,
              addresses: DataFrame | None = None) -> dict[str, DataFrame]:
    """K2: flat (rowid, sender_email, subject, date_sent) -> subjects, addresses, messages.

    J16: the fact rows get the dimension ids by one equi-join per dimension.
    """
    subj = subjects_dimension(messages_flat, subjects)
    addr = addresses_dimension(messages_flat.select(F.col("sender_email").alias("address")), addresses)
    s = subj.select(F.col("rowid").alias("subject_id"), "subject")
    a = addr.select(F.col("rowid").alias("sender_id"), F.col("address").alias("sender_email"))
    fact = (messages_flat.join(s, "subject", "left").join(a, "sender_email", "left")
            .select("rowid", "sender_id", "subject_id", "date_sent"))
    return {"subjects": subj, "addresses": addr, "messages": fact}


def recipients_positions(message_rcpts: DataFrame, id_col: str = "message_rowid",
                         array_col: str = "rcpt") -> DataFrame:
    """One row per recipient with its position in the header (posexplode)."""
    return message_rcpts.select(id_col, F.posexplode(array_col).alias("position", "address"))


def message_keywords(pairs: DataFrame, keywords: DataFrame) -> DataFrame:
    """Distinct (keyword_id, message_rowid) pairs from (message_rowid, keyword) rows."""
    k = keywords.select(F.col("rowid").alias("keyword_id"), "keyword")
    return (pairs.join(k, "keyword").select("keyword_id", "message_rowid")
            .dropDuplicates(["keyword_id", "message_rowid"]))
