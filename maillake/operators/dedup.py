"""Duplicate handling: keep newest (W3), running duplicate count (W4),
keep first with the length rule (W7), and not-yet-copied (U6).

Skew: a Message-ID shared by a third of all mail must not land in one
window partition.  The "first/newest per key" questions are answered with
an aggregate (partial, map-side combined) joined back on the key -- AQE's
skew-join split handles a hot key on the big side -- instead of
``row_number`` over the key.  The running count uses the range-partitioned
scan of ``maillake.plans.sequential``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maillake.functions.predicates import is_deleted
from maillake.plans.sequential import running_sum


def dedup_keep_newest(messages: DataFrame, folder: str = "mailbox", key: str = "message_id",
                      seq: str = "rowid", flags: str = "flags") -> DataFrame:
    """Within a folder, newest first; every later (older) copy of an id is a duplicate.

    Deleted mail and mail without an id are skipped, as the reference does.
    Returns the duplicate rows (the ones that get the deleted flag).
    """
    live = messages.filter(~is_deleted(F.col(flags)) & F.col(key).isNotNull())
    newest = live.groupBy(folder, key).agg(F.max(seq).alias("_keep"))
    return (live.join(newest, [folder, key])
            .filter(F.col(seq) < F.col("_keep"))
            .select(folder, key, seq))


def dup_running(messages: DataFrame, folder: str = "mailbox", key: str = "message_id",
                seq: str = "rowid") -> DataFrame:
    """In sequence order, each message is a duplicate if an earlier one had its id;
    ``seen_count`` is the running number of duplicates so far in the folder.

    A missing id counts as an id (the reference puts None in its seen set).
    """
    m = messages.select(folder, key, seq)
    first = (m.groupBy(folder, key).agg(F.min(seq).alias("_first"))
             .withColumnRenamed(folder, "_f").withColumnRenamed(key, "_k"))
    cond = (F.col(folder) == F.col("_f")) & F.col(key).eqNullSafe(F.col("_k"))
    flagged = (m.join(first, cond, "inner")
               .select(folder, key, seq, (F.col(seq) > F.col("_first")).alias("is_dup")))
    return running_sum(flagged, [folder], [seq], F.col("is_dup").cast("long"),
                       name="seen_count")


def dedup_keep_first(df: DataFrame, key: str, order: list[str], min_len: int = 6) -> DataFrame:
    """Rows whose id is longer than ``min_len`` keep only the first copy in ``order``;
    shorter or missing ids are never de-duplicated."""
    long_id = F.coalesce(F.length(F.col(key)) > min_len, F.lit(False))
    keyed = df.filter(long_id)
    rest = df.filter(~long_id)
    okey = F.struct(*[F.col(c) for c in order])
    firsts = keyed.groupBy(key).agg(F.min(okey).alias("_first"))
    kept = (keyed.join(firsts, key)
            .filter(F.struct(*[F.col(c) for c in order]) == F.col("_first"))
            .drop("_first"))
    return kept.unionByName(rest)


def not_yet_copied(source: DataFrame, held: DataFrame, key: str = "message_id",
                   raw_hash: str = "raw_hash") -> DataFrame:
    """Source messages whose (id, content hash) the archive does not hold yet.

    The hash is part of the key because one id may name two different messages.
    """
    cond = (source[key].eqNullSafe(held[key])) & (source[raw_hash] == held[raw_hash])
    return source.join(held, cond, "left_anti")
