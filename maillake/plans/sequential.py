"""Order-dependent computations without one-partition windows.

``Window.partitionBy(g).orderBy(o)`` sends every row of a group to one task;
when one folder or document holds a third of the data that task holds a
third of the data.  These helpers range-partition on ``(group, order)`` so
a hot group is spread over many partitions, do the scan inside each
partition, and then fix up the partition boundaries with a carry table that
has at most two rows per partition (a proven size bound, so it is
broadcast).

* ``global_row_number``: 1..N in a total order (W6 serial numbers, W11).
* ``running_sum``: per-group running total in order (W4 running counts).
* ``carry_forward``: per-group last non-null value in order (W5 pages).

The ranged rows are checkpointed once (see ``_ranged``) so every branch
sees the same partition contents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maillake.session import ensure_checkpoint_dir

_PID = "_seq_pid"
_MID = "_seq_mid"


def _cols(cs: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def _ranged(df: DataFrame, order: Sequence[str | Column], num_partitions: int | None,
            with_mid: bool = False) -> DataFrame:
    """Range-partition, sort, tag rows with their partition id, and checkpoint.

    Column pruning can give the plan's branches different range exchanges
    (each samples its own bounds), so partition ids would not agree between
    them.  A reliable checkpoint (in the cluster's ``spark.checkpoint.dir``)
    pins the assignment once; it also cuts the lineage, so a lost executor
    re-reads the checkpoint instead of re-running the upstream joins.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # The range exchange reads its input twice (bound sampling, then the
    # shuffle); persisting the input computes it once.  A lost cached block
    # is recomputed from the lineage, so this is safe on executor loss.
    mine = not df.is_cached            # never drop a cache the caller made
    src = df.persist(StorageLevel.MEMORY_AND_DISK) if mine else df
    # Without an explicit count the range exchange uses the session's
    # partition count and AQE coalesces adjacent ranges to its advisory size
    # (order is kept: only neighbouring ranges merge).  The partition id is
    # read after that, and the checkpoint pins it.
    ranged = (src.repartitionByRange(num_partitions, *_cols(order)) if num_partitions
              else src.repartitionByRange(*_cols(order)))
    r = (ranged
         .sortWithinPartitions(*_cols(order))
         .withColumn(_PID, F.spark_partition_id()))
    if with_mid:
        r = r.withColumn(_MID, F.monotonically_increasing_id())
    out = r.checkpoint(eager=True)
    if mine:
        src.unpersist()
    return out


def global_row_number(df: DataFrame, order: Sequence[str | Column], name: str = "row_no",
                      num_partitions: int | None = None) -> DataFrame:
    """Dense 1..N numbering in ``order`` (ties broken arbitrarily but consistently).

    Per partition: local index from monotonically_increasing_id (it counts
    up inside a partition); offset = rows in all earlier partitions, from a
    table with one row per partition.
    """
    r = _ranged(df, order, num_partitions, with_mid=True)
    local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    counts = r.groupBy(_PID).agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PID, F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    out = r.join(F.broadcast(offsets), _PID, "inner")
    return out.withColumn(name, F.col("_off") + local + F.lit(1)).drop(_PID, _MID, "_off")


def _boundary_groups(per_part: DataFrame, group: Sequence[str]) -> DataFrame:
    """(pid, group) rows of groups that span more than one partition (<= 2 per partition)."""
    spanning = (per_part.groupBy(*group).agg(F.count(F.lit(1)).alias("_parts"))
                .filter(F.col("_parts") > 1).drop("_parts"))
    return per_part.join(spanning, list(group), "left_semi")


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
                value: str | Column, name: str = "running",
                num_partitions: int | None = None) -> DataFrame:
    """Per-group running total of ``value`` in ``order`` (rows up to and including the current)."""
    v = F.col(value) if isinstance(value, str) else value
    r = _ranged(df, [*group, *order], num_partitions).withColumn("_v", v)
    w = (Window.partitionBy(_PID, *group).orderBy(*_cols(order))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = r.withColumn("_local", F.sum("_v").over(w))
    per_part = r.groupBy(_PID, *group).agg(F.sum("_v").alias("_tot"))
    edges = _boundary_groups(per_part, group)
    cw = Window.partitionBy(*group).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select(_PID, *group, F.sum("_tot").over(cw).alias("_carry"))
    out = local.join(F.broadcast(carry), [_PID, *group], "left")
    return (out.withColumn(name, F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0)))
            .drop(_PID, "_v", "_local", "_carry"))


def carry_forward(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
                  value: str | Column, name: str = "carried",
                  num_partitions: int | None = None) -> DataFrame:
    """Per group, the last non-null ``value`` at or before each row in ``order``."""
    v = F.col(value) if isinstance(value, str) else value
    order_cols = _cols(order)
    r = _ranged(df, [*group, *order], num_partitions).withColumn("_v", v)
    w = (Window.partitionBy(_PID, *group).orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = r.withColumn("_local", F.last("_v", ignorenulls=True).over(w))
    okey = F.struct(*order_cols)
    per_part = (r.groupBy(_PID, *group)
                .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), okey)).alias("_last")))
    edges = _boundary_groups(per_part, group)
    cw = Window.partitionBy(*group).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select(_PID, *group, F.last("_last", ignorenulls=True).over(cw).alias("_carry"))
    out = local.join(F.broadcast(carry), [_PID, *group], "left")
    return (out.withColumn(name, F.coalesce(F.col("_local"), F.col("_carry")))
            .drop(_PID, "_v", "_local", "_carry"))
