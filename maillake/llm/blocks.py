"""Rows of a task in blocks that each begin with a header row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(headers: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Headers (``order`` below 0) and rows, each block of ``key`` in one task, header first, its rows in any order.

    Columns that only one side has are null on the other; they must not be lists (Spark measures every Arrow batch row by
    row, and a list column walks all its nulls each time): a list travels as JSON.  Blocks are bounded by their makers.  Rows are sorted by one
    whole number, a hash of the key with the header's mark as its last bit: such a sort compares no rows.  Two blocks of
    a task share a hash with odds of n^2 / 2^64 for n blocks; ``in_blocks`` raises an error then.
    """
    mark = F.when(F.col(order) < 0, F.lit(0)).otherwise(F.lit(1)).cast("long")
    return (headers.unionByName(rows, allowMissingColumns=True).repartition(*key)
            .sortWithinPartitions(F.xxhash64(*key).bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(mark)))


def in_blocks(batches, key: list[str], order: str) -> Iterator[pa.Table]:
    """The blocks of sorted batches; rows with ``order`` below 0 begin a block, the others follow in ``order``."""
    def block(parts: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(parts).combine_chunks()
        for c in key:
            if len(table[c].unique()) != 1:
                raise RuntimeError(f"two blocks have one hash: {table[c].unique()}")
        at = table[order].to_numpy()
        return table if (np.diff(at) >= 0).all() else table.take(np.argsort(at, kind="stable")).combine_chunks()

    pending: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        for mark in np.flatnonzero(batch.column(batch.schema.get_field_index(order)).to_numpy() < 0):
            if mark > at:
                pending.append(batch.slice(at, mark - at))
            if pending:
                yield block(pending)
            pending, at = [], mark
        if batch.num_rows > at:
            pending.append(batch.slice(at))
    if pending:
        yield block(pending)
