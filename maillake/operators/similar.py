"""Similar attachments by content-defined chunks.

Bytes are cut where a rolling hash of the last 48 bytes says so, so an insertion changes the chunks around it only.
Two attachments are similar if common chunks hold at least ``share`` of the bytes of the smaller one.

Equal contents are one node.  A node probes with its rarest chunks, as many as hold more than 1 - ``share`` of its
bytes: any node that is similar and not smaller has one of them.  Each probe first meets the largest holder of the
chunk only; where a chunk's holders are one group after that, no more is compared.  Only chunks whose holders still are
in several groups are probed pair by pair, across groups.  So a much copied file costs a row for each copy, and the
groups are those of all pairs.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maillake.operators.wishes import connected_components
from maillake.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need no copy of this module

WINDOW = 48                     # bytes under the rolling hash
AVERAGE = 1 << 10               # bytes of a chunk, about
SHARE = 0.7
_BASE = 0x9E3779B97F4A7C15 | 3


def cuts(data: bytes, average: int = AVERAGE) -> list[int]:
    """Ends of the chunks: a fourth of ``average`` bytes at least, four times at most, but for the last."""
    n, least, most = len(data), average // 4, average * 4
    marks = np.zeros(0, dtype=np.int64)
    if n > WINDOW:
        with np.errstate(over="ignore"):
            value = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64)
            power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE & (2 ** 64 - 1), dtype=np.uint64))])[:n]
            back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64))])[:n]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(value[np.frombuffer(data, np.uint8)] * power)])
            h = (sums[WINDOW:] - sums[:-WINDOW]) * back[:n - WINDOW + 1]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        marks = np.flatnonzero((h >> np.uint64(20)) % np.uint64(average) == 0) + WINDOW
    out, start = [], 0
    for end in [*marks.tolist(), n]:
        while end - start > most:
            start += most
            out.append(start)
        if end - start >= least or (end == n and end > start):
            out.append(end)
            start = end
    return out


def _chunk_rows(average: int):
    def run(batches):
        for batch in batches:
            ids, chunks, sizes = [], [], []
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen, start = {}, 0
                for end in cuts(content, average):
                    part = content[start:end]
                    seen[hashlib.blake2b(part, digest_size=16).digest()] = len(part)
                    start = end
                ids += [at] * len(seen)
                chunks += seen
                sizes += seen.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(chunks, pa.binary()), pa.array(sizes, pa.int64())],
                                             names=["node", "chunk", "size"])
    return run


def chunked(contents: DataFrame, average: int = AVERAGE) -> DataFrame:
    """``node, chunk, size``: the distinct chunks of each content (``node`` string, ``content`` binary)."""
    return contents.select("node", "content").mapInArrow(_chunk_rows(average), "node string, chunk binary, size long")


def _links(candidates: DataFrame, chunks: DataFrame, weights: DataFrame, share: float) -> DataFrame:
    """The candidate pairs (a, b) that are similar, by all their chunks."""
    common = (candidates.join(chunks.select(F.col("node").alias("a"), "chunk", "size"), "a")
              .join(chunks.select(F.col("node").alias("b"), "chunk"), ["b", "chunk"])
              .groupBy("a", "b").agg(F.sum("size").alias("common")))
    sized = (common.join(weights.select(F.col("node").alias("a"), F.col("weight").alias("wa")), "a")
             .join(weights.select(F.col("node").alias("b"), F.col("weight").alias("wb")), "b"))
    return sized.filter(F.col("common") >= share * F.least("wa", "wb")).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def similar_groups(attachments: DataFrame, id_col: str, content: str = "content", share: float = SHARE, average: int = AVERAGE) -> DataFrame:
    """``id_col, sha256, group``: attachments joined by links of similarity; ``group`` is the least digest of its contents.

    Null contents are left out; an empty one is similar to its equals only.
    """
    ensure_checkpoint_dir(attachments.sparkSession)
    named = attachments.filter(F.col(content).isNotNull()).select(F.col(id_col), F.sha2(F.col(content), 256).alias("sha256"), F.col(content).alias("content"))
    each = named.groupBy(F.col("sha256").alias("node")).agg(F.first("content").alias("content"))
    chunks = chunked(each, average).checkpoint()
    weights = chunks.groupBy("node").agg(F.sum("size").alias("weight")).checkpoint()
    holders = chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("holders"))
    shared = chunks.join(holders, "chunk").join(weights, "node")
    rarest = Window.partitionBy("node").orderBy("holders", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    probes = (shared.withColumn("_before", F.coalesce(F.sum("size").over(rarest), F.lit(0)))
              .filter(F.col("_before") <= (1 - share) * F.col("weight")).filter("holders > 1").select("chunk", F.col("node").alias("a"), "weight").checkpoint())
    wanted = probes.select("chunk").distinct()
    held = chunks.join(wanted, "chunk").join(weights, "node").select("chunk", F.col("node").alias("b"), F.col("weight").alias("wb")).checkpoint()

    largest = held.groupBy("chunk").agg(F.max(F.struct("wb", "b")).alias("_top")).select("chunk", "_top.b")
    first = probes.join(largest, "chunk").filter("a <> b").select("a", "b").distinct()
    links = _links(first, chunks, weights, share).checkpoint()
    label = connected_components(links).withColumnRenamed("node", "b")
    grouped = held.join(label, "b", "left").select("chunk", "b", "wb", F.coalesce("label", "b").alias("gb"))
    open_ = grouped.groupBy("chunk").agg(F.min("gb").alias("_lo"), F.max("gb").alias("_hi")).filter("_lo <> _hi").select("chunk")
    by_group = probes.join(open_, "chunk").join(label.withColumnRenamed("b", "a").withColumnRenamed("label", "ga"), "a", "left").withColumn("ga", F.coalesce("ga", "a"))
    others = grouped.join(open_, "chunk")
    second = (by_group.join(others, "chunk").filter((F.col("ga") != F.col("gb")) & (F.struct("wb", "b") > F.struct("weight", "a")))
              .select("a", "b").distinct())
    every = links.unionByName(_links(second, chunks, weights, share)).checkpoint()
    found = connected_components(every).select(F.col("node").alias("sha256"), F.col("label").alias("group"))
    return named.select(id_col, "sha256").join(found, "sha256", "left").select(id_col, "sha256", F.coalesce("group", "sha256").alias("group"))
