"""Hierarchical weighted hash tree: region, rack and shard by weighted hash draws.

Every leaf draws an exponential race time -ln(u) / weight from the hash of its name and the
row's key, and a subtree's draw is the earliest of its children's, which is distributed as a
draw with the subtree's whole weight.  A row is in the region with the earliest draw, in that
region's rack and in that rack's shard with the earliest: a nested race, which the earliest leaf of all
wins.  So every leaf is hashed for every row; nothing is left out on the way down.  Draws of a subtree's
own, without its leaves', would save hashes but not the law: a row that a grown subtree wins would be drawn
among all its leaves, old ones included.

Draws depend on nothing but the key and the leaf, so when weights change, rows move only
into the subtrees whose weight grew or out of those whose weight shrank; a new shard takes
rows only into itself, from everywhere in proportion.

The shard is one expression per row (one 8-byte hash for each leaf), without a shuffle.  Slots take a range
sort by shard and row, in which a shard and any number of equal rows are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maillake.plans.sequential import running_sum

RACKS_PER_REGION = 4
SHARDS_PER_RACK = 5
SIZE_OVERHEAD = 16


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(n: int, weights: Sequence[float] | None = None) -> list[Leaf]:
    """``n`` shards filled into racks, racks into regions; shard i keeps its place when n grows."""
    return [Leaf(i // (SHARDS_PER_RACK * RACKS_PER_REGION), i // SHARDS_PER_RACK, i, 1.0 if weights is None else weights[i])
            for i in range(n)]


def draw(key: Column, leaf: Leaf) -> Column:
    """The race time of a leaf for a row: exponential with the leaf's weight as its rate."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(leaf.region), F.lit(leaf.rack), F.lit(leaf.shard), key), 11)
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(leaf.weight)


def place(key: Column, leaves: Sequence[Leaf]) -> Column:
    """Struct of ``draw, region, rack, shard``: the leaf that a row reaches; null if no leaf has weight."""
    def first(parts: list[Column]) -> Column:
        return parts[0] if len(parts) == 1 else F.least(*parts)

    regions: dict[int, dict[int, list[Column]]] = {}
    for x in leaves:
        if x.weight > 0:
            regions.setdefault(x.region, {}).setdefault(x.rack, []).append(F.struct(
                draw(key, x).alias("draw"), F.lit(x.region).alias("region"), F.lit(x.rack).alias("rack"),
                F.lit(x.shard).alias("shard")))
    if not regions:
        return F.lit(None).cast("struct<draw:double,region:int,rack:int,shard:int>")
    return first([first([first(shards) for shards in racks.values()]) for racks in regions.values()])


def row_key(id_col: Column) -> Column:
    """Hash of a row's id; null ids share one key."""
    return F.xxhash64(F.coalesce(id_col.cast("string"), F.lit("")))


def assign(df: DataFrame, n: int, weights: Sequence[float] | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, region, rack, shard, slot, grown_shard`` of every row.

    Law ``key``: the id and the shards alone decide.  ``grown_shard`` is the shard with one
    more shard of weight 1.  ``size`` is the text's UTF-8 bytes plus 16 (a null text has
    none), ``text_crc32`` the unsigned CRC-32 of those bytes (0 for none).  ``slot`` numbers
    the rows of a shard from 0 without gaps, by id, checksum and size.  Rows
    with equal or null ids share a shard.  Other columns are not read.  An empty table gives
    an empty result.
    """
    key = row_key(F.col(id_col))
    leaves = tree(n, weights)
    grown = [*leaves, tree(n + 1)[-1]]
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + SIZE_OVERHEAD
    placed = (df.select(F.col(id_col), size.alias("size"), F.coalesce(F.crc32(text_col), F.lit(0)).cast("long").alias("text_crc32"),
                        key.alias("__key"))
              .withColumn("__at", place(F.col("__key"), leaves))
              .withColumn("__grown", F.least("__at", place(F.col("__key"), grown[-1:])))
              .select(id_col, "size", "text_crc32", "__at.region", "__at.rack", "__at.shard",
                      F.col("__grown.shard").alias("grown_shard")))
    return with_slots(placed, id_col)


def with_slots(placed: DataFrame, id_col: str) -> DataFrame:
    """Add ``slot``: a row's number within its shard, from 0.

    The running number is taken over ranges of (shard, id, checksum, size), equal rows told apart by where they were
    read; the ranged rows are checkpointed, so that which of equal rows has which number is settled once.
    """
    rows = placed.select(F.col(id_col).alias("__id"), *[c for c in placed.columns if c != id_col],
                         F.coalesce("shard", F.lit(-1)).alias("__in"), F.monotonically_increasing_id().alias("__read"))
    numbered = running_sum(rows, ["__in"], ["__id", "text_crc32", "size", "__read"], F.lit(1), "__slot")
    return numbered.select(F.col("__id").alias(id_col), "size", "text_crc32", "region", "rack", "shard",
                           (F.col("__slot").cast("long") - 1).alias("slot"), "grown_shard")
