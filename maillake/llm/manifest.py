"""Merkle manifest of a dataset: few levels are stored, proofs make the others anew.

Every group has a tree over its leaves in id order; the trees' tops, in group order, are the leaves of
a tree of their own, built alike, whose top is the root.  A node is the SHA-256 of the digests (as
hex) of up to ``FAN`` consecutive nodes below.

Only every third level is stored: leaves, then one node for each aligned subtree of 4,096.
Between them a task reads the stored nodes of one such subtree (a block), makes the two levels
inside, and keeps the top alone.  Proofs go the other way, from the root down: a block gets the
siblings of its own top from above, makes its inner levels anew, emits the siblings of every
node, and forgets them.  So storage is 4,097 / 4,096 of the leaves, a block is bounded however
large its group, and the siblings from above travel once a block, not once a leaf.

The levels that a lost executor held are read again from storage.  Nothing passes the driver but
the number of leaves of the largest group.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maillake.llm.blocks import dealt, in_blocks
from maillake.llm.common import stored, tidy
from maillake.plans.sequential import global_row_number, running_sum

FAN = 16
FAN_BITS = 4
STORED_EVERY = 3                        # levels
BLOCK_BITS = FAN_BITS * STORED_EVERY    # of a position that tell the place within a block
OUT_ROWS = 512                          # proofs in one returned Arrow batch
_SIBLINGS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_SIBLINGS_DDL = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def folded(siblings: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(siblings, leaf, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def proof_text(siblings: Column) -> Column:
    """All siblings in order: level by level, left to right."""
    return F.array_join(F.transform(siblings, lambda x: F.concat(x["left"], x["right"])), "")


def _parents(digests: list[str]) -> list[str]:
    return [hashlib.sha256("".join(digests[i:i + FAN]).encode()).hexdigest() for i in range(0, len(digests), FAN)]


def _hexes(column) -> list[str]:
    return [x.hex() for x in column.to_pylist()]


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree with n of them."""
    return sum(((n > F.lit(1 << (FAN_BITS * d))).cast("int") for d in range(15)), F.lit(0))


def _levels(n: Column, step: int) -> Column:
    """Levels that the tree of n leaves has in the given step of ``STORED_EVERY`` levels."""
    return F.least(F.lit(STORED_EVERY), F.greatest(F.lit(0), _depth(n) - STORED_EVERY * step))


def _tops(batches):
    """The top of each block."""
    for block in in_blocks(batches, ["k", "block"], "pos"):
        digests = _hexes(block["h"][1:])
        for _ in range(block["levels"][0].as_py()):
            digests = _parents(digests)
        yield pa.RecordBatch.from_arrays([block["k"].chunk(0)[:1], block["block"].chunk(0)[:1],
                                          pa.array([bytes.fromhex(x) for x in digests], pa.binary())], names=["k", "pos", "h"])


def _proofs(batches):
    """The nodes of each block with their siblings up to the root."""
    for block in in_blocks(batches, ["k", "block"], "pos"):
        head, rows = block.slice(0, 1).to_pylist()[0], block.slice(1).combine_chunks()
        above = [(x["left"], x["right"]) for x in json.loads(head["siblings"])]
        levels = [_hexes(rows["h"])]
        for _ in range(head["levels"]):
            levels.append(_parents(levels[-1]))
        runs = [["".join(level[i:i + FAN]) for i in range(0, len(level), FAN)] for level in levels[:-1]]
        for start in range(0, rows.num_rows, OUT_ROWS):
            part = rows.slice(start, OUT_ROWS).combine_chunks()
            left, right = [], []
            for i in range(start, start + part.num_rows):
                for run in runs:
                    i, at = i // FAN, 64 * (i % FAN)
                    left.append(run[i][:at])
                    right.append(run[i][at + 64:])
                left += [x for x, _ in above]
                right += [x for _, x in above]
            step = len(runs) + len(above)
            siblings = pa.ListArray.from_arrays(pa.array(range(0, step * part.num_rows + 1, step) if step else [0] * (part.num_rows + 1), pa.int32()),
                                                pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
            same = {c: pa.array([head[c]] * part.num_rows, block.schema.field(c).type) for c in ("n", "top", "root")}
            columns = {c: part[c].chunk(0) for c in part.column_names if c in ("k", "pos", "h", "id", "claimed")}
            columns |= same | {"siblings": siblings}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


@dataclass(frozen=True)
class Trees:
    """One tree for each ``k``: ``levels[s]`` holds the stored nodes (``k, pos, h``) of level ``s * STORED_EVERY``.

    ``levels[0]``, the leaves, also has ``id`` and ``claimed``; ``counts`` has the leaves of each tree (``k, n``).
    """

    levels: list[DataFrame]
    counts: DataFrame

    def tops(self) -> DataFrame:
        """``k, h``: the top of each tree."""
        return self.levels[-1].select("k", "h")

    def proofs(self, above: DataFrame) -> DataFrame:
        """Leaves with ``siblings`` up to the root; ``above`` has ``k, top, root`` and each top's own ``siblings``."""
        paths = (self.levels[-1].select("k", "pos").join(self.counts, "k").join(above, "k")
                 .select("k", "pos", "n", "top", "root", "siblings"))
        for step in range(len(self.levels) - 2, -1, -1):
            headers = paths.select("k", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "n", "top", "root", F.to_json("siblings").alias("siblings"),
                                   _levels(F.col("n"), step).alias("levels"))
            below = self.levels[step].withColumn("block", F.shiftright("pos", BLOCK_BITS))
            fields = [f"`{c}` {below.schema[c].dataType.simpleString()}" for c in ("k", "pos", "h", "id", "claimed") if c in below.columns]
            found = dealt(headers, below, ["k", "block"], "pos").mapInArrow(
                tidy(_proofs), ", ".join([*fields, f"n long, top string, root string, siblings {_SIBLINGS_DDL}"]))
            paths = stored(found.drop("h")) if step else found
        return paths if len(self.levels) > 1 else paths.join(self.levels[0], ["k", "pos"])     # every tree is one leaf


def grow(leaves: DataFrame, counts: DataFrame) -> Trees:
    """Trees over ``leaves`` (``k, pos, h, id, claimed``; ``pos`` from 0 without gaps); ``counts`` has ``k, n``."""
    most = counts.agg(F.max("n")).first()[0] or 0
    levels, step = [leaves], 0
    while most > 1 << (BLOCK_BITS * step):
        last = F.shiftright(F.col("n") - 1, BLOCK_BITS * (step + 1))
        headers = counts.select("k", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"),
                                F.lit(-1).cast("long").alias("pos"), _levels(F.col("n"), step).alias("levels"))
        below = levels[-1].select("k", F.shiftright("pos", BLOCK_BITS).alias("block"), "pos", "h")
        levels.append(stored(dealt(headers, below, ["k", "block"], "pos").mapInArrow(tidy(_tops), "k string, pos long, h binary")))
        step += 1
    return Trees(levels, counts)


def prove(df: DataFrame, leaf: Column, claimed: Column | None = None, id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """``id_col, leaf, claimed, subroot, root, siblings`` of every row of ``df``.

    ``leaf`` is a row's digest (hex), ``claimed`` the digest of what a reader holds for that row now
    (null: the same).  ``siblings`` lists the other digests of the row's run on each level, joined left
    and right of it, up to the root: ``folded`` makes a root of them, ``proof_text`` one text.

    Within a group (null is a group, the first) leaves ascend by id, nulls first, rows that repeat an
    id by their digest; groups ascend by UTF-8 bytes.  Equal rows are leaves of their own.  Other
    columns are read only where ``leaf`` and ``claimed`` use them.  An empty table gives an empty result.
    """
    k = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit(""))
    rows = stored(df.select(k.alias("k"), F.col(id_col).alias("id"), F.unhex(leaf).alias("h"),
                            F.unhex(F.lit(None).cast("string") if claimed is None else claimed).alias("claimed")))
    numbered = running_sum(rows, ["k"], ["id", "h"], F.lit(1), "pos")
    leaves = stored(numbered.select("k", (F.col("pos").cast("long") - 1).alias("pos"), "h", "id", "claimed"))
    groups = grow(leaves, stored(leaves.groupBy("k").agg((F.max("pos") + 1).alias("n"))))

    tops = global_row_number(groups.tops(), ["k"], "pos")
    over = stored(tops.select(F.lit("").alias("k"), (F.col("pos").cast("long") - 1).alias("pos"), "h", F.col("k").alias("id"),
                              F.lit(None).cast("binary").alias("claimed")))
    whole = grow(over, over.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    root = F.lower(F.hex("h"))
    none = F.from_json(F.lit("[]"), _SIBLINGS_DDL)
    above = whole.proofs(whole.tops().select("k", root.alias("top"), root.alias("root"), none.alias("siblings")))
    above = stored(above.select(F.col("id").alias("k"), "root", "siblings"))
    above = above.join(groups.tops().select("k", root.alias("top")), "k")
    found = groups.proofs(above)
    hex_of = {c: F.lower(F.hex(c)) for c in ("h", "claimed")}
    return found.select(F.col("id").alias(id_col), hex_of["h"].alias("leaf"), F.coalesce(hex_of["claimed"], hex_of["h"]).alias("claimed"),
                        F.col("top").alias("subroot"), "root", "siblings")
