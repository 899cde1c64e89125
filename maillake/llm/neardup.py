"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join.

A document is the set of its word shingles.  Its signature holds the low 16 bits of 60
MinHash values; the distance of two signatures is the number of values that differ.  The
signature is split into m chunks.  By the pigeonhole principle, a pair within distance
2m - 1 has a chunk with at most one difference, so every chunk is indexed once for each of
its values left out (the allowed error): such a pair shares a key.  m is chosen so that a
pair at the similarity threshold exceeds that distance with probability under 1e-6.  Links
are confirmed on the full sets.

Groups are components, so not every pair of a bucket needs a look:

1. documents with equal sets are one node;
2. each bucket's smallest node is its star: the others are compared with it (a line a node
   and bucket at most), and the links found give components;
3. a bucket whose nodes are all in one component is done.  In those that are not, nodes of
   different components are compared, block by block of at most ``BLOCK`` nodes: first by
   signature, then, for the nodes with a partner left, on full sets.  A pair is looked at in
   its first common key only, and of the links a task finds it returns a spanning forest.

So no list of pairs is ever made, and the work within a group that holds together is linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maillake.llm import shingles as sh
from maillake.llm.common import free_names, stored, text_or_empty, tidy
from maillake.operators.wishes import connected_components

BLOCK = 1024                    # nodes of a bucket in one block
STAR_PART = 2048                # nodes compared with one star in one group
BROADCAST_ROWS = 500_000        # of ids (16 bytes each); shuffled join beyond


def _signatures(df: DataFrame, width: int) -> DataFrame:
    """``id, text_key, node, n_shingles, signature`` of every row."""
    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(2):
                s = sh.shingle_set(t.as_py(), width)
                rows.append((sh.set_name(s), len(s), sh.signature(s).tobytes() if len(s) else b""))
            node, n, sig = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int64()),
                                              pa.array(sig, pa.binary())], names=["id", "text_key", "node", "n_shingles", "signature"])

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(tidy(run), f"id {kind}, text_key long, node long, n_shingles long, signature binary")


def _sets(df: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node, shingles`` (sorted 64-bit hashes, binary) of the wanted (text_key, node) rows, from whole texts."""
    def run(batches):
        for batch in batches:
            out = [sh.shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "shingles"])

    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    found = df.select("text_key", "text").join(wanted, "text_key").select("node", "text")
    return stored(found.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(tidy(run), "node long, shingles binary"))


def _groups(batches, width: int) -> Iterator[dict]:
    """Rows with equal first ``width`` columns (integers), as columns; the rows come sorted by these."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(i).to_numpy() for i in range(width)], axis=1)
        edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0][0] != tuple(marks[a].tolist()):
                yield _joined(held)
                held = []
            held.append((tuple(marks[a].tolist()), batch.slice(a, b - a)))
    if held:
        yield _joined(held)


def _joined(held: list) -> dict:
    table = pa.Table.from_batches([x for _, x in held])
    return {n: (table.column(n).to_numpy() if pa.types.is_integer(table.schema.field(n).type) else table.column(n).to_pylist())
            for n in table.schema.names}


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())],
                                      names=["src", "dst"])


def _star_links(percent: int):
    """Links of (star, part) groups: the row whose node is the star holds the set to compare with."""
    def run(batches):
        found = []
        for g in _groups(batches, 2):
            star = g["star"][0]
            own = next(np.frombuffer(s, np.uint64) for n, s in zip(g["node"], g["shingles"], strict=True) if n == star)
            found += [(int(n), int(star)) for n, s in zip(g["node"], g["shingles"], strict=True)
                      if n != star and similar(np.frombuffer(s, np.uint64), own, percent)]
            if len(found) > 10_000:
                yield _edges(found)
                found = []
        yield _edges(found)
    return run


def _first_common(sig: np.ndarray, m: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Number of the first key that pairs (rows[i], cols[i]) of signatures share: chunk and value left out."""
    differ = sig[rows] != sig[cols]
    first = np.full(len(rows), -1, dtype=np.int64)
    for n, (a, b) in reversed(list(enumerate(sh.chunks(m, sig.shape[1])))):
        errors = differ[:, a:b].sum(axis=1)
        at = np.where(errors == 0, 0, differ[:, a:b].argmax(axis=1))
        first = np.where(errors <= 1, n * 1000 + at, first)
    return first


def _open_pairs(g: dict, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block pair that this key answers for: different components, within the distance, first common key."""
    sig = np.stack([np.frombuffer(x, np.uint16) for x in g["signature"]])
    comp, node, side = g["comp"], g["node"], g["block"]
    one = g["low"][0] == g["high"][0]
    left = np.flatnonzero(side == g["low"][0])
    right = left if one else np.flatnonzero(side == g["high"][0])
    rows, cols = [], []
    for i in left:
        others = right[(comp[right] != comp[i]) & ((node[right] > node[i]) if one else True)]
        if len(others):
            others = others[(sig[others] != sig[i]).sum(axis=1) < 2 * m]
            rows.append(np.full(len(others), i))
            cols.append(others)
    if not rows:
        return np.zeros(0, int), np.zeros(0, int)
    r, c = np.concatenate(rows), np.concatenate(cols)
    mine = _first_common(sig, m, r, c) == g["key_no"][0]
    return r[mine], c[mine]


def _survivors(m: int):
    """(key, block pair, node) rows with a partner left."""
    def run(batches):
        for g in _groups(batches, 3):
            r, c = _open_pairs(g, m)
            k = np.unique(np.concatenate([r, c]))
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(g[n][k]) for n in _MEMBER], names=list(_MEMBER))
    return run


_MEMBER = ("key", "low", "high", "node", "block", "comp", "key_no")


def _block_links(m: int, percent: int):
    """A spanning forest of the links of each block pair's open pairs, on full sets."""
    def run(batches):
        for g in _groups(batches, 3):
            r, c = _open_pairs(g, m)
            sets = [np.frombuffer(s, np.uint64) for s in g["shingles"]]
            comps, number = np.unique(g["comp"], return_inverse=True)
            parent = list(range(len(comps)))
            found = []
            for i, j in zip(r.tolist(), c.tolist(), strict=True):
                a, b = _root(parent, number[i]), _root(parent, number[j])
                if a != b and similar(sets[i], sets[j], percent):
                    parent[a] = b
                    found.append((int(g["node"][i]), int(g["node"][j])))
            yield _edges(found)
    return run


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components(df: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_key, node, n_shingles, component`` of every row.

    Rows with equal ``component`` (smallest id reachable through links, itself included) are
    near-duplicates; links join texts whose sets of ``width``-word shingles have at least
    ``percent`` percent of their union in common.  Texts without words have no shingles and
    stand alone, as does every row with a null id without a linked id.  Rows with equal texts
    are linked; equal ids of different texts stay different rows.  An empty table gives an
    empty result.
    """
    text = text_or_empty(df[text_col])
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    signed = stored(_signatures(docs, width))
    nodes = stored(signed.filter("n_shingles > 0").groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("signature").alias("signature")))
    links = _links(docs, nodes, width, percent)
    label = connected_components(links).select(F.col("node").alias("l_node"), "label")
    labelled = signed.join(label, F.col("node") == F.col("l_node"), "left").withColumn("comp", F.coalesce("label", "node"))
    first = labelled.filter("n_shingles > 0").groupBy(F.col("comp").alias("f_comp")).agg(F.min("id").alias("first"))
    return (labelled.join(first, (F.col("comp") == F.col("f_comp")) & (F.col("n_shingles") > 0), "left")
            .select("id", "text_key", "node", "n_shingles", F.coalesce("first", "id").alias("component")))


def _links(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between nodes (src, dst), enough to connect every component."""
    m = sh.chunk_count(percent / 100)
    signs = nodes.select("node", "signature")
    numbers = [n * 1000 + j for n, (a, b) in enumerate(sh.chunks(m)) for j in range(b - a)]
    keyed = signs.repartition("node").mapInArrow(tidy(_numbered_keys(m, numbers)), "key long, key_no int, node long")
    keyed = stored(keyed)
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("star")).filter("size > 1")
    members = stored(keyed.join(buckets, "key").select("key", "key_no", "node", "star", "size"))

    # 2. every node with the stars of its buckets, as far as signatures allow
    pairs = members.filter("node != star").select("node", "star").distinct()
    pairs = (pairs.join(signs, "node").join(signs.select(F.col("node").alias("star"), F.col("signature").alias("star_signature")), "star")
             .mapInArrow(tidy(_near(2 * m - 1)), "node long, star long"))
    pairs = stored(pairs)
    wanted = pairs.select("node").union(pairs.select("star")).distinct()
    sets = _sets(docs, nodes.select("node", "text_key").join(wanted, "node"), width)
    part = F.pmod("node", F.lit(1 << 30)) % F.col("parts")
    parts = pairs.groupBy("star").agg(F.ceil(F.count(F.lit(1)) / STAR_PART).cast("int").alias("parts"))
    rows = (pairs.join(parts, "star").select("star", part.cast("int").alias("part"), "node")
            .unionByName(parts.select("star", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("star").alias("node"))))
    linked = stored(rows.join(sets, "node").select("star", "part", "node", "shingles").repartition("star", "part")
                    .sortWithinPartitions("star", "part").mapInArrow(tidy(_star_links(percent)), "src long, dst long"))

    # 3. buckets that still hold several components
    label = connected_components(linked).select(F.col("node").alias("l_node"), "label")
    now = members.join(label, F.col("node") == F.col("l_node"), "left").withColumn("comp", F.coalesce("label", "node"))
    now = stored(now.select("key", "key_no", "node", "size", "comp"))
    mixed = now.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a != b").select("key")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = (now.join(mixed, "key", "left_semi").withColumn("blocks", blocks)
              .withColumn("block", (F.pmod("node", F.lit(1 << 30)) % F.col("blocks")).cast("int"))
              .select("key", "key_no", "node", "comp", "block", other.alias("other"))
              .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "block", "comp", "key_no"))
    schema = "key long, low int, high int, node long, block int, comp long, key_no int"
    left = stored(spread.join(signs, "node").select(*_MEMBER, "signature").repartition("key", "low", "high")
                  .sortWithinPartitions("key", "low", "high").mapInArrow(tidy(_survivors(m)), schema))
    wanted = left.select("node").distinct()
    known = sets.join(wanted, "node", "left_semi")
    missing = wanted.join(sets.select("node"), "node", "left_anti")
    all_sets = known.unionByName(_sets(docs, nodes.select("node", "text_key").join(missing, "node"), width))
    more = (left.join(all_sets, "node").join(signs, "node").select(*_MEMBER, "signature", "shingles").repartition("key", "low", "high")
            .sortWithinPartitions("key", "low", "high").mapInArrow(tidy(_block_links(m, percent)), "src long, dst long"))
    return stored(linked.unionByName(more))


def _numbered_keys(m: int, numbers: list[int]):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sig = np.stack([np.frombuffer(x.as_py(), dtype=np.uint16) for x in batch.column(1)])
                keys = sh.keys(sig, m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64).ravel()), pa.array(np.tile(np.array(numbers, np.int32), len(keys))),
                     pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["key", "key_no", "node"])
    return run


def _near(most: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                names = batch.schema.names
                a, b = (np.stack([np.frombuffer(x.as_py(), np.uint16) for x in batch.column(names.index(n))]) for n in ("signature", "star_signature"))
                ok = pa.array((a != b).sum(axis=1) <= most)
                yield batch.select(["node", "star"]).filter(ok)
    return run




def keep_one(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near-duplicates: one row of every group, all columns as they were.

    The row with the smallest id of the group stays (null ids last; of equal ids that with
    the smallest text hash).  Texts without words belong to no group and stay.  Of rows with
    equal id and text one stays, any of them.  Clashing column names do not matter.
    """
    groups = components(df, width, percent, id_col, text_col).filter("n_shingles > 0")
    # a row with a null id has its own component unless it is linked: group those by node
    group = F.struct("component", F.when(F.col("component").isNull(), F.col("node")).alias("node"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    rows = stored(groups.select(group.alias("group"), order.alias("row")).groupBy("group", "row").agg(F.count(F.lit(1)).alias("n")))
    best = rows.groupBy("group").agg(F.min("row").alias("row"))
    none, own_id, key = free_names(df, "__none", "__id", "__text")
    drops = stored(rows.join(best.select(F.col("row").alias("best"), F.col("group").alias("b_group")), F.col("group").eqNullSafe(F.col("b_group")))
                   .select(F.col("row.none").alias(none), F.coalesce(F.col("row.id").cast("string"), F.lit("")).alias(own_id),
                           F.col("row.text_key").alias(key), (~F.col("row").eqNullSafe(F.col("best"))).alias("__drop"), "n")
                   .filter("__drop OR n > 1"))
    text = text_or_empty(df[text_col])
    name = [df[id_col].isNull(), F.coalesce(df[id_col].cast("string"), F.lit("")), F.xxhash64(text)]
    gone = drops.filter("__drop").select(none, own_id, key).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    kept = df.join(gone, (name[0] == F.col(none)) & (name[1] == F.col(own_id)) & (name[2] == F.col(key)), "left_anti")
    if drops.filter("NOT __drop").isEmpty():
        return kept
    # rows that are there several times, id and text alike
    again = kept.withColumns({none: name[0], own_id: name[1], key: name[2]})
    worded = F.length(F.trim(text, F.lit(" \t\n\x0b\f\r"))) > 0
    return (again.filter(worded).dropDuplicates([none, own_id, key]).unionByName(again.filter(~worded))
            .drop(none, own_id, key))
