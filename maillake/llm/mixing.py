"""Mixing sources to target weights by pivotal dependent rounding in a reduction tree.

Every source has a target, so each of its documents has the same expected number of copies,
target / source size.  Its whole part is taken for sure; the fraction p must become 0 or 1
for each document.  Pivotal rounding walks along a chain of documents and lets two of them
with fractional p trade mass (p times size) until one of them is integral.  The direction is
drawn so that neither's expectation changes, and their common mass never does.  What a chain
cannot settle is one document with a fraction left.

Chains are short and many: the documents of a source fall into hashed buckets, each is
chained on its own (streamed, one open document in memory), and the open documents of 64
buckets are chained together, level by level, up to one for each source, whose p is drawn.
A hot source is many buckets, so nothing of its size is ever in one task.  Every draw is a
hash of the document and the level, so reruns, lost tasks and other cluster sizes give the
same mix.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maillake.llm.common import free_names, stored
from maillake.plans.sequential import global_row_number

WEIGHTS = (5, 2, 1)             # of the sources in code point order, null last, repeating
SHARE = 1.5                     # of all sizes
MOST = 2.0                      # times its source's size that a target may reach
BUCKETS = (4096, 64, 1)         # buckets of a source, level by level
BROADCAST_SOURCES = 100_000
_EPS = 1e-9


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(df: DataFrame, source: Column, size: Column, weights: tuple = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """``source, source_size, target`` of every source.

    ``share`` of all sizes is dealt by weight; a source stops at ``most`` times its own
    size, and what it leaves is dealt to the others until none is above.  That is one level
    of words per weight, found by a few passes over the table of sources; it rises with every
    pass and stops when no further source is full.
    """
    sizes = df.groupBy(source.alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    ranked = global_row_number(sizes, [F.col("source").isNull(), F.col("source")], "__n")
    at = (F.col("__n") - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (at + 1).cast("int"))
    table = stored(ranked.select("source", "source_size", weight.alias("weight"),
                                 (F.col("source_size") * F.lit(float(most))).alias("most")))
    row = table.agg(F.sum("source_size"), F.sum("weight")).first()
    total = share * float(row[0] or 0)
    level = total / row[1] if row[1] else 0.0
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        row = table.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not row[1]:
            break
        higher = (total - float(row[0])) / row[1]
        if higher <= level:
            break
        level = higher
    return table.select("source", "source_size", F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"))


def _trade(size_i: float, p_i: float, size_j: float, p_j: float, u: float) -> tuple[float, float]:
    """New fractions of two documents: one becomes 0 or 1, the mass size * p of both together stays."""
    up = min(size_i * (1 - p_i), size_j * p_j)
    down = min(size_i * p_i, size_j * (1 - p_j))
    step = up if u * (up + down) < down else -down
    return _snap(p_i + step / size_i), _snap(p_j - step / size_j)


def _snap(p: float) -> float:
    return 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p


def _chain(batches):
    """Settle rows (sorted by source and bucket) along their chains; each chain's last open row keeps its p.

    Columns: key, bucket, size, p, u and whatever else; p and bit are rewritten.
    """
    open_row = None                 # (one-row batch, group, size, p)

    def settled(batch, p, bit):
        columns = {n: batch.column(n) for n in batch.schema.names}
        columns["p"], columns["bit"] = pa.array(p, pa.float64()), pa.array(bit, pa.int32())
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def alone(row, p):
        return settled(row, [p], [None if 0.0 < p < 1.0 else int(p)])

    for batch in batches:
        groups = list(zip(batch.column("chain").to_pylist(), batch.column("bucket").to_pylist(), strict=True))
        sizes, ps, us = (batch.column(n).to_pylist() for n in ("size", "p", "u"))
        held = None                 # index in this batch of the open row
        for i, group in enumerate(groups):
            if open_row is not None and open_row[1] != group:
                yield alone(open_row[0], open_row[3])
                open_row = None
            if held is not None and groups[held] != group:
                held = None         # stays in its place with its p
            ps[i] = _snap(ps[i])
            if sizes[i] == 0 and 0.0 < ps[i] < 1.0:
                ps[i] = float(us[i] < ps[i])            # no mass to trade
            if not 0.0 < ps[i] < 1.0:
                continue
            if open_row is not None:
                row, _, size, p = open_row
                p, ps[i] = _trade(size, p, sizes[i], ps[i], us[i])
                open_row = (row, group, size, p)
                if not 0.0 < p < 1.0:
                    yield alone(row, p)
                    open_row = None
            elif held is not None:
                ps[held], ps[i] = _trade(sizes[held], ps[held], sizes[i], ps[i], us[i])
                if 0.0 < ps[held] < 1.0:
                    continue
                held = None
            if open_row is None and held is None and 0.0 < ps[i] < 1.0:
                held = i
        out = settled(batch, ps, [None if 0.0 < p < 1.0 else int(p) for p in ps])
        if held is not None and groups[held] == groups[-1]:
            open_row = (batch.slice(held, 1), groups[held], sizes[held], ps[held])
            keep = [i != held for i in range(batch.num_rows)]
            out = out.filter(pa.array(keep))
        if out.num_rows:
            yield out
    if open_row is not None:
        yield alone(open_row[0], open_row[3])


_KEYS = ["id", "source", "size", "text_key"]


def copies(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
           weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per distinct (id, source, text): how many rows it stands for and how often each is taken.

    Columns ``id, source, size, text_key, n_rows, source_size, target, copies``.  Equal rows
    take the same number of copies.  A null text has size 0 and null ids and sources are
    values like others; texts of size 0 are taken by a draw of their own, as they change no
    sum.  Sources whose texts hold no words have target 0.  An empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(text).alias("size"),
                     F.xxhash64(text).alias("text_key"))
    units = stored(rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n_rows")))
    goals = targets(units, F.col("source"), F.col("size") * F.col("n_rows"), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = stored(goals.withColumn("rate", rate).withColumnRenamed("source", "goal_source"))
    few = goals.count() <= BROADCAST_SOURCES
    with_goal = units.join(F.broadcast(goals) if few else goals, F.col("source").eqNullSafe(F.col("goal_source")))
    name = F.xxhash64(*_KEYS)
    open_rows = with_goal.select(
        *_KEYS, "n_rows", "source_size", "target", F.floor("rate").cast("long").alias("whole"),
        (F.col("size") * F.col("n_rows")).cast("double").alias("mass"), (F.col("rate") - F.floor("rate")).alias("p"),
        F.coalesce(F.col("source"), F.lit("")).alias("chain_name"), F.col("source").isNull().alias("no_source"), name.alias("name"))
    done = None
    for level, buckets in enumerate(BUCKETS):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(level), "name"), 11)
        ready = (open_rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "name"), F.lit(buckets)).cast("int"))
                 .withColumn("u", (bits.cast("double") + 0.5) / F.lit(float(1 << 53)))
                 .withColumn("chain", F.concat(F.col("no_source").cast("string"), F.col("chain_name")))
                 .withColumn("bit", F.lit(None).cast("int")))
        # the chain trades mass: words times equal rows
        renamed = ready.withColumnRenamed("size", "n_words").withColumnRenamed("mass", "size")
        out = stored(renamed.repartition("chain", "bucket")
                     .sortWithinPartitions("chain", "bucket", F.col("size").desc(), "name")
                     .mapInArrow(_chain, renamed.schema).withColumnRenamed("size", "mass").withColumnRenamed("n_words", "size"))
        part = out.filter("bit IS NOT NULL")
        done = part if done is None else done.unionByName(part)
        open_rows = out.filter("bit IS NULL").drop("bucket", "u", "chain", "bit")
        if level == len(BUCKETS) - 1:
            last = F.shiftrightunsigned(F.xxhash64(F.lit("last"), "name"), 11)
            done = done.unionByName(out.filter("bit IS NULL")
                                    .withColumn("bit", ((last.cast("double") + 0.5) / F.lit(float(1 << 53)) < F.col("p")).cast("int")))
    return done.select(*_KEYS, "n_rows", "source_size", "target", (F.col("whole") + F.col("bit")).alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of ``df`` repeated as often as the mix takes them (some not at all), columns as they were."""
    plan = copies(df, id_col, source_col, text_col, weights, share, most).filter("copies > 0")
    names = free_names(df, "__id", "__source", "__text_key", "__size", "__copies", "__copy")
    own_id, own_source, key, size, times, copy = names
    plan = plan.select(*(F.col(c).alias(n) for c, n in zip(("id", "source", "text_key", "size", "copies"), names, strict=False)))
    text = F.col(text_col).cast("string")
    joined = df.join(plan, F.col(id_col).eqNullSafe(F.col(own_id)) & F.col(source_col).eqNullSafe(F.col(own_source))
                     & (F.xxhash64(text) == F.col(key)) & (words(text) == F.col(size)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).drop(*names)
