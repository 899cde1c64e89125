"""Exact top-k search by inner product with a pivot-distance index.

Vectors are keyed by their nearest pivot (cell) and their distance from it, cut into rings
(annuli) of about equal count.  For a query q at distance d(q, p) from a pivot p, every x of
a ring satisfies |q - x| >= gap, the distance of d(q, p) from the ring's range of distances
(triangle inequality), and so  q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2  is at most
(|q|^2 + largest |x|^2 of the ring - gap^2) / 2.

Pass 1 searches a block of each query's own ring, which gives a k-th best score to beat.
Pass 2 expands the rings in order of their bound and stops at the first that cannot reach
that score; what is found there is merged.  The bounds only skip what cannot matter, so the
result is exact whatever the pivots are (recall 1); how much they skip depends on the data.

Pivots and ring edges come from a bounded sample (``SAMPLE`` vectors with the smallest hash
of their id); every vector is indexed.  The table of rings has at most ``PIVOTS * RINGS``
rows, so it travels with the tasks.  A ring is split into blocks of about ``BLOCK`` vectors
by hash, so equal vectors do not gather in one task; a task holds one block and streams the
queries past it.

Every row has a number of its own, given when the vectors are first stored.  A query is a row,
not an id: of rows that repeat an id each is searched for alone and is itself a neighbour of
the others.

Scores are exact whatever the size of the components: whole numbers kept as doubles, Python
integers where a double cannot hold the sums.  A score among the k best that does not fit the
64-bit result column is an error, as it is in SQL; so are vectors of different lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maillake.llm.common import stored

PIVOTS = 8
RINGS = 4
SAMPLE = 2048
BLOCK = 8192
SCALE = 64
LEAST = -2 ** 63                # stands for all scores below the 64-bit numbers


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id, vec`` (little-endian doubles, the whole numbers floor(scale * x)) of the vectors that take part.

    Left out: null ids, null or empty vectors, vectors with a null or non-finite component.
    """
    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not x.is_valid or not len(x.values) or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(v).all():
                    v = np.floor(scale * v)
                    if not np.isfinite(v).all():
                        raise OverflowError(f"vector {i}: {scale} times a component is beyond the doubles")
                    ids.append(i)
                    out.append(v.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "vec"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(run, "id long, vec binary")


def _matrix(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f8").reshape(-1, size)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = x.astype(np.float64)[:, None, :] - pivots[None, :, :]
    return np.sqrt((d * d).sum(axis=2))


def choose(sample: np.ndarray, pivots: int = PIVOTS, rings: int = RINGS) -> tuple[np.ndarray, np.ndarray]:
    """Pivots, each the sample's farthest from those before it, and the ring edges of each cell."""
    x = sample.astype(np.float64)
    picked = [0]
    near = np.linalg.norm(x - x[0], axis=1)
    while len(picked) < min(pivots, len(x)) and near.max() > 0:        # equal pivots would have empty cells
        picked.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[picked[-1]], axis=1))
    points = x[picked]
    d = _distances(sample, points)
    cell, own = d.argmin(axis=1), d.min(axis=1)
    edges = np.stack([np.quantile(own[cell == c], np.arange(1, rings) / rings) for c in range(len(points))])
    return points, edges


class Index:
    """``rows`` (row, id, vec, cell, ring, block) of every vector, the pivots, and the bounded table of rings."""

    def __init__(self, numbers: DataFrame):
        numbers = stored(numbers.withColumn("row", F.monotonically_increasing_id()))
        sample = numbers.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        self.size = len(sample[0]["vec"]) if sample else 8
        short, long = numbers.agg(F.min(F.octet_length("vec")), F.max(F.octet_length("vec"))).first()
        if short != long:
            raise ValueError(f"vectors of different lengths ({short // 8} to {long // 8}) have no inner products")
        self.dim = self.size // 8
        self.rings: list = []
        if not sample:
            self.pivots, self.edges = np.zeros((1, self.dim)), np.zeros((1, RINGS - 1))
        else:
            self.pivots, self.edges = choose(_matrix([x["vec"] for x in sample], self.dim))
        keyed = stored(numbers.select("row", "id", "vec").mapInArrow(self._keyed(), "row long, id long, vec binary, cell int, ring int, dist double, norm double"))
        self.rings = [tuple(r) for r in keyed.groupBy("cell", "ring").agg(
            F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("norm").alias("norm"),
            F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).collect()]
        schema = "cell int, ring int, low double, high double, norm double, blocks int"
        table = F.broadcast(keyed.sparkSession.createDataFrame(self.rings, schema).select("cell", "ring", "blocks"))
        self.rows = (keyed.join(table, ["cell", "ring"])
                     .select("row", "id", "vec", "cell", "ring", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block")))

    def _keyed(self):
        pivots, edges, dim = self.pivots, self.edges, self.dim

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(2).to_pylist(), dim)
                    d = _distances(x, pivots)
                    cell, own = d.argmin(axis=1), d.min(axis=1)
                    ring = (own[:, None] > edges[cell]).sum(axis=1)
                    norm = (x.astype(np.float64) ** 2).sum(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(ring.astype(np.int32)),
                         pa.array(own), pa.array(norm)], names=["row", "id", "vec", "cell", "ring", "dist", "norm"])
        return run

    def _visits(self, own_ring_only: bool):
        """Rows (query, block to visit): the query's own ring, or every ring whose bound reaches the score to beat.

        The first column of the queries names them; it is only handed on.
        """
        pivots, dim, rings = self.pivots, self.dim, self.rings
        place = {(r[0], r[1]): r for r in rings}

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, vecs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                x = _matrix(vecs, dim)
                out = []
                if own_ring_only:
                    for i, (c, r) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                        out.append((i, c, r, ids[i] % place[c, r][5], None))
                else:
                    beat = batch.column(4).to_pylist()
                    d, own = _distances(x, pivots), (x.astype(np.float64) ** 2).sum(axis=1)
                    for i in range(len(ids)):
                        bounds = []
                        for c, r, low, high, norm, blocks in rings:
                            gap = max(0.0, max(low - d[i, c], d[i, c] - high) - 1e-12 * (d[i, c] + high))      # less rounding
                            bound = (own[i] + norm - gap * gap) / 2 + 1e-9 * (own[i] + norm) + 1e-6
                            bounds.append((np.inf if np.isnan(bound) else bound, c, r, blocks))
                        for bound, c, r, blocks in sorted(bounds, reverse=True):
                            if beat[i] is not None and bound < beat[i]:
                                break
                            out += [(i, c, r, b, beat[i]) for b in range(blocks)]
                at = [o[0] for o in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in at], pa.int64()), pa.array([vecs[i] for i in at], pa.binary()),
                     pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()),
                     pa.array([o[3] for o in out], pa.int32()), pa.array([o[4] for o in out], pa.int64())],
                    names=["id", "vec", "cell", "ring", "block", "beat"])
        return run

    def search(self, is_query: Column, k: int) -> DataFrame:
        """``query_id, rank, vec_id, score``: the k best of all other rows for each query row, ties to the smaller id.

        Only the query's own row is no neighbour of it.  An id that stands on n query rows has n
        lists of ranks 1 to k under that id, one for each row's own vector.
        """
        queries = self.rows.filter(is_query)
        visit = "id long, vec binary, cell int, ring int, block int, beat long"
        first = queries.select("row", "vec", "cell", "ring").mapInArrow(self._visits(True), visit)
        beat = (self._met(first, k).groupBy("query").agg(F.min("score").alias("least"), F.count("score").alias("n"))
                .select("query", F.when(F.col("n") >= k, F.col("least")).alias("beat")))
        known = stored(queries.join(beat, queries["row"] == beat["query"], "left").select("row", "vec", "cell", "ring", "beat", "id"))
        found = self._met(known.drop("id").mapInArrow(self._visits(False), visit), k)
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id"))
        return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
                .join(known.select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query")
                .select("query_id", "rank", "vec_id", F.coalesce("score", F.raise_error(F.lit("a score is below the 64-bit numbers")).cast("long")).alias("score")))

    def _met(self, visits: DataFrame, k: int) -> DataFrame:
        """The k best of each visited block for each visit (query, vec_id, score), at least the score to beat; null: below 64 bits."""
        rows = self.rows.select("cell", "ring", "block", F.lit(0).alias("query"), "row", "vec", F.lit(None).cast("long").alias("beat"), "id")
        both = rows.unionByName(visits.withColumnRenamed("id", "row").withColumns({"query": F.lit(1), "id": F.lit(None).cast("long")}))
        return (both.repartition("cell", "ring", "block").sortWithinPartitions("cell", "ring", "block", "query")
                .mapInArrow(_met_blocks(self.dim, k), "query long, vec_id long, score long"))


def _met_blocks(dim: int, k: int):
    def run(batches):
        at, rows, ids, vecs, x = None, [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if tuple(marks[a, :3].tolist()) != at:
                    at, rows, ids, vecs, x = tuple(marks[a, :3].tolist()), [], [], [], None
                part = batch.slice(a, b - a)
                own, own_vecs = part.column(4).to_numpy(), part.column(5).to_pylist()
                if marks[a, 3] == 0:
                    rows.append(own)
                    ids.append(part.column(7).to_numpy())
                    vecs.append(_matrix(own_vecs, dim))
                elif ids:
                    if x is None:
                        x, names, numbers = np.concatenate(vecs), np.concatenate(ids), np.concatenate(rows)
                    out += _best(own, _matrix(own_vecs, dim), part.column(6).to_pylist(), numbers, names, x, k)
            got = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in got[:2]), pa.array(got[2], pa.int64(), mask=got[2] == LEAST)], names=["query", "vec_id", "score"])
    return run


def _best(own: np.ndarray, q: np.ndarray, beat: list, numbers: np.ndarray, names: np.ndarray, x: np.ndarray, k: int) -> list:
    """(query rows, vector ids, scores) of the k best vectors, other than its own row, for each query of a batch."""
    size, wide = np.abs(x).max(axis=1), {}
    out = []
    for s in range(0, len(q), 256):
        part = q[s:s + 256]
        with np.errstate(over="ignore", invalid="ignore"):
            scores = part @ x.T
            exact = np.abs(part).max() * size.max() * x.shape[1] < 2.0 ** 53      # sums fit a double
        scores = scores.astype(np.int64) if exact else scores
        for i in range(len(part)):
            query, row = own[s + i], scores[i]
            fit = numbers != query
            if not exact:
                row = _wide_scores(part[i], x, size, wide, row, fit)
            if beat[s + i] is not None:
                fit &= row >= beat[s + i]
            at = np.flatnonzero(fit)
            if len(at) > k:
                least = np.partition(row[at], len(at) - k)[len(at) - k]
                at = at[row[at] >= least]
            at = at[np.lexsort((names[at], -row[at]))][:k]
            out.append((np.full(len(at), query), names[at], row[at]))
    return out


def _wide_scores(q: np.ndarray, x: np.ndarray, size: np.ndarray, wide: dict, rough: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """The 64-bit scores of a query, in Python integers where doubles (``rough``) may round; ``wide`` keeps rows in these."""
    with np.errstate(over="ignore"):
        plain = np.abs(q).max() * size * x.shape[1] < 2.0 ** 53
    out = np.where(plain, rough, 0).astype(np.int64)
    numbers = [int(c) for c in q]
    for j in np.flatnonzero(~plain & fit):
        if j not in wide:
            wide[j] = [int(c) for c in x[j]]
        score = sum(a * b for a, b in zip(numbers, wide[j], strict=True))
        if score >= 2 ** 63:
            raise OverflowError(f"a score of {score} is above the 64-bit numbers")
        out[j] = max(score, LEAST)
    return out
