"""Removal of repeated byte strings: distributed prefix doubling over sampled positions.

A byte goes if a string of ``length`` bytes that covers it starts at another place as well,
in any text, the same one included.

Doubling over every byte would sort as many rows a round as the corpus has bytes.  Here the
positions are sampled by content first.  Every start's string of ``length`` bytes holds
``length / 2 + 1`` strings of half that length; the one with the smallest hash is its anchor.
Equal strings have equal anchors at equal distances, so each start belongs to one anchor, and
the starts of an anchor (about 50 at 400 bytes) are one row: anchor position and a range of
distances.  Rows are ranked in rounds, over ever longer strings:

* round 0 ranks anchors by their half-length string.  Anchors with a rank of their own
  cannot belong to a repeated string and leave at once;
* the next rounds cut the range of distances into cells (16, then 1) and rank each cell by
  the pair of its anchor's rank and the string that all starts of the cell have in common,
  which grows from half the length to the whole of it.

In every round a row also carries the hash of all bytes that its starts cover.  Rows equal in
that are wholly repeated and leave as found; a rank with one such hash is settled, too.  Only
rows whose rank is shared but whose surroundings differ go on, with one row standing in for
those found, until the string is unique or past the threshold.

Ranks are 64-bit names (hashes) instead of dense numbers, compared within their anchor's rank,
so that a round needs no total order.  Equal hashes are taken for equal strings: odds of one wrong pair are about
n^2 / 2^65 for n sampled rows (2e-6 for 9 million, the rows of half a GB), and no bytes are compared afterwards.

Texts are read four times.  Rows go to their texts by a shuffled join at every size; texts without such rows stay out of
it, as a filter of fixed size (``FILTER_BITS``) tells before the shuffle.  Counts are combined map-side.  A rank that
holds more than one in ``HEAVY_SHARE`` of the rows is heavy: there are fewer than ``HEAVY_SHARE`` of these, so they meet
their rows by broadcast, and the others by a shuffle in which no key is large.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maillake.llm.common import process_cache, stored, text_or_empty, tidy

LENGTH = 400
CELLS = (16, 1)                 # starts in a cell, round by round
PIECE = 1 << 20                 # bytes hashed at a time
FILTER_BITS = 26                # the filter of text identities is 8 MB
HEAVY_SHARE = 50_000            # heavy keys, at most
HEAVY_ROWS = 2_000              # of a key that may be heavy
FINAL_SALTS = 8                 # parts of the copies of one text when they meet their spans

_BASE = 0x9E3779B97F4A7C15 | 3
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse (at least n), and the random value of each byte."""
    cache = process_cache()
    if len(cache.get("substring powers", ((),))[0]) < n:
        cache["substring powers"] = tuple(
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b & (2 ** 64 - 1), dtype=np.uint64))])
            for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        cache["substring bytes"] = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
    return (*cache["substring powers"], cache["substring bytes"])


class Hashes:
    """Hashes of any substring of ``data[a:b]``, equal for equal strings wherever they stand."""

    def __init__(self, data: np.ndarray, a: int, b: int):
        power, self.inverse, value = _powers(b - a + 1)
        self.a = a
        self.sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(value[data[a:b]] * power[:b - a], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = start - self.a
        return _mixed((self.sums[end - self.a] - self.sums[s]) * self.inverse[s])

    def windows(self, k: int) -> np.ndarray:
        """Hash of every window of k bytes."""
        n = len(self.sums) - k
        return _mixed((self.sums[k:] - self.sums[:-k]) * self.inverse[:n])


def _sliding(values: np.ndarray, width: int, take) -> np.ndarray:
    got = 1
    while got < width:
        step = min(got, width - got)
        values = take(values[:-step], values[step:])
        got += step
    return values


def pieces(n: int, reach: int):
    """(first, last + 1) of the anchors of a piece, and the range of bytes around them."""
    for a in range(0, n, PIECE):
        b = min(n, a + PIECE)
        yield a, b, max(0, a - reach), min(n, b + reach)


def anchors(data: np.ndarray, length: int):
    """(position, smallest and largest distance of a start, rank, hash of all bytes covered) of one text's anchors."""
    n, half = len(data), length // 2
    width = length - half + 1           # windows in a string
    for a, b, left, right in pieces(n, 2 * length):
        if right - left < length:
            continue
        hashes = Hashes(data, left, right)
        h = hashes.windows(half)
        least = _sliding(h, width, np.minimum)                      # by start
        m = len(least)
        padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        at = np.flatnonzero(_sliding(padded, width, np.maximum)[:len(h)] == h)
        # starts of each anchor: a smaller one takes over as soon as the string reaches it, others when the last drops out
        first = np.zeros(len(at) + 1, dtype=np.int64)
        first[1:-1] = np.where(h[at[1:]] < h[at[:-1]], at[1:] - width + 1, at[:-1] + 1)
        first[-1] = m
        first = np.maximum(np.minimum.accumulate(first[::-1])[::-1], 0)
        lo, hi = first[:-1], first[1:] - 1
        p = at + left
        own = (lo <= hi) & (p >= a) & (p < b)
        p, far, near = p[own], (at - lo)[own], (at - hi)[own]
        if len(p):
            yield p, near, far, h[at[own]], cell_hashes(hashes, p, np.zeros_like(p), np.full_like(p, width - 1), n, length)[1]


def cell_hashes(hashes: Hashes, p, near, far, n: int, length: int):
    """Hash of what the strings at distances near..far have in common, and of all that they cover (cut off at the ends)."""
    common = hashes.of(p - near, p - far + length)
    start, end = np.maximum(p - far, 0), np.minimum(p - near + length, n)
    cut = (start - (p - far)) * (2 * length) + (p - near + length - end)
    return common, _mixed(hashes.of(start, end) + cut.astype(np.uint64) * np.uint64(_BASE))


def _as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


_ROW = "a long, b int, p int, near short, far short, rank long, whole long"
_NAMES = ["a", "b", "p", "near", "far", "rank", "whole"]


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    """A 96-bit identity of each text (the rows of equal texts are one), and the text."""
    text = text_or_empty(df[text_col])
    return df.select(F.xxhash64(text).alias("a"), F.pmod(F.xxhash64(text, F.lit("second")), F.lit(1 << 31)).cast("int").alias("b"), text.alias("text"))


def _octets(batch, name: str):
    """The texts of a batch as byte arrays, without copying them into Python strings."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    for x in column:
        yield np.frombuffer(x.as_buffer(), dtype=np.uint8)


def _anchor_rows(length: int):
    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            out, size = [], 0
            for i, data in enumerate(_octets(batch, "text")):
                if len(data) >= length:
                    for p, near, far, rank, whole in anchors(data, length):
                        k = len(p)
                        out.append((np.full(k, a[i]), np.full(k, b[i], np.int32), p.astype(np.int32), near.astype(np.int16),
                                    far.astype(np.int16), rank.view(np.int64), whole.view(np.int64)))
                        size += k
                if out and (size > 200_000 or i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=_NAMES)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=_NAMES)
    return run


def _cell_rows(length: int, cell: int):
    """Rows of the cells of the open anchors of each text: ``open`` holds (p, near, far, rank, weight)."""
    widest = length - length // 2

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            out = []
            for i, data in enumerate(_octets(batch, "text")):
                opened = batch.column(3)[i].as_py()
                columns = [np.array([x[k] for x in opened], dtype=np.int64) for k in ("p", "near", "far", "rank", "weight")]
                for first, last, left, right in pieces(len(data), 2 * length):
                    here = (columns[0] >= first) & (columns[0] < last)
                    if here.any():
                        out.append((a[i], b[i], _cells(Hashes(data, left, right), len(data), length, cell, widest,
                                                       *(c[here] for c in columns))))
            if out:
                k = [len(c[0]) for _, _, c in out]
                cells = [np.concatenate(c) for c in zip(*(c for _, _, c in out), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([x[0] for x in out]), k)), pa.array(np.repeat(np.array([x[1] for x in out], np.int32), k)),
                     *(pa.array(c) for c in cells)], names=[*_NAMES, "weight"])
    return run


def _cells(hashes: Hashes, n: int, length: int, cell: int, widest: int, p, near, far, rank, weight):
    """The cells of some anchors: position, distances, new rank (of the pair: old rank, common string), cover, weight."""
    count = far // cell - near // cell + 1
    grid = np.repeat(near // cell, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    p, near, far, rank, weight = (np.repeat(x, count) for x in (p, near, far, rank, weight))
    low, high = grid * cell, np.minimum(grid * cell + cell - 1, widest)
    common, whole = cell_hashes(hashes, p, low, high, n, length)
    pair = _mixed(_mixed(rank.view(np.uint64) * np.uint64(31) + grid.astype(np.uint64)) ^ common)
    return (p.astype(np.int32), np.maximum(near, low).astype(np.int16), np.minimum(far, high).astype(np.int16),
            pair.view(np.int64), whole.view(np.int64), weight.astype(np.int32))


def _met(rows: DataFrame, facts: DataFrame, keys: list[str], count: str) -> list[DataFrame]:
    """``rows`` joined with ``facts`` (one row a key, ``count`` rows of it) in two parts: light keys by a shuffle, heavy ones by broadcast."""
    total = facts.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) > max(HEAVY_ROWS, total // HEAVY_SHARE)        # below HEAVY_SHARE keys
    few = F.broadcast(facts.filter(heavy))
    return [rows.join(few.select(*keys), keys, "left_anti").join(facts.filter(~heavy), keys), rows.join(few, keys)]


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ranked rows into (ranges of repeated starts, rows that go on)."""
    here = F.struct("a", "b", "p", "near")
    ranks = stored(rows.groupBy("rank").agg(F.count(F.lit(1)).alias("c"), F.sum("weight").alias("_all"), F.min("whole").alias("_lo"),
                                            F.max("whole").alias("_hi"))
                   .filter("_all > 1").select("rank", "c", (F.col("_lo") != F.col("_hi")).alias("several")))
    shared = None
    for part in _met(rows, ranks, ["rank"], "c"):
        part = part.drop("c")
        shared = part if shared is None else shared.unionByName(part)
    shared = stored(shared)
    same = stored(shared.groupBy("rank", "whole").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("c"), F.min(here).alias("stand_in")))
    judged = None
    for part in _met(shared, same, ["rank", "whole"], "c"):
        part = (part.select("a", "b", "p", "near", "far", "rank", "n", ((F.col("n") > 1) & (F.col("weight") == 1)).alias("found"),
                            (F.col("several") & (here == F.col("stand_in"))).alias("goes_on")).filter("found OR goes_on"))
        judged = part if judged is None else judged.unionByName(part)
    judged = stored(judged)
    found = judged.filter("found").select("a", "b", "p", "near", "far").distinct()
    further = (judged.filter("goes_on").select("a", "b", "p", "near", "far", "rank", F.when(F.col("n") > 1, 2).otherwise(1).alias("weight"))
               .distinct())
    return found, further


def _named(identities: DataFrame) -> Column:
    """Whether the text identity ``a`` may be among ``identities``: a filter of ``FILTER_BITS``, built by Spark, gathered as 64-bit words."""
    bit = F.col("a").bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("long"))
    words = (identities.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63).cast("long")).cast("int")).alias("one"))
             .groupBy("word").agg(F.bit_or("one").alias("bits")).toArrow())         # at most 2^20 rows of two numbers
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    mask = (1 << FILTER_BITS) - 1

    @F.pandas_udf("boolean")
    def named(a: pd.Series) -> pd.Series:
        at = a.to_numpy() & mask
        return pd.Series((bits[at >> 6] >> (at & 63)) & 1 == 1)

    return named(F.col("a"))


def repeated_starts(df: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """``a, b`` (identity of a text) and ranges ``first..last`` of its starts of repeated strings."""
    texts = _texts(df, text_col)
    sampled = stored(texts.filter(F.octet_length("text") >= length).mapInArrow(tidy(_anchor_rows(length)), _ROW))
    found, further = _settle(sampled.withColumn("weight", F.lit(1)))
    parts = [found]
    for cell in CELLS:
        further = stored(further)
        lists = further.groupBy("a", "b").agg(F.collect_list(F.struct("p", "near", "far", "rank", "weight")).alias("open"))
        opened = texts.filter(_named(further)).join(lists, ["a", "b"]).select("a", "b", "text", "open")
        rows = stored(opened.mapInArrow(tidy(_cell_rows(length, cell)), _ROW + ", weight int").distinct())
        found, further = _settle(rows)
        parts.append(found)
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.select("a", "b", (F.col("p") - F.col("far")).alias("first"), (F.col("p") - F.col("near")).alias("last"))


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, spans, kept`` of every row.

    ``spans`` are the maximal removed runs (start, end) in bytes, in order; ``kept`` is the
    rest as binary (a run may end inside a character).  Null and empty texts have 0 bytes,
    no spans and an empty ``kept``; texts shorter than ``length`` keep everything; two equal
    rows repeat each other.  Ids may be null or repeated; other columns are not read.  An
    empty table gives an empty result.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def merged_runs(batches):
        for batch in batches:
            spans = [[{"start": s, "end": e} for s, e in merge([(x["first"], x["last"] + length) for x in found.as_py()])]
                     for found in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, span)], names=["a", "b", "spans"])

    spans = stored(repeated_starts(df, length, text_col).groupBy("a", "b")
                   .agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("starts"))
                   .mapInArrow(tidy(merged_runs), "a long, b int, spans array<struct<start:long,end:long>>"))

    def run(batches):
        for batch in batches:
            sizes, cut, kept = [], [], []
            for data, found in zip(_octets(batch, "text"), batch.column(2), strict=True):
                runs = found.as_py() or []
                sizes.append(len(data))
                cut.append(runs)
                keep = zip([0, *(x["end"] for x in runs)], [*(x["start"] for x in runs), len(data)], strict=True)
                kept.append(b"".join(data[s:e].tobytes() for s, e in keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(cut, span), pa.array(kept, pa.binary())],
                                             names=[id_col, "n_bytes", "spans", "kept"])

    text = text_or_empty(df[text_col])
    docs = df.select(F.col(id_col).alias("__id"), text.alias("text"), F.xxhash64(text).alias("a"),
                     F.pmod(F.xxhash64(text, F.lit("second")), F.lit(1 << 31)).cast("int").alias("b"))
    none = F.array().cast(spans.schema["spans"].dataType)       # no nulls: Spark measures Arrow batches row by row, and walks the nulls of a list
    # texts without spans stay where they are; copies of one text meet its spans in several parts
    docs = docs.withColumn("named", _named(spans)).withColumn("salt", F.pmod(F.xxhash64("__id"), F.lit(FINAL_SALTS)).cast("int"))
    salted = spans.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(FINAL_SALTS)])))
    with_spans = (docs.filter("named").join(salted, ["a", "b", "salt"], "left").select("__id", "text", F.coalesce("spans", none).alias("spans"))
                  .unionByName(docs.filter("NOT named").select("__id", "text", none.alias("spans"))))
    return with_spans.select("__id", "text", "spans").mapInArrow(
        tidy(run), f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, "
             "spans array<struct<start:long,end:long>>, kept binary")


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted (start, end) runs with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for s, e in runs:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out
