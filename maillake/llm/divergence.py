"""Source divergence audit over a vocabulary held as minimal acyclic transducers.

1. One pass over the texts counts in how many documents of its language each term stands; terms
   in at least ``MIN_DOCS`` are kept and sorted (range partitions, then within each).
2. Each task builds minimal acyclic transducers from its sorted stretch: a state is made once for all
   equal endings, and each step adds the number of terms that sort before, so reading a term gives
   its ordinal.  A block is a transducer of up to ``BLOCK_TERMS`` consecutive terms of one language.
3. Texts are streamed through the transducers and recounted: (language, source, ordinal, count).
   Blocks go to the tasks in packs of at most ``PACK_BYTES``, and the texts are read once a pack,
   so a task's memory is bounded whatever the vocabulary.
4. Groups are compared in tiles of 4,096 ordinals x 128 x 128 sources, each a small dense matrix in
   numpy, which returns one partial sum for each pair of sources.  No row is made for a pair of
   sources and a term.  All arithmetic is on integers.
5. Ties among terms go by ordinal, and winners are spelled out from their ordinals.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maillake.llm.blocks import dealt, in_blocks
from maillake.llm.common import stored, text_or_empty, tidy

MIN_DOCS = 10
TOP_TERMS = 10
BLOCK_TERMS = 1 << 16
PACK_BYTES = 64 << 20
TILE_TERMS_BITS = 12
TILE_SOURCES_BITS = 7
TOP_PARTS = 64                  # hashed parts of a group ranked apart before its last ranking
SCALE = 1_000_000_000

#: Letters and all bytes of non-ASCII characters stay (A-Z in lower case), every other byte is a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(octets: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of letters A-Z (lower-cased) and of characters beyond ASCII."""
    return octets.translate(_LETTERS).split()


class Builder:
    """A minimal acyclic transducer from terms in ascending order.

    The states along the last term are open; the part that the next term does not share is closed: a closed
    state equal to an earlier one (same end mark, same steps) is that one.
    """

    def __init__(self):
        self.states: dict[tuple, int] = {}
        self.closed: list[tuple[bool, tuple[tuple[int, int], ...], int]] = []      # end mark, (byte, state), terms below
        self.open: list[list] = [[False, []]]                                      # end mark, [byte, state or None]
        self.last = b""

    def add(self, term: bytes) -> None:
        shared = 0
        while shared < min(len(term), len(self.last)) and term[shared] == self.last[shared]:
            shared += 1
        self._close(shared)
        for byte in term[shared:]:
            self.open[-1][1].append([byte, None])
            self.open.append([False, []])
        self.open[-1][0] = True
        self.last = term

    def _close(self, depth: int) -> None:
        while len(self.open) > depth + 1:
            ends, steps = self.open.pop()
            state = (ends, tuple(map(tuple, steps)))
            at = self.states.get(state)
            if at is None:
                at = self.states[state] = len(self.closed)
                self.closed.append((*state, ends + sum(self.closed[t][2] for _, t in state[1])))
            self.open[-1][1][-1][1] = at

    def pack(self) -> bytes:
        """The states as int32 arrays: number of states; first step of each state; byte, target and output of each step; ends."""
        self._close(0)
        ends, steps = self.open[0]
        rows = [*((e, s) for e, s, _ in self.closed), (ends, tuple(map(tuple, steps)))]     # the root is last
        first, byte, target, output = [0], [], [], []
        for end, out in rows:
            before = int(end)
            for b, t in out:
                byte.append(b)
                target.append(t)
                output.append(before)
                before += self.closed[t][2]
            first.append(len(byte))
        parts = [[len(rows), len(byte)], first, byte, target, output, [int(e) for e, _ in rows]]
        return np.concatenate([np.array(p, dtype="<i4") for p in parts]).tobytes()


class Transducer:
    """Reads terms as their ordinals, and an ordinal as its term."""

    def __init__(self, data: bytes):
        flat = np.frombuffer(data, dtype="<i4").astype(np.int64)
        states, steps = flat[:2]
        self.root = int(states) - 1
        self.first = flat[2:3 + states]
        byte, self.target, self.output, ends = (flat[a:b] for a, b in zip(
            3 + states + np.array([0, steps, 2 * steps, 3 * steps]), 3 + states + np.array([steps, 2 * steps, 3 * steps, 3 * steps + states])))
        self.ends = ends.astype(bool)
        self.key = np.repeat(np.arange(states) << 8, np.diff(self.first)) + byte       # ascending: steps are in order of state and byte

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """The place of each term among the terms, from 0; -1 for what is none of them.  All terms advance by one byte at a time."""
        octets = np.frombuffer(b"".join(terms), dtype=np.uint8)
        length = np.fromiter(map(len, terms), dtype=np.int64, count=len(terms))
        start = np.cumsum(length) - length
        total, out = np.zeros(len(terms), dtype=np.int64), np.full(len(terms), -1, dtype=np.int64)
        state, on, depth = np.full(len(terms), self.root), np.arange(len(terms)), 0
        while len(on):
            done = length[on] == depth
            ended = on[done]
            good = self.ends[state[ended]]
            out[ended[good]] = total[ended[good]]
            on = on[~done]
            key = (state[on] << 8) + octets[start[on] + depth]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            found = self.key[at] == key if len(self.key) else np.zeros(len(on), dtype=bool)
            on, at = on[found], at[found]
            total[on] += self.output[at]
            state[on] = self.target[at]
            depth += 1
        return out

    def term(self, ordinal: int) -> bytes:
        """The term at a place."""
        state, out = self.root, bytearray()
        while not (self.ends[state] and ordinal == 0):
            lo, hi = self.first[state], self.first[state + 1]
            i = lo + np.searchsorted(self.output[lo:hi], ordinal, "right") - 1
            out.append(self.key[i] & 255)
            ordinal -= self.output[i]
            state = self.target[i]
        return bytes(out)


class Vocabulary:
    """The transducers of a pack: blocks (lang, first term, base ordinal, number of terms, data)."""

    def __init__(self, blocks):
        self.langs: dict[str, tuple[list[bytes], list[int], list[int], list[Transducer]]] = {}
        for lang, first, base, n, data in sorted(blocks, key=lambda x: (x[0], x[2])):
            for have, x in zip(self.langs.setdefault(lang, ([], [], [], [])), (bytes(first), base, n, Transducer(data)), strict=True):
                have.append(x)

    def ordinals(self, lang: str, terms: list[bytes]) -> np.ndarray:
        """The ordinal of each term in its language; -1 for what the pack has not."""
        firsts, bases, _, made = self.langs[lang]
        block = np.array([bisect_right(firsts, t) - 1 for t in terms]) if len(firsts) > 1 else np.zeros(len(terms), dtype=np.int64)
        out = np.full(len(terms), -1, dtype=np.int64)
        for i in np.unique(block[block >= 0]):
            here = np.flatnonzero(block == i)
            at = made[i].ordinals([terms[k] for k in here])
            out[here] = np.where(at < 0, -1, at + bases[i])
        return out

    def term(self, lang: str, ordinal: int) -> str | None:
        """The term of an ordinal, if the pack has it."""
        _, bases, sizes, made = self.langs.get(lang, ((), (), (), ()))
        i = bisect_right(bases, ordinal) - 1
        return made[i].term(ordinal - bases[i]).decode() if i >= 0 and ordinal - bases[i] < sizes[i] else None


def _rows(df: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return df.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"),
                     text_or_empty(text_col).cast("binary").alias("text"))


def _documents_per_term(batches):
    for batch in batches:
        seen: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            seen[lang].update(set(terms(text.as_buffer().to_pybytes())))
        for lang, counts in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()),
                                              pa.array(list(counts.values()), pa.int64())], names=["lang", "term", "n"])


def kept_terms(rows: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term`` (binary): the terms that stand in at least ``min_docs`` documents of their language."""
    found = rows.mapInArrow(tidy(_documents_per_term), "lang string, term binary, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")


def _build(block_terms: int):
    def run(batches):
        lang, first, made, n = None, None, None, 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([first], pa.binary()), pa.array([n], pa.int64()),
                                               pa.array([made.pack()], pa.binary())], names=["lang", "first", "n", "data"])

        for batch in batches:
            for at, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n and (at != lang or n == block_terms):
                    yield block()
                    n = 0
                if n == 0:
                    lang, first, made = at, term, Builder()
                made.add(term)
                n += 1
        if n:
            yield block()
    return run


def vocabulary(kept: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``lang, first, base, n, data``: the transducers of sorted stretches, with the ordinal of their first terms."""
    ordered = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    made = stored(ordered.mapInArrow(tidy(_build(block_terms)), "lang string, first binary, n long, data binary"))
    earlier = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    bases = made.select("lang", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))     # a row a block
    return stored(made.join(bases, ["lang", "first"]).select("lang", "first", "base", "n", "data"))


def packs(blocks: DataFrame, pack_bytes: int = PACK_BYTES):
    """Blocks in lists of at most ``pack_bytes`` (one block at least), one list at a time on the driver.

    A block of 65,536 terms is a few MB at most; the driver also holds one short row a block.
    """
    sizes = blocks.select("lang", "base", F.octet_length("data").alias("bytes")).orderBy("lang", "base").collect()
    pack, size = [], 0
    for r in [*sizes, None]:
        if pack and (r is None or size + r["bytes"] > pack_bytes):
            (lang, base), (last_lang, last) = pack[0], pack[-1]
            from_first = (F.col("lang") > lang) | ((F.col("lang") == lang) & (F.col("base") >= base))
            to_last = (F.col("lang") < last_lang) | ((F.col("lang") == last_lang) & (F.col("base") <= last))
            yield [tuple(x) for x in blocks.filter(from_first & to_last).collect()]
            pack, size = [], 0
        if r is not None:
            pack.append((r["lang"], r["base"]))
            size += r["bytes"]


def _recount(blocks):
    def run(batches):
        known = Vocabulary(blocks)
        for batch in batches:
            seen: dict[tuple[str, str], Counter] = defaultdict(Counter)
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if lang in known.langs:
                    seen[lang, source].update(terms(text.as_buffer().to_pybytes()))
            for lang in {lang for lang, _ in seen}:
                groups = [(source, counts) for (at, source), counts in seen.items() if at == lang]
                distinct = list(set().union(*(counts for _, counts in groups)))
                ordinal = dict(zip(distinct, known.ordinals(lang, distinct).tolist(), strict=True))
                for source, counts in groups:
                    at = np.fromiter(map(ordinal.__getitem__, counts), dtype=np.int64, count=len(counts))
                    n = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                    at, n = at[at >= 0], n[at >= 0]
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(at)), pa.repeat(pa.scalar(source), len(at)),
                                                      pa.array(at), pa.array(n)], names=["lang", "source", "ordinal", "n"])
    return run


def recount(rows: DataFrame, blocks: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """``lang, source, ordinal, n``: occurrences of the kept terms in every group, above 0."""
    schema = "lang string, source string, ordinal long, n long"
    found = None
    for pack in packs(blocks, pack_bytes):
        part = stored(rows.mapInArrow(tidy(_recount(pack)), schema).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")))
        found = part if found is None else found.unionByName(part)
    return rows.sparkSession.createDataFrame([], schema) if found is None else found


#: Counts up to which 10^9 (count + 2) stays below 2^63; larger ones are reckoned in decimals or Python's whole numbers.
PLAIN_COUNT = (1 << 63) // SCALE - 3


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), on whole numbers."""
    above, below = count + F.lit(2), total + F.lit(2) * kept
    plain = F.call_function("div", above * F.lit(SCALE), below)
    wide = F.call_function("div", above.cast("decimal(38,0)") * F.lit(SCALE).cast("decimal(10,0)"), below.cast("decimal(38,0)"))
    return F.lit(1).cast("long") + F.when(count <= PLAIN_COUNT, plain).otherwise(wide)


def shares(count: np.ndarray, below: np.ndarray) -> np.ndarray:
    """``share`` of numpy counts; ``below`` is total + 2 kept."""
    if len(count) and count.max() > PLAIN_COUNT:
        return np.array([1 + (int(c) + 2) * SCALE // int(b) for c, b in zip(count, below)], dtype=np.int64)
    return 1 + (count + 2) * SCALE // below


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); below 2^63, as shares are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _tile_sums(batches):
    """Sums of ``gap`` over the terms of each tile, for pairs of sources with the smaller number first."""
    width, mask = 1 << TILE_TERMS_BITS, (1 << TILE_SOURCES_BITS) - 1
    for tile in in_blocks(batches, ["lang", "t", "a", "b"], "number"):
        head, rows = tile.slice(0, 1).to_pylist()[0], tile.slice(1)
        number, place, n = (rows[c].to_numpy() for c in ("number", "place", "n"))
        dense = {}
        for s in ("a", "b"):
            below = np.array(json.loads(head["below_" + s]), dtype=np.int64)        # of each source of the block
            full = np.repeat(shares(np.zeros(len(below), dtype=np.int64), below)[:, None], min(width, head["n_terms"]), axis=1)
            own = number >> TILE_SOURCES_BITS == head[s]
            at = number[own] & mask
            full[at, place[own]] = shares(n[own], below[at])
            dense[s] = full
        first, second, value = [], [], []
        for i, x in enumerate(dense["a"]):
            start = i + 1 if head["a"] == head["b"] else 0
            other = dense["b"][start:]
            d = other - x
            value.append((d * d // (other + x)).sum(axis=1))
            first.append(np.full(len(other), (head["a"] << TILE_SOURCES_BITS) + i))
            second.append((head["b"] << TILE_SOURCES_BITS) + start + np.arange(len(other)))
        i, j, v = (np.concatenate(x).astype(np.int64) for x in (first, second, value))
        yield pa.RecordBatch.from_arrays([pa.array([head["lang"]] * len(i), pa.string()), pa.array(i), pa.array(j), pa.array(v)],
                                         names=["lang", "i", "j", "value"])


def _pairs(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """``lang, i, j, value`` for the numbered sources of each language, i < j."""
    each = F.sort_array(F.collect_list(F.struct("number", (F.col("total") + 2 * F.col("kept")).alias("below"))))
    by_block = groups.groupBy("lang", F.shiftright("number", TILE_SOURCES_BITS).alias("s")).agg(
        F.to_json(F.transform(each, lambda x: x["below"])).alias("below"), F.first("kept").alias("kept"))
    a = by_block.select("lang", "kept", F.col("s").alias("a"), F.col("below").alias("below_a"))
    b = by_block.select("lang", F.col("s").alias("b"), F.col("below").alias("below_b"))
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("kept") - 1, TILE_TERMS_BITS)))
    headers = (a.filter("kept > 0").join(b, "lang").filter("a <= b").withColumn("t", stretch)
               .withColumn("n_terms", F.col("kept") - F.shiftleft("t", TILE_TERMS_BITS)).withColumn("number", F.lit(-1)).drop("kept"))
    # a count belongs to the tiles of its own block of sources with every block of its language
    own = F.shiftright("number", TILE_SOURCES_BITS)
    spread = (counts.withColumn("o", F.explode(F.sequence(F.lit(0), F.shiftright(F.col("sources") - 1, TILE_SOURCES_BITS).cast("int"))))
              .select("lang", F.shiftright("ordinal", TILE_TERMS_BITS).alias("t"), F.least(own, "o").alias("a"), F.greatest(own, "o").alias("b"),
                      "number", F.col("ordinal").bitwiseAND((1 << TILE_TERMS_BITS) - 1).cast("int").alias("place"), "n"))
    sums = dealt(headers, spread, ["lang", "t", "a", "b"], "number").mapInArrow(tidy(_tile_sums), "lang string, i long, j long, value long")
    return sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def _spelled(blocks):
    def run(batches):
        known = Vocabulary(blocks)
        for batch in batches:
            item = [known.term(lang, at) for lang, at in zip(batch["lang"].to_pylist(), batch["ordinal"].to_pylist(), strict=True)]
            names = [n for n in batch.schema.names if n != "ordinal"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(item, pa.string())], names=[*names, "item"])
    return run


def audit(df: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source",
          text_col: str = "text", block_terms: int = BLOCK_TERMS, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source's use of words is from other sources and its language.

    With p and q the smoothed shares of a term (``share``), part ``pair`` sums ``gap`` over all kept terms for every other
    source of the language; part ``term`` lists the ``top`` kept terms that the source uses more than its language does.
    Null language, source and text count as ''.  Every (language, source) that occurs has its pairs, also without a
    term; a language without kept terms has pairs of value 0 and no terms.  Repeated rows count each.  Other columns are not
    read.  An empty table gives an empty result.
    """
    rows = _rows(df, lang_col, source_col, text_col)
    blocks = vocabulary(kept_terms(rows, min_docs), block_terms)
    counts = recount(rows, blocks, pack_bytes)

    by_source = Window.partitionBy("lang").orderBy("source")
    names = (rows.select("lang", "source").distinct()       # a row a group
             .withColumn("number", F.row_number().over(by_source) - 1)
             .withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang"))))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = blocks.groupBy("lang").agg(F.sum("n").alias("kept"))
    groups = (names.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", "number", "sources", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")))
    groups = stored(groups.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang"))))
    of_group = counts.join(groups, ["lang", "source"])

    one_way = stored(_pairs(groups, of_group))
    both = one_way.unionByName(one_way.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    a, b = (groups.select("lang", F.col("number").alias(x), F.col("source").alias(y)) for x, y in (("i", "source"), ("j", "item")))
    compared = groups.filter("kept = 0").select("lang", F.col("number").alias("i"), F.explode(F.sequence(F.lit(0), F.col("sources").cast("int") - 1)).alias("j"),
                                                F.lit(0).cast("long").alias("value")).filter("i <> j")
    pairs = both.unionByName(compared).join(a, ["lang", "i"]).join(b, ["lang", "j"])
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    everywhere = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("in_lang"))
    used = (of_group.join(everywhere, ["lang", "ordinal"])
            .withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
            .withColumn("q", share(F.col("in_lang"), F.col("lang_total"), F.col("kept"))).filter("p > q")
            .select("lang", "source", "ordinal", gap(F.col("p"), F.col("q")).alias("value"), F.pmod("ordinal", F.lit(TOP_PARTS)).alias("part_no")))
    best = [F.desc("value"), F.col("ordinal")]
    few = used.withColumn("r", F.row_number().over(Window.partitionBy("lang", "source", "part_no").orderBy(*best))).filter(F.col("r") <= top)
    few = stored(few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best))).filter(F.col("rank") <= top)
                 .select("lang", "source", F.lit("term").alias("part"), "ordinal", "value", "rank"))
    out = pairs
    for pack in packs(blocks, pack_bytes):
        spelled = few.mapInArrow(tidy(_spelled(pack)), "lang string, source string, part string, value long, rank int, item string")
        out = out.unionByName(spelled.filter("item IS NOT NULL"))
    return out
