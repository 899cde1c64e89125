"""Operators over whole tables, against brute force on small ones."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from maillake.llm import lines, mixing, neardup, shards, shingles, substrings, topk
from tests.llm.conftest import SCHEMA, prose, rows


def frame(spark, texts, source="s"):
    """Documents of these texts, with ids from 0."""
    return spark.createDataFrame([(i, t, "en", source if isinstance(source, str) else source[i], 0) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")


# ---- sharding

def test_a_new_shard_leaves_the_tree_as_it_is():
    for n in (1, 5, 19, 20, 39, 40):
        assert shards.tree(n + 1)[:n] == shards.tree(n)


def _race(doc_id, leaves):
    """The leaf with the earliest draw, each from XXH64 of the leaf's name and the key."""
    import math

    import xxhash

    def h(data, seed):
        return xxhash.xxh64(data, seed=seed).intdigest()

    key = h(str(doc_id).encode() if doc_id is not None else b"", 42)

    def draw(x):
        seed = 42
        for part in (x.region, x.rack, x.shard):
            seed = h(part.to_bytes(4, "little"), seed)
        return -math.log(((h(key.to_bytes(8, "little"), seed) >> 11) + 0.5) / (1 << 53)) / x.weight

    return min((x for x in leaves if x.weight > 0), key=draw).shard


def test_rows_are_where_the_earliest_draw_is(spark):
    ids = [*range(500), -7, None]
    docs = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    for weights in (None, [float(1 + i % 4) for i in range(23)]):
        got = {r["doc_id"]: r["shard"] for r in shards.assign(docs, 23, weights).collect()}
        assert got == {i: _race(i, shards.tree(23, weights)) for i in ids}


def test_slots_of_one_id_are_spread_over_tasks(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
        out = shards.assign(docs, 40).withColumn("task", F.spark_partition_id()).collect()
        assert len({r["shard"] for r in out}) == 1 and sorted(r["slot"] for r in out) == list(range(20_000))
        tasks = Counter(r["task"] for r in out)
        assert len(tasks) > 2 and max(tasks.values()) < 12_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_shards_slots_and_growth(spark, awkward, nothing):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("tëxt "), "id").alias("text"))
    got = shards.assign(docs, 40).collect()
    per = defaultdict(list)
    for r in got:
        text = f"tëxt {r['doc_id']}".encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
        assert r["grown_shard"] in (r["shard"], 40)
        assert (r["rack"], r["region"]) == (r["shard"] // 5, r["shard"] // 20)
        per[r["shard"]].append(r["slot"])
    assert len(per) == 40 and all(sorted(s) == list(range(len(s))) for s in per.values())
    assert 60 < min(map(len, per.values())) and max(map(len, per.values())) < 150
    moved = sum(r["grown_shard"] == 40 for r in got)
    assert 50 < moved < 160
    grown = {r["doc_id"]: r["shard"] for r in shards.assign(docs, 41).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in got)
    out = shards.assign(awkward, 40).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows())
    per = defaultdict(list)
    for r in out:
        per[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert shards.assign(nothing, 40).collect() == []


def test_weights_move_rows_only_into_or_out_of_the_changed_shard(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    base = {r["doc_id"]: r["shard"] for r in shards.assign(docs, 12).collect()}
    for weight in (3.0, 0.25, 0.0):
        w = [1.0] * 12
        w[4] = weight
        now = {r["doc_id"]: r["shard"] for r in shards.assign(docs, 12, w).collect()}
        changed = [(base[i], now[i]) for i in base if base[i] != now[i]]
        assert changed and all((b == 4) if weight > 1 else (a == 4) for a, b in changed)
        share = sum(s == 4 for s in now.values()) / 3000
        assert abs(share - weight / (11 + weight)) < 0.03


# ---- line de-duplication

def _dedup(docs, ratio, least):
    pages, seen = Counter(s for _, s, _ in docs), Counter()
    blank = lambda x: not x.strip(" \t\r")
    for _, s, t in docs:
        for x in {x.strip(" \t\r") for x in (t or "").split("\n") if not blank(x)}:
            seen[s, x] += 1
    out = []
    for i, s, t in docs:
        kept = None if t is None else "\n".join(x for x in t.split("\n") if blank(x) or not (
            seen[s, x.strip(" \t\r")] >= least and seen[s, x.strip(" \t\r")] > ratio * pages[s]))
        out.append((i, s, kept))
    return Counter(out)


@pytest.mark.parametrize("broadcast", [True, False])
def test_boilerplate_lines(spark, awkward, nothing, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(lines, "BROADCAST_LINES", -1)
    for ratio, least in ((0.1, 5), (0.1, 2), (0.5, 1)):
        got = lines.drop_boilerplate(awkward, F.col("source"), ratio=ratio, min_pages=least)
        assert got.columns == awkward.columns
        assert Counter((r["doc_id"], r["source"], r["text"]) for r in got.collect()) == _dedup([(r[0], r[3], r[1]) for r in rows()], ratio, least)
    assert lines.drop_boilerplate(nothing, F.col("source")).collect() == []


def test_ratio_is_the_hosts_own(spark):
    docs = frame(spark, ["menu \nown %d" % i for i in range(20)] + ["menu\nother %d" % i if i < 5 else "other %d" % i for i in range(60)],
                 ["small"] * 20 + ["large"] * 60)
    got = lines.drop_boilerplate(docs, F.col("source"), counts=("n_lines", "n_dropped")).groupBy("source").agg(F.sum("n_dropped").alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {"small": 20, "large": 0}      # 5 of 60 is under a tenth


# ---- mixing

def test_mixing_hits_targets_and_agrees_with_itself(spark):
    rng = np.random.default_rng(1)
    source = [["a", "b", "c", None, "hot", "é"][int(x)] for x in rng.choice(6, 1500, p=[.1, .1, .1, .1, .5, .1])]
    docs = frame(spark, ["w " * int(n) for n in rng.integers(0, 200, 1500)], source)
    got = mixing.copies(docs).collect()
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"] * r["n_rows"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full, level = 1.5 * sum(sizes.values()), set(), 0.0
    while True:
        level = (total - sum(2.0 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and 2.0 * sizes[s] < level * weight[s]}
        if not more:
            break
        full |= more
    taken = Counter()
    for r in got:
        want = 2.0 * sizes[r["source"]] if r["source"] in full else level * weight[r["source"]]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want) < 1e-6 * want
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"] * r["n_rows"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 200 for r in got)
    key = lambda r: (r["id"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.copies(docs.repartition(3)).collect()))


def test_pivotal_steps_keep_mass_and_expectation():
    for (s, p), (t, q) in itertools.product([(5.0, .3), (2.0, .9), (7.0, .5)], repeat=2):
        up, down = min(s * (1 - p), t * q), min(s * p, t * (1 - q))
        a, b = mixing._trade(s, p, t, q, 0.0), mixing._trade(s, p, t, q, 1 - 1e-12)
        for x, y in (a, b):
            assert abs(s * x + t * y - s * p - t * q) < 1e-6 and (x in (0, 1) or y in (0, 1))
        assert abs((a[0] * down + b[0] * up) / (up + down) - p) < 1e-6


def test_mix_takes_awkward_tables(spark, awkward, nothing):
    got = mixing.mix(awkward)
    assert got.columns == awkward.columns
    plan = Counter()
    for r in mixing.copies(awkward).collect():
        plan[r["id"], r["source"]] += r["copies"] * r["n_rows"]
    assert +plan == Counter((r["doc_id"], r["source"]) for r in got.collect())
    assert mixing.mix(nothing).collect() == [] and mixing.copies(nothing).collect() == []
    wordless = spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["target"] for r in mixing.copies(wordless).collect()} == {0.0}


# ---- near-duplicates

def _sets(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + min(width, len(w))]) for i in range(len(w) - min(width, len(w)) + 1)) if w else frozenset()


def _components(docs, width, percent):
    """Smallest id reachable, by row number."""
    sets = [_sets(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)].append(d)
    return [(d, len(sets[i]), min(least[root(i)], default=None)) for i, (d, _) in enumerate(docs)], [root(i) for i in range(len(docs))]


def _variants(seed, n, words, edits, copies):
    """Texts made from one by replacing some of its words."""
    rng = np.random.default_rng(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.choice(words, rng.integers(0, edits + 1), replace=False):
            w[k] = f"new{rng.integers(1_000_000)}"
        out += [" ".join(w)] * int(rng.integers(1, copies + 1))
    return out


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, width, percent):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "STAR_PART", 10)
    texts = _variants(1, 60, 100, 6, 2) + _variants(2, 25, 40, 3, 1) + _variants(3, 20, 12, 1, 1) + [prose(100 + i, 30) for i in range(30)]
    docs = list(enumerate(texts))[::-1]
    want, _ = _components(docs, width, percent)
    got = neardup.components(frame(spark, texts), width, percent).collect()
    assert Counter((r["id"], r["n_shingles"], r["component"]) for r in got) == Counter(want)
    assert len({c for _, _, c in want}) > 35


def test_long_pairs_exactly_at_the_threshold_are_linked(spark):
    """Sets of 185 000 shingles, 85 percent of their union in common: one false count would part them."""
    common = [f"c{i}" for i in range(170_002)]
    texts = [" ".join(common + [f"{side}{i}" for i in range(n)]) for side, n in (("a", 15_000), ("b", 15_000))]
    sets = [_sets(t, 3) for t in texts]
    assert 100 * len(sets[0] & sets[1]) == 85 * len(sets[0] | sets[1])
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in neardup.components(frame(spark, texts), 3, 85).collect()}
    assert got == {0: (185_000, 0), 1: (185_000, 0)}


def test_near_duplicates_of_awkward_tables(awkward, nothing):
    docs = [(r[0], r[1]) for r in rows()]
    want, group = _components(docs, 5, 80)
    got = neardup.components(awkward, 5, 80).collect()
    assert Counter((r["id"], r["n_shingles"], r["component"]) for r in got) == Counter(want)
    kept = neardup.keep_one(awkward)
    assert kept.columns == awkward.columns
    left = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    chosen = {}
    for (d, t), g, (_, n, _) in zip(docs, group, want, strict=True):
        name = (g if n else (d, t, "wordless"))
        chosen.setdefault(name, []).append((d is None, d, t))
    wordless = Counter((d, t) for (d, t), (_, n, _) in zip(docs, want, strict=True) if not n)
    best = Counter()
    for name, members in chosen.items():
        if not (isinstance(name, tuple)):
            assert sum(left[d, t] for d, t in {(d, t) for _, d, t in members}) == 1
            first = min(members, key=lambda m: (m[0], m[1] or 0))
            assert any(left[d, t] for none, d, t in members if (none, d) == first[:2])
            best.update(())
    assert all(left[k] == n for k, n in wordless.items())
    assert neardup.components(nothing, 5, 80).collect() == [] and neardup.keep_one(nothing).collect() == []


def test_keys_meet_within_the_guaranteed_distance():
    rng = np.random.default_rng(5)
    for m in (3, 13, 15):
        a = rng.integers(0, 2 ** 16, (200, shingles.SYMBOLS)).astype(np.uint16)
        b = a.copy()
        for row in b:
            row[rng.choice(shingles.SYMBOLS, 2 * m - 1, replace=False)] += 1
        ka, kb = shingles.keys(a, m), shingles.keys(b, m)
        assert (ka == kb).any(axis=1).all()
        both = np.concatenate([a, b])
        first = neardup._first_common(both, m, np.arange(200), np.arange(200, 400))
        numbers = [n * 1000 + j for n, (x, y) in enumerate(shingles.chunks(m)) for j in range(y - x)]
        assert [numbers[int((x == y).argmax())] for x, y in zip(ka, kb, strict=True)] == first.tolist()


def test_signatures_estimate_similarity():
    a, b = (np.unique(shingles.mixed(np.arange(s, s + 2000, dtype=np.uint64))) for s in (0, 400))
    same = np.mean(shingles.signature(a, 400) == shingles.signature(b, 400))
    assert abs(same - 1600 / 2400) < 0.08
    assert shingles.chunk_count(0.85) < shingles.chunk_count(0.8) <= 16


# ---- exact top-k

def test_top_k_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    rng = np.random.default_rng(2)
    x = rng.normal(0, .2, (400, 6)).astype(np.float32)
    x[100:200] = x[100]                 # one very common vector: ties
    x[300:] = x[300:] * .05 + 3         # a far cluster
    data = [(i, x[i].tolist(), 0) for i in range(400)]
    data += [(1000, None, 0), (1020, [None] * 6, 0), (1040, [float("nan")] * 6, 0), (1060, [float("inf")] * 6, 0), (1080, [], 0), (None, [1.0] * 6, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in topk.Index(topk.whole_numbers(df)).search(F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    v = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    assert set(got) == set(range(0, 400, 20))
    for q in got:
        s = v @ v[q]
        best = sorted((-int(s[i]), i) for i in range(400) if i != q)[:20]
        assert got[q] == [(k + 1, i, -n) for k, (n, i) in enumerate(best)]
    few = topk.Index(topk.whole_numbers(df.filter("vec_id < 3"))).search(F.col("id") % 20 == 0, 20).collect()
    assert {r["vec_id"] for r in few} == {1, 2}
    assert topk.Index(topk.whole_numbers(df.limit(0))).search(F.col("id") % 20 == 0, 20).collect() == []


def test_top_k_of_repeated_rows(spark, monkeypatch):
    """Every query row has a list of its own, whatever other rows have its id or its vector."""
    monkeypatch.setattr(topk, "BLOCK", 40)
    rng = np.random.default_rng(5)
    v = rng.integers(-40, 40, (200, 5))
    ids = list(range(200))
    ids[150:160], v[150:160] = ids[20:21] * 10, v[20]       # a query row repeated as a whole
    ids[160:163] = [40, 40, 60]                             # other vectors under query ids
    ids[170:180], v[170:180] = [7] * 10, v[7]               # a candidate repeated
    df = spark.createDataFrame([(i, (x / 64).tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    got = topk.Index(topk.whole_numbers(df)).search(F.col("id") % 20 == 0, 20).collect()
    want = Counter()
    for q in range(200):
        if ids[q] % 20 == 0:
            best = sorted((-int(v[i] @ v[q]), ids[i]) for i in range(200) if i != q)[:20]
            want.update((ids[q], k + 1, i, -n) for k, (n, i) in enumerate(best))
    assert Counter(map(tuple, got)) == want


def test_top_k_of_large_components(spark, monkeypatch):
    """No finite vector is left out, and no sum is rounded; what 64 bits cannot hold is an error."""
    monkeypatch.setattr(topk, "BLOCK", 40)
    v = np.random.default_rng(6).integers(-90, 90, (300, 4)).astype(np.float64)
    v[40:60] += [2.0 ** 33, 0, 0, 0]                                            # inner products of about 2^66 among them, but ...
    v[40:60] *= np.where(np.arange(20)[:, None] == 0, 1, [2.0 ** -9, 1, 1, 1])  # ... 2^57 and less
    v[40:60] = np.floor(v[40:60])
    v[100:110, 1] = -(2.0 ** 70)                                                # far down in every list, unless they meet
    v[::20, 1] = np.abs(v[::20, 1])
    v[100] = [5, 5, 5, 5]

    def search(rows):
        df = spark.createDataFrame([(i, (np.asarray(x) / 64).tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
        return topk.Index(topk.whole_numbers(df)).search(F.col("id") % 20 == 0, 20).collect()

    whole = [[int(c) for c in x] for x in v]
    want = set()
    for q in range(0, 300, 20):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in range(300) if i != q)[:20]
        want.update((q, k + 1, i, -n) for k, (n, i) in enumerate(best))
    assert {tuple(r) for r in search(v)} == want and max(n for *_, n in want) > 2 ** 53
    assert any(i in range(40, 60) for _, _, i, _ in want)
    for other in (2.0 ** 40, -(2.0 ** 40)):
        with pytest.raises(Exception, match="64-bit numbers"):
            search([[2.0 ** 40], [other], [0.0]])


def test_top_k_refuses_vectors_of_different_lengths(spark):
    df = spark.createDataFrame([(i, [1.0] * (3 if i == 7 else 4)) for i in range(50)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="different lengths"):
        topk.Index(topk.whole_numbers(df))


def test_rings_are_skipped_where_the_bound_allows(spark):
    x = np.concatenate([np.tile([0.0, 0.0], (500, 1)), np.tile([9.0, 9.0], (500, 1))]) + np.random.default_rng(0).normal(0, .01, (1000, 2))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    index = topk.Index(topk.whole_numbers(df))
    query = index.rows.filter("id = 520").withColumn("beat", F.lit(600 * 600).cast("long")).select("id", "vec", "cell", "ring", "beat")
    assert query.mapInArrow(index._visits(False), "id long, vec binary, cell int, ring int, block int, beat long").count() < len(index.rings)


# ---- repeated byte strings

def _cut(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        spans = substrings.merge([(i, i + length) for i in range(len(d) - length + 1) if seen[d[i:i + length]] > 1])
        gone = {j for s, e in spans for j in range(s, e)}
        out.append((len(d), spans, bytes(b for j, b in enumerate(d) if j not in gone)))
    return out


@pytest.mark.parametrize("length, piece", [(400, 1 << 20), (64, 1 << 20), (64, 500)])
def test_repeats_are_those_of_every_position(spark, monkeypatch, length, piece):
    monkeypatch.setattr(substrings, "PIECE", piece)
    rng = np.random.default_rng(4)
    shared, other = prose(9, 90), "é東" * 150 + prose(10, 60)
    texts = [prose(200 + i, int(rng.integers(5, 300))) for i in range(25)]
    for i in range(0, 25, 2):
        at = int(rng.integers(0, len(texts[i])))
        texts[i] = texts[i][:at] + shared[int(rng.integers(0, 60)):len(shared) - int(rng.integers(0, 60))] + texts[i][at:]
    texts += [other, "x" + other[3:], other[:200] + "!" + other[201:], other, "a" * 2000, "ab" * 700, "he " * 300, "abc" * 300 + shared, None, "", shared[:length],
              shared[:length - 1], prose(77, 200) + "\n" + prose(77, 200)]
    texts += _variants(6, 8, 120, 4, 2)
    got = {r["doc_id"]: (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"]))
           for r in substrings.remove_repeats(frame(spark, texts), length).collect()}
    for i, want in enumerate(_cut(texts, length)):
        assert got[i] == want, i


def test_repeats_in_awkward_tables(awkward, nothing, monkeypatch):
    for limit in (substrings.HEAVY_ROWS, 0):       # light and heavy ranks
        monkeypatch.setattr(substrings, "HEAVY_ROWS", limit)
        got = Counter((r["doc_id"], hashlib.sha256(r["kept"]).hexdigest()) for r in substrings.remove_repeats(awkward).collect())
        want = _cut([r[1] for r in rows()], 400)
        assert got == Counter((r[0], hashlib.sha256(w[2]).hexdigest()) for r, w in zip(rows(), want, strict=True))
        assert substrings.remove_repeats(nothing).collect() == []


# ---- pipeline

def test_pipeline_stages_against_the_operators_brute_force(spark):
    import corpus_pipeline
    from maillake.llm import bpe

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf).checkpoint())
        if name != "tokenize":
            assert kept[-1].columns == columns
    raw, good, lined, near, mixed, tokens = ([r.asDict() for r in k.collect()] for k in kept)
    assert {r["doc_id"] for r in good} <= {r["doc_id"] for r in raw} and len(good) > 0.7 * len(raw)
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in lined) == _dedup([(r["doc_id"], r["source"], r["text"]) for r in good], 0.1, 5)
    assert all(r["n_chars"] == len(r["text"]) for r in lined)
    want, _ = _components([(r["doc_id"], r["text"]) for r in lined], 5, 80)
    assert {r["doc_id"] for r in near} == {d for d, n, c in want if d == c} and len(near) == len({r["doc_id"] for r in near})
    taken = Counter(r["doc_id"] for r in mixed)
    assert set(taken.values()) <= {1, 2} and set(taken) <= {r["doc_id"] for r in near}
    import public_tokenizers as P
    enc = bpe.encoder(bpe.read_ranks(P.path(corpus_pipeline.RANK_FILE)), P.PATTERN)
    ids = {r["doc_id"]: enc.encode_ordinary(r["text"]) for r in mixed}
    assert Counter(r["doc_id"] for r in tokens) == taken
    assert all(bytes(r["ids_le"]) == np.array(ids[r["doc_id"]], "<u4").tobytes() and r["n_tokens"] == len(ids[r["doc_id"]]) for r in tokens)
    assert corpus_pipeline.run(spark, sf).count() == len(tokens)


def test_pipeline_takes_awkward_tables(spark, awkward, nothing, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)).checkpoint()
            assert name == "tokenize" or docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
