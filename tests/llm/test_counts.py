"""Token counts, manifest and divergence audit against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from maillake.llm import divergence, manifest, tokencount
from tests.llm.conftest import prose, rows


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    return tokencount.read_tokenizer(path), Tokenizer.from_file(path)


def test_counts_are_the_librarys(awkward, nothing, tokenizer):
    data, library = tokenizer
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows())
    assert Counter(tuple(r) for r in tokencount.count(awkward, data).collect()) == want
    assert tokencount.count(nothing, data).collect() == []


def test_counts_of_odd_strings(tokenizer):
    data, library = tokenizer
    c, rnd = tokencount.Counter(data, tokencount.library_classes()), random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "é", "東", "՘", "࢏", "̀", "1", "²", "'s", "'", "<|endoftext|>", "<|endof", " ",
             "\u0085", "\x1c", "🙂", "!", "　", "the", "﻿", "​"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 100_000, "ab" * 50_000, "x1" * 30_000, "東京" * 30_000, " " * 100_000, "<|endoftext|>" * 5000, "word " * 100_000]
    assert [c.text(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_the_table_of_known_pieces_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 50)
    c = tokencount.Counter(tokenizer[0], "")
    text = prose(3, 2000)
    assert c.text(text) == len(tokenizer[1].encode(text).ids) and len(c.known) <= 50


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _code(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _lower(t):
    return None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)


def _tree(leaves):
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for path, w in zip(paths, at):
            a = w // 16 * 16
            path.append(("".join(level[a:w]), "".join(level[w + 1:a + 16])))
        level, at = [_h(*level[i:i + 16]) for i in range(0, len(level), 16)], [w // 16 for w in at]
    return level[0], paths


def _manifest(table):
    """(id, leaf, subroot, root, proof, folded root, verified) of rows (id, source, lang, n, text)."""
    groups = defaultdict(list)
    for r in table:
        groups[r[1]].append((r, _h(*map(_code, r))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = []
    for s in order:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        tops.append(_tree([leaf for _, leaf in groups[s]]))
    root, above = _tree([t for t, _ in tops]) if tops else (None, [])
    for s, (top, paths), rest in zip(order, tops, above):
        for (r, leaf), path in zip(groups[s], paths):
            path = path + rest
            now = _h(*map(_code, (*r[:4], _lower(r[4])))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf
            for a, b in path:
                now = _h(a, now, b)
            yield r[0], leaf, top, root, _h(*(a + b for a, b in path)), now, now == root


def _proved(df):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    now = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, manifest.leaf_digest(*fields, F.translate("text", upper, upper.lower())))
    got = manifest.prove(df, manifest.leaf_digest(*fields, F.col("text")), now)
    s = F.col("siblings")
    return Counter(tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof_text(s), 256),
                                                manifest.folded(s, F.col("claimed")).alias("f"), F.col("root") == F.col("f")).collect())


def test_manifest_of_the_awkward_table(awkward, nothing):
    assert _proved(awkward) == Counter(_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows()]))
    assert not _proved(nothing)


@pytest.mark.parametrize("groups", [1, 20, 300])
def test_manifest_over_several_stored_levels(spark, groups):
    """A group that holds two thirds of the rows, beyond one block; many groups, beyond one run."""
    table = [(i, "hot" if i % 3 else f"s{i % groups}", None, i, f"Text {i}") for i in range(9000)]
    df = spark.createDataFrame(table, "doc_id long, source string, lang string, n_chars long, text string")
    assert _proved(df) == Counter(_manifest(table))


def test_manifest_of_single_leaves(spark):
    for table in ([(1, None, None, None, "X")], [(i, f"s{i}", "x", 1, "A") for i in range(40)]):
        df = spark.createDataFrame(table, "doc_id long, source string, lang string, n_chars long, text string")
        assert _proved(df) == Counter(_manifest(table))


def test_few_levels_are_stored(spark):
    n = 5000
    leaves = spark.range(n).select(F.lit("g").alias("k"), F.col("id").alias("pos"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("h"))
    trees = manifest.grow(leaves, leaves.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    assert [x.count() for x in trees.levels] == [n, 2, 1]
    assert trees.tops().first()["h"].hex() == _tree([_h(str(i)) for i in range(n)])[0]


_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _audit(table, min_docs, top=10):
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in table:
        found = _TERM.findall(_lower(text or ""))
        seen[lang or ""].update(set(found))
        counts[lang or "", source or ""].update(found)
    for lang in seen:
        kept = sorted((t for t, n in seen[lang].items() if n >= min_docs), key=str.encode)
        sources = sorted((s for a, s in counts if a == lang), key=str.encode)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}

        def shares(n, total):
            return [1 + 10 ** 9 * (n(t) + 2) // (total + 2 * len(kept)) for t in kept]

        p = {s: shares(lambda t: counts[lang, s][t], total[s]) for s in sources}
        q = shares(lambda t: sum(counts[lang, s][t] for s in sources), sum(total.values()))

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s in sources:
            pairs = sorted((-sum(map(f, p[s], p[o])), o.encode(), o) for o in sources if o != s)
            words = sorted((-f(x, y), t.encode(), t) for x, y, t in zip(p[s], q, kept) if counts[lang, s][t] and x > y)[:top]
            for part, found in (("pair", pairs), ("term", words)):
                yield from ((lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found))


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def _audited(df, **kw):
    return Counter(tuple(r) for r in divergence.audit(df, **kw).select(*COLUMNS).collect())


def test_audit_of_the_awkward_table(awkward, nothing):
    for min_docs in (1, 2, 100):
        assert _audited(awkward, min_docs=min_docs) == Counter(_audit([(r[2], r[3], r[1]) for r in rows()], min_docs))
    assert not _audited(nothing)


def test_audit_in_small_blocks_and_packs(spark):
    """Many transducers and several passes give the same as one; languages share terms."""
    table = [(["en", "fr"][i % 2], f"s{i % 5 if i % 3 else 0}", prose(i % 40, 60)) for i in range(200)]
    df = spark.createDataFrame(table, "lang string, source string, text string")
    assert _audited(df, block_terms=17, pack_bytes=4000) == Counter(_audit(table, 10))


def test_audit_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE_TERMS_BITS", 4)
    monkeypatch.setattr(divergence, "TILE_SOURCES_BITS", 1)
    table = [("en", f"s{i % 7}", prose(i % 30, 40)) for i in range(120)]
    assert _audited(spark.createDataFrame(table, "lang string, source string, text string"), min_docs=3) == Counter(_audit(table, 3))


def test_transducer_reads_terms_as_ordinals_and_back():
    rnd = random.Random(1)
    words = sorted({("".join(rnd.choice("abcé東") for _ in range(rnd.randint(1, 7)))).encode() for _ in range(3000)})
    builder = divergence.Builder()
    for w in words:
        builder.add(w)
    t = divergence.Transducer(builder.pack())
    assert t.ordinals(words).tolist() == list(range(len(words))) and [t.term(i) for i in range(len(words))] == words
    others = [x for x in (b"", b"zz", words[5] + b"!", words[-1] + b"a", b"a" * 100_000) if x not in set(words)]
    assert t.ordinals(others).tolist() == [-1] * len(others) and t.ordinals([]).tolist() == []


def test_shares_of_counts_beyond_64_bits(spark):
    counts, below = [0, 5, divergence.PLAIN_COUNT, divergence.PLAIN_COUNT + 1, 10 ** 15], 2 * 10 ** 15 + 7
    want = [1 + 10 ** 9 * (c + 2) // below for c in counts]
    assert divergence.shares(np.array(counts), np.full(len(counts), below)).tolist() == want
    df = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "i int, c long")
    got = df.select(divergence.share(F.col("c"), F.lit(below - 6).cast("long"), F.lit(3)).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == want


def test_transducer_is_minimal():
    """All words of three letters over two are four states: one for each number of letters left."""
    builder = divergence.Builder()
    for w in (a + b + c for a in "ab" for b in "ab" for c in "ab"):
        builder.add(w.encode())
    assert divergence.Transducer(builder.pack()).root + 1 == 4
