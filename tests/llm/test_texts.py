"""Operators that look at one text at a time, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from maillake.llm import bpe, licenses, quality, rules
from tests.llm.conftest import prose, rows

SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def ranks():
    P = pytest.importorskip("public_tokenizers")
    return bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN


def test_bpe_is_what_tiktoken_gives(awkward, nothing, ranks):
    enc = bpe.encoder(*ranks)
    got = bpe.encode(awkward, *ranks).collect()
    assert bpe.encode(nothing, *ranks).collect() == []
    want = Counter()
    for i, t, *_ in rows():
        ids = enc.encode_ordinary(t or "")
        want[(i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids_le"]), bytes(r["decoded"])) for r in got) == want


def test_bpe_pieces_are_cut_at_safe_places_only(ranks):
    enc = bpe.encoder(*ranks)
    for text in [prose(1, 400), "word  \n\n  next x " * 50, "x" * 5000, "é è  ü\n\nß 1 2 3!!\t " * 60, "can't we'll 12 3's\n " * 40, "東京 都 " * 300]:
        for size in (1, 7, 64):
            assert "".join(bpe.pieces(text, size)) == text
            assert [i for p in bpe.pieces(text, size) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_bpe_decodes_ids_that_end_inside_a_character(spark, ranks):
    enc = bpe.encoder(*ranks)
    ids = enc.encode_ordinary("🙂")
    assert len(ids) > 1
    df = spark.createDataFrame([(1, bytearray(np.array(ids[:1], "<u4").tobytes())), (2, None)], "doc_id long, ids_le binary")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(df, *ranks).collect()}
    assert got == {1: enc.decode_bytes(ids[:1]), 2: b""}


def _base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def test_many_detections_in_one_text():
    """200,000 detections take seconds; containment is that of comparing each with all kept ones."""
    import time

    scanner = licenses.Scanner(licenses.default_rules())
    begin = time.time()
    got = scanner.scan("licensed under cc by-sa 4.0. spdx-license-identifier: mit\n" * 70_000)["detections"]
    assert len(got) >= 140_000 and time.time() - begin < 60
    text = "licensed under the mit license, cc by-nc 4.0. gpl v3 or later; (c) 2019 x. released under cc by 4.0 license\n" * 3
    numbers = list(range(len(scanner.rules)))
    low = text.encode().decode("latin-1")
    found = sorted((scanner.rules[i].priority, m.start() - m.end(), m.start(), i, m.end()) for i in numbers for m in scanner.compiled[i].finditer(low))
    kept = []
    for _, _, start, i, end in found:
        if not any(s <= start and end <= e for s, e, _ in kept):
            kept.append((start, end, i))
    assert scanner.detections(low, numbers) == sorted(kept) and len(kept) < len(found)


def test_license_base_columns(spark, awkward, nothing):
    texts = ["CC  by; cc-by,cc BY", "accc by", "cc by-nc 4.0 cc0", "general\npublic -- LICENSE, all rights reserved!", "ccé by", "",
             None, "xcc by all rights reserved all rights reserved"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(awkward.select("doc_id", "text"))
    got = licenses.scan(df).collect()
    want = Counter((i, *_base(t)) for i, t in [*enumerate(texts), *((r[0], r[1]) for r in rows())])
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
    assert licenses.scan(nothing).collect() == []


@pytest.mark.parametrize("text, label", [
    ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("Released under the MIT License.", "mit"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("see creativecommons.org/licenses/by-sa/3.0/", "cc-by-sa-3.0"),
    ("Permission is hereby granted,  free\nof charge", "mit"), ("(c) 2019 Somebody", "copyright"),
])
def test_license_rules(text, label):
    scanner = licenses.Scanner(licenses.default_rules())
    assert label in {scanner.rules[i].label for _, _, i in scanner.scan(text)["detections"]}


def test_contained_detections_are_suppressed():
    rule = licenses.Rule
    s = licenses.Scanner([rule("short", "bsd", "bsd", 3, 0.5), rule("long", "new bsd license", "bsd", 1, 0.9), rule("tail", "license x", "license", 2, 0.9)])
    kept = [(a, b, s.rules[i].label) for a, b, i in s.scan("new BSD license x, bsd")["detections"]]
    assert kept == [(0, 15, "long"), (8, 17, "tail"), (19, 22, "short")]       # overlap stays, containment goes
    assert s.scan("plain prose")["detections"] == []


def test_keyword_gates_every_rule():
    """No rule can match a text without one of its keywords."""
    rules_ = licenses.default_rules()
    assert len(rules_) > 200
    ungated = [re.compile(licenses._loosen(r.pattern), re.ASCII) for r in rules_]
    scanner = licenses.Scanner(rules_)
    samples = ["licensed under the %s license" % n for n in ("mit", "bsd", "gpl", "zlib", "isc", "mozilla public license 2.0", "boost software license")]
    samples += ["see gnu.org/licenses/gpl-3.0 or mozilla.org/mpl/2.0", "cc by 4.0 creative commons attribution", "subject to the gpl", "copyright (c) 2020"]
    for text in samples:
        found = {i for i, p in enumerate(ungated) if p.search(text)}
        reached = set()
        for _, (_, numbers) in scanner.automaton.iter(text):
            reached.update(numbers)
        assert found <= reached


def _matches(pattern):
    """Strings the parsed pattern matches: the shortest choice everywhere, and every other branch, option and character in turn."""
    parts = []
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            parts.append([c for kind, x in arg for c in {"LITERAL": lambda x: [chr(x)], "RANGE": lambda x: [chr(x[0]), chr(x[1])],
                                                         "CATEGORY": lambda x: [" "]}[str(kind)](x)])
        elif name == "BRANCH":
            parts.append([m for branch in arg[1] for m in _matches(branch)])
        elif name == "SUBPATTERN":
            parts.append(_matches(arg[3]))
        elif name == "MAX_REPEAT":
            low, high, inner = arg
            own = _matches(inner)
            parts.append([own[0] * low] + [m * max(low, 1) for m in own if high > 0])
        else:
            assert name in ("AT", "ASSERT_NOT"), name
    first = "".join(x[0] for x in parts)
    return list(dict.fromkeys([first] + ["".join(x[0] for x in parts[:i]) + m + "".join(x[0] for x in parts[i + 1:])
                                         for i, own in enumerate(parts) for m in own[1:]]))


def test_keyword_gate_lets_every_branch_of_every_rule_through():
    scanner = licenses.Scanner(licenses.default_rules())
    n = 0
    for i, (rule, compiled) in enumerate(zip(scanner.rules, scanner.compiled, strict=True)):
        for text in _matches(re._parser.parse(licenses._loosen(rule.pattern), re.ASCII)):
            assert compiled.search(text), (rule, text)
            assert any(i in numbers for _, (_, numbers) in scanner.automaton.iter(text)), (rule, text)
            n += 1
    assert n > 5 * len(scanner.rules)


@pytest.mark.parametrize("text, label", [
    ("released by the terms of the GPL", "gpl"), ("Licensed by MIT", "mit"), ("for research use only", "research-only"),
    ("For academic use only", "research-only"), ("for educational use only", "research-only")])
def test_license_rules_without_the_words_of_other_rules(text, label):
    s = licenses.Scanner(licenses.default_rules())
    assert label in {s.rules[i].label for _, _, i in s.scan(text)["detections"]}


def _measures(text):
    text = text or ""
    words = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_measures(spark, awkward, nothing):
    texts = ["a b c d e f a b c d e g", "x " * 40, "#a *b\n\n#a *b\n  \n", "one\x1ctwo\x0bthree\x85four five"]
    df = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(awkward.select("doc_id", "text"))
    got = rules.judge(df).collect()
    want = Counter((i, *_measures(t)) for i, t in [*((100 + i, t) for i, t in enumerate(texts)), *((r[0], r[1]) for r in rows())])
    assert Counter((r["doc_id"], *(r[m] for m in rules.MEASURES[:5])) for r in got) == want
    assert all(0 <= r["quality_probability"] <= 1 for r in got)
    assert rules.judge(nothing).collect() == []


def test_em_finds_accuracies_of_planted_rules():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    right = [(0.98, 0.5), (0.95, 0.7), (0.99, 0.6), (0.97, 0.4)]     # votes good on good texts, bad on bad texts
    votes = np.stack([np.where(rng.random(len(good)) < 0.2, 0, np.where(good, np.where(rng.random(len(good)) < a, 1, -1),
                                                                       np.where(rng.random(len(good)) < b, -1, 1))) for a, b in right], axis=1)
    est = rules.estimate(list(Counter(map(tuple, votes.tolist())).items()), 4)
    assert abs(est.prior - 0.8) < 0.05
    assert all(abs(g - a) < 0.03 and abs((1 - x) - b) < 0.1 for g, x, (a, b) in zip(est.good, est.bad, right, strict=True))
    assert rules.estimate([], 4).prior == rules.FIRST_PRIOR


def test_rules_keep_good_documents_and_drop_bad_ones(spark):
    from maillake.llm import queries

    sf = "/root/testdata/sf0.1"
    got = queries.op6_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n[1, True] > 0.99 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] > 0.9 * (n[0, False] + n.get((0, True), 0))


def test_classifier_on_held_out_rows(spark):
    from maillake.llm import queries

    sf = "/root/testdata/sf0.1"
    got = queries.op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert np.mean([r["predicted"] for r in held if r["quality"] == 1]) > 0.98
    assert all((r["predicted"] == 1) == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)


def test_classifier_never_trains_on_held_out_rows_and_takes_awkward_tables(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(12)] + [(None, 1, 0, "x"), (3, None, 0, "x"), (4, 7, 0, "x")],
                                   "doc_id long, quality int, toxic int, score string")
    model = quality.fit(awkward, labels)
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(doc_id AS string)), 5) = 0 THEN 1 - quality ELSE quality END AS quality")
    assert np.array_equal(model.logits, quality.fit(awkward, flipped).logits)
    scored = awkward.select("doc_id", quality.score(model)("text").alias("s")).collect()
    assert len(scored) == len(rows()) and all(0 <= r["s"] <= 1 for r in scored)
    assert quality.keep_good(awkward, model).columns == awkward.columns
    assert quality.fit(nothing, labels).scores(["x", ""]).tolist() == [0.5, 0.5]
    assert quality.fit(awkward, labels.limit(0)).scores([""]).tolist() == [0.5]
    assert nothing.select(quality.score(model)("text")).collect() == []


def _plain_features(text):
    """Buckets of all n-grams, words and pairs of words, in whole numbers."""
    mask = (1 << 64) - 1

    def bucket(h, salt):
        h = (h ^ salt) * int(quality._MULT) & mask
        h ^= h >> 32
        return (h * int(quality._MULT) & mask) >> 48

    codes = [32 if c in " \t\n\v\f\r" else ord(c) for c in text] + [32] * 3
    out = Counter()
    for n in (3, 4):
        for i in range(len(codes) - n + 1):
            part, h = codes[i:i + n], 0
            for c in part:
                h = (h * 0x100000001B3 + c) & mask
            if set(part) != {32}:
                out[bucket(h, n)] += 1
    words = [sum((ord(c) + 1) * pow(0x100000001B3, j, 1 << 64) for j, c in enumerate(w)) & mask for w in re.findall(r"[^ \t\n\v\f\r]+", text)]
    out.update(bucket(w, 99) for w in words)
    out.update(bucket((b - a) & mask, 98) for a, b in zip(words, words[1:]))
    return out


@pytest.mark.parametrize("text", ["", "a", "  ab  c ", "one two\ttwo one\n", prose(1, 60), "Größe 東京 🙂\n" * 9, "x" * 900, "word\n" * 90, " " * 700])
def test_classifier_features_and_score_against_plain_python(text, monkeypatch):
    """Whole or in pieces of any size: the same features, and the score is the logistic of their mean logit."""
    want = _plain_features(text)
    logits = np.random.default_rng(4).normal(size=quality.BUCKETS).astype(np.float32)
    n = sum(want.values())
    z = sum(float(logits[b]) * k for b, k in want.items()) / max(n, 1) - 0.2
    for size in (1 << 18, 300, 64, 7, 1):
        monkeypatch.setattr(quality, "PIECE_CHARS", size)
        buckets, count = quality.counts(text)
        assert dict(zip(buckets.tolist(), count.tolist())) == dict(want), size
        got = quality.Model(logits, -0.2).scores(["other text", text, "", text])
        assert got[1] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6) and got[3] == pytest.approx(got[1], abs=1e-9)
        assert got[2] == pytest.approx(1 / (1 + np.exp(0.2)))


def test_decoded_digest_is_that_of_the_text(spark, ranks):
    from maillake.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op5_byte_bpe(spark, sf).collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
