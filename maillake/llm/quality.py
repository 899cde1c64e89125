"""Quality classifier: supervised subword embeddings (hashed words and character n-grams).

Every word, pair of words and character 3- and 4-gram of a text is hashed to one of ``BUCKETS``
learned vectors; a text is the average of its vectors, a softmax layer turns it into class
probabilities, and numpy stochastic gradient descent trains vectors and layer together.

Training uses a bounded, documented sample: at most ``SAMPLE_PER_CLASS`` labelled rows of
each class, those with the smallest hash of their id.  Their sparse counts are made by
Spark from whole texts; only the sample's counts reach the driver.  Class weights restore
the label frequencies of all training rows, so the probabilities are not those of a
balanced sample.

Scoring projects the vectors through the softmax layer once (averaging and the layer are
both linear up to the softmax), so a text needs one table lookup per n-gram.  Whole texts
are scored, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maillake.llm.common import release_memory, text_or_empty

BUCKETS = 1 << 16
NGRAMS = (3, 4)
DIM = 8
EPOCHS = 6
RATE = 0.5
SAMPLE_PER_CLASS = 1500
HELD_OUT_FOLDS = 5              # rows whose crc32(id) mod 5 is 0 are never trained on
THRESHOLD = 0.3
NEUTRAL = 0.5                   # the score when there is nothing to learn from
PIECE_CHARS = 1 << 18           # characters hashed at a time
_PAD = max(NGRAMS) - 1
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def held_out(id_col: Column) -> Column:
    """True for ids kept out of training; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % HELD_OUT_FOLDS == 0


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * _MULT
    h ^= h >> np.uint64(32)
    return ((h * _MULT) >> np.uint64(48)).astype(np.uint16)


def _words(codes: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last + 1 of each run without white space, and a hash of its characters alone."""
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    power = np.cumprod(np.full(len(codes), _BASE, dtype=np.uint64))
    inverse = np.cumprod(np.full(len(codes), pow(_BASE, -1, 1 << 64), dtype=np.uint64))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * power, dtype=np.uint64)])
    return begin, end, (run[end] - run[begin]) * inverse[begin]


def features(texts: list[str]):
    """(buckets, document number) arrays for each kind of feature of some texts.

    The texts are laid end to end with blanks between them, so one numpy pass hashes all
    of them and no n-gram mixes two texts.
    """
    blank = " " * _PAD
    codes = np.frombuffer((blank.join(texts) + blank).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lens = np.array([len(t) for t in texts], dtype=np.int64) + _PAD
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
    inside = np.ones(len(codes), dtype=bool)            # n-grams begin in a text, not in the blanks between two
    inside[(starts + lens)[:, None] - np.arange(1, _PAD + 1)] = False
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    codes[space] = 32
    out = []
    for n in NGRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, dtype=np.uint64)
        inked = np.zeros(m, dtype=bool)
        for j in range(n):
            h = h * np.uint64(_BASE) + codes[j:j + m]
            inked |= ~space[j:j + m]
        inked &= inside[:m]
        out.append((_bucket(h, n)[inked], doc[:m][inked]))
    first = ~space & np.concatenate([[True], space[:-1]])
    if first.any():
        begin, _, words = _words(codes, space)
        out.append((_bucket(words, 99), doc[begin]))
        # a pair of words is hashed by the difference of its words, so that all words said twice share a vector
        pair = doc[begin][1:] == doc[begin][:-1]
        out.append((_bucket(words[1:] - words[:-1], 98)[pair], doc[begin][1:][pair]))
    return out, starts


def long_features(text: str):
    """Bucket arrays of all features of one text, hashed ``PIECE_CHARS`` characters at a time.

    The features are those of ``features([text])``: n-grams look past a piece's end, and a word or a pair of words
    that a piece ends in is carried on.
    """
    last, open_hash, open_chars = None, 0, 0        # hash of the word before; the unfinished word's hash and length
    mask = (1 << 64) - 1
    for start in range(0, len(text), PIECE_CHARS):
        own = min(PIECE_CHARS, len(text) - start)
        piece = text[start:start + own + _PAD]
        codes = np.frombuffer((piece + " " * (own + _PAD - len(piece))).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        space = (codes == 32) | ((codes >= 9) & (codes <= 13))
        codes[space] = 32
        for n in NGRAMS:
            h, inked = np.zeros(own, dtype=np.uint64), np.zeros(own, dtype=bool)
            for j in range(n):
                h = h * np.uint64(_BASE) + codes[j:j + own]
                inked |= ~space[j:j + own]
            yield _bucket(h, n)[inked]
        goes_on = start + own < len(text) and not space[own - 1] and not space[own]
        codes, space = codes[:own], space[:own]
        begin, end, words = _words(codes, space)
        if open_chars:          # the first run is the rest of a word
            words[0] = np.uint64((open_hash + pow(_BASE, open_chars, 1 << 64) * int(words[0])) & mask)
        if goes_on:
            open_chars = int(end[-1] - begin[-1]) + (open_chars if len(words) == 1 else 0)
            open_hash, words = int(words[-1]), words[:-1]
        else:
            open_chars = 0
        yield _bucket(words, 99)
        chain = words if last is None else np.concatenate([np.array([last], dtype=np.uint64), words])
        yield _bucket(chain[1:] - chain[:-1], 98)
        if len(words):
            last = words[-1]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of a text and how often each occurs."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for buckets in long_features(text) if len(text) > PIECE_CHARS else (b for b, _ in features([text])[0]):
        total += np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(total)
    return used, total[used]


@dataclass
class Model:
    """Projected logit of every bucket (class 1 minus class 0) and the bias; scoring needs no more."""

    logits: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of class 1 for every text; an empty text has the bias alone."""
        total, seen = np.zeros(len(texts)), np.zeros(len(texts))
        group, size = [], 0
        for i, text in enumerate([*texts, None]):
            if text is None or size > PIECE_CHARS:
                short = [k for k in group if len(texts[k]) <= PIECE_CHARS]
                for buckets, doc in features([texts[k] for k in short])[0] if short else ():
                    total[short] += np.bincount(doc, self.logits[buckets], len(short))
                    seen[short] += np.bincount(doc, minlength=len(short))
                for k in set(group).difference(short):
                    for buckets in long_features(texts[k]):
                        total[k] += self.logits[buckets].sum(dtype=np.float64)
                        seen[k] += len(buckets)
                group, size = [], 0
            if text is not None:
                group.append(i)
                size += len(text)
        z = total / np.maximum(seen, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], share: float, seed: int = 1) -> Model:
    """Fit on (buckets, counts, class) examples; ``share`` is class 1's share of all training rows.

    With one class only, or none, there is nothing to tell apart: the score is the share
    of class 1, or ``NEUTRAL`` without any example.
    """
    classes = np.array([y for _, _, y in examples])
    if len(set(classes.tolist())) < 2:
        p = NEUTRAL if not len(classes) else float(np.clip(classes.mean(), 0.001, 0.999))
        return Model(np.zeros(BUCKETS, dtype=np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    mean = classes.mean()
    weight = np.array([(1 - share) / (1 - mean), share / mean])
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            buckets, n, y = examples[i]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(buckets):
                continue
            share_of = (n / n.sum()).astype(np.float32)
            hidden = share_of @ vectors[buckets]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g = (rate * weight[y] * p).astype(np.float32)
            back = layer @ g
            layer -= np.outer(hidden, g)
            bias -= g
            # each vector's step follows its share of the text, scaled up as the shares are small
            vectors[buckets] -= np.outer(share_of * np.float32(len(buckets) ** 0.5), back)
    projected = vectors @ layer
    return Model((projected[:, 1] - projected[:, 0]).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Train on the labelled rows that are not held out.

    Rows with a null id, a null label or a label other than 0 and 1 teach nothing.  A
    repeated id counts once (its smallest text, its largest label).  Other columns are not read.
    """
    y = F.col(label_col).cast("int")
    rows = (labels.select(F.col(id_col).alias("__id"), y.alias("__y"))
            .filter(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & ~held_out(F.col("__id")))
            .groupBy("__id").agg(F.max("__y").alias("__y")))
    order = [F.xxhash64(F.col("__id").cast("string")), F.col("__id")]
    picked = None
    for c in (0, 1):        # at most per_class ids each: the bound on what is broadcast and collected
        part = rows.filter(F.col("__y") == c).orderBy(*order).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    n = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))

    def run(batches):
        for batch in batches:
            got = [counts(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b.astype(np.int32) for b, _ in got], pa.list_(pa.int32())),
                 pa.array([c.astype(np.int32) for _, c in got], pa.list_(pa.int32()))], names=["id", "y", "buckets", "counts"])

    texts = (docs.select(docs[id_col].alias("__id"), text_or_empty(docs[text_col]).alias("__text"))
             .join(F.broadcast(picked), "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text")))
    sample = (texts.select(F.col("__id").cast("string"), "__y", "__text")
              .mapInArrow(run, "id string, y int, buckets array<int>, counts array<int>").toArrow())
    ids, ys = sample.column("id").to_pylist(), sample.column("y").to_pylist()
    b, c = sample.column("buckets").combine_chunks(), sample.column("counts").combine_chunks()
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    model = train([(b[i].values.to_numpy(), c[i].values.to_numpy(), ys[i]) for i in order], share)
    del sample, b, c
    release_memory()            # the driver outlives its training data
    return model


def score(model: Model):
    """Function from a text column to its score column; a null text scores as an empty one."""
    @F.pandas_udf("double")
    def quality_score(text: pd.Series) -> pd.Series:
        scores = pd.Series(model.scores(text.fillna("").tolist()))
        release_memory()
        return scores

    return quality_score


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches ``threshold``, all columns as they were."""
    return docs.filter(score(model)(docs[text_col]) >= threshold)
