"""Quality rules under weak supervision: rules vote or abstain, EM estimates their accuracies.

Each rule looks at one measure of a text and votes good (+1), bad (-1) or abstains (0).
Expectation-maximisation over the vote patterns of *all* texts estimates each rule's
accuracy and the share of good texts without any label; the posterior probability of
"good" given a text's votes replaces an all-rules-must-pass filter.

The vote patterns are counted by Spark (at most 3 to the number of rules of them, whatever
the number of texts), so only that bounded table reaches the driver.  Measures and votes are
written once to the checkpoint folder and read again for the verdict: texts are read once.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maillake.llm.common import ASCII_SPACE, text_or_empty
from maillake.session import ensure_checkpoint_dir

SYMBOLS = "#*$%&|<>"
WINDOW = 5
_SYMBOL = re.compile(b"[" + re.escape(SYMBOLS.encode()) + b"]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines",
            "n_distinct_words", "n_same_as_previous", "n_upper", "n_letters", "n_shouts", "n_marks", "n_symbol_words")


def repeated_window_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words inside a window of ``width`` words that occurs at least twice (all its places count)."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    ranks, length = ids, 1
    while length < width:               # exact ranks of ever longer windows, two shorter ones at a time
        step = min(length, width - length)
        pairs = ranks[:len(ranks) - step].astype(np.int64) * (int(ranks.max()) + 1) + ranks[step:]
        ranks = np.unique(pairs, return_inverse=True)[1]
        length += step
    again = np.bincount(ranks)[ranks] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edges, np.flatnonzero(again), 1)
    np.add.at(edges, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The ``MEASURES`` of one text; all 0 for an empty one."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()                # bytes.split() cuts at exactly the ASCII white space
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    octets = np.frombuffer(data, dtype=np.uint8)
    upper = int(((octets >= 65) & (octets <= 90)).sum())
    letters = upper + int((((octets >= 97) & (octets <= 122)) | (octets >= 0xC0)).sum())
    blanks, digits = sum(text.count(c) for c in ASCII_SPACE), int(((octets >= 48) & (octets <= 57)).sum())
    return (len(words), len(text) - blanks, sum(text.count(c) for c in SYMBOLS),
            len(lines) - len(set(lines)), repeated_window_words(ids), len(lines),
            sum(x.rstrip(ASCII_SPACE)[-1] in ".!?:;\"')" for x in lines), len(number),
            int((ids[1:] == ids[:-1]).sum()), upper,
            letters, text.count("!"), len(text) - blanks - digits - letters,
            sum(1 for w in words if _SYMBOL.search(w)))


@dataclass(frozen=True)
class Rule:
    """Votes bad above (below) ``bad`` and good on the other side of ``good``; abstains between, or on few words."""

    name: str
    value: Column
    good: float
    bad: float
    least_words: int = 1

    def vote(self) -> Column:
        low_is_good = self.good < self.bad
        v = self.value
        good, bad = (v <= self.good, v >= self.bad) if low_is_good else (v >= self.good, v <= self.bad)
        return (F.when(F.col("n_words") < self.least_words, 0).when(bad, -1).when(good, 1).otherwise(0)).cast("int")


def default_rules() -> list[Rule]:
    c = lambda name: F.col(name).cast("double")
    per = lambda a, b: F.when(F.col(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))
    return [
        Rule("symbols", per("n_symbols", "n_words"), 0.05, 0.2),
        Rule("symbol_words", per("n_symbol_words", "n_words"), 0.02, 0.1),
        Rule("marks", per("n_marks", "word_chars"), 0.06, 0.12),
        Rule("word_length", F.abs(per("word_chars", "n_words") - 6.5), 3.5, 6.0),
        Rule("distinct_words", per("n_distinct_words", "n_words") * F.sqrt(c("n_words")), 3.0, 1.5, 20),
        Rule("said_twice", per("n_same_as_previous", "n_words"), 0.05, 0.2, 5),
        Rule("upper_case", per("n_upper", "n_letters"), 0.2, 0.5),
        Rule("ended_lines", per("n_ended_lines", "n_lines"), 0.3, 0.02),
        Rule("repeated_lines", per("n_dup_lines", "n_lines"), 0.1, 0.3, 20),
        Rule("repeated_windows", per("n_repeat_words", "n_words"), 0.1, 0.25, 20),
        Rule("shouts", per("n_shouts", "n_words"), 0.1, 0.4),
    ]


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the ``MEASURES`` (long) of every row; a null text counts as an empty one."""
    def run(batches):
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in cols)],
                                             names=[id_col, *MEASURES])

    src = df.select(df[id_col], text_or_empty(df[text_col]).alias("__text"))
    return src.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, "
                               + ", ".join(f"{m} long" for m in MEASURES))


@dataclass(frozen=True)
class Estimate:
    """Share of good texts, and for each rule how likely a vote cast is "good" on good and on bad texts."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def accuracy(self) -> list[float]:
        """Probability that a rule is right when it votes."""
        return [self.prior * g + (1 - self.prior) * (1 - b) for g, b in zip(self.good, self.bad, strict=True)]

    def posterior(self, votes: list[Column]) -> Column:
        logit = F.lit(math.log(self.prior / (1 - self.prior)))
        for g, b, v in zip(self.good, self.bad, votes, strict=True):
            logit = logit + F.when(v > 0, math.log(g / b)).when(v < 0, math.log((1 - g) / (1 - b))).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


#: First guesses of EM: how likely a vote cast is "good" on good and on bad texts, and the share of good texts.
FIRST_GOOD, FIRST_BAD, FIRST_PRIOR = 0.98, 0.6, 0.85
#: Texts' worth of the first guess mixed into every estimate, so that no probability becomes 0 or 1.
PSEUDO_TEXTS = 2.0


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 500) -> Estimate:
    """EM on (votes, how many texts).

    A rule may be good at finding one class and blind to the other, so its votes are
    estimated for each class apart; abstaining says nothing.  Without texts the first
    guesses stand, as they do for a rule that never votes.
    """
    yes = np.repeat(np.array([[FIRST_GOOD], [FIRST_BAD]]), n_rules, axis=1)       # class x rule
    first, prior = yes.copy(), FIRST_PRIOR
    if patterns:
        patterns = sorted(patterns)
        votes = np.array([p for p, _ in patterns], dtype=int).reshape(len(patterns), n_rules)
        n = np.array([k for _, k in patterns], dtype=float)
        up, down = (votes > 0).astype(float), (votes < 0).astype(float)
        for _ in range(rounds):
            z = math.log(prior / (1 - prior)) + up @ np.log(yes[0] / yes[1]) + down @ np.log((1 - yes[0]) / (1 - yes[1]))
            good = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            mass = np.stack([good * n, (1 - good) * n])
            new = (mass @ up + PSEUDO_TEXTS * first) / (mass @ (up + down) + PSEUDO_TEXTS)
            new_prior = float((mass[0].sum() + PSEUDO_TEXTS * FIRST_PRIOR) / (n.sum() + PSEUDO_TEXTS))
            moved = max(np.abs(new - yes).max(), abs(new_prior - prior))
            yes, prior = new, new_prior
            if moved < 1e-9:
                break
    return Estimate(prior, *(tuple(float(x) for x in r) for r in yes))


def judge(df: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the measures, one ``vote_<rule>`` per rule and ``quality_probability`` of every row.

    Null and empty texts have measures of 0 and whatever votes these give; ids may be null or
    repeated (every row is judged); other columns are not read.  An empty table gives an empty result.
    """
    rules = default_rules() if rules is None else rules
    ensure_checkpoint_dir(df.sparkSession)
    voted = (measures(df, id_col, text_col)
             .select("*", *(r.vote().alias(f"vote_{r.name}") for r in rules)).checkpoint())
    names = [f"vote_{r.name}" for r in rules]
    counted = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    est = estimate([(tuple(r[x] for x in names), r["n"]) for r in counted], len(rules))
    return voted.withColumn("quality_probability", est.posterior([F.col(x) for x in names]))
