"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule says good (1), bad (0) or nothing (null). The votes' patterns are counted over all documents that pass the base rule (at most 3 to the
power of the number of rules, so the counts are small whatever the input); EM on the counts estimates each rule's accuracy:
how often it says good, bad or nothing on good and on bad documents. A document is kept if its posterior probability of being good is at least
``keep_from`` and it does not fail the base rule.

Null and empty texts have no words, fail the base rule and are not kept. Repeated rows count by themselves. Empty table:
no rows. Whole texts are used; extra columns pass through unless they have one of the added names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base rule's symbols.
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["n_lines", "upper_share", "unique_share", "top_share", "stop_share", "bang_share", "mark_share", "letter_share"]
#: ASCII marks that running text has: the others are counted by ``mark_share``.
PROSE_MARKS = np.frombuffer(b"!\"'(),-.:;?", np.uint8)
MARKS = np.setdiff1d(np.r_[33:48, 58:65, 91:97, 123:127], PROSE_MARKS)


def repeated(ids: np.ndarray, width: int = 5) -> int:
    """Words inside a window of ``width`` ids that occurs twice or more. Windows get ranks by doubling, so equal ranks
    mean equal windows."""
    n = len(ids)
    if n <= width:
        return 0
    ranks, length = ids, 1
    while length < width:
        step = min(length, width - length)
        m = n - (length + step) + 1
        pair = ranks[:m].astype(np.int64) * (int(ranks.max()) + 1) + ranks[step : step + m]
        ranks = np.unique(pair, return_inverse=True)[1]
        length += step
    twice = np.bincount(ranks)[ranks] >= 2
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    edges[at] += 1
    np.subtract.at(edges, at + width, 1)
    return int((np.cumsum(edges)[:n] > 0).sum())


def measure(text: str | None) -> tuple:
    """The base counts and the shares that the rules look at, in the order BASE + SHARES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at the six ASCII white-space characters
    n = len(words)
    if not n:
        return (0, 0, 0, 0, 0, *[0.0] * len(SHARES))
    counts = Counter(words)
    number = {w: i for i, w in enumerate(counts)}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    blank = int(codes[9:14].sum() + codes[32])
    points = len(raw) - int(codes[128:192].sum())
    upper = int(codes[65:91].sum())
    letters = upper + int(codes[97:123].sum()) + int(codes[192:].sum())
    return (
        n,
        points - blank,
        int(codes[SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated(ids),
        len(lines),
        upper / max(1, letters),
        len(counts) / n,
        max(counts.values()) / n,
        int(codes[46] + codes[44] + codes[59] + codes[58] + codes[63]) / n,
        int(codes[33]) / n,
        int(codes[MARKS].sum()) / n,
        (int(codes[65:91].sum() + codes[97:123].sum()) + int(codes[128:].sum())) / max(1, len(raw) - blank),
    )


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    fields = ", ".join([f"{c} long" for c in BASE] + [f"{c} double" for c in SHARES])

    @F.pandas_udf(fields)
    def measures(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=BASE + SHARES)

    out = docs.withColumn("_m", measures(F.col(text)))
    return out.withColumns({c: F.col(f"_m.{c}") for c in BASE + SHARES}).drop("_m")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Name to vote: 1, 0 or null."""
    n = F.greatest("n_words", F.lit(1))
    length, symbols = F.col("word_chars") / n, F.col("n_symbols") / n
    again, lines = F.col("n_repeat_words") / n, F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1.0))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1)

    long_enough = F.col("n_words") >= 20
    return {
        "length": F.when(long_enough, 1),
        "word_length": vote(length.between(3, 8), ~length.between(2, 12)),
        "symbols": vote(symbols <= 0.02, symbols > 0.1),
        "marks": vote(F.col("mark_share") <= 0.03, F.col("mark_share") > 0.15),
        "letters": vote(F.col("letter_share") >= 0.92, F.col("letter_share") < 0.85),
        "lines": F.when(lines > 0.3, 0),
        "repeats": vote(again <= 0.02, again > 0.1),
        "capitals": vote(F.col("upper_share") <= 0.2, F.col("upper_share") > 0.4),
        "vocabulary": vote((F.col("unique_share") >= 0.3) & long_enough, (F.col("top_share") > 0.25) & long_enough),
        "stops": vote(F.col("stop_share").between(0.01, 0.5), (F.col("stop_share") < 0.004) & (F.col("n_words") >= 50)),
        "shouting": F.when(F.col("bang_share") > 0.3, 0),
    }


#: Votes in the order of the tables below.
OUTCOMES = (1, 0, -1)
#: Expected chances of a good, a bad and no vote on good and on bad documents, before any data: a rule rarely speaks
#: against a good document, and most bad documents have only some of the faults.
EXPECTED = {"good": (0.78, 0.02, 0.2), "bad": (0.5, 0.3, 0.2)}


@dataclass
class Weights:
    """``prior`` of good; ``on_good`` and ``on_bad``: chances of a rule's (row) good, bad and missing vote (column)."""

    prior: float
    on_good: np.ndarray
    on_bad: np.ndarray

    def log_odds(self) -> tuple[float, np.ndarray]:
        """Of the prior, and of each rule's three outcomes."""
        return float(np.log(self.prior / (1 - self.prior))), np.log(self.on_good / self.on_bad)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 300, strength: float = 0.01) -> Weights:
    """``votes``: one row a pattern, 1, 0 or -1 (none); ``counts``: documents with it.

    The expected chances count as much as ``strength`` of all documents. After each step a bad vote is at least as likely
    on bad as on good documents, so the classes cannot change sides; the prior of good stays within 0.5 and 0.99.
    """
    n_rules, total = votes.shape[1], max(1.0, counts.sum())
    expected = {c: np.tile(EXPECTED[c], (n_rules, 1)) for c in EXPECTED}
    now = Weights(0.85, expected["good"], expected["bad"])
    cast = np.stack([votes == v for v in OUTCOMES], axis=2).astype(float)  # pattern, rule, outcome
    for _ in range(rounds):
        base, table = now.log_odds()
        odds = base + np.einsum("pro,ro->p", cast, table)
        p = counts / (1 + np.exp(-np.clip(odds, -500, 500)))
        extra = strength * total
        tables = []
        for share, c in ((p, "good"), (counts - p, "bad")):
            seen = np.einsum("p,pro->ro", share, cast) + extra * expected[c]
            tables.append(np.clip(seen / seen.sum(1, keepdims=True), 1e-5, 1.0))
        tables[1][:, 1] = np.maximum(tables[1][:, 1], tables[0][:, 1])
        prior = float(np.clip((p.sum() + 0.85 * extra) / (total + extra), 0.5, 0.99))
        done = abs(prior - now.prior) + np.abs(tables[0] - now.on_good).max() + np.abs(tables[1] - now.on_bad).max() < 1e-9
        now = Weights(prior, *tables)
        if done:
            break
    return now


def learn(voted: DataFrame, names: list[str]) -> Weights:
    """Counts the vote patterns of all documents that pass the base rule and runs EM on the counts."""
    voted = voted.filter(~base_failed())
    votes = [F.coalesce(F.col(f"vote_{n}"), F.lit(-1)).alias(n) for n in names]
    found = voted.select(*votes).groupBy(*names).count().toPandas().sort_values(names)
    if found.empty:
        return Weights(0.85, *(np.tile(EXPECTED[c], (len(names), 1)) for c in ("good", "bad")))
    return expectation_maximisation(found[names].to_numpy(), found["count"].to_numpy(float))


def posterior(weights: Weights, names: list[str]) -> Column:
    base, tables = weights.log_odds()
    odds = F.lit(base)
    for name, (good, bad, none) in zip(names, tables):
        vote = F.col(f"vote_{name}")
        odds = odds + F.when(vote == 1, float(good)).when(vote == 0, float(bad)).otherwise(float(none))
    return 1 / (1 + F.exp(-odds))


def judge(measured: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """Adds votes, ``posterior``, ``base_failed`` and ``kept`` to rows with measures. Reads them twice: store them first."""
    named = rules()
    voted = measured.withColumns({f"vote_{n}": v for n, v in named.items()})
    weights = learn(voted, list(named))
    out = voted.withColumns({"posterior": posterior(weights, list(named)), "base_failed": base_failed()})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))
