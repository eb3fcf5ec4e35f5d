"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD, with rejection.

A text's subwords are its letter n-grams of length 1 to 3 inside words (lower case, other characters are one word edge).
Each is hashed to a bucket with an embedding; the mean of the whole text's embeddings goes through a linear softmax.
A temperature fitted on a part of the sample kept back calibrates the probabilities, and the lowest probability that
reaches a wanted accuracy there is the rejection bar.

Null text, no letters: ``und``, score 0. Rows without language or id are not learned from. Empty table or no labelled
row: no language is known, every text is ``und``. Repeated rows and extra columns do not matter. Long texts: all of
their n-grams count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherloom.llm.shared import part_of

UNKNOWN = "und"
#: Characters hashed at a time, so that a very long text needs no large arrays.
STEP = 1 << 20


def subwords(text: str | None, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the text; all zero without letters. ``buckets`` is a power of two."""
    counts, mask = np.zeros(buckets, np.int64), buckets - 1
    if not text:
        return counts
    low = text.lower()
    letters = {c for c in set(low) if c.isalpha()}
    if not letters:
        return counts
    allowed = np.sort(np.fromiter(map(ord, letters), np.uint32))
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), STEP):
        piece = points[max(0, at - 2) : at + STEP]
        own = min(at, 2)  # the two characters before, for n-grams that cross the step
        place = np.minimum(np.searchsorted(allowed, piece), len(allowed) - 1)
        c = np.where(allowed[place] == piece, piece, np.uint32(0)).astype(np.uint64)
        single = c[own:][c[own:] > 0]
        counts += np.bincount(mixed(single, 1) & mask, minlength=buckets)
        two = (c[1:] << np.uint64(21)) | c[:-1]
        two = two[max(0, own - 1) :]
        counts += np.bincount(mixed(two[two > 0], 2) & mask, minlength=buckets)
        three = (c[2:] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[:-2]
        three = three[(c[1:-1] > 0)]
        counts += np.bincount(mixed(three, 3) & mask, minlength=buckets)
    return counts


def mixed(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of the packed code points and the n-gram's length."""
    x = (values + np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(8)).astype(np.int64)


@dataclass
class LanguageModel:
    """``table``: embedding times softmax matrix, one row a bucket; ``bias``; ``temperature``; ``bar`` of rejection."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    bar: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its calibrated probability, and whether the model rejects it."""
        counts = subwords(text, len(self.table)) if self.languages else np.zeros(1)
        total = counts.sum()
        if not total:
            return UNKNOWN, 0.0, True
        z = (counts @ self.table / total + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.bar)


def learn(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], buckets: int, width: int, epochs: int, rate: float, wanted: float) -> LanguageModel:
    """Stochastic gradient descent, one bag (buckets, shares) at a time; every fifth bag is kept for calibration."""
    rng = np.random.default_rng(11)
    n = len(languages)
    vectors = rng.normal(0, 1.0 / width, (buckets, width))
    matrix, bias = rng.normal(0, 0.1, (width, n)), np.zeros(n)
    kept = np.arange(len(bags)) % 5 == 4 if len(bags) >= 50 else np.zeros(len(bags), bool)
    own = np.flatnonzero(~kept)
    steps = max(1, epochs * len(own))
    for step in range(steps):
        if step % len(own) == 0:
            rng.shuffle(own)
        idx, share = bags[own[step % len(own)]]
        label = y[own[step % len(own)]]
        now = rate * (1 - step / steps)
        mean = share @ vectors[idx]
        z = mean @ matrix + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[label] -= 1
        back = matrix @ p
        matrix -= now * np.outer(mean, p)
        bias -= 0.1 * now * p
        vectors[idx] -= now * share[:, None] * back * len(idx) ** 0.5
    table = vectors @ matrix
    check = np.flatnonzero(kept) if kept.any() else own
    z = np.array([bags[i][1] @ table[bags[i][0]] + bias for i in check])
    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -log_likelihood(z / t, y[check]))
    p = np.exp(z / temperature - (z / temperature).max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best, right = p.max(1), p.argmax(1) == y[check]
    order = np.argsort(-best)
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= wanted)
    bar = float(best[order][good[-1]]) if len(good) else 1.0
    return LanguageModel(languages, table, bias, float(temperature), bar)


def log_likelihood(z: np.ndarray, y: np.ndarray) -> float:
    z = z - z.max(1, keepdims=True)
    return float((z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))).mean())


def pieces(text: str) -> list[str]:
    """The whole text and three short cuts of it, so that short texts are learned too."""
    n = len(text)
    return [text, *[text[at : at + 80] for at in (0, n // 3, 2 * n // 3) if n > 240]]


def train(
    docs: DataFrame,
    folds: int = 3,
    held: int = 1,
    most: int = 3000,
    buckets: int = 1 << 13,
    width: int = 16,
    epochs: int = 4,
    rate: float = 0.3,
    wanted: float = 0.99,
    least: int = 100,
    most_languages: int = 1000,
) -> LanguageModel:
    """Fits on about ``most`` different documents outside the held-out fold, whatever the table's size.

    Documents are drawn by a hash of id and text, each language with its share of the rows but at least ``least`` of its
    documents (all where it has fewer), so that rare languages are learned at any size. Repeated rows count once. Of more
    than ``most_languages`` the most frequent are learned. The driver gets the hashed bags of each document and of three short cuts
    of it: at most 8 * (``most`` + ``least`` * languages) bags of ``buckets`` entries, and no text.
    """
    known = docs.filter("text is not null and lang is not null and doc_id is not null")
    known = known.filter(part_of("doc_id", folds, "part") != held).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    share = most / max(1, sum(r["count"] for r in counts))
    draws = {r["lang"]: min(1.0, max(share, least / r["count"])) for r in counts}
    if not draws:
        return LanguageModel([], np.zeros((1, 1)), np.zeros(1), 1.0, 1.0)
    drawn = F.try_element_at(F.create_map(*[F.lit(x) for pair in draws.items() for x in pair]), F.col("lang"))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("lang")), F.lit(1 << 30))
    sample = known.filter(place < F.coalesce(drawn, F.lit(0.0)) * (1 << 30)).dropDuplicates(["doc_id", "text", "lang"])
    # the draw gives about that many; the bound holds for any table
    sample = sample.orderBy(place, "doc_id", "lang").limit(2 * (most + least * len(draws)))

    def bags(batches):
        for b in batches:
            for doc, text, lang in zip(b["doc_id"], b["text"], b["lang"]):
                rows = []
                for nth, piece in enumerate(pieces(text)):
                    counts = subwords(piece, buckets)
                    idx = np.flatnonzero(counts)
                    if len(idx):
                        rows.append((doc, nth, lang, idx.astype(np.int32), (counts[idx] / counts.sum()).astype(np.float32)))
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "nth", "lang", "idx", "share"])

    got = sample.mapInPandas(bags, "doc_id long, nth int, lang string, idx array<int>, share array<float>").toPandas()
    if got.empty:
        return LanguageModel([], np.zeros((1, 1)), np.zeros(1), 1.0, 1.0)
    got["sum"] = got["share"].map(lambda s: float(np.max(s)))
    got = got.sort_values(["nth", "doc_id", "lang", "sum"], kind="stable")
    languages = sorted(got["lang"].unique())
    y = got["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy()
    rows = [(np.asarray(i, np.int64), np.asarray(s, np.float64)) for i, s in zip(got["idx"], got["share"])]
    return learn(rows, y, languages, buckets, width, epochs, rate, wanted)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` (the likeliest language), ``score`` and ``rejected`` (below the model's calibrated bar)."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def languages(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    found = docs.withColumn("_found", languages(F.col(text)))
    return found.select("*", "_found.lang_pred", "_found.score", "_found.rejected").drop("_found")
