"""Quality classifier: Bradley-Terry ranking of documents by pairwise preferences.

A document's strength is linear in its features; the chance that a document of label 1 is preferred to one of label 0 is
the logistic function of the difference of strengths. Weights are fitted on all pairs of all labelled documents outside the
held-out fold. A quantile of the training strengths, at the share of documents with label 0, is the threshold; ``score`` is a logistic calibration of the
strength in which the threshold sits at ``cut``.

Null text scores as the empty text. Labels other than 0 and 1 and null labels or ids are not learned from; a document with
contradicting labels takes their majority, ties count as 0. Repeated rows score alike. Without labels of both kinds the
score is 1 and nothing is rejected. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherloom.llm.shared import part_of, stored

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PUNCTUATION_BYTES = np.frombuffer(PUNCTUATION, np.uint8)
N_FEATURES = 13 + len(PUNCTUATION)


def features(text: str | None) -> np.ndarray:
    """Shares and logarithms over the whole text; none grows with its length but the first two."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES)
    words = raw.split()
    if not words:
        return out
    n = len(words)
    counts = Counter(words)
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    ids = {w: i for i, w in enumerate(counts)}
    order = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    pairs = order[:-1] * len(ids) + order[1:]
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    upper = int(codes[65:91].sum())
    letters = upper + int(codes[97:123].sum()) + int(codes[128:].sum())
    out[:13] = (
        np.log1p(n) / 5,
        np.log1p(n / max(1, len(lines))) / 5,
        size / n / 10,
        len(counts) / n,
        max(counts.values()) / n,
        float(np.mean(order[1:] == order[:-1])) if n > 1 else 0.0,
        len(np.unique(pairs)) / max(1, n - 1),
        upper / max(1, letters),
        letters / size,
        int(codes[48:58].sum()) / size,
        1 - len(set(lines)) / max(1, len(lines)),
        1.0,
        len(raw.decode("utf-8", "replace")) / size,
    )
    out[13:] = np.sqrt(codes[PUNCTUATION_BYTES] / n)
    return out


@dataclass
class Ranking:
    """``weights`` over standardised features, ``threshold`` on the strength, ``slope`` of the calibration, ``cut``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    cut: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strengths(x) - self.threshold) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Sums:
    """Sums over learned rows that are held as arrays; a function of labels and features gives keys and values of their sums."""

    def __init__(self, y: np.ndarray, x: np.ndarray):
        self.y, self.x = y, x

    def of(self, found) -> dict[tuple[int, int], np.ndarray]:
        """Values by the two keys that ``found`` gives for rows."""
        first, second, values = found(self.y, self.x)
        out: dict[tuple[int, int], np.ndarray] = {}
        for a, b, v in zip(first, second, values):
            out[int(a), int(b)] = out.get((int(a), int(b)), 0) + v
        return out

    def values(self, found) -> np.ndarray:
        """Single numbers, for few rows."""
        return np.sort(found(self.x))


class TableSums(Sums):
    """The same over a table ``(label, x)``: tasks add up their rows, a shuffle adds up the tasks."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def of(self, found):
        width = [f"v{i}" for i in range(found(np.zeros(1, int), np.zeros((1, N_FEATURES)))[2].shape[1])]

        def summed(batches):
            for b in batches:
                if len(b):
                    first, second, values = found(b["label"].to_numpy(), np.stack(b["x"].to_numpy()))
                    yield pd.DataFrame(values, columns=width).groupby([np.asarray(first), np.asarray(second)]).sum().rename_axis(["a", "b"]).reset_index()

        parts = self.rows.mapInPandas(summed, "a int, b int, " + ", ".join(f"{w} double" for w in width))
        table = parts.groupBy("a", "b").agg(*[F.sum(w).alias(w) for w in width]).toPandas().sort_values(["a", "b"])
        return dict(zip(zip(table["a"].tolist(), table["b"].tolist()), table[width].to_numpy()))

    def values(self, found):
        def kept(batches):
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"v": found(np.stack(b["x"].to_numpy()))})

        return np.sort(self.rows.mapInPandas(kept, "v double").toPandas()["v"].to_numpy())


def order_statistics(sums: Sums, strengths, low: float, high: float, ranks: list[int], most: int) -> list[float]:
    """The strengths at ``ranks`` (from 0) of all rows, all within ``low`` and ``high``. The interval around a rank is cut
    until it holds at most ``most`` rows, which are then read, or is so narrow that its rows are taken as equal."""
    out = []
    for rank in ranks:
        a, b, before = low, high, 0
        while True:
            edges = np.linspace(a, b, max(2, min(512, most)) + 1)

            def cut(y, x, edges=edges):
                s = strengths(x)
                at = np.clip(np.searchsorted(edges, s, "right") - 1, 0, len(edges) - 2)
                inside = (s >= edges[0]) & (s <= edges[-1])
                return np.zeros(int(inside.sum()), int), at[inside], np.stack([np.ones(int(inside.sum())), s[inside]], 1)

            found = sums.of(cut)
            for (_, k), (n, total) in sorted(found.items()):
                if rank < before + n:
                    break
                before += n
            left, right, last = edges[k], edges[k + 1], k == len(edges) - 2
            if n <= most:
                got = sums.values(lambda x: (s := strengths(x))[(s >= left) & ((s <= right) if last else (s < right))])
                out.append(float(got[int(rank - before)]))
                break
            if right - left <= 1e-12 * max(1.0, abs(left)):
                out.append(float(total / n))
                break
            a, b = left, right if last else np.nextafter(right, left)
    return out


def fitted(sums: Sums, cut: float, most: int, steps: int, penalty: float) -> Ranking | None:
    """The least mean logistic loss over all pairs of a row of label 1 and one of label 0, by quasi-Newton steps.

    A pair's loss depends on its two strengths, so the loss of all pairs follows from how many rows of each label lie in
    each of ``intervals`` of strength and where their mean is, and its gradient from the sums of their features there. The
    start matrix bounds the curvature for any weights. Everything is a sum over all rows; the driver gets two rows an
    interval, and at most ``most`` strengths at the threshold.
    """
    moments = sums.of(lambda y, x: (y, np.zeros(len(y), int), np.hstack([np.ones((len(y), 1)), x, x * x])))
    if len(moments) < 2:
        return None
    n = np.array([moments[label, 0][0] for label in (0, 1)])
    first, second = ((moments[0, 0] + moments[1, 0])[1:] / n.sum()).reshape(2, -1)
    mean, scale = np.round(first, 9), np.round(np.sqrt(np.maximum(second - first * first, 0)), 9)
    scale = np.where(scale > 1e-6, scale, 1.0)
    features_of = len(mean)

    def placed(x):
        return np.clip((x - mean) / scale, -8, 8)

    def products(y, x):
        parts = [placed(x)[y == label] for label in (0, 1)]
        keys = np.repeat((0, 1), features_of), np.tile(np.arange(features_of), 2)
        return *keys, np.vstack([np.hstack([z.sum(0)[:, None], z.T @ z]) for z in parts])

    squares = sums.of(products)
    centre, spread = [], []
    for label in (0, 1):
        got = np.array([squares[label, i] for i in range(features_of)]) / n[label]
        centre.append(got[:, 0])
        spread.append(got[:, 1:] - np.outer(got[:, 0], got[:, 0]))
    apart = centre[1] - centre[0]
    bound = (spread[0] + spread[1] + np.outer(apart, apart)) / 4 + penalty * np.eye(features_of)  # logistic curvature is 1/4 at most
    overall = (n[0] * centre[0] + n[1] * centre[1]) / n.sum()
    spread_all = sum(n[k] / n.sum() * (spread[k] + np.outer(centre[k] - overall, centre[k] - overall)) for k in (0, 1))
    intervals = max(2, min(512, most))

    def by_strength(weights):
        """Rows, mean strengths and sums of features by label and interval."""
        half = 6 * float(np.sqrt(max(weights @ spread_all @ weights, 1e-12)))
        start, width = float(overall @ weights) - half, 2 * half / intervals

        def found(y, x):
            z = placed(x)
            s = z @ weights
            return y, np.clip((s - start) / width, 0, intervals - 1).astype(int), np.hstack([np.ones((len(y), 1)), s[:, None], z])

        got = sums.of(found)
        tables = [np.array([v for (label, _), v in sorted(got.items()) if label == want]) for want in (0, 1)]
        return [(t[:, 0], t[:, 1] / t[:, 0], t[:, 2:]) for t in tables]

    def loss(weights):
        (m, low, z_low), (k, high, z_high) = by_strength(weights)
        margin = high[:, None] - low[None, :]
        lost = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
        pairs = n[0] * n[1]
        value = float(k @ np.logaddexp(0, -margin) @ m) / pairs + penalty / 2 * float(weights @ weights)
        return value, (k @ lost @ z_low - (lost @ m) @ z_high) / pairs + penalty * weights

    weights, inverse = np.zeros(features_of), np.linalg.inv(bound)
    value, slope_at = loss(weights)
    start_inverse = inverse
    for _ in range(steps):
        step = -inverse @ slope_at
        if not step @ slope_at < 0:
            inverse, step = start_inverse, -start_inverse @ slope_at
        new_value, new_slope = loss(weights + step)
        if new_value > value + 1e-9:  # this step of bounded curvature always gains
            inverse, step = start_inverse, -start_inverse @ slope_at
            new_value, new_slope = loss(weights + step)
        change = new_slope - slope_at
        weights, value, gained, slope_at = weights + step, new_value, value - new_value, new_slope
        if float(np.abs(slope_at).max()) < 1e-6 or abs(gained) < 1e-9:
            break
        if (curve := float(step @ change)) > 1e-15:
            left = np.eye(features_of) - np.outer(step, change) / curve
            inverse = left @ inverse @ left.T + np.outer(step, step) / curve
    weights = np.round(weights, 6)

    def strengths(x):
        return placed(x) @ weights

    place = float((n.sum() - 1) * (n[0] / n.sum()))
    far = 8 * float(np.abs(weights).sum()) + 1.0
    ends = order_statistics(sums, strengths, -far, far, sorted({int(np.floor(place)), int(np.ceil(place))}), most)
    threshold = float(np.mean(ends))
    slope = 1.0
    (m, low, _), (k, high, _) = by_strength(weights)
    rows, strength, label = np.concatenate([m, k]), np.concatenate([low, high]) - threshold, np.repeat([0.0, 1.0], [len(m), len(k)])
    for _ in range(200):  # one-parameter logistic calibration, classes weighted by their numbers
        p = 1 / (1 + np.exp(-np.clip(slope * strength + np.log(cut / (1 - cut)), -500, 500)))
        slope = float(np.clip(slope + 0.5 * (rows @ ((label - p) * strength)) / n.sum(), 0.05, 50))
    return Ranking(mean, scale, weights, threshold, round(slope, 6), cut)


def fit(x: np.ndarray, y: np.ndarray, cut: float, most: int = 6000, steps: int = 60, penalty: float = 1e-3) -> Ranking | None:
    """Fits on rows that are held as arrays."""
    return fitted(Sums(y, x), cut, most, steps, penalty)


def known_labels(labels: DataFrame, folds: int, held: int) -> DataFrame:
    """doc_id and label of all labelled documents outside the held-out fold."""
    return (
        labels.filter("quality in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg((F.avg("quality") > 0.5).cast("int").alias("label"))
        .filter(part_of("doc_id", folds, "part") != held)
    )


def train(docs: DataFrame, labels: DataFrame, cut: float, folds: int = 5, held: int = 0, most: int = 6000, least: int = 500) -> Ranking | None:
    """Fits on all labelled documents outside the held-out fold; repeated rows count once, an id with several texts with each.

    ``most`` bounds what reaches the driver at once: sums by intervals of strength, and that many single strengths next to the
    threshold; no row is left out for it. ``least`` is accepted as before and has no effect, since all rows of both labels
    are learned from. Texts become feature rows before anything is shuffled; these are stored, as each step reads them.
    """

    def extract(batches):
        for b in batches:
            x = np.array([features(t) for t in b["text"]]).reshape(len(b), N_FEATURES)
            yield pd.DataFrame({"doc_id": b["doc_id"], "mark": b["mark"], "x": list(x)})

    texts = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (part_of("doc_id", folds, "part") != held))
    found = texts.withColumn("mark", F.md5("text")).mapInPandas(extract, f"doc_id {dict(docs.dtypes)['doc_id']}, mark string, x array<double>")
    rows = found.join(known_labels(labels, folds, held), "doc_id").dropDuplicates(["doc_id", "mark"]).select("label", "x")
    return fitted(TableSums(stored(rows, "ranking-rows")), cut, most, 60, 1e-3)


def scorer(model: Ranking | None):
    """The model as a column function of a text."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        if model is None or texts.empty:
            return pd.Series(np.ones(len(texts)))
        return pd.Series(model.scores(np.array([features(t) for t in texts])))

    return scores


def score(docs: DataFrame, model: Ranking | None, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 if the score is at least the model's cut)."""
    return docs.withColumn("score", scorer(model)(text)).withColumn("predicted", (F.col("score") >= bar(model)).cast("int"))


def bar(model: Ranking | None) -> float:
    return model.cut if model else 0.0


def accepted(docs: DataFrame, model: Ranking | None, text: str = "text") -> DataFrame:
    """The rows that the model does not reject, with their own columns only."""
    return docs.filter(scorer(model)(text) >= bar(model))
