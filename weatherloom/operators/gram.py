"""Regularised linear fits from one aggregate: normal equations for ridge, coordinate descent for lasso.

The table is read once for its sums of products; everything after that is work on a matrix of features by
features. Features are standardised (sample deviation, a constant feature stays zero), the intercept is not penalised.

* ridge: least squares plus ``alpha`` times the squared coefficients;
* lasso: half the mean squared error plus ``alpha`` times the absolute coefficients.

Sums are taken of values shifted by their means (a first, cheap aggregate), so large offsets such as years lose no digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Gram:
    """Rows, means, sample deviations, and the products of the standardised features with each other and the centred label."""

    features: list[str]
    n: int
    means: np.ndarray
    deviations: np.ndarray
    label_mean: float
    products: np.ndarray
    with_label: np.ndarray


@dataclass
class Line:
    """Coefficients in plain units."""

    features: list[str]
    coefficients: np.ndarray
    intercept: float

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """A projection: one product for each feature."""
        terms = [F.col(f) * float(c) for f, c in zip(self.features, self.coefficients)]
        return df.withColumn(prediction, sum(terms, F.lit(float(self.intercept))))


def gram(df: DataFrame, features: Sequence[str], label: str) -> Gram:
    """Rows with a null in the label or a feature are left out."""
    names = [*features, label]
    known = df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    first = known.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]).first()
    n = int(first["n"])
    if n < 2:
        raise ValueError("a fit needs two rows or more")
    means = np.array([first[f"m{i}"] for i in range(len(names))])
    centred = known.select(*[(F.col(c) - float(m)).alias(f"x{i}") for i, (c, m) in enumerate(zip(names, means))])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = centred.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs]).first()
    full = np.zeros((len(names), len(names)))
    for i, j in pairs:
        full[i, j] = full[j, i] = sums[f"s{i}_{j}"]
    p = len(features)
    deviations = np.sqrt(np.diag(full)[:p] / (n - 1))
    scale = np.where(deviations > 0, 1 / np.where(deviations > 0, deviations, 1), 0.0)
    return Gram(list(features), n, means[:p], deviations, float(means[p]), full[:p, :p] * np.outer(scale, scale), full[:p, p] * scale)


def _line(g: Gram, standardised: np.ndarray) -> Line:
    plain = np.where(g.deviations > 0, standardised / np.where(g.deviations > 0, g.deviations, 1), 0.0)
    return Line(g.features, plain, g.label_mean - float(plain @ g.means))


def ridge(g: Gram, alpha: float = 1.0) -> Line:
    """Normal equations; ``alpha`` 0 is least squares (the shortest solution where features depend on each other)."""
    left = g.products + alpha * np.eye(len(g.features))
    return _line(g, np.linalg.solve(left, g.with_label) if alpha > 0 else np.linalg.lstsq(left, g.with_label, rcond=None)[0])


def lasso(g: Gram, alpha: float = 1.0, tolerance: float = 1e-10, most_rounds: int = 10_000) -> Line:
    """Coordinate descent on the products, until no coefficient moves by more than ``tolerance``."""
    products, target = g.products / g.n, g.with_label / g.n
    b = np.zeros(len(target))
    for _ in range(most_rounds):
        moved = 0.0
        for i in range(len(b)):
            own = products[i, i]
            if own <= 0:
                continue
            rest = target[i] - products[i] @ b + own * b[i]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / own
            moved, b[i] = max(moved, abs(new - b[i])), new
        if moved <= tolerance:
            break
    return _line(g, b)
