"""Logistic models fitted by Newton steps, each one aggregation over the rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Logistic:
    """Weights of standardised features and of the constant, which comes first."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def probability(self) -> Column:
        z = F.lit(self.weights[0])
        for f, m, s, w in zip(self.features, self.mean, self.scale, self.weights[1:], strict=True):
            z = z + w * (F.col(f).cast("double") - m) / s
        z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
        return 1 / (1 + F.exp(-z))


def fit(rows: DataFrame, features: list[str], label: str, l2: float = 0.0, balanced: bool = False, steps: int = 40) -> Logistic:
    """The model of greatest likelihood, less ``l2 / 2`` of the squared weights per row (the constant is free).

    Features are standardised, those that don't vary keep a scale of 1.  With
    ``balanced`` positive rows weigh as many times more as there are fewer of
    them.  Each step sums gradient and curvature, (k + 1)(k + 4) / 2 numbers,
    over all rows; nothing else is gathered.  Rows with a null are left out;
    without rows or with one label only all weights but the constant are 0.
    """
    x = rows.select(*(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)), F.col(label).cast("double").alias("y")).dropna()
    k = len(features)
    s = x.agg(F.count("*").alias("n"), F.sum("y").alias("p"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(k)), *(F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(k))).first()
    n, p = s["n"], s["p"] or 0.0
    mean = [s[f"m{i}"] or 0.0 for i in range(k)]
    scale = [v if (v := s[f"s{i}"] or 0.0) > 1e-8 else 1.0 for i in range(k)]
    if not n or not 0 < p < n:
        return Logistic(tuple(features), tuple(mean), tuple(scale), (float(np.log((p + 0.5) / (n - p + 0.5))), *[0.0] * k))
    weight = F.when(F.col("y") == 1, max(1.0, (n - p) / p)).otherwise(1.0) if balanced else F.lit(1.0)
    z = x.select(F.lit(1.0).alias("z0"), *(((F.col(f"x{i}") - mean[i]) / scale[i]).alias(f"z{i + 1}") for i in range(k)), "y", weight.alias("w"))
    total = n - p + p * (max(1.0, (n - p) / p) if balanced else 1.0)
    w, penalty = np.zeros(k + 1), l2 * np.array([0.0, *[1.0] * k])
    for _ in range(steps):
        odds = F.lit(0.0)
        for i in range(k + 1):
            odds = odds + float(w[i]) * F.col(f"z{i}")
        q = z.withColumn("q", 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))).withColumn("h", F.col("w") * F.col("q") * (1 - F.col("q"))).withColumn("e", F.col("w") * (F.col("q") - F.col("y")))
        sums = q.agg(*(F.sum(F.col("e") * F.col(f"z{i}")).alias(f"g{i}") for i in range(k + 1)), *(F.sum(F.col("h") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i in range(k + 1) for j in range(i, k + 1))).first()
        gradient = np.array([sums[f"g{i}"] for i in range(k + 1)]) / total + penalty * w
        curve = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) / total + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, gradient)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return Logistic(tuple(features), tuple(mean), tuple(scale), tuple(map(float, w)))
