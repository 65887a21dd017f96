"""Logistic models of all folds at once, by Newton steps.

A step is one scan: each task sums gradient and Hessian of every fold's training rows in its own
batch, the sums meet in one aggregate, and the driver solves one small system per fold. The loss
is C times the summed log loss plus half the squared weights of the standardised features; the
intercept is free. Standardising comes from the folds' second moments (one more scan), and so
does the first step, which starts at zero weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geotransfer.operators.guards import safe_predictors
from geotransfer.plans.moments import Moments, grouped_moments, matrix, total
from geotransfer.schemas import FOLD

STEPS, TOLERANCE = 100, 1e-9


@dataclass(frozen=True)
class LogisticFit:
    """Intercept first; ``mean`` and ``sd`` standardise the features. ``gradient`` is its largest entry at the weights."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    sd: tuple[float, ...]
    gradient: float
    steps: int

    def margin(self) -> Column:
        out = F.lit(self.weights[0])
        for c, w, m, s in zip(self.features, self.weights[1:], self.mean, self.sd):
            out = out + F.lit(w) * ((F.col(c) - F.lit(m)) / F.lit(s))
        return out

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))


def _sums(df: DataFrame, cols: list[str], models: dict) -> dict:
    """Per held-out fold: summed loss, gradient and Hessian of the other folds' rows at the given weights."""
    size = len(cols) + 1
    upper = np.triu_indices(size)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: [0.0, np.zeros(size), np.zeros((size, size))] for k in models}
        for b in batches:
            x, y = matrix(b, cols), b.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            folds = b.column("fold").to_numpy(zero_copy_only=False)
            for k, (w, mean, sd) in models.items():
                use = folds != k
                z = np.column_stack([np.ones(int(use.sum())), (x[use] - mean) / sd])
                m = z @ w
                p = np.where(m >= 0, 1 / (1 + np.exp(-np.abs(m))), 1 - 1 / (1 + np.exp(-np.abs(m))))
                held = sums[k]
                held[0] += float((np.logaddexp(0, m) - y[use] * m).sum())
                held[1] += z.T @ (p - y[use])
                held[2] += (z * (p * (1 - p))[:, None]).T @ z
        out = [(k, *[float(v) for v in (s[0], *s[1], *s[2][upper])]) for k, s in sums.items()]
        flat = [(k, i, v) for k, *values in out for i, v in enumerate(values)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), (pa.int64(), pa.int32(), pa.float64()))],
                                         ["held", "place", "value"])

    rows = (df.mapInArrow(scan, "held bigint, place int, value double").groupBy("held", "place").agg(F.sum("value").alias("value"))
            .collect())  # (folds) x (features squared) numbers
    out = {}
    for k in models:
        v = np.array([r["value"] for r in sorted((r for r in rows if r["held"] == k), key=lambda r: r["place"])])
        hessian = np.zeros((size, size))
        hessian[upper] = v[1 + size:]
        out[k] = (v[0], v[1:1 + size], hessian + np.triu(hessian, 1).T)
    return out


def _at_zero(m: Moments) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian at zero weights from the moments of the features and, last, the label."""
    sd = m.sd()[:-1]
    hessian = np.zeros((len(m.mean), len(m.mean)))
    hessian[0, 0], hessian[1:, 1:] = m.n / 4, m.cross[:-1, :-1] / np.outer(sd, sd) / 4
    return m.n * math.log(2), np.append(m.n * (0.5 - m.mean[-1]), -m.cross[:-1, -1] / sd), hessian


def fit_folds(df: DataFrame, features: Sequence[str], label: str = "label", fold: str = FOLD, c: float = 1.0,
              steps: int = STEPS, tolerance: float = TOLERANCE) -> dict[int, LogisticFit]:
    """A model per fold, trained on all the other folds. ``tolerance`` bounds the gradient per training row."""
    cols = safe_predictors(features)
    data = df.select(F.col(fold).cast("bigint").alias("fold"), F.col(label).cast("double").alias("label"),
                     *[F.col(f).cast("double").alias(f) for f in cols])
    groups = grouped_moments(data, [*cols, "label"], "fold")
    whole = total(groups)
    rest = {k: whole.minus(m) for k, m in groups.items()}
    penalty = np.append(0.0, np.full(len(cols), 1.0 / c))
    weights = {k: np.zeros(len(cols) + 1) for k in rest}
    move, loss, done, taken = {k: np.zeros(len(cols) + 1) for k in rest}, {}, {}, 0
    while len(done) < len(rest) and taken <= steps:
        open_ = {k: (weights[k] + move[k], rest[k].mean[:-1], rest[k].sd()[:-1]) for k in rest if k not in done}
        found = _sums(data, cols, open_) if taken else {k: _at_zero(m) for k, m in rest.items()}
        for k, (value, gradient, hessian) in found.items():
            tried = weights[k] + move[k]
            value += 0.5 * float(penalty @ tried ** 2)
            if k in loss and value > loss[k] + 1e-9 * abs(loss[k]):
                move[k] = move[k] / 2  # the full step went too far: half of it next
                continue
            weights[k], loss[k] = tried, value
            gradient = gradient + penalty * tried
            largest = float(np.abs(gradient).max())
            if largest <= tolerance * rest[k].n:
                done[k] = (largest, taken)
            move[k] = -np.linalg.solve(hessian + np.diag(penalty) + 1e-12 * np.eye(len(penalty)), gradient)
        taken += 1
    if len(done) < len(rest):
        raise RuntimeError(f"no convergence within {steps} steps for folds {sorted(set(rest) - set(done))}")
    return {k: LogisticFit(tuple(cols), tuple(map(float, weights[k])), tuple(map(float, rest[k].mean[:-1])),
                           tuple(map(float, rest[k].sd()[:-1])), *done[k]) for k in rest}


def held_out(df: DataFrame, fits: dict[int, LogisticFit], fold: str = FOLD, out: str = "score") -> DataFrame:
    """Every row with the probability of the model that has not seen its fold."""
    score = F.lit(None).cast("double")
    for k, fit in fits.items():
        score = F.when(F.col(fold) == k, fit.probability()).otherwise(score)
    return df.withColumn(out, score)
