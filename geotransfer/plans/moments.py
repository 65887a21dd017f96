"""Mergeable second moments of any width, and what follows from them: ridge, scaling, components.

A task keeps, per group, the count, the means and the centred cross products of its rows (one
packed triangle); two sets of rows merge exactly, so partial results meet in two rounds: within
``LANES`` lanes, then per group. One scan serves every fold, and a training set is the total
minus the held-out fold. The driver sees one triangle per group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

LANES = 64


@dataclass
class Moments:
    """Count, means and centred cross products (sums, not averages)."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        mean = x.mean(0)
        z = x - mean
        return Moments(len(x), mean, z.T @ z)

    def plus(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if not self.n else self
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.cross + other.cross + np.outer(d, d) * (self.n * other.n / n))

    def minus(self, part: Moments) -> Moments:
        n = self.n - part.n
        mean = (self.mean * self.n - part.mean * part.n) / n
        d = part.mean - mean
        return Moments(n, mean, self.cross - part.cross - np.outer(d, d) * (n * part.n / self.n))

    def packed(self) -> tuple[int, bytes, bytes]:
        return self.n, self.mean.tobytes(), self.cross[np.triu_indices(len(self.mean))].tobytes()

    @staticmethod
    def unpacked(n: int, mean: bytes, triangle: bytes) -> Moments:
        m = np.frombuffer(mean)
        cross = np.zeros((len(m), len(m)))
        at = np.triu_indices(len(m))
        cross[at] = np.frombuffer(triangle)
        return Moments(n, m, cross + np.triu(cross, 1).T)

    def sd(self) -> np.ndarray:
        """Population standard deviations, 1 where a column is constant."""
        sd = np.sqrt(np.maximum(np.diag(self.cross), 0) / self.n)
        return np.where(sd > 0, sd, 1.0)

    def ridge(self, alpha: float) -> tuple[np.ndarray, float]:
        """Weights and intercept of the last column on the others, standardised, by the normal equations."""
        sd = self.sd()[:-1]
        gram = self.cross[:-1, :-1] / np.outer(sd, sd)
        w = np.linalg.solve(gram + alpha * np.eye(len(sd)), self.cross[:-1, -1] / sd) / sd
        return w, float(self.mean[-1] - w @ self.mean[:-1])

    def components(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``k`` principal directions of the standardised columns, and their shares of variance."""
        sd = self.sd()
        values, vectors = np.linalg.eigh(self.cross / np.outer(sd, sd))
        order = np.argsort(-values, kind="stable")[:k]
        return vectors[:, order], values[order] / values.sum()


_ROW = "lane int, n bigint, mean binary, triangle binary"


def matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Columns as float64, rows by columns; a missing value is an error, not a silent zero."""
    for c in columns:
        if batch.column(c).null_count:
            raise ValueError(f"missing value in {c}")
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])


def grouped_moments(df: DataFrame, columns: Sequence[str], group: str) -> dict:
    """``Moments`` of ``columns`` per value of ``group``, in one scan. Null is a group."""
    columns = list(columns)
    kind = df.schema[group].dataType.simpleString()

    def emit(found: dict, key_type: pa.DataType, lane: int) -> pa.RecordBatch:
        rows = [m.packed() for m in found.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), key_type), pa.array([lane] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()),
             pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
            ["key", "lane", "n", "mean", "triangle"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, key_type = {}, None
        for b in batches:
            key_type, keys = b.column("key").type, b.column("key").dictionary_encode("encode")
            x, at = matrix(b, columns), keys.indices.to_numpy()
            for place, key in enumerate(keys.dictionary.to_pylist()):
                part = Moments.of(x[at == place])
                found[key] = found[key].plus(part) if key in found else part
        if found:
            yield emit(found, key_type, TaskContext.get().partitionId() % LANES)

    def merge(lane: int | None):
        def task(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for n, mean, triangle in zip(*[b.column(c).to_pylist() for c in ("n", "mean", "triangle")]):
                    part = Moments.unpacked(n, mean, triangle)
                    total = total.plus(part) if total else part
            yield emit({key[0].as_py(): total}, key[0].type, 0 if lane is None else lane)
        return task

    wide = df.select(F.col(group).alias("key"), *[F.col(c).cast("double").alias(c) for c in columns])
    parts = wide.mapInArrow(scan, f"key {kind}, {_ROW}")
    lanes = parts.groupBy("key", "lane").applyInArrow(merge(None), f"key {kind}, {_ROW}")
    whole = lanes.groupBy("key").applyInArrow(merge(None), f"key {kind}, {_ROW}")
    return {r["key"]: Moments.unpacked(r["n"], bytes(r["mean"]), bytes(r["triangle"])) for r in whole.collect()}


def total(groups: dict) -> Moments:
    out = None
    for m in groups.values():
        out = out.plus(m) if out else m
    return out
