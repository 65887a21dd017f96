"""Exact quantiles (linear interpolation), binning by quantile and fixed edges."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from geotransfer.operators.joins import lookup_join, null_safe_join
from geotransfer.operators.ordering import (groups_fit_one_task, running_totals, value_counts)

SUMMARY_PROBS = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75,
                 "p95": 0.95, "p99": 0.99}


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
              distributed: bool | None = None) -> DataFrame:
    """One row per key with the exact quantiles named in ``probs`` (NULL where a key has no value).

    Small groups use Spark's ``percentile``, which holds a group's distinct
    values in one task. Larger groups are ranked across the cluster and only
    the two order statistics around each probability are picked out.
    """
    keys = list(keys)
    if distributed is None:
        distributed = not groups_fit_one_task(df.select(*keys, value), keys)
    if not distributed:
        real = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
        # One array-valued aggregate: the group's values are gathered once for all probabilities.
        every = F.percentile(real, [float(p) for p in probs.values()]).alias("_q")
        got = df.groupBy(*keys).agg(every) if keys else df.agg(every)
        return got.select(*keys, *[F.col("_q")[i].alias(out) for i, out in enumerate(probs)])

    ranked = running_totals(value_counts(df, keys, value), keys, "value", {"upto": "n"},
                            totals={"total": "n"}, distributed=True)
    at, out_cols = [], []
    for out, p in probs.items():
        h = (F.col("total") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        low = (F.col("upto") - F.col("n") <= lo) & (lo < F.col("upto"))
        high = (F.col("upto") - F.col("n") <= hi) & (hi < F.col("upto"))
        at += [F.max(F.when(low, F.col("value"))).alias(f"_l_{out}"),
               F.max(F.when(high, F.col("value"))).alias(f"_h_{out}")]
        frac = h - lo
        out_cols.append((F.col(f"_l_{out}") + (F.col(f"_h_{out}") - F.col(f"_l_{out}")) * frac)
                        .alias(out))
    at.append(F.max("total").alias("total"))
    if not keys:
        return ranked.agg(*at).select(*out_cols)
    # A group without any value keeps its row, as on the other path.
    picked = null_safe_join(df.select(*keys).distinct(), ranked.groupBy(*keys).agg(*at), keys, "left")
    return picked.select(*keys, *out_cols)


def quantile_edges(df: DataFrame, value: str, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, edges): the k+1 quantile edges of ``value`` with repeats dropped."""
    names = {f"_e{i}": i / k for i in range(k + 1)}
    q = quantiles(df, keys, value, names)
    return q.select(*keys, F.array_distinct(F.array(*names)).alias("edges"))


def bin_of(value, edges: Column, k: int) -> Column:
    """1-based right-closed bin among at most ``k``; the lowest edge belongs to bin 1."""
    v = F.col(value) if isinstance(value, str) else value
    code = F.lit(1)
    for i in range(2, k + 1):
        above = (F.size(edges) > i) & (F.try_element_at(edges, F.lit(i)) < v)
        code = code + F.when(above, 1).otherwise(0)
    return F.when(v.isNotNull(), code)


def quantile_bins(df: DataFrame, value: str, k: int, out: str,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Quantile binning; the edges are one small row per key (a scalar subquery without keys)."""
    edges = quantile_edges(df, value, k, keys)
    if keys:
        marked = lookup_join(df, edges.withColumnRenamed("edges", "_edges"), keys)
    else:
        marked = df.withColumn("_edges", edges.scalar())
    return marked.withColumn(out, bin_of(value, F.col("_edges"), k)).drop("_edges")


def fixed_edges(reference: DataFrame, value: str, k: int) -> list[float]:
    """Edges from a reference table with the ends opened; repeated edges are an error."""
    names = {f"_e{i}": i / k for i in range(k + 1)}
    row = quantiles(reference, [], value, names).first()
    edges = [row[n] for n in names]
    if len(set(edges)) != len(edges):
        raise RuntimeError("reference quantiles repeat")
    return [-math.inf, *edges[1:-1], math.inf]


def cut(df: DataFrame, value: str, edges: list[float], out: str) -> DataFrame:
    """0-based right-closed bins for given edges (at most a few dozen)."""
    code = sum((F.col(value) > F.lit(e)).cast("int") for e in edges[1:-1])
    return df.withColumn(out, F.when(F.col(value).isNotNull(), code if len(edges) > 2 else F.lit(0)))
