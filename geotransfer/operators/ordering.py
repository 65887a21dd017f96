"""Order statistics without a single-task sort.

A plain window over one group sorts that whole group in one task. The functions
here first count equal values (partial counts before the shuffle), then either
use the plain window, when the largest group is known to fit one task, or
range-partition the values over the cluster, store them once, and add each
partition's offset to a sum that runs only inside the partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from geotransfer.operators.joins import null_safe_join
from geotransfer.session import materialize, plan_bytes

SMALL_PLAN_BYTES = 1024 * 1024  # of compressed files, less the columns not read: a row may be two bytes
GROUP_ROWS = 1_000_000
RANGE_BYTES = 256 * 1024 * 1024


def groups_fit_one_task(df: DataFrame, keys: Sequence[str], rows: int = GROUP_ROWS) -> bool:
    """True when no group can hold more than ``rows`` rows.

    A plan that reads less than a MB passes on Catalyst's estimate; anything
    else is counted (one aggregate with partial counts).
    """
    if plan_bytes(df) <= SMALL_PLAN_BYTES:
        return True
    largest = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys
               else df.agg(F.count(F.lit(1)).alias("n")))
    top = largest.agg(F.max("n")).first()[0]
    return (top or 0) <= rows


def _by(keys):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _range_partitions(df: DataFrame) -> int:
    """The session's shuffle width, or more when the estimated input is larger than that holds."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    known = size < 1 << 60  # a plan without file statistics reports an astronomic size
    return max(width, min(size // RANGE_BYTES, 100_000)) if known else width


def _spread(df: DataFrame, keys, order) -> DataFrame:
    parts = _range_partitions(df)
    ordered = df.repartitionByRange(parts, *keys, *order)
    return materialize(ordered.withColumn("_pid", F.spark_partition_id()))


def running_totals(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str],
                   following: str | None = None, totals: dict[str, str] | None = None,
                   distributed: bool | None = None) -> DataFrame:
    """Add inclusive running totals of ``sums`` (output name -> input column).

    Rows must be unique on (keys, order). ``following`` names a column that
    receives the next larger value of ``order`` inside the key, ``totals`` adds
    whole-key sums (output name -> input column).
    """
    keys, totals = list(keys), totals or {}
    if distributed is None:
        distributed = not groups_fit_one_task(df, keys)
    if not distributed:
        w = _by(keys).orderBy(order)
        cols = {out: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                for out, c in sums.items()}
        cols |= {out: F.sum(c).over(_by(keys)) for out, c in totals.items()}
        if following:
            cols[following] = F.lead(order).over(w)
        return df.withColumns(cols)

    spread = _spread(df, keys, [order])
    parts = spread.groupBy(*keys, "_pid").agg(
        F.min(order).alias("_first"),
        *[F.sum(c).alias(f"_t_{out}") for out, c in {**sums, **totals}.items()])
    pw = _by(keys).orderBy("_pid")
    before = pw.rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *keys, "_pid",
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums],
        *[F.sum(f"_t_{out}").over(_by(keys)).alias(out) for out in totals],
        F.lead("_first").over(pw).alias("_next_first"))
    inner = Window.partitionBy(*keys, "_pid").orderBy(order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = null_safe_join(spread, offsets, [*keys, "_pid"])
    cols = {out: F.sum(c).over(upto) + F.col(f"_o_{out}") for out, c in sums.items()}
    if following:
        cols[following] = F.coalesce(F.lead(order).over(inner), F.col("_next_first"))
    return joined.withColumns(cols).select(*df.columns, *cols, *totals)


def number_rows(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (),
                name: str = "row_no", total: str | None = None,
                distributed: bool | None = None) -> DataFrame:
    """1-based row number by ``order`` (a unique sort key) inside ``keys``.

    ``total`` names a column for the number of rows in the key.
    """
    keys, order = list(keys), list(order)
    if distributed is None:
        distributed = not groups_fit_one_task(df, keys)
    if not distributed:
        out = df.withColumn(name, F.row_number().over(_by(keys).orderBy(*order)).cast("long"))
        return out.withColumn(total, F.count(F.lit(1)).over(_by(keys))) if total else out
    spread = _spread(df, keys, order)
    parts = spread.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = _by(keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = [F.sum("_n").over(_by(keys)).alias(total)] if total else []
    offsets = parts.select(*keys, "_pid", *sizes,
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*keys, "_pid").orderBy(*order)
    return (null_safe_join(spread, offsets, [*keys, "_pid"])
            .withColumn(name, F.row_number().over(inner) + F.col("_off"))
            .select(*df.columns, name, *([total] if total else [])))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n) over non-NULL, non-NaN values."""
    v = F.col(value).cast("double")
    return (df.where(F.col(value).isNotNull() & ~F.isnan(v))
            .groupBy(*keys, v.alias("value")).agg(F.count(F.lit(1)).alias("n")))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str,
                  distributed: bool | None = None) -> DataFrame:
    """Add the average-tie rank of ``value`` inside ``keys``.

    Ranks are worked out on distinct values and joined back, so a value shared
    by very many rows costs one rank row (AQE splits its join partition).
    """
    keys = list(keys)
    ranked = running_totals(value_counts(df, keys, value), keys, "value", {"_upto": "n"},
                            distributed=distributed)
    ranks = ranked.select(*keys, F.col("value").alias(value),
                          (F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2).alias(out))
    return null_safe_join(df.withColumn(value, F.col(value).cast("double")), ranks, [*keys, value])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, k: int,
                  rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each group by ``order``.

    Spark keeps only ``k`` rows per group on the map side (window group limit),
    so a hot group shuffles at most k rows per input task, as long as ``k`` is
    within ``spark.sql.optimizer.windowGroupLimitThreshold`` (``build_session`` raises it).
    """
    col = rank or "_rank"
    out = (df.withColumn(col, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
           .where(F.col(col) <= k))
    return out if rank else out.drop(col)
