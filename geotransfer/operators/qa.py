"""Quality filters, stage cascades and missing-value accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from geotransfer.functions.numeric import all_finite, clean, finite
from geotransfer.operators.guards import duplicate_keys, refuse_rows
from geotransfer.schemas import DOCUMENTED_QA, QA_STAGES, SENTINEL


def footprint_stages() -> list[tuple[str, Column]]:
    """The seven nested quality stages, each with its own predicate."""
    rules = [
        F.lit(True),
        F.col("algorithm_run_flag") == 1,
        F.col("shot_number").isNotNull() & F.col("agbd").isNotNull() & F.col("agbd_se").isNotNull(),
        F.col("l4_quality_flag") == 1,
        F.col("degrade_flag") == 0,
        F.col("agbd") >= 0,
        F.col("agbd_se") >= 0,
    ]
    return list(zip(QA_STAGES, rules))


def quality_filter(df: DataFrame, stages=None) -> DataFrame:
    """Rows passing every stage (one merged predicate, pushed to the scan)."""
    keep = F.lit(True)
    for _, rule in stages or footprint_stages():
        keep = keep & rule
    return df.where(keep)


def cascade_counts(df: DataFrame, stages=None, by: Sequence[str] = (),
                   extra: Sequence[Column] = ()) -> DataFrame:
    """Survivors of every stage in one scan: cumulative predicates, conditional counts."""
    keep, cols = F.lit(True), []
    for name, rule in stages or footprint_stages():
        keep = keep & F.coalesce(rule, F.lit(False))
        cols.append(F.count_if(keep).alias(name))
    cols = [*extra, *cols]
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def cascade_table(counts: DataFrame, stage_names: Sequence[str] = tuple(QA_STAGES)) -> DataFrame:
    """Long stage table: survivors, removed at the stage, percent of the first stage."""
    total = counts.agg(*[F.sum(n).alias(n) for n in stage_names])
    pairs = ", ".join(f"{i}, '{n}', `{n}`" for i, n in enumerate(stage_names))
    long = total.selectExpr(f"stack({len(stage_names)}, {pairs}) AS (stage, filter_stage, n_after)",
                            f"`{stage_names[0]}` AS _first")
    w = Window.partitionBy("_first").orderBy("stage")
    return long.select(
        "stage", "filter_stage", "n_after",
        (F.lag("n_after").over(w) - F.col("n_after")).alias("removed_at_stage"),
        (F.col("n_after") / F.col("_first") * 100).alias("retained_from_raw_percent"))


def scene_filter(df: DataFrame, mode: str, polarisations: Sequence[str]) -> DataFrame:
    """Scene attribute filter including list membership."""
    keep = F.col("instrument_mode") == mode
    for p in polarisations:
        keep = keep & F.array_contains("polarisations", p)
    return df.where(keep)


def undocumented_classes(df: DataFrame, qa: str, documented=DOCUMENTED_QA) -> DataFrame:
    """Class codes outside the documented list, with counts."""
    code = F.col(qa).try_cast("int")
    return (df.groupBy(code.alias(qa)).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col(qa).isNotNull() & ~F.col(qa).isin(*documented)))


def refuse_undocumented(df: DataFrame, qa: str, documented=DOCUMENTED_QA) -> None:
    refuse_rows(undocumented_classes(df, qa, documented), "undocumented class")


def missing_counts(df: DataFrame, features: Sequence[str], sentinel: float = SENTINEL) -> DataFrame:
    """(feature, sentinel_n, non_finite_n) from one scan."""
    cols = []
    for c in features:
        cols += [F.count_if(F.col(c) == sentinel).alias(f"_s_{c}"),
                 F.count_if(~finite(c)).alias(f"_f_{c}")]
    pairs = ", ".join(f"'{c}', `_s_{c}`, `_f_{c}`" for c in features)
    return df.agg(*cols).selectExpr(
        f"stack({len(features)}, {pairs}) AS (feature, sentinel_n, non_finite_n)")


def null_boundary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Sentinels, NaN and infinities become NULL."""
    return df.withColumns({c: clean(c) for c in features})


def complete_cases(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.where(all_finite(features))


def out_of_bounds(df: DataFrame, columns: Sequence[str], limit: float = 1.000001) -> DataFrame:
    """One row: how many values of each bounded column exceed the limit."""
    return df.agg(*[F.count_if(F.abs(F.col(c)) > limit).alias(c) for c in columns])


def require_bounded(df: DataFrame, columns: Sequence[str], limit: float = 1.000001) -> None:
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.abs(F.col(c)) > limit)
    refuse_rows(df.where(bad).select(*columns), "bounded index out of range")


def exclusion_counts(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Rows hit by each reason (a row may count more than once)."""
    return df.agg(*[F.count_if(F.coalesce(r, F.lit(True))).alias(n) for n, r in reasons.items()])


def any_missing(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def availability(expected: DataFrame, sampled: DataFrame, on: Sequence[str], valid: Column,
                 by: Sequence[str], marks: dict[str, Column] | None = None,
                 images: DataFrame | None = None) -> DataFrame:
    """Expected, sampled and valid counts per group with the missing share.

    ``images`` (one row per group with ``image_count``) adds the scenes behind it. A sampled
    key that occurs twice stops the job: it would count its expected row twice.
    """
    refuse_rows(duplicate_keys(sampled, on), "a sampled key occurs twice")
    joined = expected.join(sampled.withColumn("_got", F.lit(True)), list(on), "left")
    ok = F.coalesce(valid, F.lit(False))
    n, v = F.count(F.lit(1)), F.count_if(ok)
    out = joined.groupBy(*by).agg(
        n.alias("frozen_sample_n"), F.count("_got").alias("sampled_n"),
        *[F.count_if(F.coalesce(m, F.lit(False))).alias(k) for k, m in (marks or {}).items()],
        v.alias("valid_n"), (1 - v / n).alias("missing_fraction"))
    if images is None:
        return out
    return (out.join(images, list(by), "left")
            .withColumn("image_count", F.coalesce("image_count", F.lit(0))))


def common_groups(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values present in both tables (for instance the years valid in both domains)."""
    # Repeats go on the map side: alone, intersect would sort and join all rows of the few values.
    return a.select(column).distinct().intersect(b.select(column).distinct())


def large_groups(df: DataFrame, by: Sequence[str], minimum: int) -> DataFrame:
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum))
