"""Distribution summaries, two-sample distances, rank statistics, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from geotransfer.functions.numeric import l2_norm
from geotransfer.operators.joins import lookup_join, null_safe_join
from geotransfer.operators.ordering import average_ranks, running_totals
from geotransfer.operators.quantiles import SUMMARY_PROBS, quantiles


def summary(df: DataFrame, value: str, by: Sequence[str] = (), prefix: str = "",
            probs: dict[str, float] = SUMMARY_PROBS, sample_sd: bool = False) -> DataFrame:
    """n, mean, sd, min, max and exact quantiles of one column."""
    by = list(by)
    sd = F.stddev_samp(value) if sample_sd else F.stddev_pop(value)
    cols = [F.count(value).alias(f"{prefix}n"), F.avg(value).alias(f"{prefix}mean"),
            sd.alias(f"{prefix}sd"), F.min(value).alias(f"{prefix}min"),
            F.max(value).alias(f"{prefix}max")]
    q = quantiles(df, by, value, {f"{prefix}{k}": p for k, p in probs.items()})
    if by:
        return null_safe_join(df.groupBy(*by).agg(*cols), q, by)
    one = q.select(F.struct(*q.columns).alias("s")).scalar()
    return df.agg(*cols).withColumns({c: one[c] for c in q.columns})


def distortion(sample: DataFrame, raw: DataFrame, value: str, by: Sequence[str],
               smd_limit: float = 0.10, shift_limit: float = 0.10) -> DataFrame:
    """Sample against raw: standardised mean difference, median shift, status."""
    by = list(by)
    s = summary(sample, value, by, "sampled_")
    r = summary(raw, value, by, "raw_")
    smd = (F.col("sampled_mean") - F.col("raw_mean")) / F.col("raw_sd")
    shift = F.abs(F.col("sampled_p50") - F.col("raw_p50")) / (F.col("raw_p75") - F.col("raw_p25"))
    j = null_safe_join(r, s, by).withColumns({"smd": smd, "median_shift_over_raw_iqr": shift})
    status = (F.when(F.abs(F.col("smd")) > smd_limit, F.lit("FAIL"))
              .when(F.col("median_shift_over_raw_iqr") > shift_limit,
                    F.lit("PASS WITH DISTRIBUTION WARNING"))
              .otherwise(F.lit("PASS")))
    return j.withColumn("audit_status", status)


def class_histogram(df: DataFrame, by: Sequence[str], cls: str,
                    meanings: dict[int, str] | None = None) -> DataFrame:
    """Counts and shares per class inside each group; NULL is a class of its own."""
    n = df.groupBy(*by, cls).agg(F.count(F.lit(1)).alias("n"))
    out = n.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    if meanings:
        table = F.create_map(*[F.lit(x) for kv in meanings.items() for x in kv])
        out = out.withColumn("meaning", F.coalesce(table[F.col(cls)], F.lit("undocumented")))
    return out


def count_maps(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """One map of counts per group (the number of keys, not rows, is collected)."""
    n = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), F.col("_n"))))
    return n.groupBy(*by).agg(F.map_from_entries(pairs).alias("counts"))


def map_rows(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.explode(column).alias("key", "n"))


def total_variation(a: DataFrame, b: DataFrame, category: str, by: Sequence[str] = ()) -> DataFrame:
    """Half the absolute difference of category shares; an absent category counts as 0."""
    both = (a.select(*by, category, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
            .unionByName(b.select(*by, category, F.lit(0).alias("_a"), F.lit(1).alias("_b"))))
    n = both.groupBy(*by, category).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    if by:
        w = Window.partitionBy(*by)
        all_a, all_b = F.sum("_a").over(w), F.sum("_b").over(w)
    else:
        both_n = n.agg(F.struct(F.sum("_a").alias("a"), F.sum("_b").alias("b")).alias("s")).scalar()
        all_a, all_b = both_n["a"], both_n["b"]
    shares = n.select(*by, F.abs(F.col("_a") / all_a - F.col("_b") / all_b).alias("_d"))
    total = (F.sum("_d") * 0.5).alias("total_variation")
    return shares.groupBy(*by).agg(total) if by else shares.agg(total)


def unpivot(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.unpivot([F.col(c) for c in keep],
                      [F.col(c).cast("double").alias(c) for c in features], "feature", "value")


def two_sample(long: DataFrame, keys: Sequence[str], value: str, is_source: Column,
               distributed: bool | None = None) -> DataFrame:
    """KS statistic and 1-D Wasserstein distance of source against target per key.

    Equal values are merged before the running sums, so ties close before the
    two distribution functions are compared.
    """
    keys = list(keys)
    counts = (long.where(F.col(value).isNotNull() & ~F.isnan(value))
              .groupBy(*keys, F.col(value).alias("value"))
              .agg(F.count_if(is_source).alias("ns"), F.count_if(~is_source).alias("nt")))
    run = running_totals(counts, keys, "value", {"cs": "ns", "ct": "nt"}, "nxt",
                         {"source_n": "ns", "target_n": "nt"}, distributed)
    gap = F.abs(F.col("cs") / F.col("source_n") - F.col("ct") / F.col("target_n"))
    return (run.groupBy(*keys)
            .agg(F.max("source_n").alias("source_n"), F.max("target_n").alias("target_n"),
                 F.max(gap).alias("ks_statistic"),
                 F.sum(gap * (F.col("nxt") - F.col("value"))).alias("wasserstein_distance")))


def ks_pvalue(d, n1, n2) -> Column:
    """Two-sided asymptotic Kolmogorov p value (first 40 terms of the series)."""
    en = F.sqrt(n1 * n2 / (n1 + n2))
    lam = en * d
    p = F.lit(0.0)
    for k in range(1, 41):
        p = p + F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam * lam)
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def drift_table(df: DataFrame, domain: str, source: str, features: Sequence[str],
                distributed: bool | None = None) -> DataFrame:
    """Mean, sd, median of both domains with KS and Wasserstein, one row per feature."""
    long = unpivot(df, [domain], features)
    is_source = F.col(domain) == source
    marked = long.withColumn("_side", F.when(is_source, F.lit("source")).otherwise(F.lit("target")))
    moments = long.groupBy("feature").agg(
        F.avg(F.when(is_source, F.col("value"))).alias("source_mean"),
        F.avg(F.when(~is_source, F.col("value"))).alias("target_mean"),
        F.stddev_pop(F.when(is_source, F.col("value"))).alias("source_std"),
        F.stddev_pop(F.when(~is_source, F.col("value"))).alias("target_std"))
    med = quantiles(marked, ["feature", "_side"], "value", {"median": 0.5}, distributed)
    med = med.groupBy("feature").agg(
        F.max(F.when(F.col("_side") == "source", F.col("median"))).alias("source_median"),
        F.max(F.when(F.col("_side") == "target", F.col("median"))).alias("target_median"))
    dist = two_sample(long, ["feature"], "value", is_source, distributed)
    out = moments.join(med, "feature").join(dist, "feature")
    return out.withColumn("ks_pvalue", ks_pvalue(F.col("ks_statistic"), F.col("source_n").cast("double"),
                                                 F.col("target_n").cast("double")))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (),
             distributed: bool | None = None, y_rank: str | None = None) -> DataFrame:
    """Rank correlation with average ties and its large-sample two-sided p value; NaN where a side is constant.

    ``y_rank`` names a column that holds the average ranks of ``y`` already, over the rows where both sides have a value.
    """
    by = list(by)
    given = [F.col(y_rank).alias("_ry")] if y_rank else []
    pairs = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *given)
    pairs = pairs.where(F.col("_x").isNotNull() & F.col("_y").isNotNull()
                        & ~F.isnan("_x") & ~F.isnan("_y"))
    ranked = average_ranks(pairs, by, "_x", "_rx", distributed)
    if not y_rank:
        ranked = average_ranks(ranked, by, "_y", "_ry", distributed)
    # Spark's corr divides by zero, an error in ANSI mode, where all values of a side are equal.
    spread = F.stddev_pop("_rx") * F.stddev_pop("_ry")
    rho = F.when(spread == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop("_rx", "_ry"), spread))
    cols = [F.count(F.lit(1)).alias("n"), rho.alias("rho")]
    out = ranked.groupBy(*by).agg(*cols) if by else ranked.agg(*cols)
    z = F.abs(F.col("rho")) * F.sqrt(F.col("n") - 1)
    return out.withColumn("p_value", normal_two_sided(z))


def normal_two_sided(z: Column) -> Column:
    """2*(1 - Phi(z)) by the Abramowitz-Stegun 26.2.17 polynomial (error below 1.5e-7)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * z)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937)
                + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    return F.lit(2.0) * F.exp(-z * z / 2) / F.lit(2.5066282746310002) * poly


def auroc(df: DataFrame, score: str, is_positive: Column, by: Sequence[str] = (),
          distributed: bool | None = None) -> DataFrame:
    """Exact area under the ROC curve by the rank-sum form, ties counted half.

    Only (score, positives, negatives) counts are ordered, never the rows.
    """
    by = list(by)
    counts = df.groupBy(*by, F.col(score).cast("double").alias("value")).agg(
        F.count_if(is_positive).alias("np"), F.count_if(~is_positive).alias("nn"))
    run = running_totals(counts, by, "value", {"below": "nn"}, distributed=distributed)
    wins = F.col("np") * (F.col("below") - F.col("nn") + F.col("nn") / 2)
    cols = [F.sum("np").alias("positive_n"), F.sum("nn").alias("negative_n"),
            F.try_divide(F.sum(wins), F.sum("np") * F.sum("nn")).alias("auroc")]
    return run.groupBy(*by).agg(*cols) if by else run.agg(*cols)


def norm_audit(df: DataFrame, vector: str, tolerance: float = 0.02) -> DataFrame:
    """Distribution of vector lengths and how many leave 1 +- tolerance (kept, only flagged)."""
    norms = df.select(l2_norm(vector).alias("norm"))
    flagged = norms.agg(F.count_if(F.abs(F.col("norm") - 1) > tolerance)).scalar()
    out = summary(norms, "norm", probs={"p01": 0.01, "median": 0.5, "p99": 0.99}, sample_sd=True)
    return out.withColumn("deviating_n", flagged)


def timing_shares(df: DataFrame, domain: str, reference: str, ts: str) -> DataFrame:
    """Monthly shares per domain and year, with rows outside the reference season."""
    d = df.withColumns({"year": F.year(ts), "month": F.month(ts), "_doy": F.dayofyear(ts)})
    limits = quantiles(d.where(F.col(domain) == reference), ["year"], "_doy",
                       {"doy_p05": 0.05, "doy_p95": 0.95})
    marked = lookup_join(d, limits, ["year"], "left")
    unusual = (F.col("_doy") < F.col("doy_p05")) | (F.col("_doy") > F.col("doy_p95"))
    rows = marked.groupBy(domain, "year", "month").agg(
        F.count(F.lit(1)).alias("N"), F.count_if(unusual).alias("unusual_n"))
    w = Window.partitionBy(domain, "year")
    return rows.withColumns({"fraction": F.col("N") / F.sum("N").over(w),
                             "unusual_fraction": F.col("unusual_n") / F.col("N")})

