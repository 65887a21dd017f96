"""Regression metrics and the summary tables built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from geotransfer.operators.joins import lookup_join, null_safe_join
from geotransfer.operators.quantiles import quantiles
from geotransfer.schemas import R2_THRESHOLDS

METRICS = ("R2", "RMSE", "MAE", "Bias")


def metric_columns(y="agbd", p="prediction") -> list[Column]:
    """R2 (1 - SSE/SST about the evaluated rows), RMSE, MAE, Bias and N.

    Every figure, N included, is over the rows that have both a response and a prediction.
    """
    err = F.col(p).cast("double") - F.col(y).cast("double")
    yc = F.when(err.isNotNull(), F.col(y).cast("double"))
    sse, sst = F.sum(err * err), F.var_pop(yc) * F.count(yc)
    r2 = (F.when(sst > 0, F.lit(1.0) - F.try_divide(sse, sst))
          .when(F.count(yc) > 1, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))))
    return [r2.alias("R2"), F.sqrt(F.avg(err * err)).alias("RMSE"),
            F.avg(F.abs(err)).alias("MAE"), F.avg(err).alias("Bias"),
            F.count(err).alias("N")]


def metrics(df: DataFrame, y="agbd", p="prediction", by: Sequence[str] = (),
            min_rows: int = 0) -> DataFrame:
    cols = metric_columns(y, p)
    out = df.groupBy(*by).agg(*cols) if by else df.agg(*cols)
    return out.where(F.col("N") >= min_rows) if min_rows else out


def pooled_metrics(oof: DataFrame, fold: str, y="agbd", p="prediction",
                   by: Sequence[str] = ()) -> DataFrame:
    """Metrics of the pooled out-of-fold rows, with population sd over the folds."""
    per_fold = metrics(oof, y, p, [*by, fold])
    spread = [F.stddev_pop(m).alias(f"{m}_std") for m in METRICS]
    pool = metrics(oof, y, p, by)
    if by:
        return null_safe_join(pool, per_fold.groupBy(*by).agg(*spread), list(by))
    one = per_fold.agg(F.struct(*spread).alias("s")).scalar()
    return pool.withColumns({f"{m}_std": one[f"{m}_std"] for m in METRICS})


def mean_baseline(df: DataFrame, fold: str, y="agbd") -> DataFrame:
    """Predict each held-out fold by the mean response of the other folds."""
    per = df.groupBy(fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    total = per.agg(F.struct(F.sum("_s").alias("s"), F.sum("_n").alias("n")).alias("t")).scalar()
    means = per.select(fold, ((total["s"] - F.col("_s")) / (total["n"] - F.col("_n")))
                       .alias("prediction"))
    return lookup_join(df, means, [fold])


def run_summary(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs, sizes, and mean, sample sd and median of each metric over repeated runs."""
    aggs = [F.count(F.lit(1)).alias("runs"), F.median("N_train").alias("N_train"),
            F.avg("N_test").alias("N_test_mean")]
    for m in METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"),
                 F.median(m).alias(f"{m}_median")]
    return runs.groupBy(*by).agg(*aggs)


def with_zero_shot(summary: DataFrame, zero: DataFrame) -> DataFrame:
    """Put the zero-shot rows (budget 0, one run, no sd) in front of a run summary."""
    cols = [F.lit("zero_shot").alias("method"), F.lit(0).alias("budget"), F.lit(1).cast("long").alias("runs"),
            F.lit(0.0).alias("N_train"), F.col("N").cast("double").alias("N_test_mean")]
    for m in METRICS:
        cols += [F.col(m).alias(f"{m}_mean"), F.lit(None).cast("double").alias(f"{m}_sd"),
                 F.col(m).alias(f"{m}_median")]
    return zero.select(*cols).unionByName(summary.select("method", "budget", "runs", "N_train", "N_test_mean",
                                                         *[f"{m}_{s}" for m in METRICS
                                                           for s in ("mean", "sd", "median")]))


def label_thresholds(summary: DataFrame, by: Sequence[str],
                     thresholds: Sequence[float] = tuple(R2_THRESHOLDS)) -> DataFrame:
    """Smallest budget whose mean R2 is strictly above each threshold."""
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    reached = F.min(F.when(F.col("R2_mean") > F.col("R2_threshold"), F.col("budget")))
    return (summary.withColumn("R2_threshold", each).groupBy(*by, "R2_threshold")
            .agg(F.coalesce(reached.cast("string"), F.lit("not reached")).alias("labels_required")))


def first_positive_budget(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    return summary.groupBy(*by).agg(
        F.min(F.when(F.col("R2_mean") > 0, F.col("budget"))).alias("first_positive_R2_labels"))


def contrast_summary(contrasts: DataFrame) -> DataFrame:
    return contrasts.groupBy("contrast").agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("delta_R2").alias("mean_delta_R2"), F.avg("delta_RMSE").alias("mean_delta_RMSE"),
        F.count_if(F.col("delta_R2") > 0).alias("folds_favoring_first_R2"),
        F.count_if(F.col("delta_RMSE") < 0).alias("folds_favoring_first_RMSE"))


def transfer_loss(source: DataFrame, target: DataFrame, on: str = "representation") -> DataFrame:
    """Source metrics against target metrics of the same feature set."""
    s = source.select(on, F.col("R2").alias("source_R2"), F.col("RMSE").alias("source_RMSE"))
    t = target.select(on, F.col("R2").alias("target_R2"), F.col("RMSE").alias("target_RMSE"),
                      F.col("MAE").alias("target_MAE"), F.col("Bias").alias("target_Bias"), "N")
    ratio = F.col("target_RMSE") / F.col("source_RMSE")
    return s.join(t, on).withColumns({
        "R2_drop": F.col("source_R2") - F.col("target_R2"),
        "RMSE_increase": F.col("target_RMSE") - F.col("source_RMSE"),
        "RMSE_increase_percent": (ratio - 1) * 100,
        "target_RMSE_over_source_RMSE": ratio,
    })


def best_by_error(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(model, config) with the lowest RMSE; ties go to the smaller name."""
    pick = F.min_by(F.struct("model", "config", "RMSE"),
                    F.struct("RMSE", "model", "config")).alias("_w")
    out = table.groupBy(*by).agg(pick) if by else table.agg(pick)
    return out.select(*by, "_w.*")


def best_by_r2(table: DataFrame, columns: Sequence[str], metric: str = "R2") -> DataFrame:
    """The row with the highest score; equal scores go to the first name in order."""
    top = F.min_by(F.struct(*columns), F.struct(-F.col(metric), F.col(columns[0])))
    return table.agg(top.alias("_w")).select("_w.*")


def mapping_gate(best: DataFrame, minimum_r2: float = 0.20) -> DataFrame:
    return best.withColumns({
        "positive_R2": F.col("R2") > 0,
        "map_authorized": (F.col("R2") >= minimum_r2) & (F.abs(F.col("Bias")) < F.col("RMSE")),
    })


def paired_method_choice(fold_metrics: DataFrame, cheaper: str, other: str,
                         tolerance: float = 0.01) -> DataFrame:
    """Cheaper method when practically similar, else the lower (RMSE, MAE)."""
    def mean_of(name, metric):
        return F.avg(F.when(F.col("method") == name, F.col(metric)))

    a = {m: mean_of(cheaper, m) for m in ("R2", "RMSE", "MAE")}
    b = {m: mean_of(other, m) for m in ("R2", "RMSE", "MAE")}
    t = fold_metrics.agg(F.abs(a["R2"] - b["R2"]).alias("r2_absolute_difference"),
                         (F.abs(a["RMSE"] - b["RMSE"]) / a["RMSE"]).alias("relative_rmse_difference"),
                         F.struct(a["RMSE"].alias("r"), a["MAE"].alias("m")).alias("_a"),
                         F.struct(b["RMSE"].alias("r"), b["MAE"].alias("m")).alias("_b"))
    similar = ((F.col("r2_absolute_difference") < tolerance)
               & (F.col("relative_rmse_difference") < tolerance))
    return t.select("r2_absolute_difference", "relative_rmse_difference",
                    similar.alias("practically_similar"),
                    F.when(similar | (F.col("_a") <= F.col("_b")), F.lit(cheaper))
                    .otherwise(F.lit(other)).alias("rule_winner"))


def residual_bins(df: DataFrame, bin_col: str, y="agbd", p="prediction",
                  by: Sequence[str] = (), r2_min_rows: int = 20) -> DataFrame:
    """Per-bin error summary; R2 only where a bin has enough rows."""
    keys = [*by, bin_col]
    base = metrics(df, y, p, keys).drop("MAE")
    q = quantiles(df.withColumn("_res", F.col(p) - F.col(y)), keys, "_res",
                  {"residual_q25": 0.25, "residual_median": 0.5, "residual_q75": 0.75})
    return (null_safe_join(base, q, keys)
            .withColumn("R2", F.when(F.col("N") >= r2_min_rows, F.col("R2")))
            .withColumn("residual_iqr", F.col("residual_q75") - F.col("residual_q25")))


def binned_bias(df: DataFrame, bin_col: str, y="agbd", p="prediction",
                by: Sequence[str] = ()) -> DataFrame:
    err = F.col(p) - F.col(y)
    return df.groupBy(*by, bin_col).agg(
        F.count(F.lit(1)).alias("N"), F.avg(y).alias("observed_mean"),
        F.avg(p).alias("prediction_mean"), F.avg(err).alias("bias"),
        F.avg(F.abs(err)).alias("MAE"))


def binned_distance_error(df: DataFrame, bin_col: str, distance: str, y="agbd",
                          p="prediction") -> DataFrame:
    err = F.col(p) - F.col(y)
    return df.groupBy(bin_col).agg(
        F.count(F.lit(1)).alias("N"), F.min(distance).alias("distance_min"),
        F.max(distance).alias("distance_max"), F.avg(F.abs(err)).alias("MAE"),
        F.sqrt(F.avg(err * err)).alias("RMSE"))


def training_sizes(df: DataFrame, fold: str, cap: int) -> DataFrame:
    """Mean capped outer-training size and mean test size over the folds."""
    per = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n")).scalar()
    return per.agg(F.avg(F.least(total - F.col("n"), F.lit(cap))).alias("N_train"),
                   F.avg("n").alias("N_test"))
