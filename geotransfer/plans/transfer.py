"""Zero-shot transfer in two phases and few-shot adaptation on shared label draws."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from geotransfer.operators import govern
from geotransfer.operators.guards import safe_predictors
from geotransfer.operators.joins import lookup_join
from geotransfer.operators.metrics import metric_columns, metrics
from geotransfer.plans.models import Profile, assemble
from geotransfer.schemas import FOLD, KEYS, RESPONSE
from geotransfer.session import materialize

FEW_SHOT = Profile(boost_rounds=300, depth_limit=3)
CELL = ["fold", "budget", "seed"]


def predict(model, target: DataFrame, features: Sequence[str]) -> DataFrame:
    """Phase one: predictions from label-free predictors only."""
    govern.require_label_free(target)
    return (model.transform(assemble(target, features))
            .select(*KEYS, F.col("prediction").cast("double").alias("prediction")))


def evaluate(predictions: DataFrame, labels: DataFrame, freeze: DataFrame, name: str) -> DataFrame:
    """Phase two: labels join only predictions that still match their freeze row."""
    return govern.unlock(predictions, labels, freeze, "zero_shot", name)


def draw_rows(data: DataFrame, draws: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Training rows of every cell (at most the largest budget each).

    The draws are few by design, so the data is filtered where it lies.
    """
    return lookup_join(data.select(id_col, *columns), draws.select(*CELL, id_col), [id_col])


def calibrations(data: DataFrame, draws: DataFrame, id_col: str, y: str = RESPONSE,
                 p: str = "prediction") -> DataFrame:
    """Bias correction and affine fit of each cell from its drawn labels."""
    return draw_rows(data, draws, id_col, [y, p]).groupBy(*CELL).agg(
        F.avg(F.col(y) - F.col(p)).alias("bias_correction"),
        F.regr_slope(y, p).alias("affine_slope"),
        F.regr_intercept(y, p).alias("affine_intercept"),
        F.count(F.lit(1)).alias("N_train"))


def calibrated_runs(data: DataFrame, draws: DataFrame, id_col: str, y: str = RESPONSE,
                    p: str = "prediction", fold: str = FOLD) -> DataFrame:
    """Metrics of bias-only and affine calibration on each cell's held-out fold.

    A cell is a few numbers, so held-out rows stay in place and meet the cells
    of their own fold; both methods are scored in the same pass, and partial
    sums leave one row per cell and task for the shuffle.
    """
    cells = calibrations(data, draws, id_col, y, p)
    test = data.select(F.col(fold).alias("fold"), y, p)
    j = lookup_join(test, cells, ["fold"])
    both = F.explode(F.array(
        F.struct(F.lit("bias_only").alias("method"),
                 (F.col(p) + F.col("bias_correction")).alias("p")),
        F.struct(F.lit("affine").alias("method"),
                 (F.col("affine_intercept") + F.col("affine_slope") * F.col(p)).alias("p"))))
    scored = j.select(*CELL, "N_train", y, both.alias("_m"))
    scored = scored.select(F.col("_m.method").alias("method"), *CELL, "N_train", y,
                           F.col("_m.p").alias("_p"))
    return (scored.groupBy("method", *CELL, "N_train").agg(*metric_columns(y, "_p"))
            .withColumnRenamed("N", "N_test"))


def local_models(data: DataFrame, draws: DataFrame, features: Sequence[str], id_col: str,
                 y: str = RESPONSE, alpha: float = 10.0) -> DataFrame:
    """One small ridge model per cell, fitted on at most the budget's rows.

    Returns the weights in feature order with the intercept first.
    """
    cols = safe_predictors(features)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[cols].to_numpy(float)
        target = pdf[y].to_numpy(float)
        mean, sd = x.mean(0), x.std(0)
        sd[sd == 0] = 1.0
        z = (x - mean) / sd
        w = np.linalg.solve(z.T @ z + alpha * np.eye(len(cols)), z.T @ (target - target.mean())) / sd
        first = pdf.iloc[0]
        return pd.DataFrame({**{c: [int(first[c])] for c in CELL},
                             "weights": [[float(target.mean() - w @ mean), *map(float, w)]],
                             "N_train": [len(pdf)]})

    rows = draw_rows(data, draws, id_col, [y, *cols]).drop(id_col)
    return rows.groupBy(*CELL).applyInPandas(
        fit, "fold int, budget int, seed int, weights array<double>, N_train long")


def local_runs(data: DataFrame, draws: DataFrame, features: Sequence[str], id_col: str,
               y: str = RESPONSE, fold: str = FOLD, alpha: float = 10.0) -> DataFrame:
    """Held-out metrics of the local model of every cell."""
    cols = safe_predictors(features)
    models = local_models(data, draws, cols, id_col, y, alpha)
    j = lookup_join(data.select(F.col(fold).alias("fold"), y, *cols), models, ["fold"])
    score = F.col("weights")[0]
    for i, c in enumerate(cols, start=1):
        score = score + F.col("weights")[i] * F.col(c)
    return (j.select(*CELL, "N_train", y, score.alias("_p")).groupBy(*CELL, "N_train")
            .agg(*metric_columns(y, "_p")).withColumnRenamed("N", "N_test")
            .withColumn("method", F.lit("local_ridge")))


def local_tree_runs(data: DataFrame, draws: DataFrame, features: Sequence[str], id_col: str,
                    profile: Profile = FEW_SHOT, y: str = RESPONSE, fold: str = FOLD,
                    parallelism: int = 4) -> DataFrame:
    """Held-out metrics of a boosted-tree model per cell, under one fixed small protocol.

    There are folds x budgets x seeds cells and each trains on its budget of
    rows; the fits run side by side and every cell is scored on its whole fold.
    """
    spark, cols = data.sparkSession, safe_predictors(features)
    train = materialize(draw_rows(data, draws, id_col, [y, *cols]))
    cells = sorted(tuple(r) for r in train.select(*CELL).distinct().collect())
    label = assemble(data.select(F.col(fold).alias("fold"), F.col(y).alias(RESPONSE), *cols), cols)

    def run(cell):
        k, budget, seed = cell
        rows = train.where((F.col("fold") == k) & (F.col("budget") == budget) & (F.col("seed") == seed))
        rows = assemble(rows.select(F.col(y).alias(RESPONSE), *cols), cols)
        model = GBTRegressor(labelCol=RESPONSE, maxIter=profile.boost_rounds, stepSize=0.03,
                             maxDepth=min(3, profile.depth_limit), maxBins=profile.max_bins,
                             seed=seed).fit(rows)
        m = metrics(model.transform(label.where(F.col("fold") == k)), RESPONSE).first()
        return k, budget, seed, budget, m["N"], "local_trees", m["R2"], m["RMSE"], m["MAE"], m["Bias"]

    with ThreadPool(min(parallelism, len(cells))) as pool:
        out = pool.map(inheritable_thread_target(spark)(run), cells)
    return spark.createDataFrame(out, "fold int, budget int, seed int, N_train int, N_test long, method string, "
                                      "R2 double, RMSE double, MAE double, Bias double")


def zero_shot_row(data: DataFrame, y: str = RESPONSE, p: str = "prediction") -> DataFrame:
    return metrics(data, y, p)


def master_summary(source_cv: DataFrame, zero_shot: DataFrame, few_shot: DataFrame) -> DataFrame:
    """One table of source CV, zero-shot and few-shot rows."""
    cols = ["stage", "representation", "labels", "R2", "RMSE", "MAE", "Bias", "N_train", "N_test"]

    def shape(df, stage, labels, n_train, n_test, suffix=""):
        return df.select(
            F.lit(stage).alias("stage"), "representation", labels.cast("long").alias("labels"),
            *[F.col(f"{m}{suffix}").alias(m) for m in ("R2", "RMSE", "MAE", "Bias")],
            n_train.cast("double").alias("N_train"), n_test.cast("double").alias("N_test"))

    a = shape(source_cv, "source_spatial_cv", F.col("N"), F.col("N_train"), F.col("N_test"))
    b = shape(zero_shot, "zero_shot", F.lit(0), F.lit(0), F.col("N"))
    c = shape(few_shot, "few_shot_local", F.col("budget"), F.col("budget"), F.col("N_test_mean"), "_mean")
    return a.unionByName(b).unionByName(c).select(*cols)
