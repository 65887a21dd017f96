"""Nested spatial cross-validation of source models.

The driver only loops over folds and candidates; every fit, score and metric is
a Spark job on data assembled and cached once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from geotransfer.operators.guards import safe_predictors
from geotransfer.operators.metrics import best_by_error, metrics
from geotransfer.operators.ordering import number_rows, top_per_group
from geotransfer.operators.sampling import outside_fold, row_cap
from geotransfer.plans.models import CANDIDATES, FULL, Profile, assemble, build, linear_fit
from geotransfer.plans.moments import grouped_moments, total
from geotransfer.schemas import FOLD, RESPONSE, SEED
from geotransfer.session import materialize

TRAIN_CAP = 60_000  # bound on the rows a tree model is fitted on, for callers that ask for it
TUNING = "model string, config string, inner_fold int, R2 double, RMSE double, MAE double, Bias double, N long"


def _union(frames):
    return reduce(DataFrame.unionByName, frames)


def _fold_values(df: DataFrame, fold: str) -> list[int]:
    return sorted(r[0] for r in df.select(fold).distinct().collect())


def inner_select(spark: SparkSession, train: DataFrame, fold: str = FOLD,
                 candidates: Sequence[tuple[str, str]] = tuple(CANDIDATES),
                 profile: Profile = FULL, parallelism: int = 4) -> tuple[tuple[str, str], DataFrame]:
    """Joint (family, config) choice by mean RMSE over the folds present in ``train``.

    Independent fits are submitted side by side, as Spark's own CrossValidator does.
    """
    def score(cell):
        hold, (family, config) = cell
        model = build(family, config, profile).fit(train.where(F.col(fold) != hold))
        m = metrics(model.transform(train.where(F.col(fold) == hold))).first()
        return family, config, hold, m["R2"], m["RMSE"], m["MAE"], m["Bias"], m["N"]

    cells = [(hold, c) for hold in _fold_values(train, fold) for c in candidates]
    with ThreadPool(min(parallelism, len(cells))) as pool:
        rows = pool.map(inheritable_thread_target(spark)(score), cells)
    tuning = spark.createDataFrame(rows, TUNING)
    mean = tuning.groupBy("model", "config").agg(F.avg("RMSE").alias("RMSE"))
    best = best_by_error(mean).first()
    return (best["model"], best["config"]), tuning


def nested_cv(df: DataFrame, features: Sequence[str], representation: str, id_col: str,
              fold: str = FOLD, candidates: Sequence[tuple[str, str]] = tuple(CANDIDATES),
              profile: Profile = FULL, train_cap: int | None = None,
              importance_repeats: int = 0) -> dict[str, DataFrame]:
    """Out-of-fold predictions with provenance, tuning rows and optional importances.

    Every outer fold's predictions and importances are stored before its models and cached
    rows go, so reading the results never fits or scores again. ``train_cap`` bounds the rows
    of a fit (the held-out rows are always scored whole).
    """
    spark = df.sparkSession
    data = assemble(df, features).select(id_col, fold, RESPONSE, "features").persist()
    oof, tuning, importance = [], [], []
    try:
        for outer in _fold_values(data, fold):
            train = outside_fold(data, outer, fold)
            if train_cap is not None:
                train = row_cap(train, train_cap, id_col)
            train = train.persist()
            (family, config), rows = inner_select(spark, train, fold, candidates, profile)
            model = build(family, config, profile).fit(train)
            held = data.where(F.col(fold) == outer)
            scored = model.transform(held).select(
                id_col, fold, RESPONSE, "prediction", F.lit(family).alias("model"),
                F.lit(config).alias("config"), F.lit(representation).alias("representation"))
            oof.append(materialize(scored))
            tuning.append(rows.withColumns({"outer_fold": F.lit(outer),
                                            "representation": F.lit(representation)}))
            if importance_repeats:
                importance.append(materialize(permutation_importance(
                    model, held, features, id_col, importance_repeats, seed=SEED + outer)
                    .withColumns({"outer_fold": F.lit(outer),
                                  "representation": F.lit(representation)})))
            train.unpersist()
        out = {"oof": _union(oof), "tuning": _union(tuning)}
        if importance:
            out["importance"] = _union(importance)
        return out
    finally:
        data.unpersist()


def deploy(df: DataFrame, features: Sequence[str], path: str | None = None, fold: str = FOLD,
           candidates: Sequence[tuple[str, str]] = tuple(CANDIDATES), profile: Profile = FULL):
    """Model chosen by a separate CV on all source rows and refit on all of them."""
    data = assemble(df, features).persist()
    try:
        (family, config), tuning = inner_select(df.sparkSession, data, fold, candidates, profile)
        model = build(family, config, profile).fit(data)
        if path:
            model.write().overwrite().save(path)
        return model, (family, config), tuning
    finally:
        data.unpersist()


def ridge_cv(df: DataFrame, features: Sequence[str], fold: str = FOLD, y: str = RESPONSE,
             alpha: float = 10.0) -> DataFrame:
    """Held-out ridge predictions for every fold, at any width: one scan for the moments of all
    folds, each training set by subtraction, and one scoring pass."""
    cols = safe_predictors(features)
    folds = grouped_moments(df, [*cols, y], fold)
    whole = total(folds)
    score = F.lit(None).cast("double")
    for k, part in folds.items():
        score = F.when(F.col(fold) == k, linear_fit(cols, whole.minus(part), alpha).column()).otherwise(score)
    return df.withColumn("prediction", score)


def permutation_importance(model, held: DataFrame, features: Sequence[str], id_col: str,
                           repeats: int = 3, seed: int = SEED, y: str = RESPONSE) -> DataFrame:
    """Increase in RMSE when one feature is permuted: mean and population sd over repeats.

    A permutation pairs two hash orders of the same rows by row number; every
    (row, feature) variant is then scored in one pass of the model.
    """
    base = held.select(id_col, y, "features", vector_to_array("features").alias("x"))
    seeds = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    spread = base.select(id_col, y, "x", seeds)
    place = spread.withColumns({
        "_a": F.sha2(F.concat_ws("|", F.lit(f"{seed}-row"), F.col("repeat"), F.col(id_col)), 256),
        "_b": F.sha2(F.concat_ws("|", F.lit(f"{seed}-perm"), F.col("repeat"), F.col(id_col)), 256)})
    left = number_rows(place, ["_a", id_col], ["repeat"], "pos").select("repeat", "pos", y, "x")
    right = (number_rows(place, ["_b", id_col], ["repeat"], "pos")
             .select("repeat", "pos", F.col("x").alias("z")))
    paired = left.join(right, ["repeat", "pos"])
    names = list(features)
    which = F.posexplode(F.array(*[F.lit(f) for f in names])).alias("j", "feature")
    mixed = paired.select("repeat", y, "x", "z", which).withColumn(
        "features", array_to_vector(F.transform("x", lambda v, i: F.when(
            i == F.col("j"), F.element_at(F.col("z"), i + 1)).otherwise(v))))
    scored = model.transform(mixed.select("repeat", "feature", y, "features"))
    permuted = metrics(scored, y, "prediction", ["feature", "repeat"])
    plain = metrics(model.transform(base.select(y, "features")), y).select("RMSE").scalar()
    return (permuted.withColumn("_d", F.col("RMSE") - plain).groupBy("feature")
            .agg(F.avg("_d").alias("importance_mean"), F.stddev_pop("_d").alias("importance_sd"),
                 F.max("N").alias("heldout_n")))


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    """The most important features of each feature set, fold means first."""
    mean = importance.groupBy("representation", "feature").agg(
        F.avg("importance_mean").alias("importance_mean"),
        F.stddev_samp("importance_mean").alias("importance_sd"))
    return top_per_group(mean, ["representation"], [F.desc("importance_mean"), F.col("feature")], n)
