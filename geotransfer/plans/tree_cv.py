"""Nested spatial cross-validation, deployment and few-shot cells of binned tree models, each as one Spark plan.

The table is binned and stored once. A training set is named by the folds it leaves out, and all
(outer fold, inner fold, candidate) fits of a feature set run side by side as tasks, then the
winners are refitted. With a ``cap`` a fit is a group of at most about so many rows, drawn by a
hash of the id, as the protocol bounds them (``TRAIN_CAP``). Without one (None) a fit sees every
row: of one or two features by the sums of ``grids``, of more as a group that holds the whole
training set. Held-out rows are scored whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from geotransfer.operators.metrics import metric_columns
from geotransfer.plans import grids, histograms as H
from geotransfer.plans.moments import matrix
from geotransfer.plans.transfer import CELL, draw_rows
from geotransfer.schemas import FOLD, RESPONSE, SEED
from geotransfer.session import materialize

TRAIN_CAP = 60_000  # rows a single fit sees, about
BLOCK_ROWS = 200_000  # combinations of bins scored in one group
KIND = ["model_family", "config"]


def _sizes(rows: DataFrame) -> dict[int, int]:
    return {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}


def _training(rows: DataFrame, sets: list[tuple], sizes: dict[int, int], cap: int | None) -> DataFrame:
    """Rows of every training set ``(outer, inner)``: all folds but these two (None leaves out nothing).

    The sets of a fold are a small table met on the fold. A set above ``cap`` keeps the rows whose
    hash falls into its share.
    """
    spark, pairs = rows.sparkSession, []
    for outer, inner in sets:
        folds = [f for f in sizes if f not in (outer, inner)]
        share = 1.0 if cap is None else min(1.0, cap / max(1, sum(sizes[f] for f in folds)))
        pairs += [(f, outer, inner, int(share * (1 << 30))) for f in folds]
    named = spark.createDataFrame(pairs, "fold int, outer int, inner int, share int")
    drawn = rows.join(F.broadcast(named), "fold")
    return drawn.where(F.pmod(F.xxhash64(F.lit(SEED), "outer", "id"), F.lit(1 << 30)) < F.col("share"))


def prepared(df: DataFrame, features: Sequence[str], id_col: str, fold: str = FOLD, y: str = RESPONSE, bins: int = H.BINS
             ) -> tuple[DataFrame, list[np.ndarray]]:
    """The binned table (``id``, ``fold``, ``y``, ``bins``) and the edges of its features."""
    edges = H.bin_edges(df, features, bins)
    named = df.select(F.col(id_col).alias("id"), F.col(fold).cast("int").alias("fold"), F.col(y).alias("_y"), *features)
    return H.binned(named, features, edges, "_y", ["id", "fold"]), edges


def _stored_sums(rows: DataFrame, features: int, sizes: dict[int, int], cap: int | None) -> DataFrame | None:
    """The sums that fits on every row of few features read; None where fits see rows."""
    return grids.sums(rows, sizes) if cap is None and features <= grids.FEATURES else None


def _models(rows: DataFrame, sums: DataFrame | None, wanted: dict[tuple, list], learners: dict, features: int, sizes: dict[int, int],
            cap: int | None) -> DataFrame:
    """A model of every training set ``(outer, inner)`` and the candidates it wants: ``outer``, ``inner``, family, config,
    ``model`` and ``n``; stored. A set without rows has models without trees."""
    spark = rows.sparkSession
    kinds = "outer int, inner int, model_family string, config string"
    asked = spark.createDataFrame([(o, i, m, c) for (o, i), each in wanted.items() for m, c in each], kinds)
    if sums is not None:
        # Leaving out a then b leaves the rows of b then a: fitted once.
        left = {s: frozenset(s) - {None} for s in wanted}
        sets = {}
        for s, each in wanted.items():
            sets[left[s]] = list(dict.fromkeys([*sets.get(left[s], []), *each]))
        found = grids.fit_sets(sums, [([f for f in sorted(sizes) if f not in out], each) for out, each in sets.items()], learners, features)
        place = {out: k for k, out in enumerate(sets)}
        names = spark.createDataFrame([(place[left[o, i]], o, i) for o, i in wanted], "set int, outer int, inner int")
        found = materialize(found).join(F.broadcast(names), "set").drop("set")
    else:
        drawn = _training(rows, list(wanted), sizes, cap)
        train = drawn.join(F.broadcast(asked.withColumnsRenamed({"outer": "_o", "inner": "_i"})),
                           F.col("outer").eqNullSafe(F.col("_o")) & F.col("inner").eqNullSafe(F.col("_i"))).drop("_o", "_i")
        found = H.fit_cells(train, ["outer", "inner", *KIND], lambda o, i, m, c: learners[m, c])
    named = found.withColumnsRenamed({c: f"_{c}" for c in ("outer", "inner", *KIND)})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("outer", "inner", *KIND)]
    empty = F.lit(H.Trees(0.0, 1.0).packed())
    return materialize(asked.join(named, reduce(and_, same), "left").select(
        "outer", "inner", *KIND, F.coalesce("model", empty).alias("model"), F.coalesce("n", F.lit(0)).alias("n")))


def tuned(rows: DataFrame, learners: dict, outer: Sequence[int | None], features: int, sizes: dict[int, int], cap: int | None = TRAIN_CAP,
          sums: DataFrame | None = None) -> DataFrame:
    """Metrics of every candidate on every inner fold of every outer training set (None: all rows)."""
    cell = ["outer", "inner", *KIND]
    models = _models(rows, sums, {(o, i): list(learners) for o in outer for i in sizes if i != o}, learners, features, sizes, cap)
    scored = H.score_cells(rows, models.withColumn("fold", F.col("inner")), cell, ["fold"], BLOCK_ROWS)
    return materialize(scored.groupBy(*cell).agg(*metric_columns("y", "prediction")))


def winners(tuning: DataFrame) -> DataFrame:
    """Per outer training set the (family, config) of the least mean RMSE over its inner folds; ties by name."""
    mean = tuning.groupBy("outer", *KIND).agg(F.avg("RMSE").alias("RMSE"))
    return mean.groupBy("outer").agg(F.min(F.struct("RMSE", *KIND)).alias("w")).select("outer", *[F.col(f"w.{c}").alias(c) for c in KIND])


def nested(df: DataFrame, features: Sequence[str], representation: str, id_col: str, fold: str = FOLD, y: str = RESPONSE,
           learners: dict | None = None, cap: int | None = TRAIN_CAP, bins: int = H.BINS) -> dict[str, DataFrame]:
    """``oof`` (``id``, ``fold``, ``y``, ``prediction`` with family, config and representation), ``tuning``,
    ``models`` (packed, one per outer fold) and ``rows`` (the binned table)."""
    learners = learners or H.learners()
    rows, _ = prepared(df, features, id_col, fold, y, bins)
    sizes = _sizes(rows)
    sums = _stored_sums(rows, len(features), sizes, cap)
    tuning = tuned(rows, learners, list(sizes), len(features), sizes, cap, sums)
    won = {(r["outer"], None): [(r["model_family"], r["config"])] for r in winners(tuning).collect()}  # a row per outer fold
    models = _models(rows, sums, won, learners, len(features), sizes, cap).drop("inner")
    scored = H.score_cells(rows, models.withColumn("fold", F.col("outer")), ["outer", *KIND], ["fold"], BLOCK_ROWS)
    oof = scored.drop("outer").withColumn("representation", F.lit(representation))
    return {"oof": materialize(oof), "tuning": tuning.withColumn("representation", F.lit(representation)), "models": models, "rows": rows}


def importance(result: dict[str, DataFrame], features: Sequence[str], repeats: int = 3, seed: int = SEED) -> DataFrame:
    """Rise of the RMSE when one feature's bins are permuted within the held-out fold: ``outer``, ``feature``,
    ``importance_mean``, ``importance_sd`` (population, over repeats) and ``heldout_n``. Every held-out row is permuted.

    A hash deals the rows of a fold to blocks of about ``BLOCK_ROWS``, random parts of the fold, and a repeat permutes
    every block: any row of the fold can stand in for any other. Rows travel once, and a block emits its squared errors.
    """
    rows, models, width = result["rows"], result["models"].select("outer", "model"), len(features)
    spark = rows.sparkSession
    blocks = [(f, -(-n // BLOCK_ROWS)) for f, n in _sizes(rows).items()]
    dealt = rows.join(F.broadcast(spark.createDataFrame(blocks, "fold int, blocks int")), "fold").select(
        F.col("fold").alias("outer"), F.pmod(F.xxhash64(F.lit(seed), "id"), "blocks").cast("int").alias("block"), "id", "y", "bins")
    sent = models.join(F.broadcast(spark.createDataFrame(blocks, "_f int, blocks int")), F.col("outer") == F.col("_f")).select(
        F.col("outer").alias("_outer"), "model", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_block"))

    def task(key: tuple[pa.Scalar, ...], part: pa.Table, model: pa.Table) -> pa.Table:
        fold, block = (k.as_py() for k in key)
        part = part.sort_by("id").combine_chunks()
        codes, y = codes_of_part(part), part.column("y").to_numpy(zero_copy_only=False)
        known = ~part.column("y").is_null().to_numpy(zero_copy_only=False)
        trees = H.Trees.unpacked(model.column("model")[0].as_py())
        found = [(-1, -1, float(((trees.predict(codes) - y)[known] ** 2).sum()))]
        for r in range(repeats):
            other = codes[np.random.default_rng([seed, fold, block, r]).permutation(len(codes))]
            for j in range(width):
                swapped = codes.copy()
                swapped[:, j] = other[:, j]
                found.append((r, j, float(((trees.predict(swapped) - y)[known] ** 2).sum())))
        r, j, sse = zip(*found)
        return pa.table({"outer": pa.array([fold] * len(r), pa.int32()), "repeat": pa.array(r, pa.int32()), "j": pa.array(j, pa.int32()),
                         "n": pa.array([int(known.sum())] * len(r), pa.int64()), "sse": pa.array(sse)})

    def codes_of_part(part: pa.Table) -> np.ndarray:
        return H.codes_in(part.column("bins").combine_chunks()) if len(part) else np.zeros((0, width), np.uint8)

    many = max(H._width(rows), sum(b for _, b in blocks))
    left, right = dealt.repartition(many, "outer", "block"), sent.repartition(many, "_outer", "_block")
    errors = left.groupBy("outer", "block").cogroup(right.groupBy("_outer", "_block")).applyInArrow(
        task, "outer int, repeat int, j int, n long, sse double")
    each = materialize(errors).groupBy("outer", "repeat", "j").agg(F.sum("n").alias("N"), F.sqrt(F.sum("sse") / F.sum("n")).alias("RMSE"))
    plain = each.where("j < 0").select("outer", F.col("RMSE").alias("plain"))
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("j") + 1)
    return each.where("j >= 0").join(plain, "outer").groupBy("outer", names.alias("feature")).agg(
        F.avg(F.col("RMSE") - F.col("plain")).alias("importance_mean"), F.stddev_pop(F.col("RMSE") - F.col("plain")).alias("importance_sd"),
        F.max("N").alias("heldout_n"))


# ---------------------------------------------------------------- deployment

def deploy(df: DataFrame, features: Sequence[str], id_col: str, fold: str = FOLD, y: str = RESPONSE, learners: dict | None = None,
           cap: int | None = TRAIN_CAP, bins: int = H.BINS) -> tuple[DataFrame, DataFrame]:
    """The model chosen by its own cross-validation and refitted on all rows, as a table of one row, and the tuning rows.

    ``features``, ``edges``, ``model_family``, ``config``, ``model`` and ``n`` are all that scoring needs.
    """
    learners = learners or H.learners()
    rows, edges = prepared(df, features, id_col, fold, y, bins)
    sizes = _sizes(rows)
    sums = _stored_sums(rows, len(features), sizes, cap)
    tuning = tuned(rows, learners, [None], len(features), sizes, cap, sums)
    won = winners(tuning).first()
    model = _models(rows, sums, {(None, None): [(won["model_family"], won["config"])]}, learners, len(features), sizes, cap).drop("outer", "inner")
    return materialize(model.withColumns({"features": F.array(*[F.lit(f) for f in features]),
                                          "edges": F.array(*[F.array(*[F.lit(float(v)) for v in e]) for e in edges])})), tuning


def save(model: DataFrame, path: str) -> None:
    model.coalesce(1).write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def score(model: DataFrame, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``prediction`` of every row by a stored model; the model's size is bound by its trees and ``TRAIN_CAP``."""
    m = model.first()
    features, edges, keep = list(m["features"]), [np.array(e) for e in m["edges"]], list(keep)
    blob = df.sparkSession.sparkContext.broadcast(bytes(m["model"]))

    def task(batches):
        trees = H.Trees.unpacked(blob.value)
        for b in batches:
            p = trees.predict(H.codes_of(matrix(b, features), edges))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(p)], [*keep, "prediction"])

    shape = df.select(*keep, F.lit(0.0).alias("prediction")).schema
    own = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features if c not in keep])
    return own.mapInArrow(task, shape)


# ---------------------------------------------------------------- few-shot cells

def few_shot(data: DataFrame, draws: DataFrame, features: Sequence[str], id_col: str, y: str = RESPONSE, fold: str = FOLD,
             learner: H.Learner = H.FEW_SHOT, bins: int = H.BINS) -> DataFrame:
    """Held-out metrics of a boosted model per (fold, budget, seed) cell of the draws, all cells in one plan.

    A cell trains on its budget of rows in one task and is scored on its whole fold.
    """
    edges = H.bin_edges(data, features, bins)
    named = data.select(F.col(id_col).alias("id"), F.col(fold).cast("int").alias("fold"), F.col(y).alias("_y"), *features)
    rows = H.binned(named, features, edges, "_y", ["id", "fold"])
    train = draw_rows(rows.drop("fold"), draws.select(*CELL, F.col(id_col).alias("id")), "id", ["y", "bins"])
    models = materialize(H.fit_cells(train, CELL, lambda f, b, s: learner, lambda f, b, s: s))
    scored = H.score_cells(rows, models, CELL, ["fold"], BLOCK_ROWS)
    out = scored.groupBy(*CELL).agg(*metric_columns("y", "prediction")).withColumnRenamed("N", "N_test")
    return out.join(models.select(*CELL, F.col("n").alias("N_train")), CELL).withColumn("method", F.lit("local_trees"))


def over_representations(frames: dict[str, DataFrame], features: dict[str, Sequence[str]], run: Callable[..., DataFrame]) -> DataFrame:
    """``run(frame, features)`` of every feature set, in one table with the set's name. Jobs of the sets run beside each other."""
    keeping = inheritable_thread_target(next(iter(frames.values())).sparkSession)
    with ThreadPoolExecutor(min(4, len(frames))) as pool:
        started = {name: pool.submit(keeping(run), df, list(features[name])) for name, df in frames.items()}
        parts = [job.result().withColumn("representation", F.lit(name)) for name, job in started.items()]
    return reduce(DataFrame.unionByName, parts)
