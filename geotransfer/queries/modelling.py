"""Models on Spark MLlib and adaptation with small local models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from geotransfer.operators import govern, metrics as M
from geotransfer.operators.quantiles import quantile_edges
from geotransfer.operators.stats import auroc
from geotransfer.plans import domain_shift, histograms, logistic, source_cv, transfer, tree_cv
from geotransfer.plans.models import fit_ridge
from geotransfer.queries.design import DRAWS, draws_of
from geotransfer.queries.registry import query, rounded, scratch, select_rounded, stored_once, table, view, with_views
from geotransfer.queries.reporting import METRICS, _M
from geotransfer.schemas import FOLD
from geotransfer.session import materialize

FEATURES = ["f1", "f2"]


def _data(spark, sf):
    return (view(spark, sf, "foot").withColumn(FOLD, F.col("fold"))
            .select("shot_number", "year", "domain", FOLD, "agbd", *FEATURES))


# Ridge on two standardised features has a closed form: a 2x2 system per fold.
def _ridge_ctes(train, by, alpha=10):
    return f"""
    mom AS (SELECT {by}, count(*) AS n, avg(agbd) AS my, avg(f1) AS m1, avg(f2) AS m2, stddev_pop(f1) AS s1, stddev_pop(f2) AS s2,
            covar_pop(f1, agbd) / stddev_pop(f1) AS c1, covar_pop(f2, agbd) / stddev_pop(f2) AS c2,
            covar_pop(f1, f2) / (stddev_pop(f1) * stddev_pop(f2)) AS r FROM {train} GROUP BY {by}),
    sol AS (SELECT *, (n * c1 * (n + {alpha}) - n * r * n * c2) / ((n + {alpha}) * (n + {alpha}) - n * r * n * r) AS w1,
            (n * c2 * (n + {alpha}) - n * r * n * c1) / ((n + {alpha}) * (n + {alpha}) - n * r * n * r) AS w2 FROM mom)"""


@query("ridge_cv", "I4 I5 J9", with_views("foot", more="""
    train AS (SELECT k.held, foot.* FROM foot, (SELECT unnest([0, 1, 2, 3, 4]) AS held) k WHERE foot.fold <> k.held),"""
    + _ridge_ctes("train", "held") + """,
    p AS (SELECT fold, agbd, my + w1 * (f1 - m1) / s1 + w2 * (f2 - m2) / s2 AS prediction FROM foot JOIN sol ON fold = held)""")
    + f"SELECT fold AS spatial_fold, {_M} FROM p GROUP BY fold")
def ridge_cv(spark, sf):
    p = source_cv.ridge_cv(_data(spark, sf), FEATURES)
    return select_rounded(M.metrics(p, by=[FOLD]), [FOLD, "N"], METRICS)


def _winner_is_best(tuning):
    """Per outer fold: rows of the tuning table, and the (model, config) with the smallest mean RMSE."""
    mean = tuning.groupBy("outer_fold", "model", "config").agg(F.avg("RMSE").alias("RMSE"), F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("model", "config"), F.struct("RMSE", "model", "config"))
    return mean.groupBy("outer_fold").agg(F.sum("n").alias("tuning_n"), best.alias("best"))


def _nested(spark, sf):
    """Nested spatial CV of all four candidates at the protocol's full size (700 rounds, 350 trees) on every row, for three queries."""
    return stored_once(spark, ("nested", sf), lambda: tree_cv.nested(_data(spark, sf), FEATURES, "pair", "shot_number", cap=None))


@query("nested_tree_cv", "I1 I2 I9 I10 F4 K5", with_views("foot") + """
    SELECT fold AS spatial_fold, count(*) AS n, count(DISTINCT shot_number) AS scored_n, CAST(1 AS BIGINT) AS models,
           CAST(16 AS BIGINT) AS tuning_n, true AS winner_is_best, true AS all_finite FROM foot GROUP BY fold""")
def nested_tree_cv(spark, sf):
    """One finite out-of-fold prediction per footprint, one model per fold, and that model is the one with the smallest
    mean RMSE over four inner folds. ``nested_tree_metrics`` has the figures of the same run."""
    out = _nested(spark, sf)
    per = out["oof"].groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("scored_n"),
        F.count_distinct("model_family", "config").alias("models"), F.first(F.struct("model_family", "config")).alias("used"),
        F.min(F.col("prediction").isNotNull() & ~F.isnan("prediction")).alias("all_finite"))
    won = _winner_is_best(out["tuning"].withColumnsRenamed({"outer": "outer_fold", "model_family": "model"}))
    return per.join(F.broadcast(won), per["fold"] == won["outer_fold"]).select(
        F.col("fold").alias(FOLD), "n", "scored_n", "models", "tuning_n",
        ((F.col("used.model_family") == F.col("best.model")) & (F.col("used.config") == F.col("best.config"))).alias("winner_is_best"),
        "all_finite")


@query("nested_tree_metrics", "I1 I2 I9 I10 I12 E9")
def nested_tree_metrics(spark, sf):
    """Held-out metrics of every outer fold with the chosen candidate and the importance of every feature."""
    out = _nested(spark, sf)
    m = M.metrics(out["oof"], "y", "prediction", ["fold", "model_family", "config"])
    i = tree_cv.importance(out, FEATURES, 3).groupBy("outer").pivot("feature", FEATURES).agg(F.first("importance_mean"))
    named = i.select(F.col("outer").alias("_o"), *[F.col(f).alias(f"importance_{f}") for f in FEATURES])
    return m.join(F.broadcast(named), m["fold"] == named["_o"]).drop("_o")


_STUMP_SQL = """
    e AS (SELECT DISTINCT f, edge FROM (
            SELECT 1 AS f, unnest(quantile_cont(f1, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS edge FROM foot
            UNION ALL SELECT 2, unnest(quantile_cont(f2, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) FROM foot)),
    base AS (SELECT k.held, avg(agbd) AS base, count(*) AS n FROM foot, (SELECT unnest([0, 1, 2, 3, 4]) AS held) k
             WHERE foot.fold <> k.held GROUP BY k.held),
    cut AS (SELECT held, f, edge, any_value(n) AS n,
                   sum(base - agbd) FILTER ((f = 1 AND f1 <= edge) OR (f = 2 AND f2 <= edge)) AS gl, sum(base - agbd) AS g,
                   count(*) FILTER ((f = 1 AND f1 <= edge) OR (f = 2 AND f2 <= edge)) AS hl
            FROM base JOIN foot ON foot.fold <> base.held, e GROUP BY held, f, edge),
    best AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY
                 gl * gl / (hl + 1) + (g - gl) * (g - gl) / (n - hl + 1) DESC, f, edge) AS place
             FROM cut WHERE hl >= 5 AND n - hl >= 5),
    p AS (SELECT foot.fold, agbd, base + 0.05 * CASE WHEN (f = 1 AND f1 <= edge) OR (f = 2 AND f2 <= edge) THEN -gl / (hl + 1)
                 ELSE -(g - gl) / (best.n - hl + 1) END AS prediction
          FROM foot JOIN base ON foot.fold = base.held JOIN best ON best.held = base.held AND place = 1)"""


@query("boosted_stump_cv", "I2 I10", with_views("foot", more=_STUMP_SQL) + f"SELECT fold AS spatial_fold, {_M} FROM p GROUP BY fold")
def boosted_stump_cv(spark, sf):
    """One boosting round of depth 1 with the L2 leaf penalty, fitted for all folds on the whole table by one grouped
    aggregate per level: small enough for SQL to spell out."""
    data = _data(spark, sf)
    edges = [np.array(quantile_edges(data, f, 8).first()["edges"][1:-1]) for f in FEATURES]
    rows = histograms.binned(data.select("shot_number", FOLD, F.col("agbd").alias("y_"), *FEATURES), FEATURES, edges, "y_", ["shot_number", FOLD])
    learner = histograms.Learner(1, rate=0.05, depth=1, least=5.0, penalty=1.0)
    fits = histograms.fit_everywhere(rows, range(5), learner, 2, FOLD, "shot_number")
    models = spark.createDataFrame([(k, m.packed()) for k, m in enumerate(fits)], f"{FOLD} int, model binary")
    scored = histograms.score_cells(rows.withColumnRenamed("shot_number", "id"), models, [FOLD])
    return select_rounded(M.metrics(scored, "y", "prediction", [FOLD]), [FOLD, "N"], METRICS)


@query("deployment_and_zero_shot", "I11 I21 K7", with_views("foot") + """
    SELECT year, count(*) AS "N", true AS scored, true AS chosen_is_best FROM foot WHERE domain = 'target' GROUP BY year""")
def deployment_and_zero_shot(spark, sf):
    """Source model chosen among all candidates at full size by its own CV, stored and loaded again, label-free target
    scoring, freeze, unlock, metrics."""
    data = _data(spark, sf)
    model, tuning = tree_cv.deploy(data.where("domain = 'source'"), FEATURES, "shot_number", cap=None)
    best = _winner_is_best(tuning.withColumnsRenamed({"model_family": "model"}).withColumn("outer_fold", F.lit(0))).first()["best"]
    folder = scratch(spark, "model")
    tree_cv.save(model, folder)
    stored = tree_cv.load(spark, folder)
    chosen = (F.col("model_family") == best["model"]) & (F.col("config") == best["config"])
    is_best = stored.select(chosen.alias("is_best")).first()["is_best"]
    target = data.where("domain = 'target'")
    blind = target.drop("agbd")
    govern.require_label_free(blind)
    pred = materialize(tree_cv.score(stored, blind, ["shot_number", "year"]))
    freeze = govern.freeze_row(pred, "zero_shot", "pair")
    joined = transfer.evaluate(pred, target.select("shot_number", "year", "agbd"), freeze, "pair")
    m = M.metrics(joined, by=["year"])
    return m.select("year", "N", (F.col("RMSE") > 0).alias("scored"), F.lit(is_best).alias("chosen_is_best"))


@query("permutation_importance", "I12 E9", with_views("foot") + """
    SELECT 'pair' AS representation, feature, CAST(5 AS BIGINT) AS folds, count(*) AS scored_n, feature = 'f2' AS leads
    FROM foot, (VALUES ('f1'), ('f2')) f(feature) GROUP BY feature""")
def permutation_importance(spark, sf):
    """Every held-out row is permuted and scored for each feature by the full models; the response depends on f2, which has
    to lead. ``nested_tree_metrics`` has the values."""
    found = materialize(tree_cv.importance(_nested(spark, sf), FEATURES, 3).withColumn("representation", F.lit("pair")))
    per = found.groupBy("representation", "feature").agg(F.count(F.lit(1)).alias("folds"), F.sum("heldout_n").alias("scored_n"))
    first = source_cv.top_features(found, 1).select("representation", F.col("feature").alias("_top"))
    return per.join(first, "representation").select("representation", "feature", "folds", "scored_n",
                                                    (F.col("feature") == F.col("_top")).alias("leads"))


@query("local_few_shot", "I15 J7 D22", with_views("foot", more=DRAWS + """,
    train AS (SELECT d.fold AS held, d.budget, d.seed, f.agbd, f.f1, f.f2 FROM draws d JOIN foot f ON d.shot_number = f.shot_number),"""
    + _ridge_ctes("train", "held, budget, seed") + """,
    p AS (SELECT fold, budget, seed, n, agbd, my + w1 * (f1 - m1) / s1 + w2 * (f2 - m2) / s2 AS prediction FROM foot JOIN sol ON fold = held)""") + f"""
    SELECT CAST(fold AS INT) AS fold, CAST(budget AS INT) AS budget, CAST(seed AS INT) AS seed, n AS "N_train", 'local_ridge' AS method,
           {_M.replace('AS "N"', 'AS "N_test"')} FROM p GROUP BY fold, budget, seed, n""")
def local_few_shot(spark, sf):
    runs = transfer.local_runs(view(spark, sf, "foot"), draws_of(spark, sf), FEATURES, "shot_number", fold="fold")
    return select_rounded(runs, ["fold", "budget", "seed", "N_train", "N_test", "method"], METRICS)


@query("local_tree_few_shot", "I15 I2 J7", with_views("foot", more=DRAWS) + """
    SELECT CAST(d.fold AS INT) AS fold, CAST(d.budget AS INT) AS budget, CAST(d.seed AS INT) AS seed, CAST(count(*) AS INT) AS "N_train",
           any_value(t.n) AS "N_test", true AS scored
    FROM draws d JOIN (SELECT fold, count(*) AS n FROM foot GROUP BY fold) t ON d.fold = t.fold GROUP BY d.fold, d.budget, d.seed""")
def local_tree_few_shot(spark, sf):
    """Boosted trees of 300 rounds on every cell of the draws (folds x budgets x seeds) in one plan: sizes of each cell."""
    runs = tree_cv.few_shot(view(spark, sf, "foot"), draws_of(spark, sf), FEATURES, "shot_number", fold="fold")
    return runs.select("fold", "budget", "seed", F.col("N_train").cast("int").alias("N_train"), "N_test", (F.col("RMSE") > 0).alias("scored"))


def _embedded(spark, sf):
    e = table(spark, sf, "embeddings").withColumn(
        "domain", F.when(F.col("label") < 5, F.lit("source")).otherwise(F.lit("target")))
    return domain_shift.vector_columns(e, "embedding", 64)


BANDS = [f"A{i:02d}" for i in range(64)]


@query("domain_separability", "I7 I8 J10 J11 F5")
def domain_separability(spark, sf):
    scores = domain_shift.domain_scores(_embedded(spark, sf), BANDS, "domain", "source", "vec_id", fit_rows=20_000)
    return domain_shift.separability(scores)


@query("source_pca", "I6 I5")
def source_pca(spark, sf):
    scores, variance = domain_shift.source_pca(_embedded(spark, sf), BANDS, "domain", "source", "vec_id", 2)
    return (scores.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("pc")[0]).alias("pc1_mean"),
                                         F.stddev_pop(F.col("pc")[0]).alias("pc1_sd"))
            .withColumn("explained_variance", F.lit(sum(variance))))


@query("projected_nearest_source", "C15")
def projected_nearest_source(spark, sf):
    near, variance = domain_shift.projected_distance(_embedded(spark, sf), BANDS, "domain", "source", "vec_id")
    return near.agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("distance_mean"),
                    F.median("distance").alias("distance_median")).withColumn("variance_fraction", F.lit(variance))


@query("ridge_deployment", "I4 I11", with_views("foot", more="src AS (SELECT 1 AS one, * FROM foot WHERE domain = 'source'),"
    + _ridge_ctes("src", "one")) + """
    SELECT round(w1 / s1, 6) AS f1_weight, round(w2 / s2, 6) AS f2_weight, round(my - w1 / s1 * m1 - w2 / s2 * m2, 6) AS intercept,
           (SELECT count(*) FROM foot WHERE domain = 'target') AS target_n FROM sol""")
def ridge_deployment(spark, sf):
    data = _data(spark, sf)
    fit = fit_ridge(data.where("domain = 'source'"), FEATURES)
    n = data.where("domain = 'target'").withColumn("prediction", fit.column()).agg(F.count("prediction").alias("target_n"))
    return n.select("target_n", rounded(F.lit(fit.weights[0]), 6, "f1_weight"),
                    rounded(F.lit(fit.weights[1]), 6, "f2_weight"), rounded(F.lit(fit.intercept), 6, "intercept"))


@query("source_components", "I6 C15", with_views("foot", more="""
    m AS (SELECT avg(f1) AS m1, avg(f2) AS m2, stddev_pop(f1) AS s1, stddev_pop(f2) AS s2, corr(f1, f2) AS r FROM foot WHERE domain = 'source'),
    z AS (SELECT domain, shot_number, (f1 - m1) / s1 AS a, (f2 - m2) / s2 AS b, r FROM foot, m),
    d AS (SELECT t.shot_number, sqrt(min((t.a - s.a) ** 2 + (t.b - s.b) ** 2)) AS distance FROM z t JOIN z s
          ON t.domain = 'target' AND s.domain = 'source' GROUP BY t.shot_number)""") + """
    SELECT z.domain, count(*) AS n, round(avg(((a + sign(r) * b) ** 2) / 2), 6) AS first_square, round(avg(((a - sign(r) * b) ** 2) / 2), 6) AS second_square,
           round(any_value(1 + abs(r)) / 2, 6) AS first_share, round(avg(d.distance), 6) AS distance_mean
    FROM z LEFT JOIN d ON z.shot_number = d.shot_number GROUP BY z.domain""")
def source_components(spark, sf):
    """Source components of two features and what no sign changes: mean squares of the scores, shares, nearest distances."""
    data = _data(spark, sf)
    scores, shares = domain_shift.source_pca(data, FEATURES, "domain", "source", "shot_number", 2)
    near, _ = domain_shift.projected_distance(data, FEATURES, "domain", "source", "shot_number")
    joined = scores.join(near.select("shot_number", "distance"), "shot_number", "left")
    pc = [F.col("pc")[i] * F.col("pc")[i] for i in (0, 1)]
    return joined.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(pc[0]), 6).alias("first_square"),
                                        F.round(F.avg(pc[1]), 6).alias("second_square"),
                                        F.lit(round(shares[0], 6)).alias("first_share"), F.round(F.avg("distance"), 6).alias("distance_mean"))


@query("logistic_by_fold", "I7 I8", with_views("foot", more="""
    k AS (SELECT unnest([0, 1, 2, 3, 4]) AS held),
    m AS (SELECT held, avg(f2) AS mean, stddev_pop(f2) AS sd, count(*) AS n FROM foot, k WHERE fold <> held GROUP BY held),
    x AS (SELECT held, (f2 - mean) / sd AS z, CASE WHEN domain = 'target' THEN 1e0 ELSE 0e0 END AS y FROM foot JOIN m ON fold <> held),
    step AS (SELECT 0 AS i, held, 0e0 AS b, 0e0 AS w FROM k
             UNION ALL
             SELECT i + 1, held, b - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), w - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
               SELECT any_value(i) AS i, step.held, any_value(b) AS b, any_value(w) AS w, sum(p - y) AS g0, sum((p - y) * z) + any_value(w) AS g1,
                      sum(p * (1 - p)) AS h00, sum(p * (1 - p) * z) AS h01, sum(p * (1 - p) * z * z) + 1 AS h11
               FROM (SELECT i, step.held, b, w, z, y, 1 / (1 + exp(-(b + w * z))) AS p FROM step JOIN x ON step.held = x.held WHERE i < 8) step
               GROUP BY step.held)),
    last AS (SELECT * FROM step WHERE i = 8),
    s AS (SELECT fold, domain, rank() OVER (PARTITION BY fold ORDER BY w * f2) + (count(*) OVER (PARTITION BY fold, w * f2) - 1) / 2e0 AS r
          FROM foot JOIN last ON fold = held),
    a AS (SELECT fold, (sum(r) FILTER (domain = 'target') - np * (np + 1) / 2) / (np * (n - np)) AS auroc FROM
          (SELECT *, count(*) FILTER (domain = 'target') OVER (PARTITION BY fold) AS np, count(*) OVER (PARTITION BY fold) AS n FROM s)
          GROUP BY fold, np, n)""").replace("WITH foot", "WITH RECURSIVE foot") + """
    SELECT CAST(last.held AS BIGINT) AS fold, m.n AS train_n, round(b, 6) AS intercept, round(w, 6) AS weight, true AS gradient_vanishes,
           round(auroc, 6) AS auroc FROM last JOIN m ON last.held = m.held JOIN a ON a.fold = last.held""")
def logistic_by_fold(spark, sf):
    """The domain classifier on one feature, all folds by Newton steps: weights, gradient and held-out AUROC."""
    data = _data(spark, sf).withColumn("label", (F.col("domain") == "target").cast("double"))
    fits = logistic.fit_folds(data, ["f2"], "label", FOLD)
    sizes = data.groupBy(FOLD).agg(F.count(F.lit(1)).alias("own"))
    area = auroc(logistic.held_out(data, fits), "score", F.col("label") == 1.0, [FOLD])
    rows = spark.createDataFrame([(k, *f.weights, f.gradient < 1e-6) for k, f in fits.items()],
                                 f"{FOLD} int, intercept double, weight double, gradient_vanishes boolean")
    whole = data.agg(F.count(F.lit(1))).scalar()
    return rows.join(sizes, FOLD).join(area.select(FOLD, "auroc"), FOLD).select(
        F.col(FOLD).cast("bigint").alias("fold"), (whole - F.col("own")).alias("train_n"), rounded("intercept"), rounded("weight"),
        "gradient_vanishes", rounded("auroc"))


@query("domain_shift_table", "I6 I7 I8 I16 I20 C15")
def domain_shift_table(spark, sf):
    """Per feature set: AUROC of the domain classifier, PCA distance and variance kept, and the rank correlation of distance
    with the target's error, its p value and the MAE, in one row."""
    data = view(spark, sf, "foot").select("shot_number", "domain", "agbd", "prediction", *FEATURES)
    data = domain_shift.folded(data, "domain", "source", "shot_number")
    errors = domain_shift.ranked_errors(data, "domain", "source", "shot_number", "agbd", "prediction")
    sets = {"first": FEATURES[:1], "second": FEATURES[1:], "both": FEATURES}
    return tree_cv.over_representations(dict.fromkeys(sets, data), sets, lambda df, c: domain_shift.shift_row(
        df, c, "domain", "source", "shot_number", "agbd", "prediction", errors=errors))
