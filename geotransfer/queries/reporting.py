"""Metrics, contrasts, thresholds and summary tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotransfer.operators import govern, joins, metrics as M
from geotransfer.plans import transfer
from geotransfer.queries.design import DRAWS, draws_of
from geotransfer.queries.registry import query, rounded, select_rounded, view, with_views

_M = """round(1 - sum((prediction - agbd) * (prediction - agbd)) / (var_pop(agbd) * count(agbd)), 6) AS "R2",
    round(sqrt(avg((prediction - agbd) * (prediction - agbd))), 6) AS "RMSE", round(avg(abs(prediction - agbd)), 6) AS "MAE",
    round(avg(prediction - agbd), 6) AS "Bias", count(*) AS "N\""""
_RAW = _M.replace("round(", "(").replace(", 6)", ")")
METRICS = ["R2", "RMSE", "MAE", "Bias"]


@query("metrics_overall", "D1", with_views("foot") + f"SELECT {_M} FROM foot")
def metrics_overall(spark, sf):
    return select_rounded(M.metrics(view(spark, sf, "foot")), ["N"], METRICS)


@query("metrics_by_fold", "D2", with_views("foot") + f"SELECT fold, {_M} FROM foot GROUP BY fold")
def metrics_by_fold(spark, sf):
    return select_rounded(M.metrics(view(spark, sf, "foot"), by=["fold"]), ["fold", "N"], METRICS)


@query("metrics_large_years", "D2 B19", with_views("foot") + f"""
    SELECT block, year, {_M} FROM foot GROUP BY block, year HAVING count(*) >= 40""")
def metrics_large_years(spark, sf):
    m = M.metrics(view(spark, sf, "foot"), by=["block", "year"], min_rows=40)
    return select_rounded(m, ["block", "year", "N"], METRICS)


@query("metrics_pooled", "D3", with_views("foot", more=f"f AS (SELECT fold, {_RAW} FROM foot GROUP BY fold)") + f"""
    SELECT {_M}, {', '.join(f'round((SELECT stddev_pop("{m}") FROM f), 6) AS "{m}_std"' for m in METRICS)} FROM foot""")
def metrics_pooled(spark, sf):
    m = M.pooled_metrics(view(spark, sf, "foot"), "fold")
    return select_rounded(m, ["N"], METRICS + [f"{x}_std" for x in METRICS])


@query("mean_baseline", "I3 J9", with_views("foot", more="""
    t AS (SELECT fold, sum(agbd) AS s, count(*) AS n FROM foot GROUP BY fold),
    p AS (SELECT a.fold, agbd, (SELECT sum(s) FROM t b WHERE b.fold <> a.fold) / (SELECT sum(n) FROM t b WHERE b.fold <> a.fold)
          AS prediction FROM foot f JOIN t a USING (fold))""") + f"SELECT fold, {_M} FROM p GROUP BY fold")
def mean_baseline(spark, sf):
    foot = view(spark, sf, "foot").select("fold", "agbd")
    return select_rounded(M.metrics(M.mean_baseline(foot, "fold"), by=["fold"]), ["fold", "N"], METRICS)


# Three prediction variants of the same rows, by arithmetic on the formula prediction.
_VAR = """v AS (SELECT 'palsar_l' AS representation, fold, agbd, prediction FROM foot
    UNION ALL SELECT 'sentinel1_c', fold, agbd, prediction + 10 * f1 - 4 FROM foot
    UNION ALL SELECT 'embedding64', fold, agbd, agbd + (prediction - agbd) * 8e-1 + 5 * f2 FROM foot)"""


def variants(spark, sf, *extra):
    foot = view(spark, sf, "foot")
    p, y = F.col("prediction"), F.col("agbd")
    parts = {"palsar_l": p, "sentinel1_c": p + 10 * F.col("f1") - 4,
             "embedding64": y + (p - y) * 0.8 + 5 * F.col("f2")}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("r"), c.alias("p")) for n, c in parts.items()])).alias("_v")
    return foot.select("fold", "agbd", "year", "domain", *extra, each).select(
        F.col("_v.r").alias("representation"), "fold", "agbd", "year", "domain", *extra,
        F.col("_v.p").alias("prediction"))


_FOLDM = _VAR + f", m AS (SELECT representation, fold, {_RAW} FROM v GROUP BY ALL)"
PAIRS = [("palsar_l", "sentinel1_c"), ("embedding64", "palsar_l")]
_PAIRED = _FOLDM + """, c AS (SELECT concat(a.representation, ' - ', b.representation) AS contrast, a.fold,
    a."R2" - b."R2" AS d1, a."RMSE" - b."RMSE" AS d2, a."MAE" - b."MAE" AS d3, a."Bias" - b."Bias" AS d4
    FROM m a JOIN m b ON a.fold = b.fold AND (a.representation, b.representation) IN (('palsar_l', 'sentinel1_c'), ('embedding64', 'palsar_l')))"""


def _contrasts(spark, sf):
    m = M.metrics(variants(spark, sf), by=["representation", "fold"])
    return joins.paired_contrasts(m, PAIRS, "fold", METRICS, expect=5)


@query("paired_contrasts", "C10", with_views("foot", more=_PAIRED) + """
    SELECT contrast, fold, round(d1, 6) AS "delta_R2", round(d2, 6) AS "delta_RMSE", round(d3, 6) AS "delta_MAE", round(d4, 6) AS "delta_Bias" FROM c""")
def paired_contrasts(spark, sf):
    return select_rounded(_contrasts(spark, sf), ["contrast", "fold"], [f"delta_{m}" for m in METRICS])


@query("contrast_summary", "D25", with_views("foot", more=_PAIRED) + """
    SELECT contrast, count(*) AS folds, round(avg(d1), 6) AS "mean_delta_R2", round(avg(d2), 6) AS "mean_delta_RMSE",
           count(*) FILTER (WHERE d1 > 0) AS "folds_favoring_first_R2", count(*) FILTER (WHERE d2 < 0) AS "folds_favoring_first_RMSE"
    FROM c GROUP BY contrast""")
def contrast_summary(spark, sf):
    s = M.contrast_summary(_contrasts(spark, sf))
    return select_rounded(s, ["contrast", "folds", "folds_favoring_first_R2", "folds_favoring_first_RMSE"],
                          ["mean_delta_R2", "mean_delta_RMSE"])


_DOM = """v2 AS (SELECT representation, domain, agbd, prediction FROM (
    SELECT 'palsar_l' AS representation, domain, agbd, prediction FROM foot
    UNION ALL SELECT 'sentinel1_c', domain, agbd, prediction + 10 * f1 - 4 FROM foot
    UNION ALL SELECT 'embedding64', domain, agbd, agbd + (prediction - agbd) * 8e-1 + 5 * f2 FROM foot)),
    """ + f"dm AS (SELECT representation, domain, {_RAW} FROM v2 GROUP BY ALL)"


def _domain_metrics(spark, sf):
    m = M.metrics(variants(spark, sf), by=["representation", "domain"])
    return m.where("domain = 'source'").drop("domain"), m.where("domain = 'target'").drop("domain")


@query("representation_comparison", "C11", with_views("foot", more=_DOM) + """
    SELECT s.representation, """ + ", ".join(
    f'round(s."{m}", 6) AS "source_cv_{m}", round(t."{m}", 6) AS "target_zero_shot_{m}"' for m in METRICS) + """
    FROM dm s JOIN dm t ON s.representation = t.representation AND s.domain = 'source' AND t.domain = 'target'""")
def representation_comparison(spark, sf):
    s, t = _domain_metrics(spark, sf)
    w = joins.wide_comparison(s, t, "representation", METRICS, "source_cv", "target_zero_shot")
    return select_rounded(w, ["representation"], [c for c in w.columns if c != "representation"])


_LOSS = _DOM + """, loss AS (SELECT s.representation, s."R2" AS sr, s."RMSE" AS se, t."R2" AS tr, t."RMSE" AS te, t."MAE" AS tm, t."Bias" AS tb, t."N" AS n
    FROM dm s JOIN dm t ON s.representation = t.representation AND s.domain = 'source' AND t.domain = 'target')"""


@query("transfer_loss", "D26", with_views("foot", more=_LOSS) + """
    SELECT representation, round(sr, 6) AS "source_R2", round(tr, 6) AS "target_R2", round(sr - tr, 6) AS "R2_drop",
           round(se, 6) AS "source_RMSE", round(te, 6) AS "target_RMSE", round(te - se, 6) AS "RMSE_increase",
           round(100 * (te / se - 1), 6) AS "RMSE_increase_percent", round(te / se, 6) AS "target_RMSE_over_source_RMSE",
           round(tm, 6) AS "target_MAE", round(tb, 6) AS "target_Bias", n AS "N" FROM loss""")
def transfer_loss(spark, sf):
    t = M.transfer_loss(*_domain_metrics(spark, sf))
    return select_rounded(t, ["representation", "N"], [c for c in t.columns if c not in ("representation", "N")])


@query("conclusion", "K12", with_views("foot", more=_LOSS) + """
    SELECT CASE WHEN a.tr > b.tr AND a.te < b.te AND a.sr - a.tr < b.sr - b.tr THEN 'stronger transfer'
           WHEN abs(a.tr - b.tr) < 0.05 OR abs(a.te - b.te) / b.te < 0.05 THEN 'comparable transfer'
           ELSE 'no superior transfer' END AS conclusion
    FROM loss a, loss b WHERE a.representation = 'embedding64' AND b.representation = 'sentinel1_c'""")
def conclusion(spark, sf):
    return govern.conclusion(M.transfer_loss(*_domain_metrics(spark, sf)), "embedding64", "sentinel1_c")


@query("mapping_gate", "K11 D32", with_views("foot", more=_DOM) + """
    SELECT representation, round("R2", 6) AS "R2", round("RMSE", 6) AS "RMSE", round("Bias", 6) AS "Bias", "R2" > 0 AS "positive_R2",
           "R2" >= 0.2 AND abs("Bias") < "RMSE" AS map_authorized FROM dm WHERE domain = 'target' ORDER BY dm."R2" DESC LIMIT 1""")
def mapping_gate(spark, sf):
    _, t = _domain_metrics(spark, sf)
    best = M.best_by_r2(t, ["representation", "R2", "RMSE", "Bias"])
    return select_rounded(M.mapping_gate(best), ["representation", "positive_R2", "map_authorized"], ["R2", "RMSE", "Bias"])


@query("best_candidate", "F4 I9", with_views("foot", more=_FOLDM) + """
    SELECT fold, representation AS model, config, round("RMSE", 6) AS "RMSE" FROM (SELECT *, 'c' AS config,
    row_number() OVER (PARTITION BY fold ORDER BY "RMSE", representation) AS k FROM m) WHERE k = 1""")
def best_candidate(spark, sf):
    m = M.metrics(variants(spark, sf), by=["representation", "fold"]).select(
        "fold", F.col("representation").alias("model"), F.lit("c").alias("config"), "RMSE")
    return select_rounded(M.best_by_error(m, ["fold"]), ["fold", "model", "config"], ["RMSE"])


@query("paired_method_choice", "I22", with_views("foot", more=_FOLDM + """,
    s AS (SELECT representation, avg("R2") AS r, avg("RMSE") AS e, avg("MAE") AS a FROM m GROUP BY 1)""") + """
    SELECT round(abs(c.r - o.r), 6) AS r2_absolute_difference, round(abs(c.e - o.e) / c.e, 6) AS relative_rmse_difference,
           abs(c.r - o.r) < 0.01 AND abs(c.e - o.e) / c.e < 0.01 AS practically_similar,
           CASE WHEN (abs(c.r - o.r) < 0.01 AND abs(c.e - o.e) / c.e < 0.01) OR (c.e, c.a) <= (o.e, o.a) THEN 'sentinel1_c' ELSE 'palsar_l' END AS rule_winner
    FROM s c, s o WHERE c.representation = 'sentinel1_c' AND o.representation = 'palsar_l'""")
def paired_method_choice(spark, sf):
    m = M.metrics(variants(spark, sf), by=["representation", "fold"]).withColumnRenamed("representation", "method")
    c = M.paired_method_choice(m, "sentinel1_c", "palsar_l")
    return select_rounded(c, ["practically_similar", "rule_winner"], ["r2_absolute_difference", "relative_rmse_difference"])


# --- few-shot calibration on the shared draws --------------------------------
_CAL = DRAWS + """,
    fit AS (SELECT d.fold, d.seed, d.budget, avg(agbd - prediction) AS b, regr_slope(agbd, prediction) AS s,
            regr_intercept(agbd, prediction) AS i, count(*) AS n_train FROM draws d JOIN foot f ON d.shot_number = f.shot_number GROUP BY ALL)"""
_RUNS = _CAL + f""",
    scored AS (SELECT 'bias_only' AS method, c.fold, budget, seed, n_train, agbd, prediction + b AS prediction FROM foot f JOIN fit c ON f.fold = c.fold
        UNION ALL SELECT 'affine', c.fold, budget, seed, n_train, agbd, i + s * prediction FROM foot f JOIN fit c ON f.fold = c.fold),
    runs AS (SELECT method, fold, budget, seed, n_train, {_RAW} FROM scored GROUP BY ALL)"""


def _calibrated(spark, sf):
    return transfer.calibrated_runs(view(spark, sf, "foot"), draws_of(spark, sf), "shot_number", fold="fold")


@query("calibration_parameters", "I13 I14", with_views("foot", more=_CAL) + """
    SELECT CAST(fold AS INT) AS fold, CAST(budget AS INT) AS budget, CAST(seed AS INT) AS seed, round(b, 6) AS bias_correction,
           round(s, 6) AS affine_slope, round(i, 6) AS affine_intercept, n_train AS "N_train" FROM fit""")
def calibration_parameters(spark, sf):
    c = transfer.calibrations(view(spark, sf, "foot"), draws_of(spark, sf), "shot_number")
    return select_rounded(c, ["fold", "budget", "seed", "N_train"],
                          ["bias_correction", "affine_slope", "affine_intercept"])


@query("calibrated_runs", "I13 I14 J7", with_views("foot", more=_RUNS) + """
    SELECT method, CAST(fold AS INT) AS fold, CAST(budget AS INT) AS budget, CAST(seed AS INT) AS seed, n_train AS "N_train",
           round("R2", 6) AS "R2", round("RMSE", 6) AS "RMSE", round("MAE", 6) AS "MAE", round("Bias", 6) AS "Bias", "N" AS "N_test" FROM runs""")
def calibrated_runs(spark, sf):
    return select_rounded(_calibrated(spark, sf), ["method", "fold", "budget", "seed", "N_train", "N_test"], METRICS)


_SUMM = _RUNS + ", summ AS (SELECT method, budget, count(*) AS runs, median(n_train) AS n_train, avg(\"N\") AS nt, " + ", ".join(
    f'avg("{m}") AS "{m}_mean", stddev_samp("{m}") AS "{m}_sd", median("{m}") AS "{m}_median"' for m in METRICS) + \
    " FROM runs GROUP BY method, budget)"


def _summary(spark, sf):
    return M.run_summary(_calibrated(spark, sf), ["method", "budget"])


_STATS = [f"{m}_{s}" for m in METRICS for s in ("mean", "sd", "median")]
_SUMMARY_COLUMNS = ('method, CAST(budget AS INT) AS budget, runs, CAST(n_train AS DOUBLE) AS "N_train", round(nt, 6) AS "N_test_mean", '
                    + ", ".join(f'round("{c}", 6) AS "{c}"' for c in _STATS))


@query("run_summary", "D22", with_views("foot", more=_SUMM) + f"SELECT {_SUMMARY_COLUMNS} FROM summ")
def run_summary(spark, sf):
    return select_rounded(_summary(spark, sf), ["method", "budget", "runs", "N_train"], ["N_test_mean", *_STATS])


@query("few_shot_summary", "D22 G1", with_views("foot", more=_SUMM) + f"""
    SELECT {_SUMMARY_COLUMNS} FROM summ UNION ALL
    SELECT 'zero_shot', 0, 1, 0, "N", """ + ", ".join(f'"{m}", NULL, "{m}"' for m in METRICS) + f" FROM (SELECT {_M} FROM foot)")
def few_shot_summary(spark, sf):
    s = M.with_zero_shot(_summary(spark, sf), M.metrics(view(spark, sf, "foot")))
    return select_rounded(s, ["method", "budget", "runs", "N_train"], ["N_test_mean", *_STATS])


@query("label_thresholds", "D23", with_views("foot", more=_SUMM) + """
    SELECT method, CAST(t AS DOUBLE) AS "R2_threshold", coalesce(CAST(min(budget) FILTER (WHERE "R2_mean" > t) AS VARCHAR), 'not reached') AS labels_required
    FROM summ, (SELECT unnest([0.0, 0.2, 0.4, 0.5]) AS t) GROUP BY ALL""")
def label_thresholds(spark, sf):
    return M.label_thresholds(_summary(spark, sf), ["method"])


@query("first_positive_budget", "D24", with_views("foot", more=_SUMM) + """
    SELECT method, CAST(min(budget) FILTER (WHERE "R2_mean" > 0) AS INT) AS "first_positive_R2_labels" FROM summ GROUP BY method""")
def first_positive_budget(spark, sf):
    return M.first_positive_budget(_summary(spark, sf), ["method"])


@query("fewest_labels_to_exceed", "C16", with_views("foot", more=_SUMM) + """
    SELECT a.method AS representation, b.method AS legacy_reference, CAST(min(a.budget) AS INT) AS fewest_labels_to_exceed
    FROM summ a JOIN summ b ON a.budget = b.budget AND a."R2_mean" > b."R2_mean" GROUP BY ALL""")
def fewest_labels(spark, sf):
    s = _summary(spark, sf).withColumnRenamed("method", "representation")
    return joins.fewest_labels_to_exceed(s, ["affine", "bias_only"])


@query("training_sizes", "D31", with_views("foot") + """
    SELECT round(avg(least((SELECT count(*) FROM foot) - n, 10000)), 6) AS "N_train", round(avg(n), 6) AS "N_test"
    FROM (SELECT fold, count(*) AS n FROM foot GROUP BY fold)""")
def training_sizes(spark, sf):
    return select_rounded(M.training_sizes(view(spark, sf, "foot"), "fold", 10_000), [], ["N_train", "N_test"])


@query("master_summary", "D31 G1", with_views("foot", more=_SUMM + f""",
    size AS (SELECT avg(least((SELECT count(*) FROM foot) - n, 10000)) AS a, avg(n) AS b FROM (SELECT fold, count(*) AS n FROM foot GROUP BY fold)),
    all_rows AS (SELECT 'source_spatial_cv' AS stage, 'formula' AS representation, "N" AS labels, "R2", "RMSE", "MAE", "Bias",
               (SELECT a FROM size) AS nr, (SELECT b FROM size) AS nt FROM (SELECT {_RAW} FROM foot)
      UNION ALL SELECT 'zero_shot', 'formula', 0, "R2", "RMSE", "MAE", "Bias", 0, "N" FROM (SELECT {_RAW} FROM foot WHERE domain = 'target')
      UNION ALL SELECT 'few_shot_local', s.method, s.budget, "R2_mean", "RMSE_mean", "MAE_mean", "Bias_mean", s.budget, nt
          FROM summ s)""") + """
    SELECT stage, representation, CAST(labels AS BIGINT) AS labels, round("R2", 6) AS "R2", round("RMSE", 6) AS "RMSE", round("MAE", 6) AS "MAE",
           round("Bias", 6) AS "Bias", round(nr, 6) AS "N_train", round(nt, 6) AS "N_test" FROM all_rows""")
def master_summary(spark, sf):
    foot = view(spark, sf, "foot")
    size = M.training_sizes(foot, "fold", 10_000).select(F.struct("N_train", "N_test")).scalar()
    cv = M.metrics(foot).withColumns({"representation": F.lit("formula"), "N_train": size["N_train"],
                                      "N_test": size["N_test"]})
    zero = transfer.zero_shot_row(foot.where("domain = 'target'")).withColumn("representation", F.lit("formula"))
    few = _summary(spark, sf).withColumnRenamed("method", "representation")
    t = transfer.master_summary(cv, zero, few)
    return select_rounded(t, ["stage", "representation", "labels"],
                          ["R2", "RMSE", "MAE", "Bias", "N_train", "N_test"])
