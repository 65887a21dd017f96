"""Two-sample distances, rank statistics, binning and nearest source."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotransfer.operators import stats
from geotransfer.operators.metrics import (binned_bias, binned_distance_error, residual_bins)
from geotransfer.operators.nearest import nearest_source
from geotransfer.operators.ordering import average_ranks
from geotransfer.operators.quantiles import cut, fixed_edges, quantile_bins, quantiles
from geotransfer.session import materialize
from geotransfer.queries.registry import query, rounded, select_rounded, table, view, with_views

FEATURES = ["agbd", "prediction", "f1", "f2", "lon", "lat"]

_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, domain = 'source' AS src, {c} AS v FROM foot" for c in FEATURES) + ")"
_CDF = _LONG + """,
    c AS (SELECT feature, v, count(*) FILTER (WHERE src) AS ns, count(*) FILTER (WHERE NOT src) AS nt FROM long GROUP BY ALL),
    r AS (SELECT feature, v, sum(ns) OVER w / sum(ns) OVER (PARTITION BY feature) AS f1,
                 sum(nt) OVER w / sum(nt) OVER (PARTITION BY feature) AS f2, lead(v) OVER w - v AS gap
          FROM c WINDOW w AS (PARTITION BY feature ORDER BY v)),
    d AS (SELECT feature, round(max(abs(f1 - f2)), 6) AS ks_statistic, round(sum(abs(f1 - f2) * gap), 6) AS wasserstein_distance
          FROM r GROUP BY feature)"""


@query("drift_table", "I19 I17 I18 E10", with_views("foot", more=_CDF) + """
    SELECT feature, count(*) FILTER (WHERE src) AS source_n, count(*) FILTER (WHERE NOT src) AS target_n,
           round(avg(v) FILTER (WHERE src), 6) AS source_mean, round(avg(v) FILTER (WHERE NOT src), 6) AS target_mean,
           round(stddev_pop(v) FILTER (WHERE src), 6) AS source_std, round(stddev_pop(v) FILTER (WHERE NOT src), 6) AS target_std,
           round(median(v) FILTER (WHERE src), 8) AS source_median, round(median(v) FILTER (WHERE NOT src), 8) AS target_median,
           ks_statistic, wasserstein_distance FROM long JOIN d USING (feature) GROUP BY feature, ks_statistic, wasserstein_distance""")
def drift_table(spark, sf):
    t = stats.drift_table(view(spark, sf, "foot"), "domain", "source", FEATURES)
    return t.select("feature", "source_n", "target_n", *[rounded(c) for c in (
        "source_mean", "target_mean", "source_std", "target_std", "ks_statistic", "wasserstein_distance")],
        rounded("source_median", 8), rounded("target_median", 8))


@query("two_sample_by_block", "I17 I18", with_views("foot", more="""
    c AS (SELECT block, agbd AS v, count(*) FILTER (WHERE domain = 'source') AS ns, count(*) FILTER (WHERE domain <> 'source') AS nt
          FROM foot GROUP BY ALL),
    r AS (SELECT block, sum(ns) OVER p AS a, sum(nt) OVER p AS b, sum(ns) OVER w / sum(ns) OVER p AS f1,
          sum(nt) OVER w / sum(nt) OVER p AS f2, lead(v) OVER w - v AS gap
          FROM c WINDOW w AS (PARTITION BY block ORDER BY v), p AS (PARTITION BY block))""") + """
    SELECT block, CAST(max(a) AS BIGINT) AS source_n, CAST(max(b) AS BIGINT) AS target_n, round(max(abs(f1 - f2)), 6) AS ks_statistic,
           round(sum(abs(f1 - f2) * gap), 6) AS wasserstein_distance FROM r GROUP BY block""")
def two_sample_by_block(spark, sf):
    t = stats.two_sample(view(spark, sf, "foot"), ["block"], "agbd", F.col("domain") == "source")
    return select_rounded(t, ["block", "source_n", "target_n"], ["ks_statistic", "wasserstein_distance"])


@query("total_variation", "D14", with_views("foot", more="""
    a AS (SELECT year, block, count(*) FILTER (WHERE domain = 'source') AS x FROM foot GROUP BY ALL)""") + """
    SELECT round(0.5 * sum(abs(x / tx - y / ty)), 6) AS total_variation FROM (
      SELECT block, x, y, sum(x) OVER () AS tx, sum(y) OVER () AS ty FROM (
        SELECT block, count(*) AS x, count(*) FILTER (WHERE status <> 'P') AS y FROM foot GROUP BY block))""")
def total_variation(spark, sf):
    foot = view(spark, sf, "foot")
    t = stats.total_variation(foot, foot.where("status <> 'P'"), "block")
    return t.select(rounded("total_variation"))


@query("total_variation_by_domain", "D14", with_views("foot") + """
    SELECT domain AS "domain", round(0.5 * sum(abs(x / tx - y / ty)), 6) AS total_variation FROM (
      SELECT domain, x, y, sum(x) OVER w AS tx, sum(y) OVER w AS ty FROM (
        SELECT domain, year, count(*) AS x, count(*) FILTER (WHERE agbd > 100) AS y FROM foot GROUP BY ALL)
      WINDOW w AS (PARTITION BY domain)) GROUP BY domain""")
def total_variation_by_domain(spark, sf):
    foot = view(spark, sf, "foot")
    t = stats.total_variation(foot, foot.where("agbd > 100"), "year", ["domain"])
    return t.select("domain", rounded("total_variation"))


def _ranks(col, part="", out="r"):
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part + ', ' if part else ''}{col}"
    return f"rank() OVER ({p}ORDER BY {col}) + (count(*) OVER ({q}) - 1) / 2e0 AS {out}"


@query("average_ranks", "E6", with_views("foot") + f"""
    SELECT shot_number, year, o_custkey_d, {_ranks('o_custkey_d', 'year', 'rank')} FROM
      (SELECT shot_number, year, CAST(o_custkey AS DOUBLE) AS o_custkey_d FROM foot)""")
def tie_ranks(spark, sf):
    foot = view(spark, sf, "foot").select("shot_number", "year", F.col("o_custkey").cast("double").alias("o_custkey_d"))
    return average_ranks(foot, ["year"], "o_custkey_d", "rank").select("shot_number", "year", "o_custkey_d", "rank")


@query("spearman", "I16 E6", with_views("foot") + f"""
    SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM
      (SELECT {_ranks('f2', out='a')}, {_ranks('abs(prediction - agbd)', out='b')} FROM foot)""")
def spearman(spark, sf):
    foot = view(spark, sf, "foot").withColumn("err", F.abs(F.col("prediction") - F.col("agbd")))
    return stats.spearman(foot, "f2", "err").select("n", rounded("rho"))


@query("spearman_p_value", "I16", with_views("foot") + f"""
    , r AS (SELECT block, count(*) AS n, corr(a, b) AS rho FROM
      (SELECT block, {_ranks('f2', 'block', 'a')}, {_ranks('abs(prediction - agbd)', 'block', 'b')} FROM foot) GROUP BY block),
    z AS (SELECT *, abs(rho) * sqrt(n - 1) AS z, 1 / (1 + 0.2316419 * abs(rho) * sqrt(n - 1)) AS t FROM r)
    SELECT block, n, round(2 * exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937
           + t * (-1.821255978 + t * 1.330274429)))), 5) AS p_value FROM z""")
def spearman_p_value(spark, sf):
    """Two-sided large-sample p values of the rank correlation of every block."""
    foot = view(spark, sf, "foot").withColumn("err", F.abs(F.col("prediction") - F.col("agbd")))
    return stats.spearman(foot, "f2", "err", ["block"]).select("block", "n", rounded("p_value", 5))


@query("ks_p_value", "I17", with_views("foot", more=_CDF.replace(" round(max(abs(f1 - f2)), 6) AS ks", " max(abs(f1 - f2)) AS ks")) + """
    , n AS (SELECT feature, ks_statistic AS d, CAST(count(*) FILTER (WHERE src) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE NOT src) AS DOUBLE) AS b
            FROM long JOIN d USING (feature) GROUP BY feature, ks_statistic),
    l AS (SELECT feature, sqrt(a * b / (a + b)) * d AS lam FROM n)
    SELECT feature, round(CASE WHEN any_value(lam) < 0.2 THEN 1 ELSE least(greatest(sum(2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END)
           * exp(-2e0 * k * k * lam * lam)), 0), 1) END, 5) AS p_value FROM l, (SELECT unnest(range(1, 41)) AS k) GROUP BY feature""")
def ks_p_value(spark, sf):
    """Asymptotic p values of the two-sample test of every feature."""
    t = stats.drift_table(view(spark, sf, "foot"), "domain", "source", FEATURES)
    return t.select("feature", rounded("ks_pvalue", 5, "p_value"))


@query("spearman_by_block", "I16", with_views("foot") + f"""
    SELECT block, count(*) AS n, round(corr(a, b), 6) AS rho FROM
      (SELECT block, {_ranks('agbd', 'block', 'a')}, {_ranks('prediction', 'block', 'b')} FROM foot) GROUP BY block""")
def spearman_by_block(spark, sf):
    s = stats.spearman(view(spark, sf, "foot"), "agbd", "prediction", ["block"])
    return s.select("block", "n", rounded("rho"))


@query("auroc_rank_sum", "I8 E6", f"""
    WITH j AS (SELECT n_chars % 400 AS score, quality FROM labels JOIN documents USING (doc_id)),
    r AS (SELECT quality, {_ranks('score')} FROM j)
    SELECT count(*) FILTER (WHERE quality = 1) AS positive_n, count(*) FILTER (WHERE quality <> 1) AS negative_n,
           round((sum(r) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2e0)
           / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality <> 1)), 6) AS auroc FROM r""")
def auroc_rank_sum(spark, sf):
    j = (table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
         .withColumn("score", F.col("n_chars") % 400))
    a = stats.auroc(j, "score", F.col("quality") == 1)
    return a.select("positive_n", "negative_n", rounded("auroc"))


def _edges(col, k, src="foot", by=""):
    qs = ", ".join(f"quantile_cont({col}, {i / k!r})" for i in range(k + 1))
    return f"SELECT {by + ', ' if by else ''}[{qs}] AS e FROM {src}" + (f" GROUP BY {by}" if by else "")


def _bin(col, k):
    inner = " + ".join(f"CASE WHEN e[{i + 1}] < {col} AND e[{i + 1}] > e[{i}] AND e[{i + 1}] < e[{k + 1}] THEN 1 ELSE 0 END"
                       for i in range(1, k))
    return f"CAST(1 + {inner} AS INT)"


@query("quantile_bins", "E7", with_views("foot", more=f"ed AS ({_edges('o_custkey % 40', 10)})") + f"""
    SELECT shot_number, {_bin('o_custkey % 40', 10)} AS bin FROM foot, ed""")
def quantile_bin_rows(spark, sf):
    foot = view(spark, sf, "foot").select("shot_number", (F.col("o_custkey") % 40).alias("x"))
    return quantile_bins(foot, "x", 10, "bin").select("shot_number", "bin")


@query("quantile_bins_by_year", "E7", with_views("foot", more=f"ed AS ({_edges('agbd', 4, by='year')})") + f"""
    SELECT year, {_bin('agbd', 4)} AS bin, count(*) AS n FROM foot JOIN ed USING (year) GROUP BY ALL""")
def quantile_bins_by_year(spark, sf):
    b = quantile_bins(view(spark, sf, "foot"), "agbd", 4, "bin", ["year"])
    return b.groupBy("year", "bin").agg(F.count(F.lit(1)).alias("n"))


_E5 = f"ed AS ({_edges('agbd', 5, '(SELECT agbd FROM foot WHERE domain = ' + chr(39) + 'source' + chr(39) + ')')})"
_B5 = "CAST(" + " + ".join(f"(agbd > e[{i + 1}])::INT" for i in range(1, 5)) + " AS INT)"


@query("fixed_edge_bins", "E8", with_views("foot", more=_E5) + f"""
    SELECT domain AS "domain", {_B5} AS bin, count(*) AS n FROM foot, ed GROUP BY ALL""")
def fixed_edge_bins(spark, sf):
    foot = view(spark, sf, "foot")
    edges = fixed_edges(foot.where("domain = 'source'"), "agbd", 5)
    return cut(foot, "agbd", edges, "bin").groupBy("domain", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("residual_bins", "D19 E8", with_views("foot", more=_E5 + f", b AS (SELECT domain, {_B5} AS bin, agbd, prediction, prediction - agbd AS res FROM foot, ed)") + """
    SELECT domain AS "domain", bin, count(*) AS "N", round(sqrt(avg(res * res)), 6) AS "RMSE", round(avg(res), 6) AS "Bias",
           round(CASE WHEN count(*) >= 20 THEN 1 - sum(res * res) / (var_pop(agbd) * count(*)) END, 6) AS "R2",
           round(quantile_cont(res, 0.25), 6) AS residual_q25, round(quantile_cont(res, 0.5), 6) AS residual_median,
           round(quantile_cont(res, 0.75), 6) AS residual_q75,
           round(quantile_cont(res, 0.75) - quantile_cont(res, 0.25), 6) AS residual_iqr FROM b GROUP BY domain, bin""")
def residual_bin_table(spark, sf):
    foot = view(spark, sf, "foot")
    b = cut(foot, "agbd", fixed_edges(foot.where("domain = 'source'"), "agbd", 5), "bin")
    t = residual_bins(b, "bin", by=["domain"])
    return select_rounded(t, ["domain", "bin", "N"], [c for c in t.columns if c not in ("domain", "bin", "N")])


@query("response_curve", "D20 E7", with_views("foot", more=f"ed AS ({_edges('f2', 20)}), b AS (SELECT {_bin('f2', 20)} AS bin, f2, agbd FROM foot, ed)") + """
    SELECT bin, round(median(f2), 8) AS x, round(median(agbd), 8) AS y, round(quantile_cont(agbd, 0.25), 8) AS q25,
           round(quantile_cont(agbd, 0.75), 8) AS q75 FROM b GROUP BY bin""")
def response_curve(spark, sf):
    # Stored once: the edges are a subquery that every job on the bins would work out again.
    b = materialize(quantile_bins(view(spark, sf, "foot").select("f2", "agbd"), "f2", 20, "bin"))
    x = quantiles(b, ["bin"], "f2", {"x": 0.5})
    y = quantiles(b, ["bin"], "agbd", {"y": 0.5, "q25": 0.25, "q75": 0.75})
    return select_rounded(x.join(y, "bin"), ["bin"], ["x", "y", "q25", "q75"], 8)


@query("decile_bias", "D21 E7", with_views("foot", more=f"ed AS ({_edges('agbd', 10)}), b AS (SELECT {_bin('agbd', 10)} AS observed_decile, * FROM foot, ed)") + """
    SELECT observed_decile, count(*) AS "N", round(avg(agbd), 6) AS observed_mean, round(avg(prediction), 6) AS prediction_mean,
           round(avg(prediction - agbd), 6) AS bias, round(avg(abs(prediction - agbd)), 6) AS "MAE" FROM b GROUP BY 1""")
def decile_bias(spark, sf):
    b = quantile_bins(view(spark, sf, "foot"), "agbd", 10, "observed_decile")
    t = binned_bias(b, "observed_decile")
    return select_rounded(t, ["observed_decile", "N"], ["observed_mean", "prediction_mean", "bias", "MAE"])


_NEAR = """near AS (SELECT vec_id, arg_min(sid, (d, sid)) AS nearest_id, min(d) AS distance FROM (
      SELECT t.vec_id, s.vec_id AS sid, list_distance(t.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS d
      FROM embeddings t, embeddings s WHERE t.label >= 5 AND s.label < 5) GROUP BY t_id)"""
_NEAR = _NEAR.replace("GROUP BY t_id", "GROUP BY vec_id")


def nearest_table(spark, sf):
    e = table(spark, sf, "embeddings")
    return nearest_source(e.where("label < 5"), e.where("label >= 5"), "vec_id", "vec_id", "embedding")


@query("nearest_source", "C14", f"WITH {_NEAR} SELECT vec_id, nearest_id, round(distance, 6) AS distance FROM near")
def nearest(spark, sf):
    return nearest_table(spark, sf).select("vec_id", "nearest_id", rounded("distance"))


_DIST = _NEAR + """, y AS (SELECT n.*, label * 10e0 + n.vec_id % 13 AS agbd, label * 9e0 + n.vec_id % 17 AS prediction
    FROM near n JOIN embeddings e ON n.vec_id = e.vec_id)"""


def _distance_rows(spark, sf):
    near = nearest_table(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    return near.withColumns({"agbd": F.col("label") * 10.0 + F.col("vec_id") % 13,
                             "prediction": F.col("label") * 9.0 + F.col("vec_id") % 17})


@query("distance_deciles", "I20 D21", f"WITH {_DIST}, ed AS ({_edges('distance', 10, 'y')}), b AS (SELECT {_bin('distance', 10)} AS distance_decile, y.* FROM y, ed)" + """
    SELECT distance_decile, count(*) AS "N", round(min(distance), 6) AS distance_min, round(max(distance), 6) AS distance_max,
           round(avg(abs(prediction - agbd)), 6) AS "MAE", round(sqrt(avg((prediction - agbd) * (prediction - agbd))), 6) AS "RMSE"
    FROM b GROUP BY 1""")
def distance_deciles(spark, sf):
    b = quantile_bins(_distance_rows(spark, sf), "distance", 10, "distance_decile")
    t = binned_distance_error(b, "distance_decile", "distance")
    return select_rounded(t, ["distance_decile", "N"], ["distance_min", "distance_max", "MAE", "RMSE"])


@query("distance_error_rank_correlation", "I20 I16", f"WITH {_DIST}" + f"""
    SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM (SELECT {_ranks('distance', out='a')},
           {_ranks('abs(prediction - agbd)', out='b')} FROM y)""")
def distance_error_rank_correlation(spark, sf):
    y = _distance_rows(spark, sf).withColumn("err", F.abs(F.col("prediction") - F.col("agbd")))
    return stats.spearman(y, "distance", "err").select("n", rounded("rho"))
