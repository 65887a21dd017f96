"""Operators on keys, values and predictions that are often missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotransfer.operators import joins, metrics as M, ordering, quantiles, sampling
from geotransfer.queries.registry import query, rounded, select_rounded, view, with_views

# A third of the rows have no key; one key has no value at all.
_GAPS = """
    gaps AS (SELECT o_orderkey, shot_number, year, fold, agbd, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE block END AS block,
             CASE WHEN block = 'b7' AND o_orderkey % 3 <> 0 THEN NULL ELSE agbd END AS value,
             CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE prediction END AS prediction FROM foot)"""


def _gaps(spark, sf):
    third, fifth = F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 5 == 0
    return view(spark, sf, "foot").select(
        "o_orderkey", "shot_number", "year", "fold", "agbd", F.when(~third, F.col("block")).alias("block"),
        F.when(~((F.col("block") == "b7") & ~third), F.col("agbd")).alias("value"),
        F.when(~fifth, F.col("prediction")).alias("prediction"))


@query("null_strata_sample", "J2 E1 F3", with_views("foot", more=_GAPS) + """
    SELECT block, shot_number FROM (SELECT block, shot_number, row_number() OVER (
      PARTITION BY block ORDER BY sha256(concat('42|', shot_number)), shot_number) AS k FROM gaps) WHERE k <= 5""")
def null_strata_sample(spark, sf):
    return sampling.capped_sample(_gaps(spark, sf), ["block"], "shot_number", 5).select("block", "shot_number")


@query("null_strata_audit", "D12", with_views("foot", more=_GAPS) + """
    SELECT block, count(*) AS raw_n, least(count(*), 5) AS sampled_n, true AS as_expected FROM gaps GROUP BY block""")
def null_strata_audit(spark, sf):
    g = _gaps(spark, sf)
    return sampling.strata_audit(g, sampling.capped_sample(g, ["block"], "shot_number", 5), ["block"], 5).drop("sampling_fraction")


@query("null_key_numbers", "E5 A11", with_views("foot", more=_GAPS) + """
    SELECT block, shot_number, row_number() OVER (PARTITION BY block ORDER BY shot_number) AS row_no FROM gaps""")
def null_key_numbers(spark, sf):
    return ordering.number_rows(_gaps(spark, sf).select("block", "shot_number"), ["shot_number"], ["block"])


@query("null_key_ranks", "E6", with_views("foot", more=_GAPS) + """
    SELECT block, shot_number, round(rank() OVER w + (count(*) OVER (PARTITION BY block, value) - 1) / 2.0, 2) AS rank
    FROM gaps WHERE value IS NOT NULL WINDOW w AS (PARTITION BY block ORDER BY value)""")
def null_key_ranks(spark, sf):
    ranked = ordering.average_ranks(_gaps(spark, sf).select("block", "shot_number", "value"), ["block"], "value", "rank")
    return ranked.select("block", "shot_number", rounded("rank", 2))


@query("null_key_quantiles", "D6 E7", with_views("foot", more=_GAPS) + """
    SELECT block, round(quantile_cont(value, 0.25), 9) AS q25, round(quantile_cont(value, 0.5), 9) AS q50 FROM gaps GROUP BY block""")
def null_key_quantiles(spark, sf):
    q = quantiles.quantiles(_gaps(spark, sf), ["block"], "value", {"q25": 0.25, "q50": 0.5})
    return select_rounded(q, ["block"], ["q25", "q50"], 9)


@query("null_key_lookup", "C9", with_views("foot", more=_GAPS) + """
    SELECT block, count(*) AS n, CAST(count(*) * count(*) AS BIGINT) AS weight FROM gaps GROUP BY block""")
def null_key_lookup(spark, sf):
    """Sizes of groups joined back to their rows, the group without a key among them."""
    g = _gaps(spark, sf)
    sizes = g.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    return joins.lookup_join(g, sizes, ["block"]).groupBy("block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"))


@query("missing_prediction_metrics", "D1 D2", with_views("foot", more=_GAPS) + """
    SELECT fold, round(1 - sum((prediction - agbd) * (prediction - agbd)) / (var_pop(agbd) * count(*)), 6) AS "R2",
           round(sqrt(avg((prediction - agbd) * (prediction - agbd))), 6) AS "RMSE", count(*) AS "N"
    FROM gaps WHERE prediction IS NOT NULL GROUP BY fold""")
def missing_prediction_metrics(spark, sf):
    m = M.metrics(_gaps(spark, sf), by=["fold"])
    return m.select("fold", rounded("R2"), rounded("RMSE"), "N")
