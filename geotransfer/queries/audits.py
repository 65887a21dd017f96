"""Quality cascades, class audits, missing values, distribution and coverage audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotransfer.functions import radar, text, times
from geotransfer.functions.numeric import finite_vector, to_number
from geotransfer.functions.spectral import with_indices
from geotransfer.operators import qa, stats
from geotransfer.operators.composite import scenes_per_year
from geotransfer.operators.joins import coverage_by
from geotransfer.operators.sampling import first_rows
from geotransfer.queries.registry import (query, rounded, select_rounded, table, view, with_views)
from geotransfer.schemas import L_BAND, QA_STAGES

_KEEP = """algorithm_run_flag = 1 AND shot_number IS NOT NULL AND agbd IS NOT NULL AND agbd_se IS NOT NULL
    AND l4_quality_flag = 1 AND degrade_flag = 0 AND agbd >= 0 AND agbd_se >= 0"""
_RULES = ["TRUE", "algorithm_run_flag = 1", "agbd IS NOT NULL AND agbd_se IS NOT NULL",
          "l4_quality_flag = 1", "degrade_flag = 0", "agbd >= 0", "agbd_se >= 0"]


def _counts(sep=", "):
    return sep.join(f"count(*) FILTER (WHERE {' AND '.join(_RULES[:i + 1])}) AS {n}"
                    for i, n in enumerate(QA_STAGES))


@query("quality_filter", "B1", with_views("raw") + f"""
    SELECT shot_number, year, agbd FROM raw WHERE {_KEEP}""")
def quality_filter(spark, sf):
    return qa.quality_filter(view(spark, sf, "raw")).select("shot_number", "year", "agbd")


@query("qa_cascade_table", "B2 D4 E3", with_views("raw", more=f"w AS (SELECT {_counts()} FROM raw)") + f"""
    SELECT stage, filter_stage, n_after, lag(n_after) OVER (ORDER BY stage) - n_after AS removed_at_stage,
           round(n_after * 1e0 / first(n_after) OVER (ORDER BY stage) * 100, 6) AS retained_from_raw_percent
    FROM ({' UNION ALL '.join(f"SELECT CAST({i} AS INT) AS stage, '{n}' AS filter_stage, {n} AS n_after FROM w"
                              for i, n in enumerate(QA_STAGES))})""")
def qa_cascade_table(spark, sf):
    t = qa.cascade_table(qa.cascade_counts(view(spark, sf, "raw")))
    return t.withColumn("retained_from_raw_percent", F.round("retained_from_raw_percent", 6))


@query("qa_by_year", "D5", with_views("raw") + f"""
    SELECT year, count(DISTINCT granule) AS granule_count, {_counts()} FROM raw GROUP BY year""")
def qa_by_year(spark, sf):
    return qa.cascade_counts(view(spark, sf, "raw"), by=["year"],
                             extra=[F.count_distinct("granule").alias("granule_count")])


@query("calendar_year_scan", "B3", """
    SELECT l_shipdate, l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'""")
def calendar_year_scan(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.where(times.in_calendar_year("l_shipdate", 1998)).select(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")


@query("scene_attribute_filter", "B4", """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders
    WHERE o_orderstatus = 'F' AND o_custkey % 3 > 0 AND o_custkey % 2 = 0 GROUP BY 1""")
def scene_attribute_filter(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_custkey")
    pol = F.array_compact(F.array(F.when(k % 3 > 0, F.lit("VV")), F.when(k % 2 == 0, F.lit("VH"))))
    scenes = o.select(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("instrument_mode"),
                      pol.alias("polarisations"))
    return (qa.scene_filter(scenes, "F", ["VV", "VH"]).groupBy("year")
            .agg(F.count(F.lit(1)).alias("n")))


@query("qa_class_valid", "B8 H16", with_views("obs") + """
    SELECT event_type, count(*) FILTER (WHERE qa IN (1, 255)) AS valid_n,
           count(*) FILTER (WHERE TRY_CAST(event_type AS DOUBLE) IS NULL) AS unreadable_n FROM obs GROUP BY 1""")
def qa_class_valid(spark, sf):
    return view(spark, sf, "obs").groupBy("event_type").agg(
        F.count_if(radar.qa_is_valid("qa")).alias("valid_n"),
        F.count_if(to_number("event_type").isNull()).alias("unreadable_n"))


@query("undocumented_classes", "B9 G4", with_views("radar") + """
    SELECT palsar_qa, count(*) AS n FROM radar
    WHERE palsar_qa NOT IN (0, 1, 2, 3, 4, 50, 100, 150, 255) GROUP BY 1""")
def undocumented_classes(spark, sf):
    return qa.undocumented_classes(view(spark, sf, "radar"), "palsar_qa")


_RADAR = """f AS (SELECT *, CASE WHEN HH > 0 THEN 20 * log10(HH) - 83 END AS hh_db,
                 CASE WHEN HV > 0 THEN 20 * log10(HV) - 83 END AS hv_db,
                 CASE WHEN HH > 0 AND HV > 0 THEN (HH * HH - HV * HV) / (HH * HH + HV * HV) END AS rf FROM radar),
    v AS (SELECT *, coalesce(palsar_qa IN (1, 255) AND hh_db BETWEEN -60 AND 20 AND hv_db BETWEEN -60 AND 20
                 AND rf BETWEEN -1 AND 1, false) AS palsar_valid FROM f)"""


@query("radar_validity", "B10", with_views("radar", more=_RADAR) + """
    SELECT year, count(*) AS n, count(*) FILTER (WHERE palsar_valid) AS valid_n FROM v GROUP BY year""")
def radar_validity(spark, sf):
    f = radar.with_radar_features(view(spark, sf, "radar"))
    return (f.withColumn("palsar_valid", radar.radar_valid()).groupBy("year")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("palsar_valid").alias("valid_n")))


@query("missing_counts", "B12", with_views("raw", more="""
    s AS (SELECT CASE WHEN agbd IS NULL THEN -9999e0 ELSE agbd END AS agbd,
                 CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE agbd_se END AS agbd_se, lon FROM raw)""") + """
    SELECT 'agbd' AS feature, count(*) FILTER (WHERE agbd = -9999) AS sentinel_n,
           count(*) FILTER (WHERE agbd IS NULL) AS non_finite_n FROM s
    UNION ALL SELECT 'agbd_se', count(*) FILTER (WHERE agbd_se = -9999), count(*) FILTER (WHERE agbd_se IS NULL) FROM s
    UNION ALL SELECT 'lon', count(*) FILTER (WHERE lon = -9999), count(*) FILTER (WHERE lon IS NULL) FROM s""")
def missing_counts(spark, sf):
    raw = view(spark, sf, "raw").withColumns({
        "agbd": F.coalesce("agbd", F.lit(-9999.0)),
        "agbd_se": F.when(F.col("o_orderkey") % 41 != 0, F.col("agbd_se"))})
    return qa.missing_counts(raw, ["agbd", "agbd_se", "lon"])


@query("sentinel_to_null", "B12 H16", with_views("raw") + """
    SELECT year, count(agbd) AS kept, round(avg(agbd), 6) AS mean FROM raw GROUP BY year""")
def sentinel_to_null(spark, sf):
    raw = view(spark, sf, "raw").withColumn("agbd", F.coalesce("agbd", F.lit(-9999.0)))
    return (qa.null_boundary(raw, ["agbd"]).groupBy("year")
            .agg(F.count("agbd").alias("kept"), rounded(F.avg("agbd"), 6, "mean")))


@query("nonzero_vectors", "B14", """
    SELECT label, count(*) AS n FROM embeddings
    WHERE len(embedding) = 64 AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0) GROUP BY label""")
def nonzero_vectors(spark, sf):
    return (table(spark, sf, "embeddings").where(finite_vector("embedding", 64)).groupBy("label")
            .agg(F.count(F.lit(1)).alias("n")))


@query("bounded_indices", "B15", with_views("optical") + """
    SELECT count(*) FILTER (WHERE abs((B8 - B4) / (B8 + B4)) > 0.9) AS "NDVI",
           count(*) FILTER (WHERE abs((B8 - B11) / (B8 + B11)) > 0.9) AS "NDMI",
           count(*) FILTER (WHERE abs((B8 - B12) / (B8 + B12)) > 0.9) AS "NBR" FROM optical""")
def bounded_indices(spark, sf):
    return qa.out_of_bounds(with_indices(view(spark, sf, "optical")), ["NDVI", "NDMI", "NBR"], 0.9)


@query("large_groups", "B19", with_views("foot") + """
    SELECT block, year, count(*) AS n FROM foot GROUP BY block, year HAVING count(*) >= 40""")
def large_groups(spark, sf):
    return qa.large_groups(view(spark, sf, "foot"), ["block", "year"], 40)


_SUM = """count(agbd) AS {p}n, round(avg(agbd), 6) AS {p}mean, round({sd}(agbd), 6) AS {p}sd,
    round(min(agbd), 6) AS {p}min, round(max(agbd), 6) AS {p}max"""
# Quantiles of five-decimal values can end in a 5 at the seventh decimal, so they keep eight.
_MOMENTS = ["mean", "sd", "min", "max"]
_QS = {"p01": .01, "p05": .05, "p25": .25, "p50": .5, "p75": .75, "p95": .95, "p99": .99}


def _qsql(names, prefix=""):
    return ", ".join(f"round(quantile_cont(agbd, {p}), 8) AS {prefix}{n}" for n, p in names.items())


@query("distribution_summary", "D6", with_views("foot") + f"""
    SELECT year, {_SUM.format(p='', sd='stddev_pop')}, {_qsql(_QS)} FROM foot GROUP BY year""")
def distribution_summary(spark, sf):
    s = stats.summary(view(spark, sf, "foot"), "agbd", ["year"])
    return s.select("year", "n", *[rounded(c) for c in _MOMENTS], *[rounded(c, 8) for c in _QS])


_Q7 = {"p10": .1, "p25": .25, "p50": .5, "p75": .75, "p90": .9, "p95": .95}


@query("distribution_sample_sd", "D7", with_views("foot") + f"""
    SELECT {_SUM.format(p='', sd='stddev_samp')}, {_qsql(_Q7)} FROM foot""")
def distribution_sample_sd(spark, sf):
    s = stats.summary(view(spark, sf, "foot"), "agbd", probs=_Q7, sample_sd=True)
    return s.select("n", *[rounded(c) for c in _MOMENTS], *[rounded(c, 8) for c in _Q7])


_MEANINGS = {0: "no data", 1: "land (scan)", 50: "water", 100: "lay over", 150: "shadow", 255: "land (strip)"}


@query("qa_histogram", "D8 E2", with_views("obs") + f"""
    SELECT domain AS "domain", qa, n, round(n * 1e0 / sum(n) OVER (PARTITION BY domain), 12) AS proportion,
           CASE qa {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _MEANINGS.items())} ELSE 'undocumented' END AS meaning
    FROM (SELECT domain, qa, count(*) AS n FROM obs GROUP BY ALL)""")
def qa_histogram(spark, sf):
    h = stats.class_histogram(view(spark, sf, "obs"), ["domain"], "qa", _MEANINGS)
    return h.withColumn("proportion", F.round("proportion", 12))


@query("class_counts_with_null", "D9", with_views("obs") + """
    SELECT domain AS "domain", CASE WHEN qa <> 42 THEN qa END AS qa, count(*) AS n,
           round(count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY domain), 12) AS proportion
    FROM obs GROUP BY 1, 2""")
def class_counts_with_null(spark, sf):
    obs = view(spark, sf, "obs").withColumn("qa", F.when(F.col("qa") != 42, F.col("qa")))
    return stats.class_histogram(obs, ["domain"], "qa").withColumn("proportion", F.round("proportion", 12))


@query("count_map_rows", "D10 D11 H23", with_views("foot") + """
    SELECT year, block AS key, count(*) AS n FROM foot GROUP BY ALL""")
def count_map_rows(spark, sf):
    """Counts to one map per year, written as ``{k=v, ...}`` text, parsed and exploded again."""
    maps = stats.count_maps(view(spark, sf, "foot"), ["year"], "block")
    cell = F.concat(F.lit("{"), F.array_join(F.transform(
        F.map_entries("counts"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ", "),
        F.lit("}"))
    parsed = maps.select("year", text.count_map(cell.alias("c")).alias("counts"))
    return stats.map_rows(parsed, "counts", ["year"])


@query("json_cells", "H23", """
    SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum
    FROM events GROUP BY 1""")
def json_cells(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"))


@query("availability_audit", "D16", with_views("radar", "foot", more=_RADAR) + """
    SELECT f.year, count(*) AS frozen_sample_n, count(v.shot_number) AS sampled_n,
           count(*) FILTER (WHERE HH > 0) AS valid_hh_n, count(*) FILTER (WHERE HV > 0) AS valid_hv_n,
           count(*) FILTER (WHERE palsar_qa IN (1, 255)) AS qa_land_n,
           count(*) FILTER (WHERE palsar_qa IN (1, 255) AND HH > 0 AND HV > 0) AS valid_n,
           round(1 - count(*) FILTER (WHERE palsar_qa IN (1, 255) AND HH > 0 AND HV > 0) / count(*), 12) AS missing_fraction,
           count(DISTINCT f.priority) AS image_count
    FROM foot f LEFT JOIN (SELECT * FROM v WHERE priority <> '5-LOW') v
         ON f.shot_number = v.shot_number AND f.year = v.year GROUP BY f.year""")
def availability_audit(spark, sf):
    got = view(spark, sf, "radar").where("priority <> '5-LOW'").drop("o_orderkey", "priority")
    foot = view(spark, sf, "foot").select("shot_number", "year")
    images = scenes_per_year(view(spark, sf, "foot"), "year", "priority")
    land = radar.qa_is_valid("palsar_qa")
    out = qa.availability(foot, got, ["shot_number", "year"], land & (F.col("HH") > 0) & (F.col("HV") > 0),
                          ["year"], {"valid_hh_n": F.col("HH") > 0, "valid_hv_n": F.col("HV") > 0,
                                     "qa_land_n": land}, images)
    return out.withColumn("missing_fraction", F.round("missing_fraction", 12))


@query("common_years", "D18 G3", with_views("obs", more="""
    y AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem),
    z AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')""") + """
    SELECT year FROM y INTERSECT SELECT year FROM z""")
def common_years(spark, sf):
    y = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"))
    z = (table(spark, sf, "orders").where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp"))
         .select(F.year("o_orderdate").alias("year")))
    return qa.common_groups(y, z, "year")


@query("coverage_by_block", "C8", with_views("foot", "radar") + """
    SELECT f.block, f.year, count(*) AS expected_n,
           CAST(count(r.shot_number) AS BIGINT) AS received_n,
           round(1 - count(r.shot_number) / count(*), 12) AS missing_fraction
    FROM foot f LEFT JOIN (SELECT * FROM radar WHERE palsar_qa IN (1, 255)) r
         ON f.shot_number = r.shot_number AND f.year = r.year GROUP BY ALL""")
def coverage_by_block(spark, sf):
    got = view(spark, sf, "radar").where(radar.qa_is_valid("palsar_qa"))
    out = coverage_by(view(spark, sf, "foot"), got, ["shot_number", "year"], ["block", "year"])
    return out.withColumn("missing_fraction", F.round("missing_fraction", 12))


@query("norm_audit", "D28 H13", """
    WITH n AS (SELECT sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))
               * (1 + (vec_id % 7) / 100e0) AS norm FROM embeddings)
    SELECT count(*) AS n, round(avg(norm), 6) AS mean, round(stddev_samp(norm), 6) AS sd,
           round(min(norm), 6) AS min, round(max(norm), 6) AS max, round(quantile_cont(norm, 0.01), 6) AS p01,
           round(quantile_cont(norm, 0.5), 6) AS median, round(quantile_cont(norm, 0.99), 6) AS p99,
           count(*) FILTER (WHERE abs(norm - 1) > 0.02) AS deviating_n FROM n""")
def norm_audit(spark, sf):
    e = table(spark, sf, "embeddings")
    scaled = e.select(F.transform("embedding", lambda x: x.cast("double")
                                  * (1 + (F.col("vec_id") % 7) / 100.0)).alias("v"))
    s = stats.norm_audit(scaled, "v")
    return select_rounded(s, ["n", "deviating_n"], ["mean", "sd", "min", "max", "p01", "median", "p99"])


@query("timing_shares", "D27 C9 H15", with_views("obs", more="""
    d AS (SELECT domain, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, dayofyear(ts) AS doy
          FROM obs),
    l AS (SELECT year, quantile_cont(doy, 0.05) AS a, quantile_cont(doy, 0.95) AS b FROM d
          WHERE domain = 'source' GROUP BY year),
    r AS (SELECT domain, d.year, month, count(*) AS n, count(*) FILTER (WHERE doy < a OR doy > b) AS u
          FROM d LEFT JOIN l ON d.year = l.year GROUP BY ALL)""") + """
    SELECT domain AS "domain", year, month, n AS "N", u AS unusual_n,
           round(n / sum(n) OVER (PARTITION BY domain, year), 12) AS fraction,
           round(u / n, 12) AS unusual_fraction FROM r""")
def timing_shares(spark, sf):
    t = stats.timing_shares(view(spark, sf, "obs"), "domain", "source", "ts")
    return select_rounded(t, ["domain", "year", "month", "N", "unusual_n"], ["fraction", "unusual_fraction"], 12)


@query("first_examples", "E4", with_views("foot") + """
    SELECT domain AS "domain", year, shot_number FROM (SELECT *, row_number() OVER (PARTITION BY domain, year ORDER BY shot_number) AS k
    FROM foot) WHERE k <= 3""")
def first_examples(spark, sf):
    foot = view(spark, sf, "foot").select("domain", "year", "shot_number")
    return first_rows(foot, ["domain", "year"], ["shot_number"], 3)


@query("radar_exclusion_reasons", "D17", with_views("radar", more=_RADAR) + """
    SELECT count(*) FILTER (WHERE NOT palsar_valid) AS invalid_radar,
           count(*) FILTER (WHERE hh_db IS NULL OR hv_db IS NULL) AS missing_radar,
           count(*) FILTER (WHERE palsar_epoch <= 0) AS no_date FROM v""")
def radar_exclusion_reasons(spark, sf):
    f = radar.with_radar_features(view(spark, sf, "radar"))
    return qa.exclusion_counts(f, {"invalid_radar": ~radar.radar_valid(), "missing_radar": qa.any_missing(L_BAND),
                                   "no_date": F.col("palsar_epoch") <= 0})
