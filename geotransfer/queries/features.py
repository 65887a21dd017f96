"""Feature construction: radar, optical, terrain, composites, times and text cells."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from geotransfer.functions import radar, spectral, text, times
from geotransfer.functions.geo import aspect_components
from geotransfer.functions.numeric import close_to, l2_normalise
from geotransfer.operators.composite import median_composite, median_per_group
from geotransfer.operators.joins import compare_tables
from geotransfer.operators.qa import exclusion_counts
from geotransfer.plans import samples
from geotransfer.queries.registry import (query, rounded, select_rounded, table, view, with_views)
from geotransfer.schemas import (C_BAND, DEM, EMBEDDING, INDICES, KEYS, L_BAND, OPTICAL, REPRESENTATIONS)
from geotransfer.session import materialize


@query("radar_features", "H1 H2 H3 H7", with_views("radar") + """
    SELECT shot_number, round(CASE WHEN HH > 0 THEN 20 * log10(HH) - 83 END, 6) AS palsar_hh_db,
           round(CASE WHEN HV > 0 THEN 20 * log10(HV) - 83 END, 6) AS palsar_hv_db,
           round(CASE WHEN HH > 0 AND HV > 0 THEN 20 * log10(HH) - 20 * log10(HV) END, 6) AS palsar_hh_minus_hv_db,
           round(CASE WHEN HH > 0 AND HV > 0 THEN (HH * HH - HV * HV) / (HH * HH + HV * HV) END, 6) AS palsar_rfdi
    FROM radar""")
def radar_features(spark, sf):
    return select_rounded(radar.with_radar_features(view(spark, sf, "radar")), ["shot_number"], L_BAND)


@query("radar_physics_violations", "H4", with_views("radar") + """
    SELECT count(*) FILTER (WHERE HH <= 0 OR HV <= 0) AS raw_not_positive,
           count(*) FILTER (WHERE HH <= 0 OR HV <= 0) AS missing_feature,
           count(*) FILTER (WHERE HH > 0 AND 20 * log10(HH) - 83 NOT BETWEEN -60 AND 20) AS palsar_hh_db_out_of_range,
           count(*) FILTER (WHERE HV > 0 AND 20 * log10(HV) - 83 NOT BETWEEN -60 AND 20) AS palsar_hv_db_out_of_range,
           CAST(0 AS BIGINT) AS palsar_rfdi_out_of_range FROM radar""")
def radar_physics_violations(spark, sf):
    f = radar.with_radar_features(view(spark, sf, "radar"), drop_raw=False)
    return radar.physics_violations(f, "HH", "HV")


@query("spectral_indices", "H5 H6", with_views("optical") + """
    SELECT l_orderkey, px, py, (B8 - B4) / (B8 + B4) AS "NDVI",
           2.5e0 * (B8 - B4) / nullif(B8 + 6 * B4 - 7.5e0 * B2 + 1, 0) AS "EVI",
           (B8 - B11) / (B8 + B11) AS "NDMI", (B8 - B12) / (B8 + B12) AS "NBR",
           (B8A - B5) / (B8A + B5) AS "NDRE" FROM optical""")
def spectral_indices(spark, sf):
    """Plain arithmetic in the same order on both sides, so no rounding is needed."""
    return spectral.with_indices(view(spark, sf, "optical")).select("l_orderkey", "px", "py", *INDICES)


_CLEAR = """SCL NOT IN (1, 3, 8, 9, 10, 11) AND (QA60 & 1024) = 0 AND (QA60 & 2048) = 0"""


@query("cloud_masked_reflectance", "B11 H17", with_views("optical") + f"""
    SELECT SCL AS "SCL", QA60 AS "QA60", count(*) AS n, round(avg(B8 * 0.0001), 6) AS b8, round(avg(B11 * 0.0001), 6) AS b11
    FROM optical WHERE {_CLEAR} GROUP BY 1, 2""")
def cloud_masked_reflectance(spark, sf):
    df = spectral.masked_reflectance(view(spark, sf, "optical"))
    return df.groupBy("SCL", "QA60").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("B8"), 6, "b8"),
                                         rounded(F.avg("B11"), 6, "b11"))


@query("annual_median_composite", "D29", with_views("optical") + f"""
    SELECT year, px, py, count(*) AS observations, {', '.join(f'round(median({b}), 6) AS "{b}"' for b in OPTICAL)}
    FROM optical WHERE {_CLEAR} GROUP BY year, px, py""")
def annual_median_composite(spark, sf):
    clear = view(spark, sf, "optical").where(spectral.clear_sky())
    c = median_composite(clear, ["year", "px", "py"], OPTICAL)
    return select_rounded(c, ["year", "px", "py", "observations"], OPTICAL)


@query("median_any_group_size", "D29 D6", """
    SELECT l_returnflag, round(median(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1""")
def median_any_group_size(spark, sf):
    m = median_per_group(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return select_rounded(m, ["l_returnflag"], ["l_extendedprice"], 4)


@query("aspect_components", "H9", """
    SELECT p_partkey, round(sin(radians((p_partkey * 7) % 360)), 9) AS aspect_sin,
           round(cos(radians((p_partkey * 7) % 360)), 9) AS aspect_cos FROM part""")
def aspect_sin_cos(spark, sf):
    s, c = aspect_components((F.col("p_partkey") * 7) % 360)
    return table(spark, sf, "part").select("p_partkey", rounded(s, 9, "aspect_sin"), rounded(c, 9, "aspect_cos"))


@query("mission_time", "H14", with_views("foot") + """
    SELECT shot_number, CAST(year(t) AS INTEGER) AS year, strftime(t, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso FROM (
      SELECT shot_number, TIMESTAMP '2018-01-01' + to_microseconds(o_orderkey * 9000000000 + (o_orderkey % 1000) * 250000) AS t
      FROM foot)""")
def mission_time(spark, sf):
    t = times.mission_time(F.col("o_orderkey") * 9000.0 + (F.col("o_orderkey") % 1000) * 0.25)
    df = view(spark, sf, "foot").select("shot_number", t.alias("t"))
    return df.select("shot_number", F.year("t").alias("year"), times.iso_text("t").alias("iso"))


@query("epoch_millis_dates", "H15", with_views("radar") + """
    SELECT shot_number, strftime(t, '%Y-%m-%d') AS palsar_acquisition_date,
           CAST(month(t) AS INTEGER) AS palsar_acquisition_month, CAST(dayofyear(t) AS INTEGER) AS day_of_year
    FROM (SELECT shot_number, CASE WHEN palsar_epoch > 0 THEN make_timestamp(palsar_epoch * 1000) END AS t FROM radar)""")
def epoch_millis_dates(spark, sf):
    t = times.millis_time("palsar_epoch")
    return view(spark, sf, "radar").select(
        "shot_number", F.date_format(t, "yyyy-MM-dd").alias("palsar_acquisition_date"),
        F.month(t).alias("palsar_acquisition_month"), F.dayofyear(t).alias("day_of_year"))


@query("bit_test", "H17", with_views("optical") + """
    SELECT QA60 AS "QA60", (QA60 & 1024) = 0 AS bit10_clear, (QA60 & 2048) = 0 AS bit11_clear, count(*) AS n
    FROM optical GROUP BY 1""")
def bit_test(spark, sf):
    o = view(spark, sf, "optical")
    return (o.groupBy("QA60").agg(F.count(F.lit(1)).alias("n"))
            .withColumns({"bit10_clear": spectral.bit_is_clear("QA60", 10),
                          "bit11_clear": spectral.bit_is_clear("QA60", 11)}))


@query("hash_ids", "H18 J1", with_views("foot") + """
    SELECT shot_number, sha256(concat('42|', shot_number)) AS sampling_hash FROM foot""")
def hash_ids(spark, sf):
    return view(spark, sf, "foot").select("shot_number", text.hash_key(42, "shot_number").alias("sampling_hash"))


@query("tolerance_match", "H21", with_views("foot") + """
    SELECT year, count(*) FILTER (WHERE abs(lon - (lon + (o_orderkey % 5) * 5e-10)) <= 1e-9) AS close_n,
           count(*) AS n FROM foot GROUP BY year""")
def tolerance_match(spark, sf):
    f = view(spark, sf, "foot").withColumn("lon2", F.col("lon") + (F.col("o_orderkey") % 5) * 5e-10)
    return f.groupBy("year").agg(F.count_if(close_to("lon", "lon2", 1e-9)).alias("close_n"),
                                 F.count(F.lit(1)).alias("n"))


@query("token_normalise", "H22", """
    SELECT lower(trim(concat('  ', c_mktsegment, ' '))) AS token, count(*) AS n FROM customer GROUP BY 1""")
def token_normalise(spark, sf):
    t = text.token(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")))
    return table(spark, sf, "customer").groupBy(t.alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query("vector_normalise", "H13", """
    SELECT vec_id, i, round(embedding[i]::DOUBLE * 3 / n, 6) AS value FROM (SELECT *, unnest(range(1, 65)) AS i
    FROM (SELECT *, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * 3 AS n FROM embeddings))""")
def vector_normalise(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    v = table(spark, sf, "embeddings").select("vec_id", l2_normalise(scaled).alias("v"))
    return v.select("vec_id", F.posexplode("v").alias("p", "x")).select(
        "vec_id", (F.col("p") + 1).cast("bigint").alias("i"), rounded("x", 6, "value"))


# --- the identical-row sample over three keyed feature tables -----------------

def _feature_formulas(names, start):
    """name -> (multiplier, modulus) of the stand-in feature arithmetic."""
    return {n: (2 * i + 3, 1009 + i) for i, n in enumerate(names, start)}


_CONV = _feature_formulas(C_BAND + OPTICAL + INDICES + DEM, 0)
_EMB = _feature_formulas(EMBEDDING, 40)


def _conv_sql(name, mult, mod):
    value = f"((o_orderkey * {mult}) % {mod}) / {mod}e0"
    if name == "B5":
        return f"CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE {value} END AS {name}"
    if name == "elevation":
        return f"CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE {value} END AS {name}"
    return f"{value} AS {name}"


_CONV_TEXT = ("SELECT shot_number, year, agbd, block AS spatial_block_id, fold AS spatial_fold, o_orderkey, "
              + ", ".join(_conv_sql(n, *v) for n, v in _CONV.items()) + " FROM {foot}")
_EMB_TEXT = ("SELECT shot_number, year, "
             + ", ".join(f"((o_orderkey * {a}) % {m}) / {m}e0 - 5e-1 AS {n}" for n, (a, m) in _EMB.items())
             + " FROM {foot} WHERE priority <> '2-HIGH'")


def common_inputs(spark, sf):
    """(conventional, embedding, radar) feature tables keyed by shot and year."""
    foot = view(spark, sf, "foot")
    conv = spark.sql(_CONV_TEXT, foot=foot).drop("o_orderkey")
    emb = spark.sql(_EMB_TEXT, foot=foot)
    rad = radar.with_radar_features(view(spark, sf, "radar").where("year < 2001").drop("o_orderkey", "priority"))
    return conv, emb, rad.withColumn("palsar_valid", radar.radar_valid())


CARRY = ["agbd", "spatial_block_id", "spatial_fold"]

_WIDE = f"""
    conv AS ({_CONV_TEXT.replace('{foot}', 'foot')}), emb AS ({_EMB_TEXT.replace('{foot}', 'foot')}),
    rad AS (SELECT shot_number, year, CASE WHEN HH > 0 THEN 20 * log10(HH) - 83 END AS palsar_hh_db,
        CASE WHEN HV > 0 THEN 20 * log10(HV) - 83 END AS palsar_hv_db,
        CASE WHEN HH > 0 AND HV > 0 THEN 20 * log10(HH) - 20 * log10(HV) END AS palsar_hh_minus_hv_db,
        CASE WHEN HH > 0 AND HV > 0 THEN (HH * HH - HV * HV) / (HH * HH + HV * HV) END AS palsar_rfdi,
        palsar_qa FROM radar WHERE year < 2001),
    wide AS (SELECT conv.*, emb.* EXCLUDE (shot_number, year), rad.* EXCLUDE (shot_number, year),
        coalesce(palsar_qa IN (1, 255) AND palsar_hh_db BETWEEN -60 AND 20 AND palsar_hv_db BETWEEN -60 AND 20
                 AND palsar_rfdi BETWEEN -1 AND 1, false) AS ok
        FROM conv LEFT JOIN emb ON conv.shot_number = emb.shot_number AND conv.year = emb.year
        LEFT JOIN rad ON conv.shot_number = rad.shot_number AND conv.year = rad.year)"""
_ALL_VALID = "ok AND B5 IS NOT NULL AND elevation IS NOT NULL AND A00 IS NOT NULL"


@query("common_sample", "C1 C3 B13", with_views("foot", "radar", more=_WIDE) + f"""
    SELECT shot_number, year, agbd, spatial_block_id, spatial_fold,
           {', '.join(f'{c} AS "{c}"' for c in C_BAND + OPTICAL + INDICES + DEM + EMBEDDING)},
           {', '.join(f'round({c}, 6) AS "{c}"' for c in L_BAND)}
    FROM wide WHERE {_ALL_VALID}""")
def common_sample(spark, sf):
    wide = samples.common_sample(*common_inputs(spark, sf), carry=CARRY)
    return select_rounded(samples.keep_common(wide), ["shot_number", "year", *CARRY, *C_BAND, *OPTICAL,
                                                      *INDICES, *DEM, *EMBEDDING], L_BAND)


@query("exclusion_counts", "D17", with_views("foot", "radar", more=_WIDE) + """
    SELECT count(*) FILTER (WHERE year = 2001) AS not_in_palsar_common_years,
           count(*) FILTER (WHERE NOT ok) AS invalid_or_missing_palsar,
           CAST(0 AS BIGINT) AS missing_s1, count(*) FILTER (WHERE B5 IS NULL) AS missing_s2,
           count(*) FILTER (WHERE elevation IS NULL) AS missing_dem,
           count(*) FILTER (WHERE A00 IS NULL) AS missing_embedding FROM wide""")
def common_exclusions(spark, sf):
    conv, emb, rad = common_inputs(spark, sf)
    wide = samples.common_sample(conv, emb, rad, carry=CARRY)
    return exclusion_counts(wide, samples.exclusion_reasons(rad))


@query("representation_rows", "B16 C17 K4 K5", with_views("foot", "radar", more=_WIDE) + " UNION ALL ".join(
    f"SELECT '{n}' AS representation, CAST({len(f)} AS INT) AS feature_n, count(*) AS n, round(sum({' + '.join(f)}), 4) AS content, CAST(0 AS BIGINT) AS differing_rows "
    f"FROM wide WHERE {_ALL_VALID}" for n, f in REPRESENTATIONS.items()))
def representation_rows(spark, sf):
    """All eight guarded projections of one common table."""
    common = materialize(samples.keep_common(samples.common_sample(*common_inputs(spark, sf), carry=CARRY)))
    frames = samples.representation_frames(common, CARRY)
    first = frames["dem"].select(*KEYS, *CARRY)
    out = None
    for name, frame in frames.items():
        f = REPRESENTATIONS[name]
        content = functools.reduce(lambda a, b: a + b, [F.col(c) for c in f])
        diff = compare_tables(first, frame.select(*KEYS, *CARRY), KEYS, CARRY)
        bad = diff.select(sum(F.col(c) for c in diff.columns if c.endswith("_mismatch_n") or c.endswith("only_n"))).scalar()
        row = frame.agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(content), 4, "content")).select(
            F.lit(name).alias("representation"), F.lit(len(f)).cast("int").alias("feature_n"), "n", "content",
            bad.cast("bigint").alias("differing_rows"))
        out = row if out is None else out.unionByName(row)
    return out
