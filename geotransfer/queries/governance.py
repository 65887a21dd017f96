"""Fingerprints, freeze records, label lock and consistency checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotransfer.operators import govern, guards
from geotransfer.operators.metrics import metrics
from geotransfer.queries.registry import TABLES, hash_sum_sql, query, row_text_sql, rounded, table, view, with_views
from geotransfer.session import materialize
from geotransfer.sources.readers import table_checksums


@query("table_fingerprint", "K1", f"""
    SELECT count(*) AS rows, {hash_sum_sql('h')} AS hash_sum, {hash_sum_sql('h', 1)} AS hash_sum_2 FROM (
      SELECT sha256({row_text_sql('l_orderkey', 'l_linenumber', 'l_partkey', 'l_returnflag', 'mark',
                                  'CAST(l_quantity AS BIGINT)')}) AS h
      FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN l_linestatus END AS mark FROM lineitem))""")
def table_fingerprint(spark, sf):
    """Order-free fingerprint of all line items, with a column that is often missing."""
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag",
        F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).alias("mark"), F.col("l_quantity").cast("bigint").alias("qty"))
    return govern.fingerprint(rows)


@query("ordered_row_hashes", "K2 E5", with_views("foot") + """
    SELECT year, row_no, sha256(""" + row_text_sql("row_no", "shot_number", "block") + """) AS row_hash FROM (
      SELECT year, shot_number, block, row_number() OVER (PARTITION BY year ORDER BY shot_number) AS row_no FROM foot)""")
def ordered_row_hashes(spark, sf):
    return govern.ordered_row_hashes(view(spark, sf, "foot").select("year", "shot_number", "block"),
                                     ["shot_number"], ["shot_number", "block"], ["year"])


def _content(cols):
    return hash_sum_sql(f"sha256({row_text_sql(*cols)})")


@query("freeze_summary", "K9", with_views("foot") + f"""
    SELECT count(*) AS n, count(DISTINCT block) AS block_count, {_content(['shot_number'])} AS sample_ids_hash,
           {_content(['shot_number', 'year'])} AS row_key_hash,
           {_content(['shot_number', 'year', "CAST(o_orderkey AS VARCHAR)"])} AS response_hash,
           '[' || array_to_string(list_sort(list_distinct(list(year))), ',') || ']' AS years,
           (SELECT '{{' || string_agg(concat('"', fold, '":', n), ',' ORDER BY fold) || '}}' FROM (SELECT fold, count(*) AS n FROM foot GROUP BY fold))
           AS fold_counts, false AS private_rows_committed FROM foot""")
def freeze_summary(spark, sf):
    foot = view(spark, sf, "foot").withColumn("response", F.col("o_orderkey"))
    s = govern.freeze_summary(foot, "block", "fold", "response")
    return s.withColumns({"years": F.to_json("years"), "fold_counts": F.to_json("fold_counts")})


@query("freeze_chain", "K10 K8", with_views("foot") + "SELECT 'sample' AS stage, 'target' AS name, false AS recorded_found, true AS observed_found")
def freeze_chain(spark, sf):
    """The source input is unchanged; the target input was never recorded."""
    foot = view(spark, sf, "foot").select("shot_number", "year", "block", "domain")
    source, target = foot.where("domain = 'source'"), foot.where("domain = 'target'")
    recorded = govern.freeze_row(source, "sample", "source")
    now = (govern.freeze_row(source.repartition(5), "sample", "source")
           .unionByName(govern.freeze_row(target, "sample", "target")))
    bad = govern.chain_mismatches(recorded, now)
    return bad.select("stage", "name", F.col("recorded").isNotNull().alias("recorded_found"),
                      F.col("observed").isNotNull().alias("observed_found"))


@query("unlocked_metrics", "K7 K8 C2", with_views("foot") + """
    SELECT year, round(sqrt(avg((prediction - agbd) * (prediction - agbd))), 6) AS "RMSE", count(*) AS "N" FROM foot
    WHERE domain = 'target' GROUP BY year""")
def unlocked_metrics(spark, sf):
    """Freeze the predictions, then join labels through the only door there is."""
    target = view(spark, sf, "foot").where("domain = 'target'")
    predictions = materialize(target.select("shot_number", "year", "prediction"))  # the stored artefact is what is frozen
    freeze = govern.freeze_row(govern.require_label_free(predictions), "zero_shot", "formula")
    joined = govern.unlock(predictions, target.select("shot_number", "year", "agbd"), freeze, "zero_shot", "formula")
    return metrics(joined, by=["year"]).select("year", rounded("RMSE"), "N")


@query("numeric_disagreements", "K13", """
    SELECT l_returnflag, 'qty' AS "column", round(CAST(sum(l_quantity) AS DOUBLE), 2) AS left_value,
           round(CAST(sum(CASE WHEN l_tax > 0.07 AND l_returnflag = 'A' THEN 0 ELSE l_quantity END) AS DOUBLE), 2) AS right_value
    FROM lineitem GROUP BY 1 HAVING sum(l_quantity) <> sum(CASE WHEN l_tax > 0.07 AND l_returnflag = 'A' THEN 0 ELSE l_quantity END)""")
def numeric_disagreements(spark, sf):
    df = table(spark, sf, "lineitem")
    a = df.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
    lost = F.when((F.col("l_tax") > 0.07) & (F.col("l_returnflag") == "A"), 0.0).otherwise(F.col("l_quantity"))
    b = df.groupBy("l_returnflag").agg(F.sum(lost).alias("qty"), F.count(F.lit(1)).alias("n"))
    return govern.numeric_disagreements(a, b, ["l_returnflag"], ["qty", "n"]).select(
        "l_returnflag", "column", rounded("left_value", 2), rounded("right_value", 2))


@query("stage_equality", "K14 C7", with_views("radar", more="""
    st AS (SELECT 'raw' AS stage, o_orderkey, HH, palsar_qa FROM radar
      UNION ALL SELECT 'mosaic', o_orderkey, HH, palsar_qa FROM radar
      UNION ALL SELECT 'sampled', o_orderkey, CASE WHEN palsar_qa = 42 THEN HH + 1 ELSE HH END, palsar_qa FROM radar WHERE palsar_qa <> 0)""") + """
    SELECT s.stage, count(*) AS candidate_n, count(r.o_orderkey) AS common_n, count(*) FILTER (WHERE s.HH <> r.HH) AS "HH_mismatch_n",
           count(*) FILTER (WHERE s.palsar_qa <> r.palsar_qa) AS palsar_qa_mismatch_n, (SELECT count(*) FROM radar) AS raw_n,
           (SELECT count(*) FROM radar) - count(r.o_orderkey) AS raw_only_n, count(*) - count(r.o_orderkey) AS candidate_only_n,
           count(*) FILTER (WHERE s.HH <> r.HH) = 0 AND count(*) FILTER (WHERE s.palsar_qa <> r.palsar_qa) = 0
           AND count(*) = (SELECT count(*) FROM radar) AS identical
    FROM st s LEFT JOIN (SELECT * FROM st WHERE stage = 'raw') r ON s.o_orderkey = r.o_orderkey GROUP BY s.stage""")
def stage_equality(spark, sf):
    r = view(spark, sf, "radar").select("o_orderkey", "HH", "palsar_qa")
    raw = r.withColumn("stage", F.lit("raw"))
    mosaic = r.withColumn("stage", F.lit("mosaic"))
    sampled = r.where("palsar_qa <> 0").withColumns({
        "stage": F.lit("sampled"), "HH": F.expr("CASE WHEN palsar_qa = 42 THEN HH + 1 ELSE HH END")})
    return govern.stage_equality(raw.unionByName(mosaic).unionByName(sampled), "raw", ["o_orderkey"], ["HH", "palsar_qa"])


@query("inventory", "K15 A20")
def inventory(spark, sf):
    """Every table that the queries read, and one that is not delivered, against the tables present with their checksums."""
    names = spark.createDataFrame([(f"{t}.parquet",) for t in (*TABLES, "footprints")], "name string")
    return govern.inventory(names, table_checksums(spark, sf, "*.parquet"))


@query("protected_stage_inputs", "K6", with_views("foot") + """
    SELECT 'source_sampling' AS stage, 'target_raw' AS "table", count(agbd) > 0 AS has_label FROM foot WHERE domain = 'target'
    HAVING count(agbd) > 0""")
def protected_stage_inputs(spark, sf):
    """The tables that enter two stages: labelled target rows may reach evaluation, not sampling."""
    target = view(spark, sf, "foot").where("domain = 'target'")
    blind = target.select("shot_number", "year", "block")
    inputs = guards.stage_inputs("source_sampling", target_raw=target.select("shot_number", "agbd"), target_blind=blind)
    return guards.protected_inputs(inputs.unionByName(guards.stage_inputs("evaluation", target_raw=target.select("agbd"))))
