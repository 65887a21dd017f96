"""Key joins, set operations and comparison joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotransfer.operators import joins
from geotransfer.operators.guards import duplicate_keys, require_rows
from geotransfer.queries.registry import query, rounded, select_rounded, table, view, with_views

KEY = ["shot_number", "year"]


def _parts(spark, sf):
    foot = view(spark, sf, "foot")
    return {"dem": foot.where("status <> 'P'").select(*KEY, F.col("f1").alias("elevation")),
            "embedding": foot.where("priority <> '5-LOW'").select(*KEY, F.col("f2").alias("a00")),
            "conventional": foot.where("agbd > 25").select(*KEY, (F.col("f1") + F.col("f2")).alias("vv"))}


@query("validated_join", "C1", with_views("foot") + """
    SELECT a.shot_number, a.year, round(agbd, 6) AS agbd, round(CASE WHEN status <> 'P' THEN f1 END, 6) AS elevation
    FROM foot a""")
def validated_join(spark, sf):
    base = view(spark, sf, "foot").select(*KEY, "agbd")
    j = joins.validated_join(base, _parts(spark, sf)["dem"], KEY)
    return j.select(*KEY, rounded("agbd"), rounded("elevation"))


@query("complete_join", "C2", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def complete_join(spark, sf):
    """Every order finds its customer; a missing one stops the job."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    j = joins.validated_join(o, c, ["o_custkey"], validate="many_to_one")
    return require_rows(j, F.col("c_mktsegment").isNotNull(), "order without customer").select(
        "o_orderkey", "o_custkey", "c_mktsegment")


@query("complete_one_to_one", "C2", "SELECT d.doc_id, lang, quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def complete_one_to_one(spark, sf):
    l_ = table(spark, sf, "labels").select("doc_id", "quality")
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return joins.complete_join(l_, d, ["doc_id"], ["lang"]).select("doc_id", "lang", "quality")


@query("common_intersection", "C3 G3", with_views("foot") + """
    SELECT shot_number, year, round(f1, 6) AS elevation, round(f2, 6) AS a00, round(f1 + f2, 6) AS vv FROM foot
    WHERE status <> 'P' AND priority <> '5-LOW' AND agbd > 25""")
def common_intersection(spark, sf):
    j = joins.common_rows(view(spark, sf, "foot").select(*KEY), _parts(spark, sf), KEY)
    return select_rounded(j, KEY, ["elevation", "a00", "vv"])


@query("stage_survivors", "C3", with_views("foot", more="""
    s AS (SELECT count(*) AS a, count(*) FILTER (WHERE status <> 'P') AS b,
          count(*) FILTER (WHERE status <> 'P' AND priority <> '5-LOW') AS c,
          count(*) FILTER (WHERE status <> 'P' AND priority <> '5-LOW' AND agbd > 25) AS d FROM foot)""") + """
    SELECT 'initial' AS stage, a AS n, a - a AS removed_from_initial FROM s UNION ALL SELECT 'dem', b, a - b FROM s
    UNION ALL SELECT 'embedding', c, a - c FROM s UNION ALL SELECT 'conventional', d, a - d FROM s""")
def stage_survivors(spark, sf):
    return joins.stage_survivors(view(spark, sf, "foot"), _parts(spark, sf), KEY)


@query("semi_join_ids", "C4", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_ids(spark, sf):
    ids = table(spark, sf, "labels").where("quality = 1")
    return joins.keep_ids(table(spark, sf, "documents"), ids, ["doc_id"]).select("doc_id", "lang", "n_chars")


@query("masked_rows", "C5", with_views("foot") + """
    SELECT shot_number, year, 'DEM_MASKED' AS missing_reason FROM foot WHERE status = 'P'""")
def masked_rows(spark, sf):
    return joins.lost_rows(view(spark, sf, "foot").select(*KEY), _parts(spark, sf)["dem"], KEY, "DEM_MASKED")


@query("subset_violations", "C6 G2", """
    SELECT count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS documents_without_label,
           (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS labels_without_document
    FROM documents""")
def subset_violations(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    l_ = table(spark, sf, "labels").select("doc_id")
    joins.require_subset(l_, d, ["doc_id"], "label without document")
    a = d.join(l_, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("documents_without_label"))
    return a.withColumn("labels_without_document", l_.join(d, "doc_id", "left_anti").agg(F.count(F.lit(1))).scalar())


@query("outer_compare", "C7 H21", with_views("foot") + """
    SELECT domain AS "domain", count(*) FILTER (WHERE status <> 'P') AS left_n, count(*) FILTER (WHERE agbd > 50) AS right_n,
           count(*) FILTER (WHERE status <> 'P' AND agbd > 50) AS common_n,
           count(*) FILTER (WHERE status <> 'P' AND agbd <= 50) AS left_only_n,
           count(*) FILTER (WHERE status = 'P' AND agbd > 50) AS right_only_n,
           count(*) FILTER (WHERE status <> 'P' AND agbd > 50 AND priority = '5-LOW') AS block_mismatch_n,
           count(*) FILTER (WHERE status <> 'P' AND agbd > 50 AND priority = '2-HIGH') AS lon_mismatch_n
    FROM foot WHERE status <> 'P' OR agbd > 50 GROUP BY domain""")
def outer_compare(spark, sf):
    foot = view(spark, sf, "foot").select("domain", "shot_number", "block", "lon", "status", "agbd", "priority")
    a = foot.where("status <> 'P'")
    b = foot.where("agbd > 50").withColumns({
        "block": F.when(F.col("priority") == "5-LOW", F.lit("moved")).otherwise(F.col("block")),
        "lon": F.col("lon") + F.when(F.col("priority") == "2-HIGH", 1e-3).otherwise(F.lit(1e-12))})
    return joins.compare_tables(a, b, ["domain", "shot_number"], ["block", "lon"], {"lon": 1e-9}, by=["domain"])


@query("duplicate_key_count", "A13 C1", """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_key_count(spark, sf):
    return duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("key_set_equality", "G2 G4", with_views("foot", "radar") + """
    SELECT (SELECT count(*) FROM (SELECT shot_number FROM foot EXCEPT SELECT shot_number FROM radar WHERE palsar_qa <> 42)) AS only_left,
           (SELECT count(*) FROM (SELECT shot_number FROM radar WHERE palsar_qa <> 42 EXCEPT SELECT shot_number FROM foot)) AS only_right""")
def key_set_equality(spark, sf):
    a = view(spark, sf, "foot").select("shot_number")
    b = view(spark, sf, "radar").where("palsar_qa <> 42").select("shot_number")
    one = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left"))
    return one.withColumn("only_right", b.exceptAll(a).agg(F.count(F.lit(1))).scalar())


@query("key_intersection", "G3", """
    SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier
    INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey < 3""")
def key_intersection(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    n = table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("nation"))
    return c.intersect(s).intersect(n)


@query("dimension_join", "C9", """
    SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def dimension_join(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    geo = (table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
           .select(F.col("n_nationkey").alias("c_nationkey"), "r_name"))
    return (o.join(c, "o_custkey").join(geo, "c_nationkey").groupBy("r_name", "year")
            .agg(F.count(F.lit(1)).alias("n")))
