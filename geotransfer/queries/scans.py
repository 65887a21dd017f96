"""Sources, sinks and chunk checks."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from geotransfer.functions.numeric import finite
from geotransfer.operators import composite, sampling
from geotransfer.operators.joins import compare_tables
from geotransfer.operators.spatial import within_polygon
from geotransfer.queries.registry import (query, rounded, scratch, table, view, with_views)
from geotransfer.sources import chunks, readers, writers
from geotransfer.streaming import ingest as stream

_POINTS = T.StructType([T.StructField("shot_number", T.StringType()),
                        T.StructField("year", T.IntegerType()),
                        T.StructField("agbd", T.DoubleType())])


@query("csv_string_keys", "A1", with_views("foot") + "SELECT shot_number, year, agbd FROM foot")
def csv_string_keys(spark, sf):
    path = scratch(spark, "csv")
    view(spark, sf, "foot").select(*_POINTS.names).write.option("header", True).csv(path)
    return readers.read_delimited(spark, path, _POINTS)


@query("csv_by_header", "A1 A13", with_views("foot") + "SELECT shot_number, year, agbd FROM foot")
def csv_by_header(spark, sf):
    """Columns in another order than declared, and one more: values go by the names in the header."""
    path = scratch(spark, "csv")
    view(spark, sf, "foot").select("agbd", "status", "year", "shot_number").write.option("header", True).csv(path)
    return readers.read_delimited(spark, path, _POINTS)


@query("chunk_folder_scan", "A2", with_views("foot") + """
    SELECT year, count(*) AS n, count(DISTINCT shot_number) AS ids, true AS has_file
    FROM foot GROUP BY year""")
def chunk_folder_scan(spark, sf):
    path = scratch(spark, "chunks")
    (view(spark, sf, "foot").select(*_POINTS.names).repartition(6, "year")
     .write.option("header", True).csv(path))
    df = readers.read_chunks(spark, path, _POINTS)
    return df.groupBy("year").agg(F.count(F.lit(1)).alias("n"),
                                  F.count_distinct("shot_number").alias("ids"),
                                  F.min(F.col("chunk_file").endswith(".csv")).alias("has_file"))


@query("pruned_parquet_scan", "A3 B18", """
    SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'
    GROUP BY l_returnflag""")
def pruned_parquet_scan(spark, sf):
    df = readers.read_columns(spark, f"{sf}/lineitem.parquet",
                              ["l_returnflag", "l_quantity", "l_shipdate"])
    keep = df.where((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp"))
                    & (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")))
    return keep.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"),
                                            rounded(F.sum("l_quantity"), 2, "qty"))


@query("json_manifest_round_trip", "A5 A18", with_views("foot") + """
    SELECT domain AS "domain", year, count(*) AS n FROM foot GROUP BY domain, year""")
def json_manifest_round_trip(spark, sf):
    path = scratch(spark, "manifest")
    rows = view(spark, sf, "foot").groupBy("domain", "year").agg(F.count(F.lit(1)).alias("n"))
    writers.write_manifest(rows, path)
    return readers.read_manifest(spark, path, lines=True).select("domain", F.col("year").cast("int").alias("year"), "n")


@query("geojson_area_points", "A6 B5", with_views("foot", more="""
    box AS (SELECT min(lon) + (max(lon) - min(lon)) / 8e0 AS x0, max(lon) - (max(lon) - min(lon)) / 8e0 AS x1,
                   min(lat) + (max(lat) - min(lat)) / 8e0 AS y0, max(lat) - (max(lat) - min(lat)) / 8e0 AS y1 FROM foot)""") + """
    SELECT year, count(*) AS n FROM foot, box
    WHERE lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY year""")
def geojson_area_points(spark, sf):
    path = scratch(spark, "aoi")
    foot = view(spark, sf, "foot")
    w, h = F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat")
    corner = foot.agg((F.min("lon") + w / 8).alias("x0"), (F.max("lon") - w / 8).alias("x1"),
                      (F.min("lat") + h / 8).alias("y0"), (F.max("lat") - h / 8).alias("y1"))
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in
                     (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    doc = corner.select(F.lit("Feature").alias("type"),
                        F.struct(F.lit("Polygon").alias("type"),
                                 F.array(ring).alias("coordinates")).alias("geometry"))
    doc.write.json(path)
    rings = readers.read_geojson(spark, path)
    return (within_polygon(foot, rings).groupBy("year").agg(F.count(F.lit(1)).alias("n")))


@query("tile_pruned_scan", "A7", with_views("foot") + """
    SELECT shot_number, CAST(o_orderkey % 4 + 1 AS INT) AS month,
           concat('t', CAST(CAST(floor(lon) AS INT) AS VARCHAR)) AS tile FROM foot
    WHERE year = 1997 AND o_orderkey % 4 + 1 IN (1, 2) AND floor(lon) IN (-86, -85)""")
def tile_pruned_scan(spark, sf):
    path = scratch(spark, "tiles")
    tiled = view(spark, sf, "foot").select(
        "shot_number", "year", (F.col("o_orderkey") % 4 + 1).cast("int").alias("month"),
        F.concat(F.lit("t"), F.floor("lon").cast("string")).alias("tile"))
    writers.write_partitioned(tiled, path, ["year", "month", "tile"], ["shot_number"])
    got = readers.read_tiles(spark, path, 1997, [1, 2], ["t-86", "t-85"])
    return got.select("shot_number", "month", "tile")


@query("granule_union", "A8 G1", with_views("foot") + """
    SELECT domain AS "domain", count(*) AS n, count(DISTINCT year) AS years FROM foot GROUP BY domain""")
def granule_union(spark, sf):
    path = scratch(spark, "granules")
    foot = view(spark, sf, "foot").select("shot_number", "year", "domain")
    foot.where("domain = 'source'").write.parquet(f"{path}/a")
    foot.where("domain = 'target'").write.parquet(f"{path}/b")
    return (readers.read_granules(spark, [f"{path}/a", f"{path}/b"]).groupBy("domain")
            .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("year").alias("years")))


@query("scenes_per_year", "A9", """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_orderpriority) AS image_count
    FROM orders GROUP BY 1""")
def scenes_per_year(spark, sf):
    scenes = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority")
    return composite.scenes_per_year(scenes, "year", "o_orderpriority")


@query("latest_valid_mosaic", "A10", with_views("obs") + """
    SELECT user_id, arg_max(event_type, {'ts': ts, 'v': event_type}) FILTER (event_type IS NOT NULL) AS event_type,
           arg_max(value, {'ts': ts, 'v': value}) FILTER (value IS NOT NULL) AS value
    FROM obs WHERE event_type IS NOT NULL OR value IS NOT NULL GROUP BY user_id""")
def latest_valid_mosaic(spark, sf):
    return composite.mosaic(view(spark, sf, "obs"), ["user_id"], ["event_type", "value"], "ts")


@query("chunk_assignment", "A11 E5 F1", with_views("foot") + """
    SELECT shot_number, year, CAST(floor((row_number() OVER (PARTITION BY year
           ORDER BY shot_number) - 1) / 500) AS INTEGER) AS chunk FROM foot""")
def chunk_assignment(spark, sf):
    foot = view(spark, sf, "foot").select("shot_number", "year")
    return sampling.chunk_numbers(foot, "year", ["shot_number"], 500)


_DELIVERED = """
    base AS (SELECT o_orderkey, CAST(o_orderkey % 7 AS INT) AS chunk, year, f1, f2, status, agbd FROM foot),
    delivered AS (
        SELECT o_orderkey, chunk, year, CASE WHEN chunk = 1 AND agbd > 490 THEN NULL ELSE f1 END AS f1,
               f2, CASE WHEN chunk = 0 AND status = 'F' THEN NULL ELSE agbd END AS agbd
        FROM base WHERE NOT (chunk IN (2, 5) AND agbd < 20)
        UNION ALL SELECT o_orderkey, chunk, year + CAST(o_orderkey % 2 AS INT), f1, f2, agbd FROM base WHERE chunk = 3 AND status = 'P'
        UNION ALL SELECT -1 - o_orderkey, chunk, year, f1, f2, agbd FROM base WHERE chunk = 4 AND status = 'P')"""


def _delivered(spark, sf):
    """Expected rows, and a delivery with masked, repeated, foreign and missing values."""
    base = view(spark, sf, "foot").select("o_orderkey", (F.col("o_orderkey") % 7).cast("int").alias("chunk"),
                                          "year", "f1", "f2", "status", "agbd")
    main = base.where("NOT (chunk IN (2, 5) AND agbd < 20)").withColumns({
        "f1": F.expr("CASE WHEN chunk = 1 AND agbd > 490 THEN NULL ELSE f1 END"),
        "agbd": F.expr("CASE WHEN chunk = 0 AND status = 'F' THEN NULL ELSE agbd END")})
    again = base.where("chunk = 3 AND status = 'P'").withColumn("year", F.col("year") + (F.col("o_orderkey") % 2).cast("int"))
    foreign = base.where("chunk = 4 AND status = 'P'").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return base, main.unionByName(again).unionByName(foreign)


@query("chunk_audit", "A13", with_views("foot", more=_DELIVERED) + """
    , got AS (SELECT chunk, o_orderkey, count(*) AS n, count(*) FILTER (WHERE f1 IS NULL) AS bad,
              count(*) FILTER (WHERE f1 = 0 AND f2 = 0) AS zero, count(*) FILTER (WHERE agbd IS NULL) AS absent,
              min(year) AS y0, max(year) AS y1
              FROM delivered GROUP BY ALL),
    j AS (SELECT coalesce(b.chunk, g.chunk) AS chunk, b.o_orderkey AS want, b.year AS ey, g.* EXCLUDE (chunk)
          FROM base b FULL JOIN got g ON b.chunk = g.chunk AND b.o_orderkey = g.o_orderkey),
    a AS (SELECT chunk, count(want) AS expected_n, CAST(coalesce(sum(n), 0) AS BIGINT) AS observed_n,
           count(*) FILTER (WHERE n > 1) AS repeated_keys, count(*) FILTER (WHERE want IS NULL) AS foreign_keys,
           count(*) FILTER (WHERE n IS NULL) AS missing_keys,
           count(*) FILTER (WHERE want IS NOT NULL AND n IS NOT NULL AND (y0 <> ey OR y1 <> ey)) AS wrong_year,
           CAST(coalesce(sum(bad), 0) AS BIGINT) AS non_finite_rows,
           CAST(coalesce(sum(zero), 0) AS BIGINT) AS all_zero_rows,
           CAST(coalesce(sum(absent), 0) AS BIGINT) AS missing_value_rows FROM j GROUP BY chunk)
    SELECT *, CASE WHEN repeated_keys + foreign_keys + wrong_year + non_finite_rows + all_zero_rows + missing_value_rows > 0
                   THEN 'FAIL' WHEN missing_keys > 0 THEN 'SUBSET' ELSE 'PASS' END AS status FROM a""")
def chunk_audit(spark, sf):
    base, got = _delivered(spark, sf)
    return chunks.chunk_audit(got, base, "o_orderkey", "chunk", "year", ["f1", "f2"], ["agbd"])


@query("candidate_choice", "A14", with_views("foot", more="""
    base AS (SELECT o_orderkey, CAST(o_orderkey % 5 AS INT) AS chunk, status, agbd FROM foot),
    files AS (SELECT o_orderkey, chunk, 'full' AS file FROM base WHERE chunk <> 2 OR status <> 'P'
        UNION ALL SELECT o_orderkey, chunk, 'part' FROM base WHERE agbd > 100
        UNION ALL SELECT CASE WHEN status = 'P' THEN -o_orderkey - 1 ELSE o_orderkey END, chunk, 'alien' FROM base),
    s AS (SELECT f.chunk, f.file, count(*) AS row_n, count(b.o_orderkey) AS hit_n,
                 count(*) FILTER (WHERE b.o_orderkey IS NULL) AS foreign_n
          FROM files f LEFT JOIN base b ON f.chunk = b.chunk AND f.o_orderkey = b.o_orderkey GROUP BY ALL),
    e AS (SELECT s.*, n AS expected_n, (foreign_n = 0 AND hit_n = n AND row_n = n) AS exact
          FROM s JOIN (SELECT chunk, count(*) AS n FROM base GROUP BY chunk) c USING (chunk) WHERE foreign_n = 0)""") + """
    SELECT chunk, accepted_file, hit_n, expected_n, exact_n FROM (
      SELECT chunk, file AS accepted_file, hit_n, expected_n,
             count(*) FILTER (WHERE exact) OVER (PARTITION BY chunk) AS exact_n,
             row_number() OVER (PARTITION BY chunk ORDER BY exact DESC, hit_n DESC, file) AS k FROM e) WHERE k = 1""")
def candidate_choice(spark, sf):
    base = view(spark, sf, "foot").select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("chunk"),
                                          "status", "agbd")
    full = base.where("chunk <> 2 OR status <> 'P'").withColumn("file", F.lit("full"))
    part = base.where("agbd > 100").withColumn("file", F.lit("part"))
    alien = (base.withColumn("o_orderkey", F.expr("CASE WHEN status = 'P' THEN -o_orderkey - 1 ELSE o_orderkey END"))
             .withColumn("file", F.lit("alien")))
    rows = full.unionByName(part).unionByName(alien)
    choice = chunks.choose_candidates(rows, base, "o_orderkey", "chunk", "file")
    return chunks.require_one_exact(choice, "chunk")


@query("unexpected_files", "A15 G4", """
    SELECT DISTINCT concat(p_brand, '_', p_size, '.csv') AS name FROM part
    WHERE concat(p_brand, '_', p_size, '.csv') NOT IN (SELECT concat(p_brand, '_', p_size, '.csv') FROM part WHERE p_size <= 40)""")
def unexpected_files(spark, sf):
    part = table(spark, sf, "part").withColumn("name", F.concat("p_brand", F.lit("_"), "p_size", F.lit(".csv")))
    return chunks.unexpected_files(part.select("name").distinct(), part.where("p_size <= 40").select("name"))


@query("twin_sink", "A16", with_views("foot") + """
    SELECT count(*) AS left_n, count(*) AS right_n, count(*) AS common_n, CAST(0 AS BIGINT) AS left_only_n,
           CAST(0 AS BIGINT) AS right_only_n, CAST(0 AS BIGINT) AS year_mismatch_n,
           CAST(0 AS BIGINT) AS agbd_mismatch_n FROM foot""")
def twin_sink(spark, sf):
    path = scratch(spark, "twins")
    writers.write_twins(view(spark, sf, "foot").select(*_POINTS.names), path)
    a = readers.read_table(spark, f"{path}.parquet")
    b = readers.read_table(spark, f"{path}.csv", _POINTS)
    return compare_tables(a, b, ["shot_number"], ["year", "agbd"])


@query("manifest_upsert", "A18 G5", with_views("obs") + """
    SELECT user_id, event_type, event_id, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS k FROM obs) WHERE k = 1""")
def manifest_upsert(spark, sf):
    obs = view(spark, sf, "obs").select("user_id", "event_type", "event_id", "value", "ts")
    half = F.lit("2024-01-15").cast("timestamp")
    old, new = obs.where(F.col("ts") < half), obs.where(F.col("ts") >= half)
    return writers.upsert_manifest(old, new, ["user_id", "event_type"], "ts").drop("ts")


@query("public_extract", "A19 H18", with_views("foot") + """
    SELECT sha256(block) AS block_hash, year, count(*) AS n FROM foot GROUP BY ALL""")
def public_extract(spark, sf):
    foot = view(spark, sf, "foot").select("shot_number", "lon", "lat", "block", "year")
    pub = writers.public_extract(foot, ["shot_number", "lon", "lat"], ["block"])
    return pub.groupBy("block_hash", "year").agg(F.count(F.lit(1)).alias("n"))


@query("file_checksums", "A20 K15")
def file_checksums(spark, sf):
    """Root checksum of every table of the folder, from checksums of byte ranges."""
    return readers.table_checksums(spark, sf, "*.parquet")


@query("ingest_restart", "A12 ST1 ST2 ST3 K3", with_views("obs") + """
    SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, CAST((SELECT count(*) FROM obs) AS BIGINT)
           AS ledger_rows, (SELECT count(*) FROM obs WHERE ts >= TIMESTAMP '2024-01-14'
                            AND ts < TIMESTAMP '2024-01-16') AS rejected
    FROM obs GROUP BY event_type""")
def ingest_restart(spark, sf):
    """Two deliveries that overlap by two days; the job runs three times."""
    out = scratch(spark, "ingest")
    obs = table(spark, sf, "events")
    obs.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp")).write.parquet(f"{out}/in/a")
    args = dict(schema=obs.schema, out=f"{out}/out", keys=["event_id"], partition="event_type",
                options={"recursiveFileLookup": "true"})
    stream.ingest(spark, f"{out}/in", **args)
    obs.where(F.col("ts") >= F.lit("2024-01-14").cast("timestamp")).write.parquet(f"{out}/in/b")
    stream.ingest(spark, f"{out}/in", **args)
    stream.ingest(spark, f"{out}/in", **args)
    got = stream.read_ingested(spark, f"{out}/out")
    ledger = stream.read_ingested(spark, f"{out}/out", "ledger").agg(F.sum("rows")).scalar()
    rejected = stream.read_ingested(spark, f"{out}/out", "rejects").agg(F.sum("copies")).scalar()
    return (got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                          F.count_distinct("event_id").alias("ids"))
            .withColumns({"ledger_rows": ledger, "rejected": rejected}))


@query("finite_rows_per_chunk", "B13", with_views("foot", more=_DELIVERED) + """
    SELECT chunk, count(*) AS n FROM delivered WHERE f1 IS NOT NULL AND f2 IS NOT NULL GROUP BY chunk""")
def finite_rows_per_chunk(spark, sf):
    _, got = _delivered(spark, sf)
    return (got.where(finite("f1") & finite("f2")).groupBy("chunk")
            .agg(F.count(F.lit(1)).alias("n")))
