"""Projections, blocks, polygons, pixels, terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotransfer.functions import geo
from geotransfer.operators import spatial
from geotransfer.plans.samples import with_source_blocks
from geotransfer.session import materialize
from geotransfer.queries.registry import (query, rounded, select_rounded, table, view, with_views)
from geotransfer.queries.sqltext import albers_sql, utm_sql

_AX, _AY = albers_sql("lon", "lat")
_UE, _UN = utm_sql("tlon", "tlat")


@query("albers_blocks", "H10 H11", with_views("foot", more=f"p AS (SELECT shot_number, {_AX} AS x, {_AY} AS y FROM foot)") + """
    SELECT shot_number, round(x, 3) AS x, round(y, 3) AS y,
           concat('EPSG5070_50KM_', CAST(CAST(floor(x / 50000) AS BIGINT) AS VARCHAR), '_',
                  CAST(CAST(floor(y / 50000) AS BIGINT) AS VARCHAR)) AS spatial_block_id FROM p""")
def albers_blocks(spark, sf):
    x, y = geo.albers("lon", "lat")
    df = with_source_blocks(view(spark, sf, "foot"))
    return df.select("shot_number", rounded(x, 3, "x"), rounded(y, 3, "y"), "spatial_block_id")


_UTM = f"""p AS (SELECT shot_number, {_UE} AS e, {_UN} AS n FROM foot),
    b AS (SELECT CAST(floor(e / 5000) AS BIGINT) AS ie, CAST(floor(n / 5000) AS BIGINT) AS ino, count(*) AS sample_n
          FROM p GROUP BY ALL)"""


@query("utm_block_table", "H12 H10 H19", with_views("foot", more=_UTM) + """
    SELECT concat('E', CAST(ie AS VARCHAR), '_N', CAST(ino AS VARCHAR)) AS target_block_id, sample_n,
           concat('POLYGON ((', ie * 5000, ' ', ino * 5000, ', ', ie * 5000 + 5000, ' ', ino * 5000, ', ',
                  ie * 5000 + 5000, ' ', ino * 5000 + 5000, ', ', ie * 5000, ' ', ino * 5000 + 5000, ', ',
                  ie * 5000, ' ', ino * 5000, '))') AS geometry_wkt FROM b""")
def utm_block_table(spark, sf):
    e, n = geo.utm_north("tlon", "tlat")
    b = (view(spark, sf, "foot").groupBy(geo.grid_index(e, 5000).alias("ie"), geo.grid_index(n, 5000).alias("in"))
         .agg(F.count(F.lit(1)).alias("sample_n")))
    x, y = F.col("ie") * 5000, F.col("in") * 5000
    return b.select(geo.utm_block_id("ie", "in").alias("target_block_id"), "sample_n",
                    geo.box_wkt(x, y, x + 5000, y + 5000).alias("geometry_wkt"))


@query("utm_coordinates", "H12", with_views("foot") + f"""
    SELECT shot_number, round({_UE}, 3) AS easting, round({_UN}, 3) AS northing FROM foot""")
def utm_coordinates(spark, sf):
    e, n = geo.utm_north("tlon", "tlat")
    return view(spark, sf, "foot").select("shot_number", rounded(e, 3, "easting"), rounded(n, 3, "northing"))


# A concave area with a hole and a second, overlapping area.
AREAS = {
    "area_a": [[(-87.5, 30.5), (-82.0, 30.5), (-84.0, 33.0), (-81.0, 35.5), (-87.0, 35.0)],
               [(-86.0, 31.5), (-85.0, 31.5), (-85.0, 32.5), (-86.0, 32.5)]],
    "area_b": [[(-84.0, 31.0), (-80.5, 32.0), (-83.0, 34.0)]],
}


def _edge_sql():
    rows = []
    for pid, rings in AREAS.items():
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                rows.append(f"('{pid}', {x1}e0, {y1}e0, {x2}e0, {y2}e0)")
    return f"edges(poly_id, x1, y1, x2, y2) AS (VALUES {', '.join(rows)})"


@query("points_in_polygon", "B5 B6 C13", with_views("foot", more=_edge_sql()) + """
    SELECT poly_id, shot_number FROM foot, edges GROUP BY poly_id, shot_number, lon, lat
    HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / nullif(y2 - y1, 0)
               THEN 1 ELSE 0 END) % 2 = 1
        OR bool_or((x2 - x1) * (lat - y1) = (y2 - y1) * (lon - x1) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2)
                   AND lat BETWEEN least(y1, y2) AND greatest(y1, y2))""")
def points_in_polygon(spark, sf):
    rings = spatial.polygon_frame(spark, AREAS)
    return spatial.within_polygon(view(spark, sf, "foot"), rings).select("poly_id", "shot_number")


@query("block_hull_area", "B7 H20", with_views("foot", more=f"""
    h AS (SELECT block, min(tlon) AS x0, max(tlon) AS x1, min(tlat) AS y0, max(tlat) AS y1 FROM foot GROUP BY block),
    c AS (SELECT block, i, CASE WHEN i IN (0, 3) THEN x0 ELSE x1 END AS tlon, CASE WHEN i IN (0, 1) THEN y0 ELSE y1 END AS tlat
          FROM h, (VALUES (0), (1), (2), (3)) t(i)),
    q AS (SELECT block, i, {_UE} AS e, {_UN} AS n FROM c)""") + """
    SELECT a.block AS poly_id, round(abs(sum(a.e * b.n - b.e * a.n)) / 2e6, 4) AS area_km2
    FROM q a JOIN q b ON a.block = b.block AND b.i = (a.i + 1) % 4 GROUP BY 1""")
def block_hull_area(spark, sf):
    h = view(spark, sf, "foot").groupBy("block").agg(F.min("tlon").alias("x0"), F.max("tlon").alias("x1"),
                                                     F.min("tlat").alias("y0"), F.max("tlat").alias("y1"))
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in
                     (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    rings = h.select(F.col("block").alias("poly_id"), ring.alias("ring"))
    area = spatial.polygon_area(rings, lambda x, y: geo.utm_north(x, y))
    return area.select("poly_id", rounded(F.col("area") / 1e6, 4, "area_km2"))


def _pixels(spark, sf):
    """One pixel per part: a 40-wide grid."""
    p = table(spark, sf, "part")
    return p.select((F.col("p_partkey") % 40).alias("px"), F.floor(F.col("p_partkey") / 40).alias("py"),
                    F.col("p_retailprice").alias("elevation"), F.col("p_size").cast("double").alias("band1"),
                    ((F.col("p_partkey") * 7) % 101).cast("double").alias("band2"))


_PIX = """pix AS (SELECT p_partkey % 40 AS px, p_partkey // 40 AS py, p_retailprice AS elevation,
    CAST(p_size AS DOUBLE) AS band1, CAST((p_partkey * 7) % 101 AS DOUBLE) AS band2 FROM part)"""
_SHOT = """shot AS (SELECT o_orderkey, (o_custkey % 50) * 30e0 + 7 AS x, 1500e0 - (o_orderkey % 60) * 30e0 - 11 AS y FROM orders),
    loc AS (SELECT o_orderkey, CAST(floor(x / 30) AS BIGINT) AS px, CAST(floor((1500 - y) / 30) AS BIGINT) AS py FROM shot)"""


def _points(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", ((F.col("o_custkey") % 50) * 30.0 + 7).alias("x"),
        (1500.0 - (F.col("o_orderkey") % 60) * 30.0 - 11).alias("y"))
    return spatial.pixel_columns(o, "x", "y", (0.0, 1500.0), 30.0)


@query("point_to_pixel", "C12 B17", f"WITH {_PIX}, {_SHOT}" + """
    SELECT o_orderkey, loc.px, loc.py, elevation, band1, band2 FROM loc JOIN pix ON loc.px = pix.px AND loc.py = pix.py""")
def point_to_pixel(spark, sf):
    return (spatial.point_to_pixel(_points(spark, sf), _pixels(spark, sf), ["px", "py"])
            .select("o_orderkey", "px", "py", "elevation", "band1", "band2"))


_OFFS = spatial.disc_offsets(25.0, 10.0)


@query("neighbourhood_mean", "D30", f"""WITH {_PIX}, {_SHOT},
    off(dx, dy) AS (VALUES {', '.join(f'({i}, {j})' for i, j in _OFFS)}),""" + """
    m AS (SELECT o_orderkey, count(*) AS pixel_n, avg(band1) AS a, avg(band2) AS b
          FROM loc, off, pix WHERE pix.px = loc.px + dx AND pix.py = loc.py + dy GROUP BY o_orderkey)
    SELECT o_orderkey, pixel_n, round(a / nullif(sqrt(a * a + b * b), 0), 6) AS band1,
           round(b / nullif(sqrt(a * a + b * b), 0), 6) AS band2 FROM m""")
def neighbourhood_mean(spark, sf):
    m = spatial.neighbourhood_mean(_points(spark, sf), _pixels(spark, sf), "o_orderkey", ["band1", "band2"], _OFFS)
    return select_rounded(m, ["o_orderkey", "pixel_n"], ["band1", "band2"])


@query("terrain_slope_aspect", "H8", f"WITH {_PIX}, {_SHOT}," + """
    z AS (SELECT o_orderkey, count(*) AS n, max(CASE WHEN dx = 0 AND dy = 0 THEN band2 END) AS elevation,
      (sum(CASE WHEN dx = 1 THEN band2 * (2 - abs(dy)) ELSE 0 END) - sum(CASE WHEN dx = -1 THEN band2 * (2 - abs(dy)) ELSE 0 END)) / 240e0 AS gx,
      (sum(CASE WHEN dy = -1 THEN band2 * (2 - abs(dx)) ELSE 0 END) - sum(CASE WHEN dy = 1 THEN band2 * (2 - abs(dx)) ELSE 0 END)) / 240e0 AS gy
      FROM loc, (SELECT a.i AS dx, b.i AS dy FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(i)), pix
      WHERE pix.px = loc.px + dx AND pix.py = loc.py + dy GROUP BY o_orderkey),
    s AS (SELECT *, degrees(atan2(-gx, -gy)) AS asp FROM z)
    SELECT o_orderkey, elevation, CASE WHEN n = 9 THEN round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) END AS slope,
           CASE WHEN n = 9 THEN round(CASE WHEN asp < 0 THEN asp + 360 ELSE asp END, 6) END AS aspect FROM s""")
def terrain_slope_aspect(spark, sf):
    dem = _pixels(spark, sf).select("px", "py", F.col("band2").alias("elevation"))
    t = spatial.terrain(_points(spark, sf), dem, "o_orderkey", 30.0)
    return select_rounded(t, ["o_orderkey", "elevation"], ["slope", "aspect"])


_AREA_N = 8  # points of a block and year


def _point_sql(axis):
    return f"('0x' || substr(sha256(concat('42|{axis}|', poly_id, '|', year, '|', i)), 1, 13))::BIGINT / 4503599627370496e0"


@query("random_points", "J8 B5 B7", with_views("foot", more=f"""
    box AS (SELECT block AS poly_id, min(tlon) AS x0, max(tlon) AS x1, min(tlat) AS y0, max(tlat) AS y1 FROM foot GROUP BY block),
    s AS (SELECT DISTINCT block AS poly_id, year FROM foot),
    u AS (SELECT poly_id, year, i, {_point_sql('t')} AS t, sqrt({_point_sql('u')}) AS r, {_point_sql('v')} AS w
          FROM s, (SELECT unnest(range({_AREA_N})) AS i)),
    c AS (SELECT u.*, t < 0.5 AS one, x0, x1, y0, y1 FROM u JOIN box ON u.poly_id = box.poly_id)""") + """
    SELECT poly_id, year, CAST(i AS INT) AS point_no,
           round(CASE WHEN one THEN x0 * (1 - r) + x0 * (r * (1 - w)) + x1 * (r * w) ELSE x1 * (1 - r) + x1 * (r * (1 - w)) + x0 * (r * w) END, 9) AS lon,
           round(CASE WHEN one THEN y1 * (1 - r) + y0 * (r * (1 - w)) + y0 * (r * w) ELSE y0 * (1 - r) + y1 * (r * (1 - w)) + y1 * (r * w) END, 9) AS lat
    FROM c""")
def random_points(spark, sf):
    """Eight seeded points of every block and year inside the block's valid outline, all of them kept by the polygon test."""
    foot = view(spark, sf, "foot").withColumn("poly_id", F.col("block"))
    h = foot.groupBy("poly_id").agg(F.min("tlon").alias("x0"), F.max("tlon").alias("x1"), F.min("tlat").alias("y0"), F.max("tlat").alias("y1"))
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    rings = spatial.require_valid_rings(materialize(h.select("poly_id", ring.alias("ring"))))
    points = spatial.area_points(rings, foot.select("poly_id", "year").distinct(), _AREA_N, 42)
    own = points.withColumnRenamed("poly_id", "block")
    inside = spatial.within_polygon(own, rings).where(F.col("poly_id") == F.col("block"))
    return inside.select("poly_id", "year", "point_no", rounded("lon", 9), rounded("lat", 9))
