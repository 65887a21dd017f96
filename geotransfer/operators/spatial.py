"""Point-in-polygon, point-to-pixel and neighbourhood joins; polygon area.

Polygon edges are indexed by horizontal slabs. A point meets only the edges of
its own slab through an equality join, and the even-odd test runs inside the
row, so there is no point-by-edge product and no second shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geotransfer.functions.text import hash_key
from geotransfer.operators.guards import GuardError, duplicate_keys, refuse_rows
from geotransfer.operators.joins import lookup_join
from geotransfer.operators.sampling import uniform_from_hash


def polygon_frame(spark: SparkSession, polygons: dict[str, list[list[tuple[float, float]]]]) -> DataFrame:
    """(poly_id, ring) rows from rings given in code; rings close themselves."""
    rows = [(pid, [[float(x), float(y)] for x, y in ring])
            for pid, rings in polygons.items() for ring in rings]
    return spark.createDataFrame(rows, "poly_id string, ring array<array<double>>")


def invalid_rings(rings: DataFrame) -> DataFrame:
    """Rings with fewer than three distinct corners, off-globe corners or no area."""
    corners = F.size(F.array_distinct("ring"))
    on_globe = F.forall("ring", lambda p: (F.size(p) >= 2) & p[0].between(-180, 180) & p[1].between(-90, 90))
    nxt = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    twice = F.aggregate(F.zip_with("ring", nxt, lambda p, q: p[0] * q[1] - q[0] * p[1]), F.lit(0.0),
                        lambda acc, x: acc + x)
    ok = (corners >= 3) & on_globe & (twice != 0)
    return rings.where(~F.coalesce(ok, F.lit(False)))


def require_valid_rings(rings: DataFrame) -> DataFrame:
    refuse_rows(invalid_rings(rings).select("poly_id"), "invalid polygon ring")
    return rings


def edges(rings: DataFrame) -> DataFrame:
    """One row per directed edge of every ring."""
    nxt = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    zipped = F.explode(F.arrays_zip(F.col("ring").alias("p"), nxt.alias("q"))).alias("e")
    e = rings.select("poly_id", zipped)
    out = e.select("poly_id", F.col("e.p")[0].alias("x1"), F.col("e.p")[1].alias("y1"),
                   F.col("e.q")[0].alias("x2"), F.col("e.q")[1].alias("y2"))
    return out.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def slab_index(rings: DataFrame, slab: float) -> DataFrame:
    """(poly_id, slab, column, edges): edges grouped under every horizontal slab they touch, for each
    column of cells between the leftmost and the rightmost of these edges."""
    e = edges(rings)
    low = F.floor(F.least("y1", "y2") / F.lit(slab))
    high = F.floor(F.greatest("y1", "y2") / F.lit(slab))
    spread = e.withColumn("_slab", F.explode(F.sequence(low, high)))
    rows = spread.groupBy("poly_id", "_slab").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"),
        F.floor(F.min(F.least("x1", "x2")) / F.lit(slab)).alias("_from"),
        F.floor(F.max(F.greatest("x1", "x2")) / F.lit(slab)).alias("_to"))
    return rows.select("poly_id", "_slab", "_edges", F.explode(F.sequence("_from", "_to")).alias("_column"))


def _inside(x: Column, y: Column, edge_list: Column) -> Column:
    """Even-odd rule with points on an edge counted as inside."""
    def crosses(e):
        spans = (e.y1 > y) != (e.y2 > y)
        at = e.x1 + (y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
        return F.when(spans, x < at).otherwise(F.lit(False))

    def touches(e):
        cross = (e.x2 - e.x1) * (y - e.y1) - (e.y2 - e.y1) * (x - e.x1)
        return ((cross == 0) & (x >= F.least(e.x1, e.x2)) & (x <= F.greatest(e.x1, e.x2))
                & (y >= F.least(e.y1, e.y2)) & (y <= F.greatest(e.y1, e.y2)))

    odd = F.size(F.filter(edge_list, crosses)) % 2 == 1
    return odd | F.exists(edge_list, touches)


def within_polygon(points: DataFrame, rings: DataFrame, lon: str = "lon", lat: str = "lat",
                   slab: float = 0.25) -> DataFrame:
    """Points inside each polygon (boundary included), with the polygon id.

    The bounding box goes to the scan first.
    """
    e = edges(rings)
    box = e.agg(F.min("x1"), F.max("x1"), F.min("y1"), F.max("y1")).first()
    if box[0] is None:
        raise GuardError("polygon table is empty")
    x, y = F.col(lon), F.col(lat)
    near = points.where(x.between(box[0], box[1]) & y.between(box[2], box[3]))
    near = near.withColumns({"_slab": F.floor(y / F.lit(slab)), "_column": F.floor(x / F.lit(slab))})
    # A point meets only polygons that reach its cell, not all of its latitude.
    return (lookup_join(near, slab_index(rings, slab), ["_slab", "_column"]).where(_inside(x, y, F.col("_edges")))
            .drop("_slab", "_column", "_edges"))


def polygon_area(rings: DataFrame, project=None) -> DataFrame:
    """Shoelace area per polygon after an optional (x, y) -> (x, y) projection."""
    e = edges(rings)
    if project:
        x1, y1 = project("x1", "y1")
        x2, y2 = project("x2", "y2")
        e = e.select("poly_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    return e.groupBy("poly_id").agg((F.abs(twice) / 2).alias("area"))


def ear_clipped(ring: Sequence[Sequence[float]]) -> list[tuple]:
    """Triangles that tile a simple ring, by cutting off ears in the order of the corners."""
    corners = [tuple(p[:2]) for p in ring]
    corners = [p for k, p in enumerate(corners) if p != corners[k - 1]] if len(corners) > 1 else corners

    def turn(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    if sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(corners, corners[1:] + corners[:1])) < 0:
        corners.reverse()
    out = []
    while len(corners) > 3:
        for k, b in enumerate(corners):
            a, c = corners[k - 1], corners[(k + 1) % len(corners)]
            size = turn(a, b, c)
            others = (p for p in corners if p not in (a, b, c))
            if size == 0 or size > 0 and not any(
                    turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0 for p in others):
                if size:
                    out.append((a, b, c))
                del corners[k]
                break
        else:
            raise GuardError("a ring crosses itself")
    return out + [tuple(corners)] if len(corners) == 3 and turn(*corners) else out


_TRIANGLES = "poly_id string, tiles array<struct<ax:double,ay:double,bx:double,by:double,cx:double,cy:double,upto:double>>"


def triangles(rings: DataFrame) -> DataFrame:
    """``poly_id`` and its ``tiles``: triangles with the area summed up to and with each. A ring is clipped in one task."""
    def task(batches):
        for b in batches:
            tiles = []
            for ring in b.column("ring").to_pylist():
                total, found = 0.0, []
                for (ax, ay), (bx, by), (cx, cy) in ear_clipped(ring):
                    total += abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / 2
                    found.append(dict(ax=ax, ay=ay, bx=bx, by=by, cx=cx, cy=cy, upto=total))
                tiles.append(found)
            kind = pa.list_(pa.struct([(n, pa.float64()) for n in ("ax", "ay", "bx", "by", "cx", "cy", "upto")]))
            yield pa.RecordBatch.from_arrays([b.column("poly_id"), pa.array(tiles, kind)], ["poly_id", "tiles"])

    return rings.select(F.col("poly_id").cast("string").alias("poly_id"), "ring").mapInArrow(task, _TRIANGLES)


def area_points(rings: DataFrame, strata: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` seeded points of every stratum (columns of ``strata``, with ``poly_id``), even over its polygon's area.

    A hash picks a triangle by its share of the area and a place in it, so no point is thrown away
    and a rerun gives the same points. ``point_no`` counts from 0.
    """
    keys = [F.col(c).cast("string") for c in strata.columns]
    each = lookup_join(strata.withColumn("point_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), triangles(rings), ["poly_id"])
    u, v, w = (uniform_from_hash(hash_key(f"{seed}|{axis}", *keys, "point_no")) for axis in "tuv")
    at = F.lit(1.0) * u * F.element_at("tiles", -1)["upto"]
    tile = F.element_at(F.filter("tiles", lambda t: t["upto"] > at), 1)
    placed = each.where(F.size("tiles") > 0).withColumns({"_t": tile, "_r": F.sqrt(v), "_w": w})
    t, r, w = F.col("_t"), F.col("_r"), F.col("_w")
    point = [(t[f"a{c}"] * (1 - r) + t[f"b{c}"] * (r * (1 - w)) + t[f"c{c}"] * (r * w)).alias(name) for c, name in (("x", "lon"), ("y", "lat"))]
    return placed.select(*strata.columns, "point_no", *point)


def single_feature(features: DataFrame, condition: Column) -> DataFrame:
    """The one feature that matches, or an error."""
    found = features.where(condition)
    if found.limit(2).count() != 1:
        raise GuardError("expected exactly one matching feature")
    return found


def pixel_columns(points: DataFrame, x: str, y: str, origin: tuple[float, float],
                  size: float) -> DataFrame:
    """Central-pixel indices on a north-up grid with its origin at the top left."""
    return points.withColumns({
        "px": F.floor((F.col(x) - F.lit(origin[0])) / F.lit(size)).cast("long"),
        "py": F.floor((F.lit(origin[1]) - F.col(y)) / F.lit(size)).cast("long")})


def point_to_pixel(points: DataFrame, pixels: DataFrame, on: Sequence[str] = ("year", "px", "py"),
                   how: str = "inner") -> DataFrame:
    """Sample a pixel table at points. Refuses band names the points already use.

    A masked (absent) pixel drops the point with ``inner`` and gives NULL with ``left``.
    """
    on = list(on)
    clash = (set(points.columns) & set(pixels.columns)) - set(on)
    if clash:
        raise GuardError(f"band names collide with point properties: {sorted(clash)}")
    refuse_rows(duplicate_keys(pixels, on), "pixel table repeats a pixel")
    return points.join(pixels, on, how)


def disc_offsets(radius: float, pixel: float) -> list[tuple[int, int]]:
    """Pixel offsets whose centres lie within ``radius`` of the centre pixel."""
    reach = int(math.floor(radius / pixel))
    return [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)
            if (i * i + j * j) * pixel * pixel <= radius * radius]


def neighbours(points: DataFrame, pixels: DataFrame, offsets: Sequence[tuple[int, int]],
               on: Sequence[str] = ()) -> DataFrame:
    """Each point with the pixels at fixed offsets from its own (dx, dy added)."""
    offs = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"))
                               for i, j in offsets]))
    spread = points.withColumn("_o", offs).select(
        *[c for c in points.columns if c not in ("px", "py")],
        F.col("_o.dx").alias("dx"), F.col("_o.dy").alias("dy"),
        (F.col("px") + F.col("_o.dx")).alias("px"), (F.col("py") + F.col("_o.dy")).alias("py"))
    return spread.join(pixels, [*on, "px", "py"])


def neighbourhood_mean(points: DataFrame, pixels: DataFrame, id_col: str, bands: Sequence[str],
                       offsets: Sequence[tuple[int, int]], on: Sequence[str] = (),
                       normalise: bool = True) -> DataFrame:
    """Mean of each band over a disc of pixels, then unit length across bands."""
    near = neighbours(points.select(id_col, *on, "px", "py"), pixels, offsets, on)
    mean = near.groupBy(id_col).agg(F.count(F.lit(1)).alias("pixel_n"),
                                    *[F.avg(b).alias(b) for b in bands])
    if not normalise:
        return mean
    length = F.sqrt(sum(F.col(b) * F.col(b) for b in bands))
    return mean.select(id_col, "pixel_n", *[F.try_divide(F.col(b), length).alias(b) for b in bands])


def terrain(points: DataFrame, dem: DataFrame, id_col: str, size: float,
            elevation: str = "elevation") -> DataFrame:
    """Slope and aspect (degrees, clockwise from north) by Horn's 3x3 gradient.

    ``py`` grows southward. Points without all nine pixels get NULL.
    """
    offs = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1)]
    near = neighbours(points.select(id_col, "px", "py"), dem.select("px", "py", elevation), offs)

    def z(i, j):
        return F.max(F.when((F.col("dx") == i) & (F.col("dy") == j), F.col(elevation)))

    east = (z(1, -1) + 2 * z(1, 0) + z(1, 1)) - (z(-1, -1) + 2 * z(-1, 0) + z(-1, 1))
    north = (z(-1, -1) + 2 * z(0, -1) + z(1, -1)) - (z(-1, 1) + 2 * z(0, 1) + z(1, 1))
    g = near.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"), z(0, 0).alias(elevation),
                                 (east / (8 * size)).alias("_gx"), (north / (8 * size)).alias("_gy"))
    full = F.col("_n") == 9
    slope = F.degrees(F.atan(F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))))
    aspect = F.degrees(F.atan2(-F.col("_gx"), -F.col("_gy")))
    return g.select(id_col, elevation, F.when(full, slope).alias("slope"),
                    F.when(full, F.when(aspect < 0, aspect + 360).otherwise(aspect)).alias("aspect"))
