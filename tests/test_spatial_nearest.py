import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from geotransfer.operators import composite, nearest, spatial
from geotransfer.operators.guards import GuardError
from geotransfer.sources.features import LBandSource


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


@pytest.mark.parametrize("slab", [0.25, 3.0, 100.0])
def test_polygon_cases(spark, slab):
    rings = [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (4.0, 3.0), (0.0, 8.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 2.0), (1.0, 2.0)]]
    pts = [(x / 2, y / 2) for x in range(-2, 19) for y in range(-2, 19)]
    df = spark.createDataFrame(pts, "lon double, lat double")
    got = {(r.lon, r.lat) for r in spatial.within_polygon(df, spatial.polygon_frame(spark, {"p": rings}), slab=slab).collect()}
    assert got == {p for p in pts if inside(*p, rings)}
    assert (0.0, 4.0) in got and (2.0, 1.5) not in got and (4.0, 5.0) not in got


def test_bounding_box_reaches_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("double").alias("lon"), F.col("id").cast("double").alias("lat")).write.parquet(str(tmp_path / "p"))
    pts = spark.read.parquet(str(tmp_path / "p"))
    ring = spatial.polygon_frame(spark, {"p": [[(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0)]]})
    out = spatial.within_polygon(pts, ring)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lon,10.0)" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert out.count() == 11


def test_area_and_single_feature(spark):
    r = spatial.polygon_frame(spark, {"a": [[(0.0, 0.0), (4.0, 0.0), (0.0, 3.0)]], "b": [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]})
    assert {x.poly_id: x.area for x in spatial.polygon_area(r).collect()} == {"a": 6.0, "b": 1.0}
    assert spatial.single_feature(r, F.col("poly_id") == "a").count() == 1
    with pytest.raises(GuardError):
        spatial.single_feature(r, F.lit(True))


def test_point_to_pixel(spark):
    pix = spark.createDataFrame([(2020, 0, 0, 1.0), (2020, 1, 0, 2.0)], "year int, px long, py long, band double")
    pts = spatial.pixel_columns(spark.createDataFrame([(2020, 5.0, 95.0), (2020, 15.0, 95.0), (2020, 25.0, 95.0)],
                                                      "year int, x double, y double"), "x", "y", (0.0, 100.0), 10.0)
    assert {r.band for r in spatial.point_to_pixel(pts, pix).collect()} == {1.0, 2.0}
    assert spatial.point_to_pixel(pts, pix, how="left").where("band IS NULL").count() == 1
    with pytest.raises(GuardError, match="collide"):
        spatial.point_to_pixel(pts.withColumn("band", F.lit(0)), pix)
    with pytest.raises(GuardError, match="repeats"):
        spatial.point_to_pixel(pts, pix.union(pix))


def test_terrain_on_tilted_plane(spark):
    dem = spark.createDataFrame([(i, j, 100.0 + 3.0 * i * 30 * 0.1) for i in range(5) for j in range(5)], "px long, py long, elevation double")
    pts = spark.createDataFrame([("p", 2, 2), ("edge", 0, 0)], "id string, px long, py long")
    r = {x.id: x for x in spatial.terrain(pts, dem, "id", 30.0).collect()}
    assert r["p"].slope == pytest.approx(np.degrees(np.arctan(0.3)))
    assert r["p"].aspect == pytest.approx(270.0)  # rises to the east, so it faces west
    assert r["edge"].slope is None
    north = spark.createDataFrame([(i, j, -6.0 * j) for i in range(5) for j in range(5)], "px long, py long, elevation double")
    assert spatial.terrain(pts, north, "id", 30.0).where("id = 'p'").first().aspect == pytest.approx(180.0)


def test_disc_and_mean(spark):
    assert len(spatial.disc_offsets(25.0, 10.0)) == 21 and len(spatial.disc_offsets(10.0, 10.0)) == 5
    pix = spark.createDataFrame([(i, j, float(i), 1.0) for i in range(9) for j in range(9)], "px long, py long, a double, b double")
    pts = spark.createDataFrame([("p", 4, 4)], "id string, px long, py long")
    r = spatial.neighbourhood_mean(pts, pix, "id", ["a", "b"], spatial.disc_offsets(25.0, 10.0)).first()
    assert r.pixel_n == 21 and r.a == pytest.approx(4 / np.sqrt(17)) and r.a ** 2 + r.b ** 2 == pytest.approx(1)


def test_scene_contract_and_mosaic(spark):
    s = spark.createDataFrame([(2020, "a"), (2021, "b"), (2021, "c")], "year int, scene_id string")
    composite.require_single_scene(s.where("year = 2020"), "year", "scene_id")
    with pytest.raises(GuardError):
        composite.require_single_scene(s, "year", "scene_id")
    px = spark.createDataFrame([(0, 1, 5.0), (0, 2, None), (1, 1, 7.0), (1, 3, 8.0)], "px int, ts int, b double")
    assert {(r.px, r.b) for r in composite.mosaic(px, ["px"], ["b"], "ts").collect()} == {(0, 5.0), (1, 8.0)}


def test_sensor_source_is_exact_year(spark):
    px = spark.createDataFrame([("s", 2020, 0, 0, 1000.0, 500.0, 255), ("s", 2020, 1, 0, 1000.0, 500.0, 50)],
                               "scene_id string, year int, px long, py long, HH double, HV double, qa int")
    pts = spark.createDataFrame([("1", 2020, 0, 0), ("2", 2020, 1, 0), ("3", 2021, 0, 0)], "shot_number string, year int, px long, py long")
    src = LBandSource(px)
    assert [r.shot_number for r in src.for_year(pts, 2020).collect()] == ["1"]
    with pytest.raises(RuntimeError, match="nearest-year"):
        src.for_year(pts, 2021)


def brute(s, t):
    d = np.sqrt(((t[:, None, :] - s[None, :, :]) ** 2).sum(2))
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("block_rows,pivots", [(4096, 32), (40, 4)])
def test_nearest_equals_brute_force_with_a_hot_group(spark, block_rows, pivots):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8)) * 4
    pick = np.where(rng.random(700) < 0.5, 0, rng.integers(1, 6, 700))
    s = centre[pick] + rng.normal(size=(700, 8))
    t = centre[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8))
    sdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(s)], "id long, v array<double>")
    tdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(t)], "tid long, v array<double>")
    got = {r.tid: (r.nearest_id, r.distance) for r in nearest.nearest_source(
        sdf, tdf, "id", "tid", "v", pivots, block_rows).collect()}
    idx, dist = brute(s, t)
    assert len(got) == 300
    assert all(got[i][0] == idx[i] and got[i][1] == pytest.approx(dist[i]) for i in range(300))


def test_nearest_with_identical_vectors_takes_the_smaller_id(spark):
    s = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "id long, v array<float>")
    t = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [4.0, 6.0])], "tid string, v array<float>")
    got = {r.tid: (r.nearest_id, r.distance) for r in nearest.nearest_source(s, t, "id", "tid", "v", 4, 7).collect()}
    assert got == {"x": (0, 0.0), "y": (0, 5.0)}


def test_nearest_sends_a_target_to_bags_and_not_to_every_group(spark, monkeypatch):
    """Vectors without clusters: no group can be skipped, and a target still meets each block of sources once."""
    rng = np.random.default_rng(8)
    s, t = rng.normal(size=(2000, 32)), rng.normal(size=(300, 32))
    stored = []
    monkeypatch.setattr(nearest, "materialize", lambda df, real=nearest.materialize: stored.append(real(df)) or stored[-1])
    out = nearest.nearest_source(*[spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>") for x in (s, t)],
                                 "id", "id", "v", 64, 500).collect()
    idx, dist = brute(s, t)
    assert len(out) == 300 and all(r.nearest_id == idx[r.id] and r.distance == pytest.approx(dist[r.id]) for r in out)
    visits = [df.count() for df in stored if "v" in df.columns and "radius" not in df.columns]
    assert len(visits) == 2 and sum(visits) <= 300 * 5


def frames_of(spark, s, t):
    """Sources in reverse, so that the smaller id of a tie comes last; ids are texts whose order is the number's."""
    return (spark.createDataFrame([(f"{i:05d}", v.tolist()) for i, v in reversed(list(enumerate(s)))], "id string, v array<double>"),
            spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(t)], "tid long, v array<double>"))


def same_as_brute(got, s, t):
    idx, dist = brute(s, t)
    return len(got) == len(t) and all(int(r.nearest_id) == idx[r.tid] and r.distance == pytest.approx(dist[r.tid]) for r in got)


def test_nearest_on_a_line_merges_equal_values(spark, monkeypatch):
    rng = np.random.default_rng(10)
    s = np.where(rng.random(3000) < 0.5, 7.0, rng.integers(-40, 40, 3000) / 4.0)[:, None]
    t = np.concatenate([rng.integers(-90, 90, 500) / 8.0, [1e6, -1e6]])[:, None]
    stored = []
    monkeypatch.setattr(nearest, "materialize", lambda df, real=nearest.materialize: stored.append(real(df)) or stored[-1])
    assert same_as_brute(nearest.nearest_source(*frames_of(spark, s, t), "id", "tid", "v").collect(), s, t)
    assert max(df.count() for df in stored) <= len(np.unique(s)) + len(np.unique(t))
    assert same_as_brute(nearest.nearest_source(*frames_of(spark, s[:1], t), "id", "tid", "v").collect(), s[:1], t)
    with pytest.raises(ValueError, match="empty"):
        nearest.nearest_source(*frames_of(spark, s[:0], t), "id", "tid", "v")


@pytest.mark.parametrize("width", [2, 3])
def test_nearest_of_narrow_vectors_visits_the_boxes_within_reach(spark, width, monkeypatch):
    rng = np.random.default_rng(11)
    s, t = rng.normal(size=(3000, width)), np.concatenate([rng.normal(size=(400, width)), np.full((1, width), 90.0)])
    s[rng.random(3000) < 0.4] = 0.5  # one popular vector
    stored = []
    monkeypatch.setattr(nearest, "materialize", lambda df, real=nearest.materialize: stored.append(real(df)) or stored[-1])
    assert same_as_brute(nearest.nearest_source(*frames_of(spark, s, t), "id", "tid", "v", block_rows=100).collect(), s, t)
    boxes = next(df for df in stored if "radius" in df.columns).select("cell").distinct().count()
    visits = [df.count() for df in stored if "v" in df.columns and "radius" not in df.columns]
    assert boxes > 10 and visits[0] == 401 and visits[1] < 401 * 4
    cuts = nearest._Cuts(np.full((50, width), 2.0), 8)
    assert (cuts.place(np.zeros((3, width))) == 0).all()


def test_closest_within_reach_is_brute_force():
    rng = np.random.default_rng(9)
    for width in (1, 2, 16):
        b, a = rng.integers(0, 40, (500, width)) / 8.0, rng.integers(-4, 44, (200, width)) / 8.0
        b = np.unique(b, axis=0)
        idx, dist = brute(b, a)
        got, d = nearest._closest(a, b, np.full(200, np.inf))
        assert (got == idx).all() and np.allclose(d, dist)
        near = dist <= np.median(dist)
        got, d = nearest._closest(a, b, np.where(near, dist, 0.0))
        assert (got[near] == idx[near]).all() and np.allclose(d[near], dist[near])


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), min_size=1, max_size=20))
def test_nearest_property(spark, pts):
    s = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(pts)], "id long, v array<double>")
    t = spark.createDataFrame([(0, [0.0, 0.0])], "tid long, v array<double>")
    r = nearest.nearest_source(s, t, "id", "tid", "v", 3, 4).first()
    d = [np.hypot(a, b) for a, b in pts]
    assert r.distance == pytest.approx(min(d)) and r.nearest_id == int(np.argmin(d))


def test_ring_validity(spark):
    good = spatial.polygon_frame(spark, {"a": [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]})
    spatial.require_valid_rings(good)
    for ring in ([(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], [(0.0, 0.0), (200.0, 0.0), (1.0, 1.0)]):
        with pytest.raises(GuardError):
            spatial.require_valid_rings(spatial.polygon_frame(spark, {"a": [ring]}))


def star(corners, seed):
    """A simple, mostly hollow ring around the origin."""
    rng = np.random.default_rng(seed)
    angle = np.sort(rng.uniform(0, 2 * np.pi, corners))
    reach = rng.uniform(0.2, 1.0, corners)
    return [[float(r * np.cos(a)), float(r * np.sin(a))] for a, r in zip(angle, reach)]


def shoelace(ring):
    x, y = np.array(ring).T
    return abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


@pytest.mark.parametrize("seed", range(6))
def test_triangles_tile_the_ring(seed):
    ring = star(30, seed)
    if seed % 2:
        ring = ring[::-1] + ring[-1:]  # clockwise and closed
    tiles = spatial.ear_clipped(ring)
    assert sum(shoelace(t) for t in tiles) == pytest.approx(shoelace(ring)) and all(tuple(p) in map(tuple, ring) for t in tiles for p in t)


def test_area_points_lie_inside_evenly_and_repeat(spark):
    rings = spatial.polygon_frame(spark, {"l": [[(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]], "star": [star(20, 3)]})
    strata = spark.createDataFrame([("l", 2020), ("l", 2021), ("star", 2020)], "poly_id string, year int")
    points = spatial.area_points(rings, strata, 500, 7)
    rows = sorted(map(tuple, points.collect()))
    assert rows == sorted(map(tuple, spatial.area_points(rings, strata.repartition(3), 500, 7).collect())) and len(rows) == 1500
    inside = spatial.within_polygon(points.withColumnRenamed("poly_id", "own"), rings).where("own = poly_id")
    assert inside.count() == 1500
    far = points.where("poly_id = 'l' AND lon > 1").count() / 1000  # three of seven unit squares
    assert abs(far - 3 / 7) < 0.06
