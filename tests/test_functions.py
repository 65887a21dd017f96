import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotransfer.functions import geo, numeric, radar, spectral, text, times
from geotransfer.operators.guards import GuardError, feature_schema, safe_predictors
from geotransfer.operators.qa import refuse_undocumented, undocumented_classes
from geotransfer.schemas import L_BAND, REPRESENTATIONS


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_gamma0_formula_and_domain(spark):
    got = one(spark, [(1000.0,), (10000.0,), (0.0,), (-1.0,), (math.nan,), (math.inf,), (None,)],
              "dn double", radar.gamma0_db("dn"))
    assert got[0][0] == pytest.approx(20 * math.log10(1000) - 83)
    assert got[1][0] == pytest.approx(-3.0)
    assert [g[0] for g in got[2:]] == [None] * 5


def test_rfdi_uses_linear_power(spark):
    got = one(spark, [(4.0, 2.0), (0.0, 2.0), (3.0, None)], "a double, b double", radar.rfdi("a", "b"))
    assert got[0][0] == pytest.approx(12 / 20)
    assert got[1][0] is None and got[2][0] is None


def test_radar_feature_columns(spark):
    df = spark.createDataFrame([(1000.0, 500.0), (2000.0, 1000.0)], "HH double, HV double")
    out = radar.with_radar_features(df)
    assert out.columns == L_BAND
    assert all(math.isfinite(v) for r in out.collect() for v in r)
    with pytest.raises(ValueError):
        radar.with_radar_features(df.drop("HV"))


def test_valid_classes_over_whole_byte_range(spark):
    rows = spark.range(256).where(radar.qa_is_valid("id")).collect()
    assert {r.id for r in rows} == {1, 255}
    bad = one(spark, [("x",), (None,), ("255",)], "q string", radar.qa_is_valid("q"))
    assert bad == [(False,), (False,), (True,)]


def test_undocumented_class_is_found_and_refused(spark):
    ok = spark.createDataFrame([(1,), (2,), (3,)], "qa int")
    bad = spark.createDataFrame([(1,), (42,), (255,)], "qa int")
    assert undocumented_classes(ok, "qa").count() == 0
    assert [r.qa for r in undocumented_classes(bad, "qa").collect()] == [42]
    refuse_undocumented(ok, "qa")
    with pytest.raises(GuardError):
        refuse_undocumented(bad, "qa")


def test_null_boundary(spark):
    got = one(spark, [(1.5,), (-9999.0,), (math.nan,), (-math.inf,), (None,)], "x double", numeric.clean("x"))
    assert [g[0] for g in got] == [1.5, None, None, None, None]
    fin = one(spark, [(1.5,), (math.nan,), (math.inf,), (None,)], "x double", numeric.finite("x"))
    assert [g[0] for g in fin] == [True, False, False, False]


def test_vectors(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([1.0, math.nan],), ([1.0],)]
    got = one(spark, rows, "v array<double>", numeric.l2_norm("v"), numeric.l2_normalise("v"),
              numeric.finite_vector("v", 2))
    assert got[0] == (5.0, [0.6, 0.8], True)
    assert got[1][1] is None and got[1][2] is False
    assert got[2][2] is False and got[3][2] is False


def test_indices_and_mask(spark):
    df = spark.createDataFrame([(0.1, 0.05, 0.2, 0.5, 0.45, 0.3, 0.25, 4, 0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 4, 0)],
                               "B2 double, B4 double, B5 double, B8 double, B8A double, B11 double, B12 double, SCL int, QA60 int")
    r, z = spectral.with_indices(df).collect()
    assert r.NDVI == pytest.approx(0.45 / 0.55)
    assert r.EVI == pytest.approx(2.5 * 0.45 / (0.5 + 0.3 - 0.75 + 1))
    assert z.NDVI is None and z.EVI == 0.0
    clear = one(spark, [(4, 0), (8, 0), (4, 1024), (4, 2048), (4, 512)], "SCL int, QA60 int", spectral.clear_sky())
    assert [c[0] for c in clear] == [True, False, False, False, True]


def test_times(spark):
    got = one(spark, [(0.0,), (31536000.25,)], "s double", times.iso_text(times.mission_time("s")))
    assert [g[0] for g in got] == ["2018-01-01T00:00:00.000000Z", "2019-01-01T00:00:00.250000Z"]
    ms = one(spark, [(1577836800000,), (0,), (-5,)], "e long", F.year(times.millis_time("e")))
    assert [m[0] for m in ms] == [2020, None, None]


@pytest.mark.parametrize("cell", ['{"a": 3, "b": 10}', "{'a': 3, 'b': 10}", "{a=3, b=10}", "{ a = 3,b=10 }"])
def test_count_map_spellings(spark, cell):
    assert one(spark, [(cell,)], "c string", text.count_map("c"))[0][0] == {"a": 3, "b": 10}


def test_empty_count_map(spark):
    assert one(spark, [("{}",)], "c string", text.count_map("c"))[0][0] == {}


def test_albers_published_example(spark):
    x, y = geo.albers("lon", "lat", ellipsoid=geo.CLARKE_1866)
    r = one(spark, [(-75.0, 35.0)], "lon double, lat double", x, y)[0]
    assert r[0] == pytest.approx(1885472.7, abs=0.1) and r[1] == pytest.approx(1535925.0, abs=0.1)


def test_utm_central_meridian_and_symmetry(spark):
    e, n = geo.utm_north("lon", "lat")
    a, b, c = one(spark, [(117.0, 0.0), (118.0, 29.0), (116.0, 29.0)], "lon double, lat double", e, n)
    assert a == (pytest.approx(500000.0), pytest.approx(0.0, abs=1e-6))
    assert b[0] - 500000 == pytest.approx(500000 - c[0]) and b[1] == pytest.approx(c[1])
    # Meridian arc on WGS 84 to 45 N is 4984944.378 m; the grid scale is 0.9996.
    m = one(spark, [(117.0, 45.0)], "lon double, lat double", n)[0][0]
    assert m == pytest.approx(0.9996 * 4984944.378, abs=0.01)


def test_schemas_exclude_shortcuts(spark):
    for name, features in REPRESENTATIONS.items():
        assert feature_schema(name, features) == features
    with pytest.raises(GuardError):
        feature_schema("dem", list(reversed(REPRESENTATIONS["dem"])))
    for leak in ("agbd", " LON ", "spatial_fold", "palsar_qa"):
        with pytest.raises(GuardError):
            safe_predictors(["slope", leak])
    with pytest.raises(GuardError):
        safe_predictors(["slope", "slope"])


def test_close_to_and_bits(spark):
    r = one(spark, [(1.0, 1.0 + 5e-10), (1.0, 1.1)], "a double, b double", numeric.close_to("a", "b", 1e-9))
    assert [x[0] for x in r] == [True, False]
    assert np.isclose(20 * np.log10(1000.0) - 83, -23)


def test_radar_physics_guard(spark):
    good = spark.createDataFrame([(1000.0, 500.0)], "HH double, HV double")
    zero = spark.createDataFrame([(0.0, 1.0)], "HH double, HV double")
    radar.require_physics(radar.with_radar_features(good, drop_raw=False), "HH", "HV")
    with pytest.raises(ValueError):
        radar.require_physics(radar.with_radar_features(zero, drop_raw=False), "HH", "HV")
    with pytest.raises(ValueError):
        radar.require_physics(radar.with_radar_features(good).withColumn("palsar_hh_db", F.lit(25.0)))
