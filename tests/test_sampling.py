import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geotransfer.operators import sampling
from geotransfer.operators.guards import GuardError


def hot_frame(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    block = np.where(rng.random(n) < 0.35, "hot", [f"b{i}" for i in rng.integers(0, 25, n)])
    pdf = pd.DataFrame({"id": [f"{10**17 + i}" for i in range(n)], "block": block,
                        "year": rng.integers(2019, 2022, n)})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("prefilter", [False, True])
def test_capped_sample_sizes_and_rows(spark, prefilter):
    df, pdf = hot_frame(spark)
    got = sampling.capped_sample(df, ["block", "year"], "id", 20, prefilter=prefilter).toPandas()
    sizes = pdf.groupby(["block", "year"]).size()
    assert len(got) == np.minimum(sizes, 20).sum()
    pdf["h"] = [hashlib.sha256(f"42|{i}".encode()).hexdigest() for i in pdf.id]
    want = pdf.sort_values(["h", "id"]).groupby(["block", "year"]).head(20)
    assert set(got.id) == set(want.id)


@pytest.mark.parametrize("parts", [1, 37])
def test_sample_ignores_partitioning(spark, parts):
    df, _ = hot_frame(spark)
    base = {r.id for r in sampling.capped_sample(df, ["block", "year"], "id", 15).collect()}
    assert {r.id for r in sampling.capped_sample(df.repartition(parts), ["block", "year"], "id", 15).collect()} == base


def test_nested_caps(spark):
    df, _ = hot_frame(spark)
    small = {r.id for r in sampling.capped_sample(df, ["block", "year"], "id", 5).collect()}
    large = {r.id for r in sampling.capped_sample(df, ["block", "year"], "id", 20).collect()}
    assert small < large


def greedy(sizes, k=5):
    order = sorted(sizes.items(), key=lambda kv: (-kv[1], hashlib.sha256(f"42|{kv[0]}".encode()).hexdigest()))
    load, out = [0] * k, {}
    for b, n in order:
        f = min(range(k), key=lambda i: (load[i], i))
        out[b], load[f] = f, load[f] + n
    return out


@pytest.mark.parametrize("chunk", [500_000, 7])
def test_greedy_folds(spark, chunk):
    """Small chunks hand the fold totals on and give the same folds."""
    df, pdf = hot_frame(spark)
    blocks = df.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    got = {r.block: r.spatial_fold for r in sampling.greedy_folds(blocks, "block", "n", chunk_rows=chunk).collect()}
    assert got == greedy(pdf.groupby("block").size().to_dict())


def test_blocks_never_cross_folds(spark):
    df, _ = hot_frame(spark)
    folded = sampling.with_folds(df, sampling.block_folds(df, "block"), "block")
    assert sampling.split_blocks(folded, "block").count() == 0
    assert folded.count() == df.count()
    broken = folded.withColumn("spatial_fold", F.pmod(F.col("spatial_fold") + F.col("year"), F.lit(5)))
    assert sampling.split_blocks(broken, "block").count() > 0


def test_giant_block_sits_alone(spark):
    df = spark.createDataFrame([("g", 100)] + [(f"s{i}", 10) for i in range(10)], "block string, n long")
    got = sampling.greedy_folds(df, "block", "n").groupBy("spatial_fold").agg(F.sum("sample_n").alias("t")).collect()
    assert sorted(r.t for r in got) == [20, 20, 30, 30, 100]


def test_label_draws_nest_and_avoid_fold(spark):
    df, _ = hot_frame(spark)
    data = sampling.with_folds(df, sampling.block_folds(df, "block"), "block")
    draws = sampling.label_draws(data, "id", budgets=[10, 50, 200])
    rows = draws.toPandas()
    assert rows.groupby(["fold", "seed", "budget"]).size().eq(rows.groupby(["fold", "seed", "budget"])["budget"].first()).all()
    for _, g in rows.groupby(["fold", "seed"]):
        ids = {b: set(x["id"]) for b, x in g.groupby("budget")}
        assert ids[10] < ids[50] < ids[200]
    sampling.require_draws(draws, data, "id")
    with pytest.raises(GuardError):
        sampling.require_draws(draws.where("budget > 10 OR rank > 1"), data, "id")


def test_budget_above_pool_is_left_out(spark):
    data = spark.range(40).select(F.col("id").cast("string").alias("id"), (F.col("id") % 5).cast("int").alias("spatial_fold"))
    got = {r.budget for r in sampling.label_draws(data, "id", budgets=[8, 32, 33], short_pools="omit").collect()}
    assert got == {8, 32}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.integers(1, 12))
def test_cap_property(spark, strata, cap):
    df = spark.createDataFrame(list(enumerate(strata)), "id long, s long")
    got = sampling.capped_sample(df, ["s"], "id", cap).count()
    assert got == sum(min(strata.count(s), cap) for s in set(strata))


def test_hold_out_and_folds_are_stratified(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 800, "a").otherwise("b").alias("c"))
    h = {(r.c, r.held_out): r["count"] for r in sampling.hash_share(df, "id", ["c"], 0.25).groupBy("c", "held_out").count().collect()}
    assert h == {("a", True): 200, ("a", False): 600, ("b", True): 50, ("b", False): 150}
    f = sampling.stratified_folds(df, "id", ["c"]).groupBy("c", "spatial_fold").count().collect()
    assert {r["count"] for r in f if r.c == "a"} == {160} and {r["count"] for r in f if r.c == "b"} == {40}


def test_random_points_repeat_and_fill_box(spark):
    a = sampling.random_points(spark, 50, (10.0, 20.0, 11.0, 22.0), 42).collect()
    assert a == sampling.random_points(spark, 50, (10.0, 20.0, 11.0, 22.0), 42).collect()
    assert all(10 <= r.lon < 11 and 20 <= r.lat < 22 for r in a)


def test_keep_latest_and_chunks(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, v int, w string")
    assert {(r.k, r.w) for r in sampling.keep_latest(df, ["k"], "v").collect()} == {("a", "y"), ("b", "z")}
    c = spark.range(10).select(F.col("id"), F.lit(2020).alias("year"))
    assert [r.chunk for r in sampling.chunk_numbers(c, "year", ["id"], 4).orderBy("id").collect()] == [0] * 4 + [1] * 4 + [2] * 2


@pytest.mark.parametrize("prefilter", [False, True])
def test_row_cap_and_narrow_filter(spark, prefilter, monkeypatch):
    df, pdf = hot_frame(spark)
    want = sorted(pdf.id, key=lambda i: hashlib.sha256(f"42|{i}".encode()).hexdigest())[:40]
    assert {r.id for r in sampling.row_cap(df, 40, "id", prefilter=prefilter).collect()} == set(want)
    # A pre-filter that is too narrow is noticed: the cap falls back, the sample stops.
    monkeypatch.setattr(sampling, "_reach", lambda k, n: F.lit(1e-3))
    assert {r.id for r in sampling.row_cap(df, 40, "id", prefilter=True).collect()} == set(want)
    with pytest.raises(PySparkException, match="too narrow"):
        sampling.capped_sample(df, ["year"], "id", 20, prefilter=True).collect()


def test_short_pools_stop_or_are_reported(spark):
    data = spark.createDataFrame([(str(i), i % 5) for i in range(40)], "id string, spatial_fold int")
    with pytest.raises(Exception, match="label pool is smaller"):
        sampling.label_draws(data, "id", budgets=[8, 33]).collect()
    draws = sampling.label_draws(data, "id", budgets=[8, 33], seeds=[42], short_pools="omit")
    cells = sampling.draw_cells(spark, budgets=[8, 33], seeds=[42])
    audit = {(r.fold, r.budget): (r.n, r.exact) for r in sampling.draw_integrity(draws, data, "id", cells=cells).collect()}
    assert audit == {(f, b): ((8, True) if b == 8 else (0, False)) for f in range(5) for b in (8, 33)}


def test_equal_versions_are_settled(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 0, "z")]
    got = {sampling.keep_latest(spark.createDataFrame(r, "k string, v int, w string").repartition(3), ["k"], "v").first().w
           for r in (rows, rows[::-1])}
    assert len(got) == 1 and got <= {"x", "y"}
