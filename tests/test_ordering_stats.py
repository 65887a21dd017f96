"""Order statistics: both paths (one task per group, spread over the cluster) against numpy."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from geotransfer.operators import ordering, quantiles as Q, stats

PATHS = [False, True]


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows and one value holds a third of them."""
    rng = np.random.default_rng(7)
    n = 6000
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    value = np.where(rng.random(n) < 0.33, 5.0, rng.integers(0, 900, n) / 8.0)
    other = value * 0.5 + rng.integers(0, 300, n)
    pdf = pd.DataFrame({"id": np.arange(n), "key": key, "value": value, "other": other,
                        "domain": np.where(rng.random(n) < 0.4, "source", "target")})
    return spark.createDataFrame(pdf).repartition(11), pdf


@pytest.mark.parametrize("distributed", PATHS)
def test_quantiles_equal_numpy(skewed, distributed):
    df, pdf = skewed
    probs = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99, "top": 1.0}
    got = Q.quantiles(df, ["key"], "value", probs, distributed).toPandas().set_index("key")
    for k, g in pdf.groupby("key"):
        for name, p in probs.items():
            assert got.loc[k, name] == pytest.approx(np.quantile(g.value, p))
    whole = Q.quantiles(df, [], "value", probs, distributed).first()
    assert whole["p25"] == pytest.approx(np.quantile(pdf.value, 0.25))


@pytest.mark.parametrize("distributed", PATHS)
def test_average_ranks(skewed, distributed):
    df, pdf = skewed
    got = ordering.average_ranks(df, ["key"], "value", "r", distributed).toPandas().sort_values("id")
    want = pdf.groupby("key")["value"].rank(method="average")
    assert np.allclose(got["r"].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("distributed", PATHS)
def test_number_rows(skewed, distributed):
    df, pdf = skewed
    got = ordering.number_rows(df.select("key", "id"), ["id"], ["key"], "no", "total",
                               distributed).toPandas().sort_values("id")
    assert (got["no"].to_numpy() == pdf.groupby("key").cumcount().to_numpy() + 1).all()
    assert (got["total"].to_numpy() == pdf.groupby("key")["id"].transform("size").to_numpy()).all()
    flat = ordering.number_rows(df.select("id"), ["id"], distributed=distributed).toPandas()
    assert (flat.sort_values("id")["row_no"].to_numpy() == np.arange(1, len(pdf) + 1)).all()


def _ks_w(x, y):
    grid = np.unique(np.concatenate([x, y]))
    f = np.searchsorted(np.sort(x), grid, side="right") / len(x)
    g = np.searchsorted(np.sort(y), grid, side="right") / len(y)
    return np.abs(f - g).max(), (np.abs(f - g)[:-1] * np.diff(grid)).sum()


@pytest.mark.parametrize("distributed", PATHS)
def test_two_sample_distances(skewed, distributed):
    df, pdf = skewed
    got = stats.two_sample(df, ["key"], "value", F.col("domain") == "source", distributed).toPandas()
    for r in got.itertuples():
        g = pdf[pdf.key == r.key]
        ks, w = _ks_w(g.value[g.domain == "source"].to_numpy(), g.value[g.domain == "target"].to_numpy())
        assert r.ks_statistic == pytest.approx(ks) and r.wasserstein_distance == pytest.approx(w)
        assert r.source_n == (g.domain == "source").sum()


@pytest.mark.parametrize("distributed", PATHS)
def test_spearman_and_auroc(skewed, distributed):
    df, pdf = skewed
    r = stats.spearman(df, "value", "other", distributed=distributed).first()
    want = np.corrcoef(pdf.value.rank(), pdf.other.rank())[0, 1]
    assert r.rho == pytest.approx(want)
    a = stats.auroc(df, "value", F.col("domain") == "target", distributed=distributed).first()
    rank = pdf.value.rank()
    pos = pdf.domain == "target"
    n1, n0 = pos.sum(), (~pos).sum()
    assert a.auroc == pytest.approx((rank[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


@pytest.mark.parametrize("distributed", PATHS)
def test_drift_table_paths_agree(skewed, distributed):
    df, pdf = skewed
    t = stats.drift_table(df, "domain", "source", ["value", "other"], distributed).toPandas().set_index("feature")
    s = pdf[pdf.domain == "source"]
    assert t.loc["other", "source_median"] == pytest.approx(s.other.median())
    assert t.loc["value", "source_std"] == pytest.approx(s.value.std(ddof=0))
    assert (t["ks_pvalue"].between(0, 1)).all()


def test_quantile_bins_equal_qcut(skewed):
    df, pdf = skewed
    got = Q.quantile_bins(df, "value", 10, "bin").toPandas().sort_values("id")
    want = pd.qcut(pdf.value, 10, labels=False, duplicates="drop") + 1
    assert (got["bin"].to_numpy() == want.to_numpy()).all()


def test_fixed_edges_refuse_repeats_and_open_ends(spark, skewed):
    df, pdf = skewed
    with pytest.raises(RuntimeError):
        Q.fixed_edges(df, "value", 10)
    edges = Q.fixed_edges(df, "other", 4)
    assert edges[0] == -np.inf and edges[-1] == np.inf
    wide = spark.createDataFrame([(-1e9,), (1e9,)], "other double")
    assert [r.b for r in Q.cut(wide, "other", edges, "b").collect()] == [0, 3]


def test_plan_of_counts_before_order(skewed):
    df, _ = skewed
    plan = ordering.value_counts(df, ["key"], "value")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 1 and "partial_count" in plan


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-5, 5), min_size=2, max_size=40))
def test_wasserstein_is_zero_on_itself(spark, values):
    rows = [(float(v), d) for v in values for d in ("source", "target")]
    df = spark.createDataFrame(rows, "value double, domain string").withColumn("k", F.lit(1))
    r = stats.two_sample(df, ["k"], "value", F.col("domain") == "source", False).first()
    assert r.ks_statistic == 0 and (r.wasserstein_distance or 0) == 0


def test_total_variation_counts_absent_category(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), ("y",)], "c string")
    b = spark.createDataFrame([("x",), ("z",)], "c string")
    assert stats.total_variation(a, b, "c").first()[0] == pytest.approx(0.5)


def test_p_values(spark):
    one = spark.range(1).select(stats.normal_two_sided(F.lit(1.959964)).alias("z"),
                                stats.ks_pvalue(F.lit(0.2), F.lit(100.0), F.lit(100.0)).alias("k")).first()
    assert one.z == pytest.approx(0.05, abs=1e-5)
    assert one.k == pytest.approx(0.0366, abs=1e-3)


def test_top_per_group_with_large_k(spark):
    df = spark.range(9000).select((F.col("id") % 2).alias("g"), "id")
    got = ordering.top_per_group(df, ["g"], [F.col("id")], 2500)
    assert got.groupBy("g").count().collect()[0]["count"] == 2500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_spearman_of_a_constant_side_is_nan(spark):
    """As in numpy and SQL; Spark's own corr divides by zero in ANSI mode. A group of NULLs has no row."""
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 5.0), ("b", 2.0, 4.0), ("c", None, 1.0)], "k string, x double, y double")
    got = {r.k: (r.n, r.rho) for r in stats.spearman(df, "x", "y", ["k"]).collect()}
    assert got["a"][0] == 2 and np.isnan(got["a"][1])
    assert got["b"] == (2, pytest.approx(-1.0)) and "c" not in got


def test_shift_row_when_every_target_lies_on_a_source(spark):
    from geotransfer.plans import domain_shift
    rows = [(i, "source" if i < 40 else "target", float(i % 20), 1.0 * i, 2.0 * i) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, domain string, f double, y double, p double")
    out = domain_shift.shift_row(df, ["f"], "domain", "source", "id", "y", "p")
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    row = out.first()
    assert (row.positive_n, row.negative_n, row.n, row.distance_mean) == (40, 40, 40, 0.0) and np.isnan(row.rho)


def test_common_groups_drops_repeats_before_the_join(spark):
    from geotransfer.operators import qa
    a = spark.range(1000).selectExpr("id % 7 AS year")
    out = qa.common_groups(a, spark.range(900).selectExpr("id % 5 + 3 AS year"), "year")
    assert sorted(r.year for r in out.collect()) == [3, 4, 5, 6]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate", plan.index("Join"))


def test_a_compressed_file_of_many_rows_is_counted(spark, tmp_path):
    """1.2 million rows of one group lie in a few MB: the file's size does not tell that they fit one task."""
    spark.range(1_200_000).selectExpr("id % 1100000 AS v").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert not ordering.groups_fit_one_task(df, []) and ordering.groups_fit_one_task(df.where("v < 10"), [])
    assert Q.quantiles(df, [], "v", {"q": 1.0}).first().q == 1_099_999.0
