import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from geotransfer.operators import metrics as M, sampling, stats
from geotransfer.operators.guards import GuardError
from geotransfer.plans import domain_shift, source_cv, transfer
from geotransfer.plans.models import Profile, assemble, build, fit_ridge

TINY = Profile(forest_trees=3, boost_rounds=2, forest_depth=3, max_bins=16, depth_limit=3)
COLS = ["elevation", "slope", "NDVI"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 600
    x = rng.normal(size=(n, 3))
    y = 5 + 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(size=n) * 0.3
    pdf = pd.DataFrame(x, columns=COLS).assign(agbd=y, id=[f"{i:05d}" for i in range(n)],
                                              spatial_fold=rng.integers(0, 4, n), year=2020)
    return spark.createDataFrame(pdf).persist(), pdf


def ridge_np(x, y, alpha=10.0):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / s
    return w, y.mean() - w @ m


def test_ridge_equals_closed_form(data):
    df, pdf = data
    fit = fit_ridge(df, COLS)
    w, b = ridge_np(pdf[COLS].to_numpy(), pdf.agbd.to_numpy())
    assert np.allclose(fit.weights, w, atol=1e-8) and fit.intercept == pytest.approx(b, abs=1e-8)
    with pytest.raises(GuardError):
        fit_ridge(df, [*COLS, "agbd"])


def test_ridge_cv_equals_a_fit_per_fold(data):
    df, pdf = data
    fast = source_cv.ridge_cv(df, COLS).select("id", "prediction").toPandas().set_index("id").prediction
    held = pdf[pdf.spatial_fold == 2]
    slow = df.where("spatial_fold = 2").withColumn("p", fit_ridge(df.where("spatial_fold <> 2"), COLS).column()).toPandas().set_index("id").p
    w, b = ridge_np(pdf[pdf.spatial_fold != 2][COLS].to_numpy(), pdf[pdf.spatial_fold != 2].agbd.to_numpy())
    assert np.allclose(fast.loc[held.id], held[COLS].to_numpy() @ w + b) and np.allclose(fast.loc[held.id], slow.loc[held.id], atol=1e-8)


def test_nested_cv_provenance_and_pooling(data):
    df, pdf = data
    out = source_cv.nested_cv(df, COLS, "rep", "id", profile=TINY, train_cap=300, importance_repeats=2,
                              candidates=[("random_forest", "rf_sqrt"), ("boosted_trees", "gbt_depth6")])
    oof = out["oof"].toPandas()
    assert sorted(oof.id) == sorted(pdf.id)
    assert oof.groupby("spatial_fold")[["model", "config"]].nunique().max().max() == 1
    tuning = out["tuning"].toPandas()
    assert len(tuning) == 4 * 3 * 2  # outer folds x inner folds present x candidates
    assert (tuning.inner_fold != tuning.outer_fold).all()
    for fold, g in tuning.groupby("outer_fold"):
        best = g.groupby(["model", "config"]).RMSE.mean().reset_index().sort_values(["RMSE", "model", "config"]).iloc[0]
        used = oof[oof.spatial_fold == fold].iloc[0]
        assert (used.model, used.config) == (best.model, best.config)
    pooled = M.pooled_metrics(out["oof"], "spatial_fold").first()
    sse = ((oof.prediction - oof.agbd) ** 2).sum()
    assert pooled.R2 == pytest.approx(1 - sse / ((oof.agbd - oof.agbd.mean()) ** 2).sum())
    imp = out["importance"].toPandas()
    means = imp.groupby("feature").importance_mean.mean()
    assert means["elevation"] > means["NDVI"] and len(imp) == 4 * 3
    top = source_cv.top_features(out["importance"], 1).collect()
    assert [t.feature for t in top] == ["elevation"]


def test_permutation_importance_is_repeatable_and_zero_for_unused(data, spark):
    df, _ = data
    vec = assemble(df.withColumn("slope", F.lit(1.0)), COLS).select("id", "agbd", "features")
    model = build("random_forest", "rf_half", TINY).fit(vec)
    a = source_cv.permutation_importance(model, vec, COLS, "id", 2).toPandas().set_index("feature")
    b = source_cv.permutation_importance(model, vec.repartition(7), COLS, "id", 2).toPandas().set_index("feature")
    assert abs(a.loc["slope", "importance_mean"]) < 1e-12
    assert np.allclose(a.importance_mean, b.loc[a.index].importance_mean)


def test_deploy_save_and_score(data, tmp_path):
    from pyspark.ml.regression import RandomForestRegressionModel
    df, _ = data
    path = str(tmp_path / "m")
    model, chosen, tuning = source_cv.deploy(df, COLS, path, candidates=[("random_forest", "rf_sqrt")], profile=TINY)
    assert chosen == ("random_forest", "rf_sqrt") and tuning.count() == 4  # folds present
    target = df.withColumnRenamed("id", "shot_number").drop("agbd")
    a = transfer.predict(model, target, COLS).orderBy("shot_number").collect()
    b = transfer.predict(RandomForestRegressionModel.load(path), target, COLS).orderBy("shot_number").collect()
    assert a == b
    with pytest.raises(GuardError):
        transfer.predict(model, df.withColumnRenamed("id", "shot_number"), COLS)


def test_local_models_equal_numpy(data):
    df, pdf = data
    draws = sampling.label_draws(df, "id", folds=range(4), budgets=[20, 60], seeds=[42])
    runs = transfer.local_runs(df, draws, COLS, "id").toPandas().set_index(["fold", "budget"])
    picked = draws.toPandas()
    for (fold, budget), g in picked.groupby(["fold", "budget"]):
        tr = pdf[pdf.id.isin(g.id)]
        te = pdf[pdf.spatial_fold == fold]
        w, b = ridge_np(tr[COLS].to_numpy(), tr.agbd.to_numpy())
        err = te[COLS].to_numpy() @ w + b - te.agbd.to_numpy()
        assert runs.loc[(fold, budget), "RMSE"] == pytest.approx(np.sqrt((err ** 2).mean()))
        assert runs.loc[(fold, budget), "N_test"] == len(te)


def test_local_trees_cover_every_cell(data):
    df, pdf = data
    draws = sampling.label_draws(df, "id", folds=[0, 1], budgets=[60], seeds=[42])
    runs = transfer.local_tree_runs(df, draws, COLS, "id", TINY).toPandas()
    assert list(runs.fold) == [0, 1] and set(runs.N_train) == {60}
    assert list(runs.N_test) == [int((pdf.spatial_fold == f).sum()) for f in (0, 1)]


def two_domains(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "source" if i < 200 else "target", *map(float, rng.normal(size=3) + (0 if i < 200 else 1.5))) for i in range(400)]
    return spark.createDataFrame(rows, "id long, domain string, elevation double, slope double, NDVI double")


def test_domain_scores_separate(spark):
    df = two_domains(spark)
    scores = domain_shift.domain_scores(df, COLS, "domain", "source", "id")
    assert scores.count() == 400 and scores.select("id").distinct().count() == 400
    assert domain_shift.separability(scores).first().auroc > 0.9
    same = df.withColumn("domain", F.when(F.col("id") % 2 == 0, "source").otherwise("target"))
    assert abs(domain_shift.separability(domain_shift.domain_scores(same, COLS, "domain", "source", "id")).first().auroc - 0.5) < 0.15


def test_pca_scores_centre_on_source(spark):
    df = two_domains(spark)
    scores, var = domain_shift.source_pca(df, COLS, "domain", "source", "id", 3)
    mean = scores.where("domain = 'source'").agg(F.avg(F.col("pc")[0])).first()[0]
    assert abs(mean) < 1e-9 and sum(var) == pytest.approx(1.0)
    near, share = domain_shift.projected_distance(df, COLS, "domain", "source", "id")
    assert near.count() == 200 and share == pytest.approx(1.0)
    # With all components kept the distance equals the one in standardised space.
    pdf = df.toPandas()
    s, t = pdf[pdf.domain == "source"][COLS].to_numpy(), pdf[pdf.domain == "target"][COLS].to_numpy()
    z = lambda a: (a - s.mean(0)) / s.std(0)
    d = np.sqrt(((z(t)[:, None] - z(s)[None]) ** 2).sum(2)).min(1)
    assert near.agg(F.avg("distance")).first()[0] == pytest.approx(d.mean())


def test_balanced_sides(spark):
    got = domain_shift.balanced(two_domains(spark), "domain", "source", "id", 50).groupBy("domain").count().collect()
    assert {r["count"] for r in got} == {50}


def test_distortion_status(spark):
    raw = spark.createDataFrame([(1, float(i)) for i in range(100)], "year int, agbd double")
    ok = stats.distortion(raw, raw, "agbd", ["year"]).first()
    bad = stats.distortion(raw.where("agbd > 60"), raw, "agbd", ["year"]).first()
    warn = stats.distortion(raw.where("agbd < 10 OR agbd > 35").where("agbd <> 99"), raw, "agbd", ["year"]).first()
    assert ok.audit_status == "PASS" and bad.audit_status == "FAIL"
    assert warn.audit_status in ("FAIL", "PASS WITH DISTRIBUTION WARNING")


def test_vector_helpers(spark):
    df = spark.createDataFrame([(1, [0.5, 1.5])], "id int, v array<float>")
    assert domain_shift.vector_columns(df, "v", 2).columns == ["id", "A00", "A01"]
    v = assemble(df.select(F.lit(1.0).alias("slope"), F.lit(2.0).alias("NDVI")), ["slope", "NDVI"])
    assert v.select(vector_to_array("features")).first()[0] == [1.0, 2.0]
