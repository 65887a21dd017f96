"""Binned trees, packed moments and Newton fits against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geotransfer.operators import sampling
from geotransfer.operators.guards import GuardError
from geotransfer.plans import domain_shift, histograms as H, logistic, moments, source_cv, tree_cv
from geotransfer.schemas import REPRESENTATIONS

COLS = ["elevation", "slope", "NDVI"]


def table(n=500, seed=3, folds=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = 3 * x[:, 0] + np.sin(3 * x[:, 1]) + 0.3 * rng.normal(size=n)
    return pd.DataFrame(x, columns=COLS).assign(agbd=y, id=np.arange(n), spatial_fold=rng.integers(0, folds, n))


@pytest.fixture(scope="module")
def data(spark):
    pdf = table()
    return spark.createDataFrame(pdf).repartition(5).persist(), pdf


def brute_tree(codes, g, h, depth, least, penalty):
    """Nested (feature, cut, left, right) or a leaf value, by trying every cut of every feature."""
    G, Hs = g.sum(), h.sum()
    leaf = -G / (Hs + penalty)
    if depth == 0:
        return leaf
    best = (1e-12, None)
    for j in range(codes.shape[1]):
        for cut in range(codes[:, j].max() + 1):
            left = codes[:, j] <= cut
            hl, hr = h[left].sum(), h[~left].sum()
            if hl < least or hr < least:
                continue
            gain = g[left].sum() ** 2 / (hl + penalty) + g[~left].sum() ** 2 / (hr + penalty) - G ** 2 / (Hs + penalty)
            if gain > best[0] + 1e-9:
                best = (gain, (j, cut))
    if best[1] is None:
        return leaf
    j, cut = best[1]
    left = codes[:, j] <= cut
    return (j, cut, brute_tree(codes[left], g[left], h[left], depth - 1, least, penalty),
            brute_tree(codes[~left], g[~left], h[~left], depth - 1, least, penalty))


def brute_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_boosting_equals_brute_force_in_a_task_and_on_a_table(data):
    df, pdf = data
    rows, edges = tree_cv.prepared(df, COLS, "id", bins=32)
    codes = H.codes_of(pdf[COLS].to_numpy(), edges)
    y = pdf.agbd.to_numpy()
    learner = H.Learner(3, rate=0.3, depth=3, least=5.0, penalty=1.0)
    margin = np.zeros(len(y))
    for _ in range(3):
        tree = brute_tree(codes, y.mean() + 0.3 * margin - y, np.ones(len(y)), 3, 5, 1.0)
        margin += [brute_value(tree, r) for r in codes]
    want = y.mean() + 0.3 * margin
    assert np.allclose(H.fit(codes, y, learner).predict(codes), want, atol=1e-9)
    everywhere, without = H.fit_everywhere(rows, [None, 2], learner, 3)
    assert np.allclose(everywhere.predict(codes), want, atol=1e-9)
    seen = (pdf.spatial_fold != 2).to_numpy()
    assert np.allclose(without.predict(codes), H.fit(codes[seen], y[seen], learner).predict(codes), atol=1e-9)
    assert np.allclose(H.Trees.unpacked(without.packed()).predict(codes), without.predict(codes))


def test_stored_margins_change_nothing(data, monkeypatch):
    df, _ = data
    rows, _ = tree_cv.prepared(df, COLS, "id", bins=16)
    learner = H.Learner(5, rate=0.3, depth=2, penalty=1.0, rows=0.7, columns=0.7)
    once = H.fit_everywhere(rows, [1], learner, 3)[0]
    monkeypatch.setattr(H, "STORED_ROUNDS", 2)
    again = H.fit_everywhere(rows, [1], learner, 3)[0]
    assert once.feature == again.feature and np.allclose(once.value, again.value)


def test_full_protocol_on_a_small_table(spark):
    """700 rounds and 350 trees of all four candidates, whole, on a table of 90 rows."""
    pdf = table(90, folds=2)
    out = tree_cv.nested(spark.createDataFrame(pdf), COLS, "dem", "id")
    oof, tuning = out["oof"].toPandas(), out["tuning"].toPandas()
    assert sorted(oof.id) == sorted(pdf.id) and np.isfinite(oof.prediction).all()
    assert len(tuning) == 2 * 1 * 4 and set(tuning.N) <= set(pdf.spatial_fold.value_counts())
    for fold, g in oof.groupby("fold"):
        mean = tuning[tuning.outer == fold].groupby(["model_family", "config"]).RMSE.mean().reset_index()
        best = mean.sort_values(["RMSE", "model_family", "config"]).iloc[0]
        assert g[["model_family", "config"]].drop_duplicates().values.tolist() == [[best.model_family, best.config]]
    models = {r.outer: (r.config, H.Trees.unpacked(bytes(r.model))) for r in out["models"].collect()}
    assert all(len(m.roots) == (700 if c.startswith("gbt") else 350) for c, m in models.values())
    error = oof.merge(pdf, on="id")
    assert ((error.prediction - error.agbd) ** 2).mean() < 0.5 * error.agbd.var()


def small():
    return H.learners(rounds=8, trees=4)


def test_importance_finds_the_signal_and_scores_every_row(data):
    df, pdf = data
    out = tree_cv.nested(df.withColumn("NDVI", F.lit(1.0)), COLS, "dem", "id", learners=small(), bins=32)
    got = tree_cv.importance(out, COLS, 2).toPandas()
    assert len(got) == 4 * 3 and got.groupby("outer").heldout_n.first().to_dict() == pdf.spatial_fold.value_counts().to_dict()
    mean = got.groupby("feature").importance_mean.mean()
    assert mean["elevation"] > max(0, mean["slope"]) and abs(mean["NDVI"]) < 1e-12


def test_deployed_model_is_saved_loaded_and_scored(data, tmp_path, spark):
    df, pdf = data
    model, tuning = tree_cv.deploy(df, COLS, "id", learners=small(), bins=32)
    assert tuning.count() == 4 * 4
    tree_cv.save(model, str(tmp_path / "m"))
    loaded = tree_cv.load(spark, str(tmp_path / "m"))
    a, b = (tree_cv.score(m, df.drop("agbd"), ["id"]).toPandas().set_index("id").prediction.sort_index() for m in (model, loaded))
    row = loaded.first()
    want = H.Trees.unpacked(bytes(row.model)).predict(H.codes_of(pdf[COLS].to_numpy(), [np.array(e) for e in row.edges]))
    assert np.allclose(a, b) and np.allclose(a, want) and row.n == len(pdf)


def test_blocks_and_cap(data, monkeypatch):
    df, _ = data
    whole = tree_cv.nested(df, COLS, "dem", "id", learners=small(), bins=16)["oof"].toPandas().sort_values("id")
    monkeypatch.setattr(tree_cv, "BLOCK_ROWS", 20)
    blocks = tree_cv.nested(df, COLS, "dem", "id", learners=small(), bins=16)["oof"].toPandas().sort_values("id")
    assert np.allclose(whole.prediction, blocks.prediction)
    capped = tree_cv.nested(df, COLS, "dem", "id", learners=small(), bins=16, cap=100)
    assert max(r.n for r in capped["models"].collect()) < 150 and capped["oof"].count() == 500


def test_tabulated_models_predict_as_their_trees_do():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (600, 2)).astype(np.uint8)
    y = codes[:, 0] / 9.0 + rng.normal(size=600)
    for learner in small().values():
        m = H.fit(codes, y, learner)
        every = np.stack(np.meshgrid(range(256), range(256), indexing="ij"), 2).reshape(-1, 2).astype(np.uint8)
        walked = m.base + m.scale * m.margins(every)
        assert np.allclose(m.predict(every), walked) and m._grid is not None
        assert np.allclose(m.predict(codes[:5]), m.base + m.scale * m.margins(codes[:5]))


def test_each_combination_of_bins_is_scored_once(spark, monkeypatch):
    """Rows that share their bins share a prediction: the trees see the distinct bins, and rows are not copied per model."""
    rows = [(i, i % 2, float(i), bytes([i % 3, 0])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, fold int, y double, bins binary")
    fits = {k: H.fit(np.array([[0, 0], [1, 0], [2, 0]] * 4, np.uint8), np.arange(12.0) % 3 * k, H.Learner(2, depth=2, least=1.0)) for k in (1, 2, 3)}
    models = spark.createDataFrame([(f, k, m.packed()) for f in (0, 1) for k, m in fits.items()], "fold int, kind int, model binary")
    stored = []
    monkeypatch.setattr(H, "materialize", lambda d, real=H.materialize: stored.append(real(d)) or stored[-1])
    got = H.score_cells(df, models, ["kind"], ["fold"]).toPandas()
    assert len(got) == 1800 and stored[0].count() == 6
    for (k, i), g in got.groupby(["kind", "id"]):
        assert len(g) == 1 and np.isclose(g.prediction.iloc[0], fits[k].predict(np.array([[i % 3, 0]], np.uint8))[0])


def test_every_few_shot_cell_of_every_representation_in_one_plan(data):
    df, pdf = data
    draws = sampling.label_draws(df, "id", folds=range(4), budgets=[25, 100], seeds=[42, 43])
    sets = {"dem": COLS[:2], "all": COLS}
    runs = tree_cv.over_representations(dict.fromkeys(sets, df), sets, lambda f, c: tree_cv.few_shot(f, draws, c, "id")).toPandas()
    assert len(runs) == 2 * 4 * 2 * 2 and (runs.N_train == runs.budget).all()
    assert (runs.N_test == runs.fold.map(pdf.spatial_fold.value_counts())).all()
    by = runs.groupby("budget").RMSE.mean()
    assert by[100] < by[25]
    cell = runs[(runs.representation == "all") & (runs.fold == 1) & (runs.budget == 100) & (runs.seed == 43)].iloc[0]
    ids = [r.id for r in draws.where("fold = 1 AND budget = 100 AND seed = 43").collect()]
    edges = H.bin_edges(df, COLS)
    train, test = pdf[pdf.id.isin(ids)].sort_values("id"), pdf[pdf.spatial_fold == 1]
    model = H.fit(H.codes_of(train[COLS].to_numpy(), edges), train.agbd.to_numpy(), H.FEW_SHOT, 43)
    error = model.predict(H.codes_of(test[COLS].to_numpy(), edges)) - test.agbd.to_numpy()
    assert cell.RMSE == pytest.approx(np.sqrt((error ** 2).mean()))


def test_moments_of_68_features_in_one_scan(spark):
    rng = np.random.default_rng(8)
    names = REPRESENTATIONS["embedding64"]
    x = rng.normal(size=(300, 68)) @ rng.normal(size=(68, 68)) + 1e4
    pdf = pd.DataFrame(x, columns=names).assign(agbd=x[:, 0] - x[:, 5] + rng.normal(size=300), id=range(300), spatial_fold=np.arange(300) % 3)
    df = spark.createDataFrame(pdf).repartition(7)
    folds = moments.grouped_moments(df, [*names, "agbd"], "spatial_fold")
    rest = moments.total(folds).minus(folds[1])
    part = pdf[pdf.spatial_fold != 1][[*names, "agbd"]].to_numpy()
    assert np.allclose(rest.mean, part.mean(0)) and np.allclose(rest.cross / rest.n, np.cov(part.T, bias=True), rtol=1e-6, atol=1e-6)
    got = source_cv.ridge_cv(df, names).select("id", "prediction").toPandas().set_index("id").prediction
    z = (part[:, :-1] - part[:, :-1].mean(0)) / part[:, :-1].std(0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(68), z.T @ (part[:, -1] - part[:, -1].mean())) / part[:, :-1].std(0)
    held = pdf[pdf.spatial_fold == 1]
    assert np.allclose(got.loc[held.id], part[:, -1].mean() + (held[names].to_numpy() - part[:, :-1].mean(0)) @ w, atol=1e-4)
    with pytest.raises(Exception, match="missing value"):
        moments.grouped_moments(df.withColumn("A00", F.when(F.col("id") == 5, None).otherwise(F.col("A00"))), names, "spatial_fold")


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    names = ["elevation", "slope", "NDVI", "EVI"]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=range(200), domain=["source"] * 120 + ["target"] * 80))
    scores, shares = domain_shift.source_pca(df, names, "domain", "source", "id", 2)
    z = (x - x[:120].mean(0)) / x[:120].std(0)
    _, s, v = np.linalg.svd(z[:120], full_matrices=False)
    assert np.allclose(shares, (s ** 2 / (s ** 2).sum())[:2])
    got = np.array([r.pc for r in scores.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(z @ v[:2].T))


@pytest.mark.parametrize("shift", [0.3, 6.0])
def test_newton_gradient_vanishes(spark, shift):
    """Also for two domains that are all but separated, where full steps go too far."""
    rng = np.random.default_rng(4)
    label = np.arange(400) % 2
    x = rng.normal(size=(400, 3)) + shift * label[:, None]
    pdf = pd.DataFrame(x, columns=COLS).assign(label=label.astype(float), spatial_fold=(np.arange(400) // 2) % 5)
    fits = logistic.fit_folds(spark.createDataFrame(pdf), COLS)
    assert sorted(fits) == list(range(5))
    for k, fit in fits.items():
        part = pdf[pdf.spatial_fold != k]
        z = (part[COLS].to_numpy() - part[COLS].to_numpy().mean(0)) / part[COLS].to_numpy().std(0)
        w = np.array(fit.weights)
        p = 1 / (1 + np.exp(-(w[0] + z @ w[1:])))
        gradient = np.append((p - part.label).sum(), z.T @ (p - part.label) + w[1:])
        assert np.abs(gradient).max() < 1e-6 and fit.steps < 30
    scored = logistic.held_out(spark.createDataFrame(pdf), fits)
    assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    with pytest.raises(GuardError):
        logistic.fit_folds(spark.createDataFrame(pdf), ["label", "lon"])


def test_domain_shift_row_of_every_representation(spark):
    rng = np.random.default_rng(6)
    n = 300
    x = rng.normal(size=(n, 3))
    domain = np.where(np.arange(n) < 180, "source", "target")
    x[domain == "target"] += 0.8
    pdf = pd.DataFrame(x, columns=COLS).assign(id=range(n), domain=domain, agbd=rng.normal(size=n), prediction=rng.normal(size=n))
    df = spark.createDataFrame(pdf)
    sets = {"one": COLS[:1], "all": COLS}
    rows = tree_cv.over_representations(dict.fromkeys(sets, df), sets, lambda f, c: domain_shift.shift_row(
        f, c, "domain", "source", "id", "agbd", "prediction")).toPandas().set_index("representation")
    target = pdf[pdf.domain == "target"]
    assert np.allclose(rows.target_mae, (target.agbd - target.prediction).abs().mean()) and (rows.n == len(target)).all()
    assert 0.6 < rows.auroc["one"] < rows.auroc["all"] < 1 and np.allclose(rows.variance_fraction, 1)
    z = (pdf[COLS] - pdf[pdf.domain == "source"][COLS].mean()) / pdf[pdf.domain == "source"][COLS].std(ddof=0)
    s, t = z[domain == "source"].to_numpy(), z[domain == "target"].to_numpy()
    near = np.sqrt(((t[:, None] - s[None]) ** 2).sum(2)).min(1)
    assert rows.distance_mean["all"] == pytest.approx(near.mean())
    rank = pd.Series(near).rank().corr((target.agbd - target.prediction).abs().reset_index(drop=True).rank())
    assert rows.rho["all"] == pytest.approx(rank) and 0 <= rows.p_value["all"] <= 1
