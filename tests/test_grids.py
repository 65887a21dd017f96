"""Trees on sums of bins against the learner on rows, and that tree queries fit every row."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geotransfer.plans import grids as G, histograms as H, tree_cv
from geotransfer.queries import modelling

COLS = ["elevation", "slope"]
SF = "/root/testdata/sf0.01"


LEARNERS = H.learners


def small():
    return LEARNERS(rounds=8, trees=4)


def rows_of(n=20_000, seed=1, high=40):
    """Responses are whole numbers, so sums in any order are equal."""
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, high, (n, 2)).astype(np.uint8)
    return codes, codes[:, 0] + codes[:, 1] ** 2 % 7 + rng.integers(0, 50, n) * 1.0, rng.integers(0, G.GROUPS, n)


def summed(codes, y, group):
    cell, size = G.cells_of(codes), G.SIDE ** codes.shape[1]
    counts, totals = np.zeros((G.GROUPS, size)), np.zeros((G.GROUPS, size))
    np.add.at(counts, (group, cell), 1)
    np.add.at(totals, (group, cell), y)
    at = np.flatnonzero(counts.any(0))
    return at, counts[:, at], totals[:, at], codes.shape[1]


@pytest.mark.parametrize("learner", [
    H.Learner(5, rate=0.3, depth=4, penalty=1.0), H.Learner(12, rate=0.1, depth=8, least=10.0, penalty=1.0, columns=0.5),
    H.Learner(2, depth=30), H.Learner(3, depth=30, node_columns=0.5), H.Learner(2, depth=0)])
@pytest.mark.parametrize("features", [1, 2])
def test_trees_on_sums_equal_trees_on_rows(learner, features):
    codes, y, group = rows_of()
    codes = codes[:, :features]
    model = G.fit(*summed(codes, y, group), learner)
    assert np.allclose(model.predict(codes), H.fit(codes, y, learner).predict(codes), atol=1e-9)
    again = H.Trees.unpacked(model.packed())
    assert np.array_equal(again.predict(codes), model.predict(codes)) and again.rounds == learner.rounds


def test_a_tree_sees_exactly_the_drawn_groups():
    codes, y, group = rows_of(4000)
    learner = H.Learner(1, rate=1.0, depth=3, rows=0.8)
    drawn = np.random.default_rng([42, 1]).permutation(G.GROUPS)[:H.share_of(G.GROUPS, 0.8)]
    assert len(drawn) == 0.8 * G.GROUPS
    use = np.isin(group, drawn)
    trees, base = H.Trees(y.mean(), 1.0), y.mean()
    H.grow(trees, codes, (base - y) * use, use * 1.0, learner, np.arange(2), np.random.default_rng(0))
    assert np.allclose(G.fit(*summed(codes, y, group), learner, seed=42).predict(codes), trees.predict(codes), atol=1e-9)


def test_a_forest_on_sums_is_as_good_as_one_on_rows():
    codes, y, group = rows_of(20_000, 5)
    signal = codes[:, 0] + codes[:, 1] ** 2 % 7
    learner = H.Learner(30, node_columns=0.5, least=20.0, forest=True)
    error = [np.sqrt(np.mean((m.predict(codes) - signal - (y - signal).mean()) ** 2))
             for m in (G.fit(*summed(codes, y, group), learner), H.fit(codes, y, learner))]
    assert error[0] < 1.1 * error[1]


def test_models_without_a_cap_see_every_row_and_sums_do_not_depend_on_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(900, 2)), columns=COLS).assign(agbd=rng.integers(0, 90, 900) * 1.0, id=range(900), spatial_fold=np.arange(900) % 4)
    df = spark.createDataFrame(pdf)
    runs = []
    for part_rows in (G.PART_ROWS, 2):
        monkeypatch.setattr(G, "PART_ROWS", part_rows)
        out = tree_cv.nested(df, COLS, "pair", "id", learners=small(), cap=None, bins=32)
        runs.append(out["oof"].toPandas().sort_values("id").prediction)
        assert {r.n for r in out["models"].collect()} == {675}
        assert out["tuning"].count() == 4 * 3 * 4 and out["oof"].count() == 900
    assert np.allclose(*runs, atol=1e-9)
    model, _ = tree_cv.deploy(df, COLS, "id", learners=small(), cap=None, bins=32)
    assert model.first().n == 900


def test_nested_queries_fit_every_row_of_the_other_folds(spark, monkeypatch):
    monkeypatch.setattr(H, "learners", small)
    monkeypatch.setattr(modelling, "stored_once", lambda s, key, build: build())
    models = modelling._nested(spark, SF)["models"]
    size = {r.fold: r.n for r in modelling.view(spark, SF, "foot").groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert {r.outer: r.n for r in models.collect()} == {k: sum(size.values()) - n for k, n in size.items()}


def test_deployed_query_model_fits_every_source_row(spark, monkeypatch):
    monkeypatch.setattr(H, "learners", small)
    seen = []
    monkeypatch.setattr(tree_cv, "deploy", lambda *a, real=tree_cv.deploy, **k: seen.append(real(*a, **k)) or seen[-1])
    modelling.deployment_and_zero_shot(spark, SF).collect()
    assert seen[0][0].first().n == modelling.view(spark, SF, "foot").where("domain = 'source'").count()


def test_importance_equals_permuting_whole_folds_and_stores_no_rows(spark, monkeypatch):
    """Blocks of a fold are random parts of it, so permuting them is as good as permuting the fold; what is stored are sums."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame(rng.normal(size=(4000, 2)), columns=COLS).assign(id=range(4000), spatial_fold=np.arange(4000) % 3)
    pdf["agbd"] = 10 * pdf.elevation + 3 * pdf.slope + rng.normal(size=4000)
    out = tree_cv.nested(spark.createDataFrame(pdf), COLS, "pair", "id", learners=LEARNERS(rounds=60, trees=10), cap=None, bins=32)
    rows = out["rows"].toPandas()
    want = {}
    for r in out["models"].collect():
        held, model = rows[rows.fold == r.outer], H.Trees.unpacked(bytes(r.model))
        codes, y = np.array([list(b) for b in held.bins], np.uint8), held.y.to_numpy()
        plain = np.sqrt(np.mean((model.predict(codes) - y) ** 2))
        for j, f in enumerate(COLS):
            rise = []
            for _ in range(20):
                swapped = codes.copy()
                swapped[:, j] = rng.permutation(codes[:, j])
                rise.append(np.sqrt(np.mean((model.predict(swapped) - y) ** 2)) - plain)
            want[r.outer, f] = np.mean(rise)
    for block_rows in (tree_cv.BLOCK_ROWS, 200):
        stored = []
        monkeypatch.setattr(tree_cv, "BLOCK_ROWS", block_rows)
        monkeypatch.setattr(tree_cv, "materialize", lambda d, real=H.materialize: stored.append(real(d)) or stored[-1])
        got = tree_cv.importance(out, COLS, 3).toPandas()
        assert (got.heldout_n == got.outer.map(rows.fold.value_counts())).all() and (got.importance_sd > 0).all()
        assert got.importance_mean.to_numpy() == pytest.approx([want[o, f] for o, f in zip(got.outer, got.feature)], rel=0.08)
        blocks = sum(-(-n // block_rows) for n in rows.fold.value_counts())
        assert [d.count() for d in stored] == [blocks * 7] and "bins" not in stored[0].columns
