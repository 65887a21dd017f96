"""The domain-shift table: what its feature sets share, rows without an error, and the first Newton step."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geotransfer.operators import stats
from geotransfer.plans import domain_shift, logistic
from geotransfer.queries import modelling

SF = "/root/testdata/sf0.001"


def test_folds_and_error_ranks_are_made_once_for_all_sets(spark, monkeypatch):
    made = []
    for name in ("stratified_folds", "average_ranks"):
        monkeypatch.setattr(domain_shift, name, lambda *a, real=getattr(domain_shift, name), name=name: made.append(name) or real(*a))
    ranked = []
    monkeypatch.setattr(stats, "average_ranks", lambda df, by, value, *a, real=stats.average_ranks: ranked.append(value) or real(df, by, value, *a))
    got = modelling.domain_shift_table(spark, SF).toPandas()
    assert made == ["stratified_folds", "average_ranks"] and ranked == ["_x"] * 3
    assert sorted(got.representation) == ["both", "first", "second"] and got.n.nunique() == 1


def test_rows_without_an_error_keep_their_distance(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(200), "a": rng.normal(size=200), "domain": ["source"] * 120 + ["target"] * 80, "y": rng.normal(size=200), "p": 0.0})
    df = spark.createDataFrame(pdf).withColumn("p", F.when(F.col("id") % 4 == 0, None).otherwise(F.col("p")))
    got = domain_shift.shift_row(df, ["a"], "domain", "source", "id", "y", "p").first()
    t, s = pdf[pdf.domain == "target"], pdf[pdf.domain == "source"].a
    near = np.abs(t.a.to_numpy()[:, None] - s.to_numpy()[None]).min(1) / s.std(ddof=0)
    has = (t.id % 4 != 0).to_numpy()
    assert got.distance_mean == pytest.approx(near.mean()) and got.distance_median == pytest.approx(np.median(near))
    assert got.n == has.sum() and got.target_mae == pytest.approx(t.y[has].abs().mean())
    assert got.rho == pytest.approx(pd.Series(near[has]).rank().corr(t.y[has].abs().reset_index(drop=True).rank()))


def test_the_first_newton_step_needs_no_scan(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(300, 2)), columns=["slope", "NDVI"]).assign(label=np.arange(300) % 2 * 1.0, spatial_fold=np.arange(300) // 2 % 3)
    pdf.slope += pdf.label
    df, scans = spark.createDataFrame(pdf), []
    monkeypatch.setattr(logistic, "_sums", lambda *a, real=logistic._sums: scans.append(a[2]) or real(*a))
    fits = logistic.fit_folds(df, ["slope", "NDVI"])
    assert len(scans) == max(f.steps for f in fits.values())
    x = pdf[pdf.spatial_fold != 1]
    z = (x[["slope", "NDVI"]] - x[["slope", "NDVI"]].mean()) / x[["slope", "NDVI"]].std(ddof=0)
    hessian = np.diag([len(x) / 4, 1.0, 1.0])
    hessian[1:, 1:] += z.T @ z / 4
    first = np.linalg.solve(hessian, np.append((x.label - 0.5).sum(), z.T @ (x.label - 0.5)))
    assert np.allclose(scans[0][1][0], first)
