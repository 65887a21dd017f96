import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geotransfer.operators import govern, guards, joins, metrics as M, qa
from geotransfer.operators.guards import GuardError
from geotransfer.plans import samples
from geotransfer.schemas import (C_BAND, DEM, EMBEDDING, INDICES, L_BAND, OPTICAL, REPRESENTATIONS)

KEYS = ["shot_number", "year"]


def frame(spark, rows, extra="x double"):
    return spark.createDataFrame(rows, f"shot_number string, year int, {extra}")


def test_duplicate_key_stops_one_to_one_join(spark):
    left = frame(spark, [("1", 2020, 1.0), ("2", 2020, 2.0)])
    right = frame(spark, [("1", 2020, 3.0)], "z double")
    assert joins.validated_join(left, right, KEYS).count() == 2
    for a, b in ((left.union(left), right), (left, right.union(right))):
        with pytest.raises(PySparkException, match="duplicate key"):
            joins.validated_join(a, b, KEYS).collect()


def test_many_to_one_allows_left_repeats_only(spark):
    left = frame(spark, [("1", 2020, 1.0)] * 3)
    right = frame(spark, [("1", 2020, 3.0)], "z double")
    assert joins.validated_join(left, right, KEYS, validate="many_to_one").count() == 3
    with pytest.raises(GuardError):
        joins.validated_join(left, right.union(right), KEYS, validate="many_to_one")


def test_join_adds_only_missing_columns(spark):
    left = frame(spark, [("1", 2020, 1.0)])
    right = frame(spark, [("1", 2020, 9.0, 3.0)], "x double, z double")
    r = joins.validated_join(left, right, KEYS).first()
    assert (r.x, r.z) == (1.0, 3.0)


def test_unique_join_shuffles_each_side_once(spark):
    a = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("x"))
    b = spark.range(1000).select(F.col("id").alias("k"), F.lit(2).alias("y"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.validated_join(a, b, ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_incomplete_join_stops(spark):
    left = frame(spark, [("1", 2020, 1.0), ("2", 2020, 2.0)])
    right = frame(spark, [("1", 2020, 3.0)], "z double")
    with pytest.raises(PySparkException, match="incomplete"):
        joins.complete_join(left, right, KEYS, ["z"]).collect()


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_lookup_join_same_rows_broadcast_or_salted(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "LOOKUP_BYTES", limit)
    big = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"))
    small = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "k long, v string")
    got = joins.lookup_join(big, small, ["k"])
    want = big.join(small, "k")
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0
    left = joins.lookup_join(big, small, ["k"], "left")
    assert left.count() == 5000


def test_compare_tables(spark):
    a = frame(spark, [("1", 1, 1.0), ("2", 1, 2.0), ("3", 1, None)])
    b = frame(spark, [("2", 1, 2.5), ("3", 1, None), ("4", 1, 0.0)])
    r = joins.compare_tables(a, b, KEYS, ["x"]).first()
    assert (r.left_n, r.right_n, r.common_n, r.left_only_n, r.right_only_n, r.x_mismatch_n) == (3, 3, 2, 1, 1, 1)
    assert joins.compare_tables(a, b, KEYS, ["x"], {"x": 1.0}).first().x_mismatch_n == 0


def test_paired_contrasts_need_every_fold(spark):
    rows = [("a", f, 0.5 + f) for f in range(5)] + [("b", f, 0.25 + f) for f in range(5)]
    m = spark.createDataFrame(rows, "representation string, outer_fold int, R2 double")
    out = joins.paired_contrasts(m, [("a", "b")], "outer_fold", ["R2"], expect=5)
    assert {round(r.delta_R2, 9) for r in out.collect()} == {0.25}
    with pytest.raises(GuardError):
        joins.paired_contrasts(m.where("outer_fold < 4"), [("a", "b")], "outer_fold", ["R2"], expect=5)
    with pytest.raises(PySparkException):
        joins.paired_contrasts(m.where("NOT (representation = 'a' AND outer_fold = 2)"), [("a", "b")],
                               "outer_fold", ["R2"]).collect()


def common_tables(spark, drop_radar=False):
    rows = [("1", 2020, 10.0, "a", 0), ("2", 2021, 20.0, "b", 1)]
    meta = spark.createDataFrame(rows, "shot_number string, year int, agbd double, spatial_block_id string, spatial_fold int")
    conv = meta.select("*", *[F.lit(1.0).alias(c) for c in C_BAND + OPTICAL + INDICES + DEM])
    emb = meta.select(*KEYS, *[F.lit(2.0).alias(c) for c in EMBEDDING])
    rad = meta.select(*KEYS, *[F.lit(0.2 if c == "palsar_rfdi" else 3.0).alias(c) for c in L_BAND],
                      F.lit(True).alias("palsar_valid"))
    return conv, emb, rad.where("year = 2020") if drop_radar else rad


CARRY = ["agbd", "spatial_block_id", "spatial_fold"]


def test_common_sample_keeps_identical_rows(spark):
    common = samples.keep_common(samples.common_sample(*common_tables(spark), carry=CARRY))
    frames = samples.representation_frames(common, CARRY)
    assert list(frames) == list(REPRESENTATIONS) and common.count() == 2
    joins.require_identical_rows(frames, [*KEYS, *CARRY], KEYS)
    moved = dict(frames, palsar_l=frames["palsar_l"].withColumn("agbd", F.col("agbd") + 1))
    with pytest.raises(GuardError):
        joins.require_identical_rows(moved, [*KEYS, *CARRY], KEYS)


def test_exclusions_and_missing_columns(spark):
    conv, emb, rad = common_tables(spark, drop_radar=True)
    wide = samples.common_sample(conv, emb, rad, carry=CARRY)
    r = qa.exclusion_counts(wide, samples.exclusion_reasons(rad)).first()
    assert (r.not_in_palsar_common_years, r.invalid_or_missing_palsar, r.missing_dem) == (1, 1, 0)
    assert samples.keep_common(wide).count() == 1
    with pytest.raises(GuardError):
        samples.common_sample(conv.drop("slope"), emb, rad, carry=CARRY)


def test_stage_protection(spark):
    blind = spark.createDataFrame([("1", None)], "shot_number string, AGBD double")
    filled = spark.createDataFrame([("1", 2.0), ("2", None)], "shot_number string, AGBD double")
    guards.protect_stage("model_tuning", target=blind, other=blind.drop("AGBD"))
    guards.protect_stage("evaluation", target=filled)
    with pytest.raises(GuardError):
        guards.protect_stage("model_tuning", target=filled)
    inputs = guards.stage_inputs("any_stage", target=filled)
    assert guards.protected_inputs(inputs).count() == 0
    allowed = spark.createDataFrame([("evaluation",)], "stage string")
    assert guards.protected_inputs(inputs, allowed).count() == 1


def test_predictors_have_to_be_numeric_columns(spark):
    df = spark.createDataFrame([(1.0, "x")], "Slope double, name string")
    assert guards.safe_predictors(["slope"], df.schema) == ["slope"]
    for wrong in (["name"], ["absent"], ["slope", "SLOPE"], ["agbd"]):
        with pytest.raises(GuardError):
            guards.safe_predictors(wrong, df.schema)


def test_fingerprint_ignores_order_and_sees_change(spark):
    df = spark.range(500).select("id", (F.col("id") * 1.5).alias("x"))
    a = govern.fingerprint_text(df)
    assert govern.fingerprint_text(df.repartition(9).orderBy(F.desc("id"))) == a
    assert govern.fingerprint_text(df.withColumn("x", F.when(F.col("id") == 3, 0.0).otherwise(F.col("x")))) != a
    assert govern.fingerprint_text(df.union(df.limit(1))) != a


@pytest.mark.parametrize("a,b", [((None, "5"), ("5", None)), ((None, "N;"), ("N;", None)), (("1:", "x"), ("1", ":x")),
                                 (("a|b", "c"), ("a", "b|c")), (("\\N", "1"), (None, "1"))])
def test_hashes_tell_places_and_missing_values_apart(spark, a, b):
    schema = "x string, y string"
    one, two = spark.createDataFrame([a], schema), spark.createDataFrame([b], schema)
    assert govern.fingerprint_text(one) != govern.fingerprint_text(two)
    for columns in (["x", "y"],):
        h = [df.agg(govern.content_hash(columns)).first()[0] for df in (one, two)]
        assert h[0] != h[1]
        r = [govern.ordered_row_hashes(df, ["x"], columns).first().row_hash for df in (one, two)]
        assert r[0] != r[1]


def test_ordered_hashes_see_order(spark):
    df = frame(spark, [("1", 1, 1.0), ("2", 1, 2.0)])
    a = govern.ordered_row_hashes(df, ["shot_number"], KEYS).collect()
    b = govern.ordered_row_hashes(df, ["x"], KEYS).collect()
    c = govern.ordered_row_hashes(df.withColumn("o", -F.col("x")), ["o"], KEYS).collect()
    assert {r.row_hash for r in a} == {r.row_hash for r in b} != {r.row_hash for r in c}


def test_schema_hashes(spark):
    t = govern.schema_hashes(spark, REPRESENTATIONS).collect()
    assert len({r.schema_hash for r in t}) == 8
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert govern.schema_hash(df.schema) != govern.schema_hash(df.select("b", "a").schema)
    assert govern.schema_hash(df.schema) != govern.schema_hash(df.withColumn("a", F.col("a").cast("long")).schema)
    import hashlib
    assert govern.schema_hash(df.schema) == hashlib.sha256(b"struct<a:int,b:double>").hexdigest()


def test_label_lock(spark):
    pred = frame(spark, [("1", 2020, 1.0), ("2", 2020, 2.0)], "prediction double")
    labels = frame(spark, [("1", 2020, 1.5), ("2", 2020, 2.5)], "agbd double")
    freeze = govern.freeze_row(pred, "zero_shot", "m")
    assert govern.unlock(pred, labels, freeze, "zero_shot", "m").count() == 2
    with pytest.raises(GuardError, match="locked"):
        govern.unlock(pred, labels, freeze.where("false"), "zero_shot", "m")
    with pytest.raises(GuardError, match="changed"):
        govern.unlock(pred.withColumn("prediction", F.col("prediction") + 1e-9), labels, freeze, "zero_shot", "m")
    with pytest.raises(GuardError, match="response"):
        govern.require_label_free(labels)
    with pytest.raises(PySparkException, match="no label"):
        govern.unlock(pred, labels.limit(1), freeze, "zero_shot", "m").collect()


def test_freeze_chain(spark):
    df = frame(spark, [("1", 2020, 1.0)])
    row = govern.freeze_row(df, "sample", "source")
    govern.require_chain(row, govern.freeze_row(df, "sample", "source"))
    with pytest.raises(GuardError):
        govern.require_chain(row, govern.freeze_row(df.union(df), "sample", "source"))


def test_freeze_summary_has_no_private_columns(spark):
    df = spark.createDataFrame([("1", 2020, "a", 0, 1.0), ("2", 2021, "b", 1, 2.0)],
                               "shot_number string, year int, block string, fold int, agbd double")
    r = govern.freeze_summary(df, "block", "fold").first().asDict()
    assert r["years"] == [2020, 2021] and r["fold_counts"] == {"0": 1, "1": 1} and r["n"] == 2
    assert not {"shot_number", "lon", "lat"} & set(r)
    full = govern.freeze_summary(df, "block", "fold", features=REPRESENTATIONS, exclusions={"missing_dem": 3}).first()
    assert len(full.feature_schema_hashes) == 8 and full.exclusion_counts == {"missing_dem": 3}
    other = govern.freeze_summary(df.withColumn("agbd", F.col("agbd") + 1), "block", "fold").first()
    assert other["sample_ids_hash"] == r["sample_ids_hash"] and other["response_hash"] != r["response_hash"]


def test_metrics_edge_cases(spark):
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "agbd double, prediction double")
    assert M.metrics(flat).first().R2 == 0.0
    assert M.metrics(flat.withColumn("prediction", F.col("agbd"))).first().R2 == 1.0
    assert M.metrics(flat.limit(1)).first().R2 is None
    bad = spark.createDataFrame([(1.0, 4.0), (2.0, 1.0), (3.0, 9.0)], "agbd double, prediction double")
    assert M.metrics(bad).first().R2 == pytest.approx(1 - (9 + 1 + 36) / 2)  # negative, unlike a squared correlation


def test_threshold_is_strict_and_reports_not_reached(spark):
    s = spark.createDataFrame([("m", 25, 0.2), ("m", 50, 0.3)], "method string, budget int, R2_mean double")
    got = {r.R2_threshold: r.labels_required for r in M.label_thresholds(s, ["method"]).collect()}
    assert got == {0.0: "25", 0.2: "50", 0.4: "not reached", 0.5: "not reached"}


def test_tied_candidates_go_to_the_smaller_name(spark):
    t = spark.createDataFrame([("rf", "b", 1.0), ("rf", "a", 1.0), ("gbt", "z", 1.0)], "model string, config string, RMSE double")
    assert M.best_by_error(t).first()[:2] == ("gbt", "z")


def test_stage_rollup(spark):
    """Stage roll-up: yearly counts add up to the totals and percentages of the first stage."""
    counts = spark.createDataFrame([(2019, 100, 80, 80, 40, 30, 30, 30), (2020, 50, 50, 45, 20, 20, 20, 19)],
                                   "year int, " + ", ".join(f"{n} long" for n in qa.QA_STAGES))
    rows = qa.cascade_table(counts.drop("year")).orderBy("stage").collect()
    assert [r.n_after for r in rows] == [150, 130, 125, 60, 50, 50, 49]
    assert rows[0].removed_at_stage is None and rows[3].removed_at_stage == 65
    assert rows[6].retained_from_raw_percent == pytest.approx(49 / 150 * 100)


def test_bounded_guard(spark):
    df = spark.createDataFrame([(0.5,), (1.0000005,)], "NDVI double")
    qa.require_bounded(df, ["NDVI"])
    with pytest.raises(GuardError):
        qa.require_bounded(df.union(spark.createDataFrame([(1.5,)], "NDVI double")), ["NDVI"])
