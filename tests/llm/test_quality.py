import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotransfer.llm import quality_rules as Q
from tests.llm import brute
from tests.llm.test_dedup import corpus, frame


def test_statistics_are_brute_force():
    odd = ["", None, " \n\t", "#*$ %&|<> é#", "a b c d e f g h i " * 5, "x\nx\n x\nx", "été\x85a b c", "w " * 5000]
    for t in odd + [t for _, t in corpus(8)]:
        assert Q.statistics(None if t is None else t.encode())[:5] == brute.statistics(t), t


def labelled(spark, n=600, seed=9):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < 0.3
        w = ["word%d" % r.randint(0, 500) for _ in range(r.randint(30, 80))]
        if bad:
            w = [x + r.choice(["###", "%%%"]) for x in w] if i % 2 else [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, 0 if bad else 1))
    bad = {i for i, t in rows if "#" in t or "%" in t or "!!" in t}
    return rows, labels, bad


def test_rules_find_held_out_documents(spark):
    rows, labels, bad = labelled(spark)
    df = frame(spark, rows)
    rules = Q.fit(df, spark.createDataFrame(labels + [(None, 1), (5000, 0)], "doc_id bigint, quality int"))
    assert 1 <= len(rules) <= 16 and all(1 <= len(r) <= 4 for r in rules)
    known = {i for i, _ in labels}
    kept = {r.id: r.kept for r in Q.judged(df, rules).collect() if r.id not in known}
    wrong = [i for i, k in kept.items() if k == (i in bad)]
    assert len(wrong) <= 0.02 * len(kept)


def test_verdict_expression_is_the_list(spark):
    rows, labels, _ = labelled(spark, 200)
    df = frame(spark, rows)
    rules = Q.fit(df, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    names = list(Q.features())
    out = Q.judged(df, rules).select(F.col("kept"), *[f.alias(k) for k, f in Q.features().items()]).toPandas()
    x = out[names].to_numpy(np.float64)
    hit = np.zeros(len(x), bool)
    for rule in rules:
        hit |= Q._covered(rule, names, x)
    assert (out["kept"].to_numpy() == ~hit).all()


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, None), (None, 0)]])
def test_without_labels_of_both_kinds_the_base_decides(spark, labels):
    rows = [(1, "a b"), (2, " ".join(f"x{k}" for k in range(40))), (None, None), (3, "a b c d e f g h " * 9)]
    df = frame(spark, rows)
    got = {(r.id, r.base_failed, r.kept) for r in Q.judged(df, Q.fit(df, spark.createDataFrame(
        labels, "doc_id bigint, quality int"))).collect()}
    assert got == {(1, True, False), (2, False, True), (None, True, False), (3, True, False)}


def test_empty_table_and_stage_columns(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    empty = frame(spark, [])
    assert Q.judged(empty, Q.fit(empty, none)).count() == 0
    df = frame(spark, corpus(10, 10))
    assert Q.stage(df, none).dtypes == df.dtypes
