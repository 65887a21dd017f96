"""Source mixing against exact fractions, its bounds, and odd tables."""

import re
from collections import defaultdict
from fractions import Fraction

from geotransfer.llm import source_mix
from geotransfer.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, source string, size string, row int, place int"


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        each = {s: Fraction(left * weight[s], sum(weight[o] for o in open_)) for s in open_}
        above = {s for s in open_ if each[s] > 3 * sizes[s]}
        if not above:
            return {s: float(each[s]) if s in each else float(3 * sizes[s]) for s in order}
        capped |= above


def hold(rows, given):
    """Targets are exact, copies within one of their expectation, and the words taken near the target."""
    sizes, longest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source in given:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        longest[source] = max(longest[source], n)
    want = targets(sizes)
    assert sorted(str((r.id, r.source)) for r in rows) == sorted(str((i, s)) for i, _, s in given)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-9 * want[r.source]
        each = r.target / r.source_size if r.source_size else 0
        assert abs(r.copies - each) < 1 and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * longest[s]
    assert abs(sum(want.values()) - sum(sizes.values())) <= 1e-6 * sum(sizes.values())


def test_query_holds_bounds_and_reruns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = source_mix.mixed(docs).collect()
    hold(rows, [(r.doc_id, r.text, r.source) for r in docs.collect()])
    again = source_mix.mixed(docs.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert QUERIES["op11_source_mix"](spark, SF).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_odd_rows(spark):
    """Null ids, texts and sources, empty and long texts, repeated rows, clashing names, tiny sources that reach the limit."""
    given = [(1, None, "a"), (2, "", "a"), (None, "one two", "a"), (None, "one two", "a"), (3, "w " * 5_000, "b"), (4, "x", "c"),
             (4, "x", "c"), (5, "\t\n", None), (6, "p q r", None), (7, "é \x0b ü", "Z"), (8, None, "none"), (9, "k " * 300, "d")]
    given += [(100 + k, "v " * (k % 17), "hot") for k in range(400)] + [(900, "same text", "hot")] * 200
    frame = spark.createDataFrame([(*g, "s", 1, 2) for g in given], SCHEMA)
    mix = source_mix.mixed(frame, keep=True)
    rows = mix.collect()
    hold(rows, given)
    assert all(r.row.asDict().keys() == {"doc_id", "text", "source", "size", "row", "place"} for r in rows)
    assert source_mix.emitted(mix).count() == sum(r.copies for r in rows)


def test_offsets_move_the_choice(spark):
    frame = spark.createDataFrame([(k, "w " * 3, "ab"[k % 2], "s", 1, 2) for k in range(60)], SCHEMA)
    picks = {tuple(sorted((r.id, r.copies) for r in source_mix.mixed(frame, weights=(1, 4), seed=s).collect())) for s in (1, 2, 3)}
    assert len(picks) > 1


def test_empty_and_wordless(spark):
    assert source_mix.mixed(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = source_mix.mixed(spark.createDataFrame([(1, None, "a", "", 0, 0), (2, " ", None, "", 0, 0)], SCHEMA)).collect()
    assert [(r.target, r.copies) for r in rows] == [(0.0, 0)] * 2


def test_native_plan(spark):
    plan = QUERIES["op11_source_mix"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
