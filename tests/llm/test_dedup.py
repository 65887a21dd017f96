import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from geotransfer.llm import line_dedup, simhash_index, substring_dedup
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, tag string, pos string, hi string"  # clashing extra columns


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = [f"w{k}é" for k in range(400)]
    passage = [r.choice(vocab) for _ in range(70)]
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(0, 90))]
        if i % 3 == 0:
            a = r.randint(0, 30)
            w = w[:20] + passage[a:a + r.randint(15, 40)] + w[20:]
        text = ""
        for k, x in enumerate(w):
            text += x + r.choice([" ", " ", "  ", "\n", "\t"])
        rows.append((i * 7 % 101, text))
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "the " * 300), (204, rows[0][1]), (None, rows[3][1])]
    return rows


@pytest.mark.parametrize("slots", [1 << 20, 1 << 22])
def test_substring_dedup_is_brute_force(spark, slots):
    rows = corpus()
    got = {r.id: r for r in substring_dedup.remove_repeats(frame(spark, rows), max_slots=slots).collect()}
    want = brute.substring_dedup(rows)
    assert len(got) == len(rows)
    for i, (kept, removed) in want.items():
        assert got[i].text == " ".join(kept) and got[i].n_removed == removed, i
        assert got[i].rest.pos == "y"


def test_substring_dedup_saturated_sketch_loses_nothing(spark, monkeypatch):
    """With every slot marked repeated, all windows reach the exact pass."""
    rows = corpus(2)
    bits = substring_dedup.PACK.compress(bytes([255]) * ((1 << 20) // 8))
    full = ([(0, 0, bits), (1, 0, bits)], 1 << 20)
    monkeypatch.setattr(substring_dedup, "repeated_mask", lambda *a: full)
    got = {r.id: r.text for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {i: " ".join(k) for i, (k, _) in brute.substring_dedup(rows).items()}


def test_substring_dedup_repeated_rows_and_empty_table(spark):
    text = " ".join(f"a{k}" for k in range(30))
    out = substring_dedup.remove_repeats(frame(spark, [(5, text), (5, text), (6, text)]))
    assert sorted((r.id, r.n_removed) for r in out.collect()) == [(5, 0), (5, 0), (6, 30)]
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_stages_keep_columns(spark):
    rows = corpus(3, 20)
    df = frame(spark, rows).withColumn("n_chars", F.lit(-1).cast("bigint"))
    for stage in (substring_dedup.stage, line_dedup.stage, simhash_index.stage):
        out = stage(df)
        assert out.columns == df.columns and out.dtypes == df.dtypes
        assert out.where("tag <> 'x' OR pos <> 'y'").count() == 0


def lines_corpus(seed=4, n=80):
    r = random.Random(seed)
    common = ["Share this", "  share THIS\t", "Cookies é", "cookies É", "x"]
    rows = []
    for i in range(n):
        lines = [f"own {i} {k}" for k in range(r.randint(0, 4))]
        for _ in range(r.randint(0, 3)):
            lines.insert(r.randint(0, len(lines)), r.choice(common))
        if i % 9 == 0:
            lines += ["rare", "rare", ""]
        rows.append((i, "\n".join(lines)))
    return rows + [(500, None), (501, ""), (502, "\n\n \n"), (503, "Share this\n" * 200 + "end")]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("parts", ["1", "8", "60"])
def test_line_dedup_is_brute_force(spark, keep_first, parts):
    rows = lines_corpus()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = frame(spark, rows)
        got = {r.id: (r.text, r.n_dropped) for r in line_dedup.apply_bitmaps(
            df, line_dedup.keep_bitmaps(df, min_docs=10, keep_first=keep_first)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: w for (i, _), w in zip(rows, brute.line_dedup(rows, 10, keep_first))}


def test_line_dedup_null_ids_repeats_and_empty_table(spark):
    rows = [(1, "a\nb")] * 9 + [(None, "A \nc")]
    df = frame(spark, rows)
    got = sorted((r.id or 0, r.text, r.n_dropped) for r in line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df)).collect())
    assert got == [(0, "c", 1)] + [(1, "b", 1)] * 9
    assert line_dedup.keep_bitmaps(frame(spark, [])).count() == 0


def test_fingerprint_is_brute_force():
    for _, t in corpus(5) + [(0, "a b c"), (0, "A b C d"), (0, "a b c d e")]:
        assert simhash_index.fingerprint((t or "").encode()) == brute.simhash(t)


@pytest.mark.parametrize("unit", [50_000, 40])
def test_index_finds_the_components_of_all_pairs(spark, unit):
    r = np.random.default_rng(6)
    base = r.integers(0, 2 ** 63, 60, dtype=np.int64)
    fps = set(base.tolist()) | {0, -1, 1 << 62, -(1 << 63)}
    for b in base[:40]:
        x = int(b)
        for _ in range(12):  # chains and clusters
            x ^= sum(1 << int(k) for k in r.choice(63, r.integers(1, 6), replace=False))
            fps.add(x)
    hub = int(base[50])
    fps |= {hub ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 63, (300, 2))}
    fps = sorted(fps)
    links = simhash_index.near_links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), unit=unit)
    roots = {x.v: x.root for x in simhash_index.components(links).collect()}
    want = brute.components([(f, f & (2 ** 64 - 1)) for f in fps])
    group = {}
    for f, w in zip(fps, want):
        group.setdefault(w, set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in group.values()) and len({min(g) for g in group.values()}) == len(group)


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(k, k + 1) for k in range(n)], "a bigint, b bigint")
    assert simhash_index.components(links).agg(F.countDistinct("root"), F.count("*")).first()[:] == (1, n + 1)


def test_near_duplicates_on_texts(spark):
    rows = corpus(7) + [(300, "alpha beta gamma"), (301, "ALPHA  beta\ngamma"), (300, "alpha beta gamma")]
    got = sorted((r.id is not None, r.id or 0, r.fp & (2 ** 64 - 1), r.component_id)
                 for r in simhash_index.near_duplicates(frame(spark, rows)).collect())
    prints = [(i, brute.simhash(t)) for i, t in rows]
    want = sorted((i is not None, i or 0, f, c) for (i, f), c in zip(prints, brute.components(prints)))
    assert got == want
    assert simhash_index.near_duplicates(frame(spark, [])).count() == 0


def test_simhash_stage_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "z y x w v u t"), (3, None), (4, ""), (None, "q r s t u v")]
    kept = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in simhash_index.stage(frame(spark, rows)).collect())
    assert kept == [(False, 0, "q r s t u v"), (True, 1, "a b c d e f"), (True, 3, ""), (True, 3, "z y x w v u t")]


def test_kept_digest_matches_text(spark):
    out = substring_dedup.remove_repeats(frame(spark, [(1, "b  a\nc")])).select("text", F.sha2("text", 256).alias("h")).first()
    assert out.h == hashlib.sha256(b"b a c").hexdigest() and isinstance(T.LongType(), T.DataType)


def clashing():
    """Two texts of one CRC-32, which once told rows of one id apart, with a line in common."""
    seen = {}
    for k in range(1_000_000):
        text = f"first {k}\nshared line\nlast {3 * k}"
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            return other, text


def test_texts_of_one_checksum_and_id_stay_apart(spark):
    texts = clashing()
    rows = [(None, t) for t in texts]
    bitmaps = line_dedup.keep_bitmaps(frame(spark, rows), min_docs=2)
    out = line_dedup.apply_bitmaps(frame(spark, rows), bitmaps)
    assert sorted((r.text, r.n_dropped) for r in out.collect()) == sorted((t.replace("\nshared line", ""), 1) for t in texts)
    passage = " ".join(f"w{k}" for k in range(25))
    lost = sorted(r.n_removed for r in substring_dedup.remove_repeats(frame(spark, [(None, f"{t} {passage}") for t in texts])).collect())
    assert lost == [0, 25]


def test_a_row_repeated_very_often(spark):
    rows = [(1, "one line\nanother line\none line")] * 100_000 + [(2, "another line\nown line")]
    bitmaps = line_dedup.keep_bitmaps(frame(spark, rows))
    assert sorted((r.id, r.n_dropped) for r in bitmaps.collect()) == [(1, 3), (2, 1)]
    out = line_dedup.apply_bitmaps(frame(spark, rows), bitmaps)
    assert {r.text for r in out.select("text").distinct().collect()} == {"", "own line"}
