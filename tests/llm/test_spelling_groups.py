"""Spelling variants against plain counting and all deletions of all words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from geotransfer.llm import spelling_groups
from geotransfer.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, word string, n string, id int"


def plain_words(docs, thinned=31):
    out = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if thinned and h % thinned == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def plain_groups(words):
    stems, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            stems[w[:k] + w[k + 1:], k].add(w)
    for (rest, k), group in stems.items():
        for w in group:
            near[w] |= group - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 10 * n:
                form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def result(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = result(QUERIES["op13_spelling_groups"](spark, SF))
    assert got == plain_groups(plain_words(docs)) and any(v[0] for v in got.values())


def variants(rng, count):
    """Words of few syllables, so that every gram is frequent somewhere, with chains of forms."""
    words, parts = {}, ["ab", "ba", "aab", "tion", "éa", "aaa", "b"]
    while len(words) < count:
        w = "".join(rng.choice(parts) for _ in range(rng.randint(3, 6)))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            words.setdefault(w, rng.choice([2, 3, 25, 30, 400, 5_000, 70_000])) if len(w) >= 7 else None
            w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abté") + w[k:], w[:k] + rng.choice("abté") + w[k + 1:]])
    return words


@pytest.mark.parametrize("limit", [1, 5, 40, 10_000])
def test_all_near_words_at_any_gram_limit(spark, limit):
    words = variants(random.Random(limit), 700)
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    want = plain_groups(words)
    assert result(spelling_groups.grouped(frame, limit)) == want
    assert max(v[3] for v in want.values()) > 5 and sum(1 for v in want.values() if v[0]) > 50


def test_lists_hold_no_more_words_than_the_limit(spark):
    words = variants(random.Random(9), 700)
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    frequent, lists = spelling_groups.frequent_grams(frame, 12), Counter()
    for w in words:
        lists.update({key for key, _ in spelling_groups.index_rows(w, *spelling_groups.bounds(w, frequent)) if key[0] in "LR"})
    assert max(lists.values()) <= 12
    assert frequent and all(sum(g in w for w in words) > 12 for g in frequent)


def test_odd_texts(spark):
    """Nulls, empty and very long texts and runs, repeated rows, clashing names, letters outside the range."""
    docs = [(1, None), (2, ""), (None, "Letters letterS lettexs"), (None, "Letters letterS lettexs"), (3, "x" * 40_000 + " lettters"),
            (4, "x" * 40_000 + " lettters letters1letters"), (5, "ÀBÇDÉFG àbçdéfg İstanbul ×÷ÿabcd"),
            (5, "ÀBÇDÉFG àbçdéfg İstanbul ×÷ÿabcd"), (6, "letters " * 3_000)]
    frame = spark.createDataFrame([(*d, "w", "n", 1) for d in docs], SCHEMA)
    for thinned in (None, 2, 31):
        words = spelling_groups.word_counts(frame, thinned=thinned)
        assert {r.word: r.n for r in words.collect()} == plain_words(docs, thinned)
        assert result(spelling_groups.grouped(words)) == plain_groups(plain_words(docs, thinned))


@pytest.mark.parametrize("long", [8, 12])
def test_long_words_in_pairs(long, monkeypatch):
    monkeypatch.setattr(spelling_groups, "LONG", long)
    words = variants(random.Random(3), 500)
    for limit in (0, 3, 50):
        grams = Counter(g for w in words for g in {w[a:b] for a in range(len(w)) for b in range(a + 3, len(w) + 1)})
        frequent = frozenset(g for g, n in grams.items() if n > limit)
        lists, near = defaultdict(list), Counter()
        for w, n in words.items():
            for key, site in spelling_groups.index_rows(w, *spelling_groups.bounds(w, frequent)):
                lists[key].append((w, n, site))
        for key, rows in lists.items():
            near.update({w: c for w, (c, _) in spelling_groups.merged_list(key, rows).items()})
        assert {w: near[w] for w in words} == {w: v[3] for w, v in plain_groups(words).items()}


def test_very_long_words(spark):
    words = {"x" * 40_000: 2, "x" * 39_999: 30, "y" + "x" * 39_999: 400, "x" * 20_000 + "y" + "x" * 19_999: 3, "x" * 39_998 + "yy": 2}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {w: (v[0], v[2], v[3]) for w, v in result(spelling_groups.grouped(frame)).items()}
    a, b, c, d, e = words
    assert got == {a: (c, 2, 3), b: (c, 30, 3), c: (None, 400, 2), d: (b, 3, 2), e: (None, 2, 0)}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert result(spelling_groups.grouped(spelling_groups.word_counts(none))) == {}
