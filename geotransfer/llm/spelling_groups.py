"""Spelling variants: words one edit apart, found through an index of variable-length grams.

The gram dictionary grows level by level from ``SHORTEST`` code points and is pruned by frequency:
only grams found in more than a limit of words are extended. A word's gram at a place is the
shortest one there that is not frequent; a gram cut off by the word's end while still frequent is
open. A gram depends on its own letters alone, so an edit affects only the grams that it lies in.

Every word keeps two bounds from this: ``e``, the end of the shortest prefix that ends a rare gram,
and ``p``, the start of the shortest suffix that starts with one. An edit at or after ``e`` leaves
the prefix whole; one before ``p`` leaves the suffix whole. So a word stands in the list of its
prefix for the edits from ``e`` on, in the list of its suffix for the edits before ``p`` that the
prefix does not serve, and for the few edits between, where no gram is rare enough, in the merge
of both open lists: the key is then all that the edit leaves on both sides. The place of an edit
and the letters around it are the same for both words, so both choose the same list, once. Lists
hold at most as many words as the limit; words in a list are verified letter by letter.

The limit grows with the words, so that at most ``LEVEL_GRAMS`` grams a level are frequent: these
are all that the tasks are sent. Counts cover every word; nothing is sampled or capped.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geotransfer.llm.common import mapped, slices
from geotransfer.operators.joins import null_safe_join
from geotransfer.session import materialize

SHORTEST, LONGEST = 3, 16
LIST_WORDS, LEVEL_GRAMS = 256, 50_000
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
LONG = 200  # words beyond this length are compared in pairs of a list, not by all their shortened forms
HELD = 200_000  # words counted in a task before they are sent
_LOWER = {c: c + 32 for c in range(65, 91)}


# ---------------------------------------------------------------- words

def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, thinned: int | None = None) -> DataFrame:
    """``word`` and ``n``: maximal runs of Latin letters with A-Z lower-cased, long and frequent enough.

    With ``thinned`` a run whose checksum ``crc32(id:run)`` it divides loses one letter first
    (planted variants for the registered query). Null texts have no words; a null id is written
    as nothing before the colon. Runs are counted per task before the shuffle. An empty table has no words.
    """
    pattern = re.compile(rf"[a-zÀ-ÿ]{{{least_length},}}")

    def thin(prefix: str, run: str) -> str:
        h = zlib.crc32((prefix + run).encode())
        k = h % len(run)
        return run if h % thinned else run[:k] + run[k + 1:]

    def task(batches):
        counts: Counter = Counter()
        for b in batches:
            texts, ids = b.column("text"), b.column("id").to_pylist()
            for low, high in slices(texts):
                for key, text in zip(ids[low:high], texts.slice(low, high - low).to_pylist()):
                    if text is None:
                        continue
                    runs = pattern.findall(text.translate(_LOWER))
                    if not thinned:
                        counts.update(runs)
                        continue
                    prefix = f"{'' if key is None else key}:"
                    for run, n in Counter(runs).items():
                        counts[thin(prefix, run)] += n
                if len(counts) >= HELD:
                    yield _counted(counts)
                    counts = Counter()
        yield _counted(counts)

    found = mapped(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), task, "word string, n bigint")
    return found.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= least_count)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


# ---------------------------------------------------------------- gram dictionary

def _level_task(length: int, shorter: frozenset | None):
    def task(batches):
        counts: Counter = Counter()
        for b in batches:
            for word in b.column("word").to_pylist():
                ends = range(len(word) - length + 1)
                counts.update({word[p:p + length] for p in ends if shorter is None or word[p:p + length - 1] in shorter})
                if len(counts) >= HELD:
                    yield _counted(counts)
                    counts = Counter()
        yield _counted(counts)
    return task


def frequent_grams(words: DataFrame, limit: int | None = None) -> frozenset[str]:
    """Grams in more than ``limit`` words, every level counted exactly over all words.

    Without ``limit`` it is ``LIST_WORDS``, or what keeps a level within ``LEVEL_GRAMS`` grams.
    """
    if limit is None:
        places = words.agg(F.sum(F.length("word") - SHORTEST + 1)).first()[0] or 0
        limit = max(LIST_WORDS, math.ceil(places / LEVEL_GRAMS))
    found: set[str] = set()
    level = None
    for length in range(SHORTEST, LONGEST + 1):
        counted = mapped(words.select("word"), _level_task(length, level), "word string, n bigint").groupBy("word").agg(
            F.sum("n").alias("n")).where(F.col("n") > limit)
        level = frozenset(r.word for r in counted.select("word").collect())
        if not level:
            break
        found |= level
    return frozenset(found)


def bounds(word: str, frequent: frozenset[str]) -> tuple[int, int]:
    """``e`` and ``p``: edits from ``e`` on leave a rare gram at the front whole, those before ``p`` one at the back.

    Without a rare gram ``e`` is past the last edit and ``p`` before the first.
    """
    n, e, p = len(word), len(word) + 1, -1
    for start in range(n - SHORTEST + 1):
        end = start + SHORTEST
        while end <= n and word[start:end] in frequent:
            end += 1
        if end <= n:
            e, p = min(e, end), start
    return e, p


# ---------------------------------------------------------------- index and lists

_INDEX = "key string, word string, n bigint, site int"


def index_rows(word: str, e: int, p: int) -> Iterator[tuple[str, int]]:
    """(list, site) of a word. ``site`` is the first place not served in a list of suffixes, or the place of an open edit."""
    n = len(word)
    if e <= n:
        yield "L" + word[:e], e
    if p >= 0:
        yield "R" + word[p:], e
    for i in range(max(p, 0), min(e, n)):  # the letter at i is lost or replaced
        yield f"O{i}:{word[:i]}{word[i + 1:]}", i
    for i in range(p + 1, min(e, n + 1)):  # a letter comes before i
        yield f"O{i}:{word}", -1


def _index_task(frequent: frozenset[str]):
    def task(batches):
        for b in batches:
            words, counts = b.column("word").to_pylist(), b.column("n").to_pylist()
            out = [(key, w, n, site) for w, n in zip(words, counts) for key, site in index_rows(w, *bounds(w, frequent))]
            for k in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k:k + 20_000]), (
                    pa.string(), pa.string(), pa.int64(), pa.int32()))], ["key", "word", "n", "site"])
    return task


def _new_letter(word: str, i: int) -> bool:
    """Losing the letter at i is told by its first place only: of a run of one letter the first."""
    return i == 0 or word[i - 1] != word[i]


def _meet(near: dict, group: list[tuple[int, str]], shorter: tuple[int, str] | None, i: int) -> None:
    """Words that agree but for the letter at i, and the word without it, are near each other."""
    group = sorted((-n, w) for n, w in group)
    for k, (_, w) in enumerate(group):
        if len(group) > 1:
            _add(near, w, len(group) - 1, group[1] if k == 0 else group[0])
        if shorter and _new_letter(w, i):
            _add(near, w, 1, (-shorter[0], shorter[1]))
            _add(near, shorter[1], 1, group[k])


def _add(near: dict, word: str, count: int, best: tuple[int, str]) -> None:
    held = near.get(word)
    near[word] = (held[0] + count, min(held[1], best)) if held else (count, best)


def _agreed(a: str, b: str) -> int:
    """Letters that two words begin with in common."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def _meet_long(near: dict, rows: list[tuple[str, int, int]], key: str) -> None:
    """The same where the longer word is beyond ``LONG``, pair by pair, without shortened forms in memory."""
    rows = sorted(rows, key=lambda r: (len(r[0]), r[0]))
    for k, (a, n, _) in enumerate(rows):
        for b, m, e in rows[k + 1:]:
            if len(b) > len(a) + 1:
                break
            if len(b) <= LONG:
                continue
            i = _agreed(a, b)
            if a[i + (len(a) == len(b)):] != b[i + 1:]:
                continue
            while len(a) < len(b) and not _new_letter(b, i):
                i -= 1
            if i >= e if key[0] == "L" else i < min(e, len(b) - len(key) + 1):
                _add(near, a, 1, (-m, b))
                _add(near, b, 1, (-n, a))


def merged_list(key: str, rows: list[tuple[str, int, int]]) -> dict[str, tuple[int, tuple[int, str]]]:
    """Verified near words of one list: word to (how many, (-n, word) of the best)."""
    near: dict = {}
    if key[0] == "O":
        i = int(key[1:key.index(":")])
        shorter = next(((n, w) for w, n, site in rows if site < 0), None)
        _meet(near, [(n, w) for w, n, site in rows if site >= 0], shorter, i)
        return near
    long = [r for r in rows if len(r[0]) >= LONG]
    if len(long) > 1:
        _meet_long(near, long, key)
    rows = [r for r in rows if len(r[0]) <= LONG]
    counts = {w: n for w, n, _ in rows}
    groups: dict[tuple[int, str], list[tuple[int, str]]] = {}
    for w, n, e in rows:
        sites = range(e, len(w)) if key[0] == "L" else range(min(e, len(w) - len(key) + 1))
        for i in sites:
            groups.setdefault((i, w[:i] + w[i + 1:]), []).append((n, w))
    for (i, rest), group in groups.items():
        if len(group) > 1 or rest in counts:
            _meet(near, group, (counts[rest], rest) if rest in counts else None, i)
    return near


def _lists_task(batches):
    key, rows, out = None, [], []

    def closed():
        if len(rows) > 1:
            out.extend((w, c, -best[0], best[1]) for w, (c, best) in merged_list(key, rows).items())

    def sent():
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((
            pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "near", "best_n", "best"])
        out.clear()
        return batch

    for b in batches:
        for k, *row in zip(*[b.column(c).to_pylist() for c in ("key", "word", "n", "site")]):
            if k != key:
                closed()
                key, rows = k, []
                if len(out) >= 20_000:
                    yield sent()
            rows.append(row)
    closed()
    yield sent()


def near_words(words: DataFrame, frequent: frozenset[str]) -> DataFrame:
    """``word``, ``near`` (words one edit away), ``best_n`` and ``best`` (the most frequent of them, ties to the least)."""
    index = mapped(words.select("word", "n"), _index_task(frequent), _INDEX)
    lists = index.repartition("key").sortWithinPartitions("key")
    found = mapped(lists, _lists_task, "word string, near bigint, best_n bigint, best string")
    return found.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")).select(
        "word", "near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


# ---------------------------------------------------------------- groups

def roots(links: DataFrame, most: int) -> DataFrame:
    """``word`` and ``root``: links followed to their end by doubling. A link multiplies the count, so chains are short."""
    current = materialize(links.select("word", F.col("form").alias("root")))
    hops = max(1, math.ceil(math.log(max(most, 2), RATIO)))
    for _ in range(math.ceil(math.log2(hops + 1))):
        on = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        current = materialize(current.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return current


def grouped(words: DataFrame, limit: int | None = None, ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word of ``word_counts``.

    A word's form is its near word of largest count (ties: the least by code point) if that count
    is ``ratio`` times its own or more, else null. ``root`` ends the chain of forms. Words without
    near words have ``n_near`` 0 and themselves as root. An empty table gives no rows; columns
    besides ``word`` and ``n`` are not read; words are distinct and not null.
    """
    words = materialize(words.select("word", "n"))
    near = near_words(words, frequent_grams(words, limit))
    far = F.col("best_n") >= ratio * F.col("n")
    each = materialize(null_safe_join(words, near, ["word"], "left").select(
        "word", "n", F.coalesce("near", F.lit(0)).cast("bigint").alias("n_near"), F.when(far, F.col("best")).alias("form"),
        F.when(far, F.col("best_n")).alias("form_n")))
    most = each.agg(F.max("n")).first()[0] or 1
    ends = roots(each.where("form IS NOT NULL"), most)
    return null_safe_join(each, ends, ["word"], "left").withColumn("root", F.coalesce("root", "word"))
