"""Quality rules: text statistics and a decision list learned by sequential covering.

The learner grows a conjunction of threshold tests on two thirds of the labelled rows by
information gain, prunes it on the other third from its last test backwards, keeps it if it is
precise enough there, removes the rows it covers, and goes on. The list is an ordered Spark
``when`` expression over the statistics, so documents are judged inside the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from geotransfer.llm.common import keyed, mapped, restored, utf8
from geotransfer.llm.substring_dedup import rolling

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_lines",
          "n_distinct_words", "n_punct", "n_long_words"]
FIT_ROWS = 20_000  # bound on the labelled rows that the rules are fitted on

_DELETE_ALL_BUT = {
    "n_symbols": bytes(set(range(256)) - set(SYMBOLS)),
    "n_upper": bytes(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    "n_digits": bytes(set(range(256)) - set(b"0123456789")),
    "n_punct": bytes(set(range(256)) - set(b".,;:!?")),
}
_CONTINUATION = bytes(set(range(256)) - set(range(0x80, 0xC0)))
_SPACE = bytes([0x20, 9, 10, 11, 12, 13])
_WORD = re.compile(rb"[^\x20\x09-\x0D]")


def statistics(text: bytes | None) -> list[int]:
    """The counts of ``COUNTS`` for one whole text."""
    text = text or b""
    words = text.split()
    n = len(words)
    dense = text.translate(None, _SPACE)
    chars = len(dense) - len(dense.translate(None, _CONTINUATION))
    seen, dup, lines = set(), 0, text.split(b"\n")
    for line in lines:
        if _WORD.search(line):
            dup += line in seen
            seen.add(line)
    repeat = 0
    distinct = len(set(words))
    if n > WINDOW and distinct < n:
        h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
        with np.errstate(over="ignore"):
            w = rolling(h, WINDOW, np.uint64(0x9E3779B97F4A7C15))
        o = np.argsort(w)
        s = w[o]
        same = s[1:] == s[:-1]
        many = np.zeros(len(w), bool)
        many[o[1:]] |= same
        many[o[:-1]] |= same
        edge = np.zeros(n + 1, np.int64)
        edge[:len(w)] += many
        edge[WINDOW:WINDOW + len(w)] -= many
        repeat = int((np.cumsum(edge[:n]) > 0).sum())
    of = {k: len(text.translate(None, d)) for k, d in _DELETE_ALL_BUT.items()}
    return [n, chars, of["n_symbols"], dup, repeat, of["n_upper"], of["n_digits"], len(lines), distinct, of["n_punct"],
            sum(1 for x in words if len(x) > 24)]


def _statistics_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = np.array([statistics(t) for t in utf8(batch.column("text"))], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(table[:, k]) for k in range(len(COUNTS))]],
                                         [*batch.schema.names, *COUNTS])


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) and the columns of ``COUNTS``; one narrow pass."""
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS]])
    return mapped(docs, _statistics_task, schema)


def features() -> dict[str, Column]:
    """Ratios the rules test, as Spark expressions over the counts."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": F.col("word_chars") / words,
        "symbols_per_char": F.col("n_symbols") / chars,
        "duplicate_lines": F.col("n_dup_lines") / lines,
        "repeated_words": F.col("n_repeat_words") / words,
        "upper_per_char": F.col("n_upper") / chars,
        "digits_per_char": F.col("n_digits") / chars,
        "punctuation_per_word": F.col("n_punct") / words,
        "distinct_words": F.col("n_distinct_words") / words,
        "long_words": F.col("n_long_words") / words,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def of(self, column: Column) -> Column:
        return column >= self.threshold if self.above else column < self.threshold


def _covered(rule: Sequence[Test], names: list[str], x: np.ndarray) -> np.ndarray:
    yes = np.ones(len(x), bool)
    for t in rule:
        v = x[:, names.index(t.feature)]
        yes &= v >= t.threshold if t.above else v < t.threshold
    return yes


def _best_test(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, Test] | None:
    """The test with the most information gain for the positives; ties go to the first feature and threshold."""
    p0, n0 = y.sum(), (~y).sum()
    best = None
    for k, name in enumerate(names):
        o = np.argsort(x[:, k], kind="stable")
        v, pos = x[o, k], np.cumsum(y[o])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        below_p, below_n = pos[cut], cut + 1 - pos[cut]
        for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
            i = int(gain.argmax())
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0] + 1e-9):
                best = float(gain[i]), Test(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    return best


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], max_tests: int = 4, max_rules: int = 16,
          precision: float = 0.9, least: int = 5) -> list[tuple[Test, ...]]:
    """Rules that reject, in order. Rows are split by position: every third row prunes.

    A rule stays if on the pruning rows (growing rows when none of these is covered) at
    least ``precision`` of its documents are bad and it covers ``least`` bad rows in all.
    """
    rules, left = [], np.ones(len(x), bool)
    prune = np.arange(len(x)) % 3 == 2
    while len(rules) < max_rules:
        g, q = left & ~prune, left & prune
        if not bad[g].any():
            break
        rule, inside = [], g.copy()
        while len(rule) < max_tests and bad[inside].any() and not bad[inside].all():
            found = _best_test(x[inside], bad[inside], names)
            if found is None:
                break
            rule.append(found[1])
            inside = g & _covered(rule, names, x)
        if not rule:
            break

        def worth(r: list[Test]) -> float:
            c = q & _covered(r, names, x)
            return (2 * bad[c].sum() - c.sum()) / c.sum() if c.any() else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = left & _covered(rule, names, x)
        judged = covered & prune if (covered & prune).any() else covered
        if bad[judged].mean() < precision or (covered & bad).sum() < least:
            break
        rules.append(tuple(rule))
        left &= ~covered
    return rules


def verdict(rules: Sequence[Sequence[Test]]) -> Column:
    """Ordered conditional expression: false at the first rule that holds, else true."""
    of = features()
    chain = None
    for rule in rules:
        cond = None
        for t in rule:
            one = t.of(of[t.feature])
            cond = one if cond is None else cond & one
        chain = F.when(cond, F.lit(False)) if chain is None else chain.when(cond, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        rows: int = FIT_ROWS) -> list[tuple[Test, ...]]:
    """Learn from at most ``rows`` labelled documents, the first by a hash of the id.

    Labels other than 0 and 1, null ids and ids without a document are left out; an id with both
    labels counts as good. Without labels of both kinds the list is empty and rejects nothing.
    """
    votes = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("good"))
             .orderBy(F.xxhash64("label_id"), "label_id").limit(rows))
    docs = keyed(df, id_col, text_col).join(F.broadcast(votes), F.col("id") == F.col("label_id"))
    cols = [f.alias(k) for k, f in features().items()]
    got = (with_statistics(docs.select("id", F.coalesce(F.crc32("text"), F.lit(-1)).alias("tag"), "good", "text")).where(~base_failed())
           .select(F.xxhash64("id", "tag").alias("o"), "good", *cols).distinct().orderBy("o").limit(rows).toPandas())
    names = list(features())
    return learn(got[names].to_numpy(np.float64), got["good"].to_numpy() == 0, names)


def judged(df: DataFrame, rules: Sequence[Sequence[Test]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``tag``, ``text``, ``rest``, the counts, ``base_failed`` and ``kept`` for every row.

    Null and empty texts have zero words and fail. Ids play no part: null and repeated ids
    and repeated rows are judged row by row. An empty table gives an empty table.
    """
    stats = with_statistics(keyed(df, id_col, text_col, rest=True))
    return stats.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules))


def stage(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns that the rules keep."""
    out = judged(df, fit(df, labels, id_col, text_col), id_col, text_col)
    return restored(out.where("kept"), df, id_col, text_col)
