"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every source gets a target: its share of the words of all sources by weight, at most ``LIMIT``
times its own words; what is above the limit is shared again among the others. A document of a
source is expected ``target / source_size`` times. Documents of a source stand in one order (by
size, so that neighbours are alike); the prefix sum of the expected copies, moved by one random
offset per source, crosses whole numbers, and a document is emitted once for each number crossed.
Copies differ from their expectation by less than one, and since the order is by size the words
taken differ from the target by at most about the source's longest document.

Places in the order come from a range partition over the cluster and offsets of partitions
(``ordering.number_rows``), so a source with a third of all rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geotransfer.operators import ordering
from geotransfer.operators.joins import lookup_join
from geotransfer.session import materialize

LIMIT = 3
WEIGHTS = (1, 2, 3)
SEED = 42
WORD = r"[^\x20\x09-\x0D]++"
_STEPS = 1 << 20  # offsets have 20 bits: a sum of whole expected copies stays exact


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def offset(source: Column, seed: int = SEED) -> Column:
    """Random offset of a source in (0, 1), from the seed and its name alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null")))
    return (F.conv(F.substring(F.md5(name), 1, 5), 16, 10).cast("double") + 0.5) / _STEPS


def weighted_sources(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source``, ``source_size`` and ``weight``: weights repeat over the sources by code point, null last."""
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"))
                        .withColumn("last", F.col("source").isNull()))
    placed = ordering.number_rows(sizes, ["last", "source"], name="place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    return placed.select("source", "source_size", weight.cast("bigint").alias("weight"))


def with_targets(sources: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add ``target``: a share of all words by weight, at most ``limit`` times the source's own.

    One aggregate a round over the table of sources: sources above their limit are set to it and
    the rest is shared anew by weight, until none is above. Only two whole numbers, words left
    and weight left, come to the driver.
    """
    stored = materialize(sources)
    own, w = F.col("source_size"), F.col("weight")
    words, heavy = stored.agg(F.coalesce(F.sum(own), F.lit(0)), F.coalesce(F.sum(w), F.lit(0))).first()
    left, rest = words, heavy

    def above() -> Column:
        return ((own * limit).cast("decimal(38,0)") * F.lit(rest).cast("decimal(19,0)")
                < w.cast("decimal(19,0)") * F.lit(left).cast("decimal(19,0)"))

    while rest:
        cut, gone = stored.where(above()).agg(F.coalesce(F.sum(own * limit), F.lit(0)),
                                              F.coalesce(F.sum(w), F.lit(0))).first()
        if (words - cut, heavy - gone) == (left, rest):
            break
        left, rest = words - cut, heavy - gone
    share = (w * F.lit(left)).cast("double") / F.lit(float(rest or 1))
    capped = F.when(above(), (own * limit).cast("double")).otherwise(share) if rest else (own * limit).cast("double")
    return stored.withColumn("target", capped)


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = SEED, keep: bool = False) -> DataFrame:
    """``id``, ``size``, ``source``, ``source_size``, ``target`` and ``copies`` of every row.

    With ``keep`` the row's own columns come along in the struct ``row``. Null texts and texts
    without a word have size 0 and may be emitted, taking nothing. Null sources are one source,
    the last. Null ids, repeated ids and repeated rows are rows of their own; rows equal in id and
    text are alike, so it does not matter which of them is emitted. A source without words has
    target 0 and is not emitted. An empty table gives no rows. Columns with clashing names sit in
    ``row``. Reruns give the same rows.
    """
    text, own = F.col(f"`{text_col}`"), [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if keep else []
    rows = materialize(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                                 word_count(text).alias("size"), F.xxhash64(text).alias("print"), *own))
    targets = with_targets(weighted_sources(rows, weights), limit)
    placed = ordering.number_rows(rows, ["size", "id", "print"], ["source"], "place", distributed=True)
    joined = lookup_join(placed, targets.drop("weight"), ["source"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = (F.floor(F.col("place") * each + offset(F.col("source"), seed))
               - F.floor((F.col("place") - 1) * each + offset(F.col("source"), seed)))
    return joined.select("id", "size", "source", "source_size", "target", crossed.cast("int").alias("copies"),
                         *(["row"] if keep else []))


def emitted(mix: DataFrame) -> DataFrame:
    """The mix itself: every row of ``mixed`` once per copy, with ``copy`` from 1."""
    return mix.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
