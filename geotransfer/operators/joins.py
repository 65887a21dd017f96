"""Key joins with stated cardinality, comparison joins and coverage joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from geotransfer.functions.numeric import close_to
from geotransfer.operators.guards import (GuardError, duplicate_keys, refuse_rows, require_rows,
                                          unique_keys)
from geotransfer.session import materialize

LOOKUP_BYTES = 16 * 1024 * 1024


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Inner or left join in which NULL keys are equal; the key columns of ``left`` stay."""
    own = right.select(*[F.col(c).alias(f"_k_{c}") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(own[f"_k_{c}"])
    return left.join(own, cond, how).drop(*[f"_k_{c}" for c in on])


def memory_bytes(df: DataFrame) -> int:
    """Upper bound on the bytes a table takes as rows in memory: counted, not estimated."""
    text = F.lit(0).cast("long")
    for f in df.schema.fields:
        if not isinstance(f.dataType, T.NumericType | T.BooleanType | T.DateType | T.TimestampType):
            text = text + F.coalesce(4 * F.octet_length(F.col(f.name).cast("string")), F.lit(0)) + 16
    fixed = 32 + 16 * len(df.columns)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(text).alias("b")).first()
    return row["n"] * fixed + (row["b"] or 0)


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows to a lookup table on keys that may be very popular.

    NULL keys meet NULL keys on either path. The lookup is stored once and its
    rows and text are measured. Up to the limit it is broadcast and the big side
    never moves. Beyond it both sides are shuffled by key, and adaptive execution
    splits the partition of a popular key.
    """
    stored = materialize(small)
    fits = memory_bytes(stored) <= LOOKUP_BYTES
    return null_safe_join(big, F.broadcast(stored) if fits else stored, list(on), how)


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
                   validate: str = "one_to_one") -> DataFrame:
    """Join that fails on a repeated key and adds only columns the left side lacks.

    ``right_unique`` is one to one for a left side whose keys have been checked before.
    """
    on = list(on)
    extra = [c for c in right.columns if c not in on and c not in left.columns]
    if validate == "one_to_one":
        left = unique_keys(left, on, "left table")
        right = unique_keys(right, on, "right table")
    elif validate == "right_unique":
        right = unique_keys(right, on, "right table")
    elif validate == "many_to_one":
        # A separate check keeps both join inputs plain shuffles, which is what
        # lets Spark split a hot key of the many side.
        refuse_rows(duplicate_keys(right, on), "duplicate key in right table")
    return left.join(right.select(*on, *extra), on, how)


def complete_join(left: DataFrame, right: DataFrame, on: Sequence[str],
                  required: Sequence[str], message: str = "join is incomplete") -> DataFrame:
    """One-to-one left join that fails when a required right column is missing."""
    joined = validated_join(left, right, on, "left")
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return require_rows(joined, ok, message)


def common_rows(base: DataFrame, parts: dict[str, DataFrame], on: Sequence[str]) -> DataFrame:
    """Inner join of all parts on a unique key."""
    out = base
    for i, part in enumerate(parts.values()):
        out = validated_join(out, part, on, "inner", "right_unique" if i else "one_to_one")
    return out


def stage_survivors(base: DataFrame, parts: dict[str, DataFrame], on: Sequence[str]) -> DataFrame:
    """Rows left after each part, from one pass over left joins with presence marks."""
    on = list(on)
    marked = base.select(*on)
    for name, part in parts.items():
        marks = part.select(*on).distinct().withColumn(f"_has_{name}", F.lit(True))
        marked = marked.join(marks, on, "left")
    kept, cols = F.lit(True), [F.count(F.lit(1)).alias("initial")]
    for name in parts:
        kept = kept & F.col(f"_has_{name}").isNotNull()
        cols.append(F.count_if(kept).alias(name))
    wide = marked.agg(*cols)
    pairs = ", ".join(f"'{n}', `{n}`" for n in ["initial", *parts])
    return (wide.selectExpr("initial AS _first", f"stack({len(parts) + 1}, {pairs}) AS (stage, n)")
            .select("stage", "n", (F.col("_first") - F.col("n")).alias("removed_from_initial")))


def keep_ids(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*on), list(on), "left_semi")


def lost_rows(expected: DataFrame, received: DataFrame, on: Sequence[str], reason: str) -> DataFrame:
    return (expected.join(received.select(*on), list(on), "left_anti")
            .withColumn("missing_reason", F.lit(reason)))


def require_subset(inner: DataFrame, outer: DataFrame, on: Sequence[str], message: str) -> None:
    refuse_rows(inner.select(*on).join(outer.select(*on), list(on), "left_anti"), message)


def compare_tables(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str],
                   tolerance: dict[str, float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Full outer comparison: one-sided counts and mismatches per column.

    Counts of ``by`` groups come from whichever side holds the row.
    """
    tolerance = tolerance or {}
    on, by = list(on), list(by)
    l_ = left.select(*on, *[F.col(c).alias(f"_l_{c}") for c in columns], F.lit(True).alias("_in_l"))
    r_ = right.select(*on, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(True).alias("_in_r"))
    j = l_.join(r_, on, "full_outer")
    both = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    aggs = [F.count_if(F.col("_in_l").isNotNull()).alias("left_n"),
            F.count_if(F.col("_in_r").isNotNull()).alias("right_n"),
            F.count_if(both).alias("common_n"),
            F.count_if(F.col("_in_r").isNull()).alias("left_only_n"),
            F.count_if(F.col("_in_l").isNull()).alias("right_only_n")]
    for c in columns:
        a, b = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        same = (F.coalesce(close_to(a, b, tolerance[c]), a.isNull() & b.isNull())
                if c in tolerance else a.eqNullSafe(b))
        aggs.append(F.count_if(both & ~same).alias(f"{c}_mismatch_n"))
    return j.groupBy(*by).agg(*aggs) if by else j.agg(*aggs)


def coverage_by(expected: DataFrame, received: DataFrame, on: Sequence[str],
                by: Sequence[str]) -> DataFrame:
    """Expected rows, received rows and missing share per group."""
    marks = received.select(*on).distinct().withColumn("_got", F.lit(1))
    joined = expected.join(marks, list(on), "left")
    got = F.sum(F.coalesce(F.col("_got"), F.lit(0)))
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("expected_n"), got.alias("received_n"),
        (1 - got / F.count(F.lit(1))).alias("missing_fraction"))


def paired_contrasts(metrics: DataFrame, pairs: Sequence[tuple[str, str]], pair_on: str,
                     metric_columns: Sequence[str], variant: str = "representation",
                     expect: int | None = None) -> DataFrame:
    """Per-pair differences first minus second, matched on ``pair_on``.

    The metric table holds one row per variant and fold, so it is unpivoted to
    contrast rows by a lookup on the short list of pairs, not by a self-join.
    """
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows += [(a, i, f"{a} - {b}", 1), (b, i, f"{a} - {b}", -1)]
    spark = metrics.sparkSession
    lookup = spark.createDataFrame(rows, f"{variant} string, _c int, contrast string, _sign int")
    long = metrics.join(F.broadcast(lookup), variant)
    out = long.groupBy("contrast", pair_on).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.col("_sign") * F.col(m)).alias(f"delta_{m}") for m in metric_columns])
    out = require_rows(out, F.col("_n") == 2, "unpaired fold in contrast").drop("_n")
    if expect is not None:
        refuse_rows(out.groupBy("contrast").count().where(F.col("count") != expect),
                    f"expected {expect} pairs")
    return out


def wide_comparison(left: DataFrame, right: DataFrame, on: str, columns: Sequence[str],
                    left_prefix: str, right_prefix: str) -> DataFrame:
    l_ = left.select(on, *[F.col(c).alias(f"{left_prefix}_{c}") for c in columns])
    r_ = right.select(on, *[F.col(c).alias(f"{right_prefix}_{c}") for c in columns])
    return validated_join(l_, r_, [on], "inner")


def fewest_labels_to_exceed(summary: DataFrame, references: Sequence[str],
                            metric: str = "R2_mean") -> DataFrame:
    """Smallest budget at which a variant is strictly better than each reference."""
    ref = (summary.where(F.col("representation").isin(*references))
           .select(F.col("representation").alias("legacy_reference"), "budget",
                   F.col(metric).alias("_ref")))
    return (summary.join(ref, "budget").where(F.col(metric) > F.col("_ref"))
            .groupBy("representation", "legacy_reference")
            .agg(F.min("budget").alias("fewest_labels_to_exceed")))


def require_identical_rows(variants: dict[str, DataFrame], shared: Sequence[str],
                           keys: Sequence[str]) -> None:
    """All variants hold the same keys with the same shared fields."""
    names = list(variants)
    first = variants[names[0]].select(*shared)
    for name in names[1:]:
        diff = compare_tables(first, variants[name].select(*shared), keys,
                              [c for c in shared if c not in keys]).first().asDict()
        bad = {k: v for k, v in diff.items()
               if (k.endswith("_mismatch_n") or k.endswith("only_n")) and v}
        if bad:
            raise GuardError(f"{name} differs from {names[0]}: {bad}")
