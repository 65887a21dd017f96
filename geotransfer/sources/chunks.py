"""Validation of delivered chunk files against the rows they should hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from geotransfer.functions.numeric import all_finite
from geotransfer.operators.guards import refuse_rows, require_columns


def chunk_audit(rows: DataFrame, expected: DataFrame, key: str, chunk: str, year: str,
                features: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """One row per chunk: sizes, repeats, foreign and missing keys, bad values, status.

    ``required`` columns may not be missing; a table without one of them, or without a feature, is refused.

    ``rows`` and ``expected`` both carry ``chunk``. Rows are counted per
    (chunk, key) first, so a heavily repeated key is one row after the map side.
    """
    require_columns(rows, [key, chunk, year, *features, *required], "delivered chunks")
    absent = F.lit(False)
    for c in required:
        absent = absent | F.col(c).isNull()
    zero = F.lit(True)
    for c in features:
        zero = zero & (F.col(c) == 0)
    got = rows.groupBy(chunk, key).agg(
        F.count(F.lit(1)).alias("_n"), F.min(year).alias("_y0"), F.max(year).alias("_y1"),
        F.count_if(F.col(year).isNull()).alias("_no_year"), F.count_if(absent).alias("_absent"),
        F.count_if(~all_finite(features)).alias("_bad"),
        F.count_if(F.coalesce(zero, F.lit(False))).alias("_zero"))
    want = expected.select(chunk, key, F.col(year).alias("_ey"), F.lit(True).alias("_want"))
    j = want.join(got, [chunk, key], "full_outer")
    missing = F.count_if(F.col("_n").isNull())
    foreign = F.count_if(F.col("_want").isNull())
    repeated = F.count_if(F.col("_n") > 1)
    other = ~F.col("_y0").eqNullSafe(F.col("_ey")) | ~F.col("_y1").eqNullSafe(F.col("_ey")) | (F.col("_no_year") > 0)
    off_year = F.count_if(F.col("_want").isNotNull() & F.col("_n").isNotNull() & other)
    out = j.groupBy(chunk).agg(
        F.count("_want").alias("expected_n"), F.coalesce(F.sum("_n"), F.lit(0)).alias("observed_n"),
        repeated.alias("repeated_keys"), foreign.alias("foreign_keys"), missing.alias("missing_keys"),
        off_year.alias("wrong_year"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("non_finite_rows"),
        F.coalesce(F.sum("_zero"), F.lit(0)).alias("all_zero_rows"),
        F.coalesce(F.sum("_absent"), F.lit(0)).alias("missing_value_rows"))
    bad = (F.col("repeated_keys") + F.col("foreign_keys") + F.col("wrong_year")
           + F.col("non_finite_rows") + F.col("all_zero_rows") + F.col("missing_value_rows"))
    return out.withColumn("status", F.when(bad > 0, F.lit("FAIL"))
                          .when(F.col("missing_keys") > 0, F.lit("SUBSET"))
                          .otherwise(F.lit("PASS")))


def choose_candidates(rows: DataFrame, expected: DataFrame, key: str, chunk: str,
                      file: str) -> DataFrame:
    """One accepted file per chunk among repeated deliveries.

    A file with foreign keys is rejected, an exact match wins, otherwise the
    largest subset. ``exact_n`` above one is a conflict.
    """
    per_key = rows.groupBy(chunk, file, key).agg(F.count(F.lit(1)).alias("_n"))
    want = expected.select(chunk, key, F.lit(True).alias("_want"))
    sizes = expected.groupBy(chunk).agg(F.count(F.lit(1)).alias("expected_n"))
    files = (per_key.join(want, [chunk, key], "left").groupBy(chunk, file)
             .agg(F.sum("_n").alias("row_n"), F.count("_want").alias("hit_n"),
                  F.count_if(F.col("_want").isNull()).alias("foreign_n"))
             .join(sizes, chunk))
    exact = ((F.col("foreign_n") == 0) & (F.col("hit_n") == F.col("expected_n"))
             & (F.col("row_n") == F.col("expected_n")))
    usable = files.withColumn("exact", exact).where("foreign_n = 0")
    order = F.struct((~F.col("exact")).cast("int"), -F.col("hit_n"), F.col(file))
    return usable.groupBy(chunk).agg(
        F.min_by(file, order).alias("accepted_file"), F.min_by("hit_n", order).alias("hit_n"),
        F.max("expected_n").alias("expected_n"), F.count_if(F.col("exact")).alias("exact_n"))


def require_one_exact(choice: DataFrame, chunk: str) -> DataFrame:
    refuse_rows(choice.where("exact_n > 1").select(chunk), "several exact candidates")
    return choice


def unexpected_files(listed: DataFrame, expected: DataFrame, on: str = "name") -> DataFrame:
    return listed.join(expected.select(on), on, "left_anti")
