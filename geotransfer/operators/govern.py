"""Fingerprints, freeze records, label lock and consistency checks."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from geotransfer.functions.text import row_text
from geotransfer.operators.guards import GuardError, duplicate_keys, refuse_rows
from geotransfer.operators.joins import complete_join
from geotransfer.operators.ordering import number_rows
from geotransfer.schemas import KEYS, RESPONSE


def _part_sum(digest: Column, part: int) -> Column:
    """Exact sum over rows of the ``part``-th 60 bits of a sha256 text, in two sums of 30 bits that stay plain numbers."""
    bits = F.conv(F.substring(digest, 15 * part + 1, 15), 16, 10).cast("bigint")
    high, low = (F.coalesce(F.sum(c), F.lit(0)).cast("decimal(28,0)") for c in (F.shiftright(bits, 30), bits.bitwiseAND((1 << 30) - 1)))
    return (high * F.lit(1 << 30).cast("decimal(10,0)") + low).cast("decimal(38,0)").cast("string")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free table fingerprint: row count and the sums of two 60-bit parts of every row's sha256.

    A row's hash covers each value with its length and place, and NULL apart from any text. Every part
    is a partial aggregate, so the table is read once and only one row per task is shuffled.
    """
    h = F.sha2(row_text(list(columns or df.columns)), 256)
    return df.select(h.alias("_h")).agg(F.count(F.lit(1)).alias("rows"), _part_sum(F.col("_h"), 0).alias("hash_sum"),
                                        _part_sum(F.col("_h"), 1).alias("hash_sum_2"))


def fingerprint_text(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    r = fingerprint(df, columns).first()
    return hashlib.sha256(f"{r['rows']}|{r['hash_sum']}|{r['hash_sum_2']}".encode()).hexdigest()


def ordered_row_hashes(df: DataFrame, order: Sequence[str], columns: Sequence[str],
                       keys: Sequence[str] = ()) -> DataFrame:
    """sha256 of (row number, values) per row, in canonical order inside ``keys``."""
    numbered = number_rows(df, order, keys, "row_no")
    return numbered.select(*keys, "row_no", F.sha2(row_text(["row_no", *columns]), 256).alias("row_hash"))


def schema_hash(schema: T.StructType) -> str:
    """Hash of the names and types of a table, in order; nullability and metadata play no part."""
    bare = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    return hashlib.sha256(bare.simpleString().encode()).hexdigest()


def number_schema(features: Sequence[str]) -> T.StructType:
    """The schema a feature set has in a model table: numbers in fixed order."""
    return T.StructType([T.StructField(c, T.DoubleType()) for c in features])


def schema_hashes(spark, features: dict[str, list[str]]) -> DataFrame:
    rows = [(name, len(cols), schema_hash(number_schema(cols))) for name, cols in features.items()]
    return spark.createDataFrame(rows, "representation string, feature_n int, schema_hash string")


def content_hash(columns: Sequence[str]) -> Column:
    """Order-free content hash: sum of the first 60 bits of each row's sha256."""
    return _part_sum(F.sha2(row_text(columns), 256), 0)


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def freeze_summary(df: DataFrame, block: str, fold: str, response: str = RESPONSE,
                   keys: Sequence[str] = tuple(KEYS), features: dict[str, list[str]] | None = None,
                   exclusions: dict[str, int] | None = None) -> DataFrame:
    """One public row: counts, years, folds and content hashes; no ids or coordinates.

    ``features`` adds the schema hash of every feature set, ``exclusions`` the
    counts of rows left out.

    Per-fold and per-year counts are aggregated first, so the maps are built
    from a handful of rows.
    """
    base = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(block).alias("block_count"),
                  content_hash([keys[0]]).alias("sample_ids_hash"),
                  content_hash(keys).alias("row_key_hash"),
                  content_hash([*keys, response]).alias("response_hash"))
    folds = df.groupBy(fold).agg(F.count(F.lit(1)).alias("c"))
    fold_map = folds.agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col(fold).cast("string"), F.col("c")))))).scalar()
    years = df.select("year").distinct().agg(F.array_sort(F.collect_list("year"))).scalar()
    extra = {}
    if features:
        extra["feature_schema_hashes"] = _literal_map({k: schema_hash(number_schema(v)) for k, v in features.items()})
    if exclusions:
        extra["exclusion_counts"] = _literal_map({k: int(v) for k, v in exclusions.items()})
    return base.withColumns({"years": years, "fold_counts": fold_map, **extra,
                             "private_rows_committed": F.lit(False)})


def freeze_row(df: DataFrame, stage: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A manifest row (stage, name, fingerprint) for a frozen table."""
    fp = F.sha2(F.concat_ws("|", F.col("rows").cast("string"), "hash_sum", "hash_sum_2"), 256)
    return fingerprint(df, columns).select(F.lit(stage).alias("stage"), F.lit(name).alias("name"),
                                           "rows", fp.alias("fingerprint"))


def chain_mismatches(recorded: DataFrame, observed: DataFrame) -> DataFrame:
    """Inputs whose fingerprint is absent from, or differs from, the record."""
    r = recorded.select("stage", "name", F.col("fingerprint").alias("recorded"),
                        F.lit(None).cast("string").alias("observed"))
    o = observed.select("stage", "name", F.lit(None).cast("string").alias("recorded"),
                        F.col("fingerprint").alias("observed"))
    j = r.unionByName(o).groupBy("stage", "name").agg(F.max("recorded").alias("recorded"),
                                                      F.max("observed").alias("observed"))
    return j.where(~F.col("recorded").eqNullSafe(F.col("observed")))


def require_chain(recorded: DataFrame, observed: DataFrame) -> None:
    refuse_rows(chain_mismatches(recorded, observed), "frozen input changed")


def require_label_free(df: DataFrame, response: str = RESPONSE) -> DataFrame:
    if response in df.columns or f"{response}_se" in df.columns:
        raise GuardError("prediction table holds the response")
    return df


def unlock(predictions: DataFrame, labels: DataFrame, freeze: DataFrame, stage: str, name: str,
           on: Sequence[str] = tuple(KEYS), response: str = RESPONSE) -> DataFrame:
    """Join labels to frozen predictions: the only way labels reach a target table.

    Stops when no freeze row exists or the predictions changed since the freeze.
    """
    row = freeze.where((F.col("stage") == stage) & (F.col("name") == name)).limit(1).collect()
    if not row:
        raise GuardError("labels stay locked: predictions are not frozen")
    now = freeze_row(require_label_free(predictions, response), stage, name).first()
    if now["fingerprint"] != row[0]["fingerprint"]:
        raise GuardError("frozen prediction changed")
    return complete_join(predictions, labels.select(*on, response), on, [response],
                         "a prediction has no label")


def numeric_disagreements(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str],
                          tol: float = 1e-6) -> DataFrame:
    """(keys, column, left, right) where two records of the same figures differ."""
    def long(df, out):
        return df.unpivot([F.col(k) for k in keys],
                          [F.col(c).cast("double").alias(c) for c in columns], "column", out)

    j = long(a, "left_value").join(long(b, "right_value"), [*keys, "column"], "full_outer")
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    return j.where(F.coalesce(gap > tol, F.lit(True)))


def conclusion(table: DataFrame, a: str, b: str) -> DataFrame:
    """Three-way reading of transfer results from the two rows ``a`` and ``b``."""
    def v(name, m):
        return F.max(F.when(F.col("representation") == name, F.col(m)))

    w = table.agg(*[v(n, m).alias(f"{s}_{m}") for n, s in ((a, "a"), (b, "b"))
                    for m in ("target_R2", "target_RMSE", "R2_drop")])
    stronger = ((F.col("a_target_R2") > F.col("b_target_R2"))
                & (F.col("a_target_RMSE") < F.col("b_target_RMSE"))
                & (F.col("a_R2_drop") < F.col("b_R2_drop")))
    near = ((F.abs(F.col("a_target_R2") - F.col("b_target_R2")) < 0.05)
            | (F.abs(F.col("a_target_RMSE") - F.col("b_target_RMSE")) / F.col("b_target_RMSE") < 0.05))
    return w.select(F.when(stronger, F.lit("stronger transfer"))
                    .when(near, F.lit("comparable transfer"))
                    .otherwise(F.lit("no superior transfer")).alias("conclusion"))


def inventory(expected: DataFrame, present: DataFrame, on: str = "name") -> DataFrame:
    """Expected artefacts with their checksum and a present / missing status."""
    return (expected.join(present, on, "left")
            .withColumn("status", F.when(F.col("sha256").isNotNull(), F.lit("present"))
                        .otherwise(F.lit("missing"))))


def inventory_status(listing: DataFrame) -> DataFrame:
    n, m = F.count(F.lit(1)), F.count_if(F.col("status") == "missing")
    return listing.agg(n.alias("expected_n"), m.alias("missing_n"),
                       F.when(m == 0, F.lit("complete")).otherwise(F.lit("in progress")).alias("state"))


def stage_equality(stages: DataFrame, reference: str, on: Sequence[str],
                   bands: Sequence[str], stage: str = "stage") -> DataFrame:
    """The same points through several extraction stages, each against the reference stage."""
    refuse_rows(duplicate_keys(stages, [stage, *on]), "a stage holds a point twice")
    ref = stages.where(F.col(stage) == reference).select(
        *on, *[F.col(b).alias(f"_r_{b}") for b in bands], F.lit(True).alias("_ref"))
    # One left join on the point key compares every stage at once.
    j = stages.join(ref, list(on), "left")
    same = F.col("_ref").isNotNull()
    per = j.groupBy(stage).agg(
        F.count(F.lit(1)).alias("candidate_n"), F.count_if(same).alias("common_n"),
        *[F.count_if(same & ~F.col(b).eqNullSafe(F.col(f"_r_{b}"))).alias(f"{b}_mismatch_n")
          for b in bands])
    raw = ref.agg(F.count(F.lit(1))).scalar()
    clean = F.lit(True)
    for b in bands:
        clean = clean & (F.col(f"{b}_mismatch_n") == 0)
    return per.withColumns({
        "raw_n": raw, "raw_only_n": raw - F.col("common_n"),
        "candidate_only_n": F.col("candidate_n") - F.col("common_n"),
        "identical": clean & (F.col("candidate_n") == raw)})
