"""Sinks: Parquet and CSV twins, partitioned tables, JSON manifests, public extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from geotransfer.functions.text import anonymise
from geotransfer.operators.sampling import keep_latest


def write_twins(df: DataFrame, path: str) -> None:
    """The same rows as Parquet and as headed CSV."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], order: Sequence[str]) -> None:
    """Partitioned table, rows in canonical order inside each file.

    Rows are spread by (partition columns, order) ranges, so a large year is
    written by many tasks.
    """
    (df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
     .write.mode("overwrite").partitionBy(*by).parquet(path))


def upsert_manifest(old: DataFrame | None, new: DataFrame, keys: Sequence[str],
                    version: str) -> DataFrame:
    """Manifest rows with the newest version of each key."""
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    return keep_latest(rows, keys, version)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def public_extract(df: DataFrame, drop: Sequence[str], hash_columns: Sequence[str]) -> DataFrame:
    """Remove identifying columns and replace block ids by their hash."""
    keep = df.drop(*drop)
    return keep.withColumns({f"{c}_hash": anonymise(c) for c in hash_columns}).drop(*hash_columns)

