"""Scene stacks: yearly medians, mosaics and the one-scene-per-year contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from geotransfer.operators.guards import refuse_rows
from geotransfer.operators.quantiles import quantiles


def median_composite(pixels: DataFrame, by: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Median of every band per pixel and year (NULL observations are ignored).

    One pixel-year holds at most a year's revisits, so the built-in exact median fits.
    """
    return pixels.groupBy(*by).agg(F.count(F.lit(1)).alias("observations"),
                                   *[F.median(b).alias(b) for b in bands])


def median_per_group(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median for groups of any size (ranked across the cluster when large)."""
    return quantiles(df, by, value, {value: 0.5})


def mosaic(pixels: DataFrame, by: Sequence[str], bands: Sequence[str], scene_ts: str) -> DataFrame:
    """The latest valid value of every band; of scenes with one time stamp the largest value counts.

    A pixel without any valid value is left out.
    """
    valid = pixels.where(F.greatest(*[F.col(b).isNotNull().cast("int") for b in bands], F.lit(0)) > 0)
    latest = [F.max(F.when(F.col(b).isNotNull(), F.struct(F.col(scene_ts).alias("ts"), F.col(b).alias("v"))))["v"].alias(b)
              for b in bands]
    return valid.groupBy(*by).agg(*latest)


def scenes_per_year(scenes: DataFrame, year: str, scene_id: str) -> DataFrame:
    return scenes.groupBy(year).agg(F.count_distinct(scene_id).alias("image_count"))


def require_single_scene(scenes: DataFrame, year: str, scene_id: str) -> None:
    """Refuse a year with more than one scene: no implicit mosaic, no nearest year."""
    refuse_rows(scenes_per_year(scenes, year, scene_id).where(F.col("image_count") != 1),
                "expected exactly one scene per year")
