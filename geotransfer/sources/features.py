"""Plug-in point for sensors: anything that turns points of one year into features."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from geotransfer.functions.radar import qa_is_valid, with_radar_features
from geotransfer.operators.composite import require_single_scene
from geotransfer.operators.spatial import point_to_pixel


class FeatureSource(Protocol):
    """``(points, year) -> points with feature columns``; exact year only."""

    def for_year(self, points: DataFrame, year: int) -> DataFrame: ...


class LBandSource:
    """Yearly L-band pixel table (scene_id, year, px, py, HH, HV, qa) sampled at points."""

    def __init__(self, pixels: DataFrame, scene_id: str = "scene_id"):
        self.pixels, self.scene_id = pixels, scene_id

    def for_year(self, points: DataFrame, year: int) -> DataFrame:
        scene = self.pixels.where(F.col("year") == year)
        if scene.limit(1).count() == 0:
            raise RuntimeError(f"no scene for {year}; nearest-year substitution is refused")
        require_single_scene(scene, "year", self.scene_id)
        land = scene.where(qa_is_valid("qa")).withColumnRenamed("qa", "palsar_qa").drop(self.scene_id)
        sampled = point_to_pixel(points.where(F.col("year") == year), land)
        return with_radar_features(sampled)
