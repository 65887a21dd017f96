"""From raw footprints to a capped sample, and from feature tables to identical rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from geotransfer.functions.geo import albers, albers_block_id, grid_index
from geotransfer.functions.numeric import all_finite
from geotransfer.operators import qa, sampling
from geotransfer.operators.guards import require_columns, select_representation
from geotransfer.operators.joins import validated_join
from geotransfer.schemas import (C_BAND, DEM, EMBEDDING, INDICES, KEYS, L_BAND, OPTICAL,
                                 REPRESENTATIONS, SEED, SOURCE_BLOCK)

GRID_METRES = 50_000.0


def with_source_blocks(df: DataFrame, lon: str = "lon", lat: str = "lat",
                       size: float = GRID_METRES) -> DataFrame:
    x, y = albers(lon, lat)
    out = df.withColumns({"spatial_block_x": grid_index(x, size),
                          "spatial_block_y": grid_index(y, size)})
    return out.withColumn(SOURCE_BLOCK, albers_block_id("spatial_block_x", "spatial_block_y"))


def source_sample(raw: DataFrame, cap: int = 200, seed: int = SEED,
                  stages=None) -> tuple[DataFrame, DataFrame]:
    """(quality-filtered rows with blocks, capped sample per block and year)."""
    valid = with_source_blocks(qa.quality_filter(raw, stages))
    return valid, sampling.capped_sample(valid, [SOURCE_BLOCK, "year"], "shot_number", cap, seed)


def common_sample(conventional: DataFrame, embedding: DataFrame, radar: DataFrame,
                  carry: Sequence[str]) -> DataFrame:
    """Wide table of every feature group on the conventional table's rows (unfiltered)."""
    require_columns(conventional, [*KEYS, *carry, *C_BAND, *OPTICAL, *INDICES, *DEM], "conventional")
    require_columns(embedding, [*KEYS, *EMBEDDING], "embedding")
    require_columns(radar, [*KEYS, *L_BAND, "palsar_valid"], "radar")
    wide = validated_join(conventional, embedding.select(*KEYS, *EMBEDDING), KEYS)
    return validated_join(wide, radar.select(*KEYS, *L_BAND, "palsar_valid"), KEYS, validate="right_unique")


def exclusion_reasons(radar: DataFrame) -> dict:
    """Reason -> predicate on the unfiltered wide table.

    The radar years are a short list (one per calendar year), read once.
    """
    years = [r[0] for r in radar.select("year").distinct().collect()]
    return {
        "not_in_palsar_common_years": ~F.col("year").isin(*years),
        "invalid_or_missing_palsar": ~F.coalesce(F.col("palsar_valid"), F.lit(False)),
        "missing_s1": qa.any_missing(C_BAND),
        "missing_s2": qa.any_missing(OPTICAL + INDICES),
        "missing_dem": qa.any_missing(DEM),
        "missing_embedding": qa.any_missing(EMBEDDING),
    }


def keep_common(wide: DataFrame) -> DataFrame:
    """Rows valid in every feature group."""
    needed = C_BAND + OPTICAL + INDICES + DEM + EMBEDDING + L_BAND
    return wide.where(F.coalesce(F.col("palsar_valid"), F.lit(False)) & all_finite(needed))


def representation_frames(common: DataFrame, carry: Sequence[str]) -> dict[str, DataFrame]:
    """The eight guarded projections of one table; rows are identical by construction."""
    return {name: select_representation(common, name, [*KEYS, *carry]) for name in REPRESENTATIONS}


def folded(df: DataFrame, block: str, k: int = 5) -> DataFrame:
    return sampling.with_folds(df, sampling.block_folds(df, block, k), block)


