"""Optical masks and spectral indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geotransfer.functions.numeric import _col
from geotransfer.schemas import CLOUD_BITS, CLOUD_CLASSES, OPTICAL


def normalised_difference(a, b) -> Column:
    x, y = _col(a), _col(b)
    return F.try_divide(x - y, x + y)


def enhanced_vegetation_index(nir, red, blue) -> Column:
    n, r, b = _col(nir), _col(red), _col(blue)
    return F.try_divide(F.lit(2.5) * (n - r),
                        n + F.lit(6.0) * r - F.lit(7.5) * b + F.lit(1.0))


def with_indices(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "NDVI": normalised_difference("B8", "B4"),
        "EVI": enhanced_vegetation_index("B8", "B4", "B2"),
        "NDMI": normalised_difference("B8", "B11"),
        "NBR": normalised_difference("B8", "B12"),
        "NDRE": normalised_difference("B8A", "B5"),
    })


def bit_is_clear(value, bit: int) -> Column:
    return _col(value).bitwiseAND(F.lit(1 << bit)) == 0


def clear_sky(scene_class="SCL", qa="QA60") -> Column:
    ok = ~_col(scene_class).isin(*CLOUD_CLASSES)
    for bit in CLOUD_BITS:
        ok = ok & bit_is_clear(qa, bit)
    return ok


def masked_reflectance(df: DataFrame, bands=tuple(OPTICAL), scale: float = 1e-4) -> DataFrame:
    """Drop cloudy observations and scale the integer bands to reflectance."""
    keep = df.where(clear_sky())
    return keep.withColumns({b: F.col(b) * F.lit(scale) for b in bands})
