"""Feature lists, class codes and protected names shared by the operators.

Fixed values: column names, class codes and file formats that must equal the
published data model for results to agree. They are stated as plain lists.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
SEED = 42
KEYS = ["shot_number", "year"]
SOURCE_BLOCK = "spatial_block_id"
TARGET_BLOCK = "target_block_id"
FOLD = "spatial_fold"
RESPONSE = "agbd"
SENTINEL = -9999.0

DEM = ["elevation", "slope", "aspect_sin", "aspect_cos"]
C_BAND = ["VV", "VH", "VV_minus_VH"]
OPTICAL = ["B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12"]
INDICES = ["NDVI", "EVI", "NDMI", "NBR", "NDRE"]
L_BAND = ["palsar_hh_db", "palsar_hv_db", "palsar_hh_minus_hv_db", "palsar_rfdi"]
EMBEDDING = [f"A{i:02d}" for i in range(64)]
L_BAND_QC = ["palsar_angle", "palsar_epoch", "palsar_acquisition_date", "palsar_qa"]

VALID_QA = (1, 255)
DOCUMENTED_QA = (0, 1, 2, 3, 4, 50, 100, 150, 255)
CLOUD_CLASSES = (1, 3, 8, 9, 10, 11)
CLOUD_BITS = (10, 11)

FORBIDDEN_PREDICTORS = frozenset({
    "agbd", "agbd_se", "shot_number", "lon", "lat", "longitude", "latitude", "geometry",
    "spatial_block_id", "target_block_id", "spatial_fold", "block_e_index",
    "block_n_index", "palsar_angle", "palsar_epoch", "palsar_acquisition_date",
    "palsar_qa", "qa", "epoch", "angle",
})

PROTECTED_STAGES = frozenset({
    "source_sampling", "feature_engineering", "representation_selection",
    "model_tuning", "palsar_aggregation_selection",
})

QA_STAGES = [
    "all_intersecting_shots", "algorithm_run_flag_eq_1", "required_fields_nonnull",
    "l4_quality_flag_eq_1", "degrade_flag_eq_0", "agbd_nonnegative", "agbd_se_nonnegative",
]

FEW_SHOT_BUDGETS = [25, 50, 100, 250, 500, 1000, 2500]
FEW_SHOT_SEEDS = [42, 43, 44]
R2_THRESHOLDS = [0.0, 0.2, 0.4, 0.5]

REPRESENTATIONS = {
    "dem": DEM,
    "sentinel1_c": C_BAND + DEM,
    "palsar_l": L_BAND + DEM,
    "sentinel1_c_palsar_l": C_BAND + L_BAND + DEM,
    "sentinel1_sentinel2": C_BAND + OPTICAL + INDICES + DEM,
    "palsar_sentinel2": L_BAND + OPTICAL + INDICES + DEM,
    "sentinel1_palsar_sentinel2": C_BAND + L_BAND + OPTICAL + INDICES + DEM,
    "embedding64": EMBEDDING + DEM,
}
# ----------------------------------------------------------------------------
