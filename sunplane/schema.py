"""The output table: 31 columns, fixed in name, order and type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name, type, nullable.
_FIELDS = [
    ("polygon_id", T.StringType(), False),
    ("geometry", T.BinaryType(), False),
    ("n_points_panel", T.IntegerType(), False),
    ("n_inliers_panel", T.IntegerType(), False),
    ("panel_tilt_deg", T.FloatType(), True),
    ("panel_azimuth_deg", T.FloatType(), True),
    ("panel_rmse_m", T.FloatType(), True),
    ("panel_tilt_unc_deg", T.FloatType(), True),
    ("panel_azimuth_unc_deg", T.FloatType(), True),
    ("n_planes_detected", T.ByteType(), False),
    ("secondary_tilt_deg", T.FloatType(), True),
    ("secondary_azimuth_deg", T.FloatType(), True),
    ("roof_tilt_deg", T.FloatType(), True),
    ("roof_azimuth_deg", T.FloatType(), True),
    ("roof_rmse_m", T.FloatType(), True),
    ("panel_roof_angle_deg", T.FloatType(), True),
    ("height_above_roof_m", T.FloatType(), True),
    ("height_above_ground_m", T.FloatType(), False),
    ("on_building", T.BooleanType(), False),
    ("building_id", T.StringType(), True),
    ("area_m2", T.FloatType(), False),
    ("aspect_ratio", T.FloatType(), True),
    ("mounting_type", T.StringType(), False),
    ("mounting_confidence", T.FloatType(), False),
    ("mounting_rule", T.StringType(), False),
    ("flags", T.ArrayType(T.StringType()), False),
    ("lidar_tile_ids", T.ArrayType(T.StringType()), False),
    ("pkg_version", T.StringType(), False),
    ("config_hash", T.StringType(), False),
    ("run_id", T.StringType(), False),
    ("partition_id", T.IntegerType(), False),
]

OUTPUT = T.StructType([T.StructField(*f) for f in _FIELDS])
VERSION = "0.1.0"


def conform(rows: DataFrame) -> DataFrame:
    """rows with exactly the output's columns and types; NaN becomes null. KeyError if a column is missing."""
    missing = [f.name for f in OUTPUT if f.name not in rows.columns]
    if missing:
        raise KeyError(f"columns missing from the output: {', '.join(missing)}")
    number = lambda f: F.when(~F.isnan(F.col(f.name).cast("double")), F.col(f.name)).cast(f.dataType) if isinstance(f.dataType, T.FloatType) else F.col(f.name).cast(f.dataType)
    return rows.select(*[number(f).alias(f.name) for f in OUTPUT])
