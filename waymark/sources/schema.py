"""Columns of raw sessions: header spellings, units, and checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Canonical names and the headers that stand for them, without case: fixed values.
HEADERS = {
    "gps_lat": ("GPS LATITUDE (degrees)",),
    "gps_lon": ("GPS LONGITUDE (degrees)",),
    "gps_alt": ("GPS ALTITUDE (m)",),
    "gps_speed_kmh": ("GPS SPEED (Kmh)",),
    "gps_accuracy_m": ("GPS ACCURACY (m)",),
    "gps_bearing_deg": ("GPS ORIENTATION (°)", "GPS ORIENTATION (A)"),
    "gps_satellites": ("GPS SATELLITES IN RANGE",),
    "time_ms": ("TIME SINCE START (ms)",),
    "date_str": ("DATE (YYYY-MO-DD HH-MI-SS_SSS)", "DATE (YYYY-MO-DD HH-MI-SS_SSS"),
    **{f"acc_{a}": (f"ACCELEROMETER {a} (m/s²)", f"ACCELEROMETER {a} (m/s)") for a in "xyz"},
    **{f"grav_{a}": (f"GRAVITY {a} (m/s²)", f"GRAVITY {a} (m/s)") for a in "xyz"},
    **{f"gyro_{a}": (f"GYROSCOPE {a} (rad/s)",) for a in "xyz"},
    **{f"mag_{a}": (f"MAGNETIC FIELD {a} (μT)", f"MAGNETIC FIELD {a} (IT)") for a in "xyz"},
    "ori_azimuth_deg": ("ORIENTATION (Azimuth) (°)", "ORIENTATION (Azimuth) (A)"),
    "ori_pitch_deg": ("ORIENTATION (Pitch) (°)", "ORIENTATION (Pitch) (A)"),
    "ori_roll_deg": ("ORIENTATION (Roll ) (°)", "ORIENTATION (Roll ) (A)"),
}
EDGE_COLUMNS = ("acc_x", "acc_y", "acc_z", "acc_lin_x", "acc_lin_y", "acc_lin_z", "gyro_x", "gyro_y", "gyro_z", "acc_veh_fwd", "gyro_veh_yaw_rate", "dt_sec")
_TEXT = ("date_str", "gps_satellites")


def _folded(header: str) -> str:
    return re.sub(r"\s+", " ", header.strip()).upper()  # upper() also folds the two signs for micro


_BY_HEADER = {_folded(h): name for name, headers in HEADERS.items() for h in headers}


def canonical_name(header: str) -> str:
    """The canonical name of a header; unknown ones in lower case with underscores and without brackets."""
    return _BY_HEADER.get(_folded(header)) or header.strip().lower().replace(" ", "_").replace("(", "").replace(")", "")


def with_canonical_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(canonical_name(c) for c in df.columns))


def resolve(df: DataFrame, *keywords: str) -> str | None:
    """The first column whose name holds the first keyword that any column holds."""
    for keyword in keywords:
        for c in df.columns:
            if keyword.lower() in c.lower():
                return c
    return None


def column_or_zero(df: DataFrame, keyword: str) -> Column:
    name = resolve(df, keyword)
    return F.col(name) if name else F.lit(0.0)


def require(df: DataFrame, columns: Sequence[str] = EDGE_COLUMNS) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns, *(c for c in df.columns if c not in columns))


def header_difference(found: Sequence[str], wanted: Sequence[str]) -> dict[str, list[str]]:
    return {"missing": [c for c in wanted if c not in found], "extra": [c for c in found if c not in wanted]}


def typed(df: DataFrame) -> DataFrame:
    """Numeric channels as doubles, NaN as null."""
    cast = lambda c: F.col(c).cast("double")
    return df.select(*(F.col(c) if c in _TEXT or c in ("session_id", "row_idx", "source_file") else F.when(~F.isnan(cast(c)), cast(c)).alias(c) for c in df.columns))
