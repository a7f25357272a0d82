"""From raw session rows to processed sessions, and from sensor files to the edge contract."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.geo import vehicle_frame
from waymark.operators import windows as win
from waymark.operators.joins import asof_nearest, common_span, regular_grid

TEXT = ("session_id", "row_idx", "source_file", "date_str", "gps_satellites")


def process_sessions(raw: DataFrame, gap_ms: float = 5000, least_rows: int = 50) -> DataFrame:
    """Repeated rows dropped, gaps filled both ways over the whole file, sub-sessions split, and derived channels added."""
    channels = [c for c in raw.columns if c not in ("row_idx",)]
    rows = raw.withColumn("_k", F.row_number().over(Window.partitionBy(*channels).orderBy("row_idx"))).filter("_k = 1").drop("_k")
    rows = rows.withColumns({c: win.fill_both_ways(c) for c in rows.columns if c not in TEXT})
    rows = win.split_sessions(rows, "time_ms", gap_ms=gap_ms, least_rows=least_rows)
    rows = rows.withColumn("session_id", F.concat("session_id", "sub_name")).drop("sub_name", "sub_idx")
    rows = rows.withColumn("row_idx", F.row_number().over(win.ordered()).cast("bigint") - 1)
    rows = rows.withColumn("time_rel_sec", win.relative_time("time_ms") / 1000)
    rows = win.add_dt(rows, "time_rel_sec", name="dt_sec")
    rows = rows.withColumns({f"acc_lin_{a}": F.col(f"acc_{a}") - F.col(f"grav_{a}") for a in "xyz"})
    rows = rows.withColumns({"gps_speed_ms": F.col("gps_speed_kmh") / 3.6, "is_gnss_update": win.changed(["gps_lat", "gps_lon"])})
    return rows.withColumn("gnss_fix_id", win.fix_id("is_gnss_update"))


def add_vehicle_frame(rows: DataFrame, yaw: DataFrame) -> DataFrame:
    """rows with vehicle-frame columns; yaw: session_id, mounting_yaw_deg, alignment_corr (aggregates.yaw_alignment)."""
    c = F.col
    joined = rows.join(yaw, "session_id", "left").withColumns({"mounting_yaw_deg": F.coalesce("mounting_yaw_deg", F.lit(0.0)), "mounting_alignment_corr": F.coalesce("alignment_corr", F.lit(0.0))}).drop("alignment_corr")
    return joined.withColumns(vehicle_frame(*(c(f"acc_lin_{a}") for a in "xyz"), *(c(f"grav_{a}") for a in "xyz"), *(c(f"gyro_{a}") for a in "xyz"), F.radians("mounting_yaw_deg")))


def adapt_sensors(acc_lin: DataFrame, gravity: DataFrame, gyro: DataFrame, total: DataFrame, session: str = "device", yaw_deg: float = 0.0, step: float = 0.1) -> DataFrame:
    """The edge contract from four sensors (t, prefix_x/y/z with prefixes acc_lin, grav, gyro, acc): their common span on a
    regular grid, each sensor's nearest sample, dt, and the vehicle frame."""
    sides = [s.withColumn("session_id", F.lit(session)) for s in (acc_lin, gravity, gyro, total)]
    grid = regular_grid(common_span(sides, "session_id", "t"), "session_id", "t0", "t1", step, "t")
    for side, prefix in zip(sides, ("acc_lin", "grav", "gyro", "acc"), strict=True):
        grid = asof_nearest(grid, side, "session_id", "t", [f"{prefix}_{a}" for a in "xyz"])
    grid = win.number_rows(grid, "session_id", ["t"]).withColumn("row_idx", F.col("row_idx").cast("bigint"))
    grid = grid.withColumn("dt_sec", F.coalesce(F.col("t") - F.lag("t").over(win.ordered()), F.lit(step)))
    c = F.col
    return grid.withColumns(vehicle_frame(*(c(f"acc_lin_{a}") for a in "xyz"), *(c(f"grav_{a}") for a in "xyz"), *(c(f"gyro_{a}") for a in "xyz"), F.lit(math.radians(yaw_deg))))


def split_reason(name: str = "session_id"):
    """Why a session was split, by its name."""
    return F.when(~F.col(name).contains("_sub"), "single").when(F.col(name).contains("S-Vtb1_sub"), "gap+duplicates").otherwise("time reset")
