"""The edge engine: a trajectory from windows of samples, each one's displacement corrected by a model.

Speed and heading run on from window to window and don't depend on the correction, so they are window functions over the
session; the corrected displacements are then summed. No loop and no driver state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.geo import magnitude
from waymark.operators.features import features_58, overlapped_windows
from waymark.operators.windows import clamped_integral, integrate, zupt_v1

WINDOW_ROWS = 91
#: A window is stationary if at least half its rows are, or so many in a row, and it hardly moved.
STILL_RUN, STILL_M = 8, 0.10
#: A row is quiet under these, as in the stationary mask.
ACC_LIMIT, GYRO_LIMIT = 5.389, 0.753


def window_physics(samples: DataFrame, rows: int = WINDOW_ROWS, mask: str | None = None, start_v: float = 0.0, start_psi: float = 0.0) -> DataFrame:
    """For each window: de, dn, ds_imu, the end row, speed and heading, how many rows were still, and how many quiet rows end it.

    samples: session_id, row_idx and the edge columns. The stationary mask is found within each window, so it starts anew with
    it, unless a column of the session's own mask is given.
    """
    spread = overlapped_windows(samples, rows)
    acc = magnitude(*(F.col(c) for c in ("acc_lin_x", "acc_lin_y", "acc_lin_z")))
    gyro = magnitude(*(F.col(c) for c in ("gyro_x", "gyro_y", "gyro_z")))
    still = F.col(mask) if mask else zupt_v1(acc, gyro, by=["session_id", "window_idx"])
    quiet = F.coalesce((acc < ACC_LIMIT) & (gyro < GYRO_LIMIT), F.lit(False))
    spread = spread.withColumns({"_still": still, "_quiet": quiet})
    tails = spread.groupBy("session_id", "window_idx").agg((F.max("row_idx") - F.coalesce(F.max(F.when(~F.col("_quiet"), F.col("row_idx"))), F.min("row_idx") - 1)).alias("n_tail"))
    steps = spread.filter((F.col("row_idx") == 0) | (F.floor((F.col("row_idx") - 1) / (rows - 1)) == F.col("window_idx")))  # each row once
    steps = steps.withColumns({"_inc": F.col("acc_veh_fwd") * F.col("dt_sec"), "_v0": F.lit(start_v)})
    steps = clamped_integral(steps, "_inc", "velocity", start="_v0", reset="_still")
    steps = steps.withColumn("heading", F.lit(start_psi) + integrate(F.col("gyro_veh_yaw_rate") * F.col("dt_sec")))
    moved = F.when(F.col("row_idx") > 0, F.col("velocity") * F.col("dt_sec")).otherwise(F.lit(0.0))
    sums = steps.groupBy("session_id", "window_idx").agg(
        F.sum(moved * F.sin("heading")).alias("de"), F.sum(moved * F.cos("heading")).alias("dn"), F.max("row_idx").alias("t_idx"), F.max_by("velocity", "row_idx").alias("velocity"),
        F.max_by("heading", "row_idx").alias("heading"), F.count("*").alias("n_rows"), F.sum(F.col("_still").cast("bigint")).alias("n_still"),
    )
    sums = sums.join(tails, ["session_id", "window_idx"])
    return sums.withColumn("ds_imu", F.sqrt(F.col("de") * F.col("de") + F.col("dn") * F.col("dn")))


def no_correction(features: DataFrame) -> DataFrame:
    """The model that corrects nothing."""
    return features.select("session_id", "window_idx", F.lit(0.0).alias("ds_corr"))


def is_stationary() -> Column:
    """The rule for a whole window: enough still rows, or quiet ones at its end, hardly any displacement, and no speed left."""
    return ((F.col("n_still") >= F.floor(F.col("n_rows") / 2)) | (F.col("n_tail") >= STILL_RUN)) & (F.col("ds_imu") < STILL_M) & (F.col("velocity") == 0)


def run_engine(samples: DataFrame, model: Callable[[DataFrame], DataFrame] = no_correction, rows: int = WINDOW_ROWS, skip_still: bool = False) -> DataFrame:
    """The trajectory: a row at each session's start and at each window's end.

    model: from the windows' 58 features to (session_id, window_idx, ds_corr); a null counts as 0 and is flagged. skip_still:
    stationary windows aren't corrected.
    """
    physics = window_physics(samples, rows)
    features = features_58(overlapped_windows(samples, rows), ["session_id", "window_idx"], "dt_sec")
    found = physics.join(model(features), ["session_id", "window_idx"], "left")
    failed = F.col("ds_corr").isNull()
    corr = F.coalesce(F.col("ds_corr"), F.lit(0.0))
    if skip_still:
        corr = F.when(is_stationary(), F.lit(0.0)).otherwise(corr)
    found = found.withColumns({"correction_failed": failed, "ds_corr": corr})
    ds = F.greatest(F.lit(0.0), F.col("ds_imu") + F.col("ds_corr"))
    way = F.when(F.col("ds_imu") > 1e-3, F.atan2("de", "dn")).otherwise(F.col("heading"))
    found = found.withColumns({"_e": ds * F.sin(way), "_n": ds * F.cos(way)})
    w = Window.partitionBy("session_id").orderBy("window_idx").rowsBetween(Window.unboundedPreceding, 0)
    out = found.select("session_id", F.col("t_idx").cast("bigint").alias("t_idx"), F.sum("_e").over(w).alias("x"), F.sum("_n").over(w).alias("y"), "heading", "velocity", "ds_imu", "ds_corr", "correction_failed")
    zero = [F.lit(0.0).alias(c) for c in ("x", "y", "heading", "velocity", "ds_imu", "ds_corr")]
    starts = samples.select("session_id").distinct().select("session_id", F.lit(0).cast("bigint").alias("t_idx"), *zero, F.lit(False).alias("correction_failed"))
    return starts.unionByName(out)
