"""Feature tables of windows and segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.geo import magnitude
from waymark.operators.windows import clamped_integral, integrate, ordered

#: The order of the signals is part of the feature vectors: fixed values.
AXES = ("acc_x", "acc_y", "acc_z", "acc_lin_x", "acc_lin_y", "acc_lin_z", "gyro_x", "gyro_y", "gyro_z", "acc_veh_fwd", "gyro_veh_yaw_rate")
MAGNITUDES = {"a_mag": ("acc_x", "acc_y", "acc_z"), "w_mag": ("gyro_x", "gyro_y", "gyro_z"), "al_mag": ("acc_lin_x", "acc_lin_y", "acc_lin_z")}
SIGNALS_56 = (*AXES, "a_mag", "w_mag", "al_mag")
SIGNALS_58 = (*AXES, "a_mag", "al_mag", "w_mag")
STATS = ("mean", "std", "min", "max")


def with_magnitudes(df: DataFrame) -> DataFrame:
    """Adds the three magnitudes; axes that are missing count as zero."""
    missing = {c: F.lit(0.0) for c in AXES if c not in df.columns}
    return df.withColumns(missing).withColumns({name: magnitude(*(F.col(c) for c in axes)) for name, axes in MAGNITUDES.items()})


def stats_of(signal: str) -> dict[str, Column]:
    x = F.col(signal)
    return {f"{signal}_mean": F.avg(x), f"{signal}_std": F.stddev_pop(x), f"{signal}_min": F.min(x), f"{signal}_max": F.max(x)}


def features_58(df: DataFrame, segment: Sequence[str], dt: str = "dt") -> DataFrame:
    """The 56 statistics of each segment, its duration and its rows."""
    found = [x.alias(name) for s in SIGNALS_58 for name, x in stats_of(s).items()]
    return with_magnitudes(df).groupBy(*segment).agg(*found, F.sum(dt).alias("seg_dur_s"), F.count("*").alias("seg_n_samples"))


def fix_segments(df: DataFrame, flag: str, time: str, speed: str, by: str = "session_id", order: str = "row_idx", most_s: float = 30.0, still: float = 0.5) -> DataFrame:
    """Pairs of consecutive fixes: at least two rows apart, at most most_s, not still at both ends."""
    fixes = df.filter(F.col(flag)).select(by, F.col(order).alias("seg_start"), F.col(time).alias("t_start_s"), F.col(speed).alias("v_k"), *(c for c in ("east", "north", "heading") if c in df.columns))
    w = ordered(by, "seg_start")
    pairs = fixes.withColumns({"seg_end": F.lead("seg_start").over(w), "t_end_s": F.lead("t_start_s").over(w), "v_k1": F.lead("v_k").over(w)})
    if "east" in df.columns and "north" in df.columns:
        de, dn = F.lead("east").over(w) - F.col("east"), F.lead("north").over(w) - F.col("north")
        pairs = pairs.withColumn("ds_gnss", F.sqrt(de * de + dn * dn))
    pairs = pairs.withColumn("dur_s", F.col("t_end_s") - F.col("t_start_s"))
    return pairs.filter((F.col("seg_end") - F.col("seg_start") >= 2) & (F.col("dur_s") > 0) & (F.col("dur_s") <= most_s) & ~((F.col("v_k") < still) & (F.col("v_k1") < still)))


def segment_displacement(samples: DataFrame, segments: DataFrame, fwd: str, yaw: str, dt: str, by: str = "session_id", order: str = "row_idx") -> DataFrame:
    """Open-loop displacement of each segment from its first speed and heading: ds_imu and v_end.

    samples have seg_start, the segment they belong to (rows after the first fix up to the next). One shuffle by session.
    """
    keys = [by, "seg_start"]
    rows = samples.join(segments.select(by, "seg_start", "v_k", F.col("heading").alias("_h0")), keys)
    rows = rows.withColumn("_inc", F.col(fwd) * F.col(dt))
    first = F.row_number().over(ordered(keys, order)) == 1
    rows = rows.withColumn("_start", F.greatest(F.lit(0.0), F.col("v_k") + F.when(first, F.col("_inc"))))
    rows = clamped_integral(rows, "_inc", "_v", start="_start", by=keys, order=order)
    rows = rows.withColumn("_psi", F.col("_h0") + integrate(F.col(yaw) * F.col(dt), keys, order, skip_first=False))
    de, dn = F.col("_v") * F.sin("_psi") * F.col(dt), F.col("_v") * F.cos("_psi") * F.col(dt)
    sums = rows.groupBy(*keys).agg(F.sum(de).alias("de"), F.sum(dn).alias("dn"), F.max_by("_v", order).alias("v_end"))
    return sums.select(*keys, F.sqrt(F.col("de") * F.col("de") + F.col("dn") * F.col("dn")).alias("ds_imu"), "v_end")


def overlapped_windows(df: DataFrame, rows: int = 91, by: str = "session_id", order: str = "row_idx") -> DataFrame:
    """Windows of `rows` rows that share their end row: a row at a multiple of rows - 1 is in two. Single rows are dropped."""
    step = rows - 1
    k = F.floor(F.col(order) / step)
    both = F.when((F.col(order) % step == 0) & (F.col(order) > 0), F.array(k - 1, k)).otherwise(F.array(k))
    spread = df.withColumn("window_idx", F.explode(both))
    return spread.withColumn("_n", F.count("*").over(Window.partitionBy(by, "window_idx"))).filter(F.col("_n") >= 2).drop("_n")

