"""The data-quality report of raw sessions: nine questions, each a small table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.signal import mounting_class
from waymark.operators import aggregates as agg
from waymark.operators.windows import ordered
from waymark.sources.schema import HEADERS, header_difference

#: (channel, least, greatest) of a vehicle's phone: fixed values for the range check.
RANGES = (("gps_lat", -90.0, 90.0), ("gps_lon", -180.0, 180.0), ("gps_speed_kmh", 0.0, 250.0), ("acc_x", -80.0, 80.0), ("acc_y", -80.0, 80.0), ("acc_z", -80.0, 80.0), ("gyro_x", -35.0, 35.0), ("gyro_y", -35.0, 35.0), ("gyro_z", -35.0, 35.0))


def profile(raw: DataFrame, ranges: Sequence[tuple[str, float, float]] = RANGES, by: str = "session_id") -> dict[str, DataFrame | dict]:
    """readable rows, header difference, sampling, position runs, nulls, duplicates, ranges and mounting of raw sessions."""
    channels = [c for c in raw.columns if c not in (by, "row_idx", "source_file")]
    timed = raw.withColumn("_dt", F.col("time_ms") - F.lag("time_ms").over(ordered(by)))
    gravity = raw.groupBy(by).agg(*(F.avg(f"grav_{a}").alias(f"g{a}") for a in "xyz"))
    return {
        "rows": raw.groupBy(by).agg(F.count("*").alias("n_rows")),
        "header": header_difference(channels, list(HEADERS)),
        "sampling": agg.dt_profile(timed, "_dt", by),
        "runs": agg.run_length_stats(raw, ["gps_lat", "gps_lon"], by, "row_idx"),
        "nulls": agg.null_counts(raw.select(*channels)),
        "duplicates": agg.duplicate_rows(raw.select(by, *channels)),
        "ranges": agg.range_check(raw, [r for r in ranges if r[0] in channels]),
        "mounting": gravity.withColumn("mounting", mounting_class(F.col("gx"), F.col("gy"), F.col("gz"))),
    }
