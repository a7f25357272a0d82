"""Order-dependent operators as window expressions.

Each works on rows keyed by a session column and ordered by a column with no ties in a session. All windows of a session
share one partitioning, so a chain of these operators needs one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from waymark.functions.geo import TWO_PI, wrap_two_pi

SESSION, ORDER = "session_id", "row_idx"


def ordered(by: str | Sequence[str] = SESSION, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)


def so_far(by: str | Sequence[str] = SESSION, order: str = ORDER) -> WindowSpec:
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)


def whole(by: str | Sequence[str] = SESSION) -> WindowSpec:
    return Window.partitionBy(*([by] if isinstance(by, str) else by))


def number_rows(df: DataFrame, by: str, order: Sequence[str], name: str = ORDER) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


def split_sessions(df: DataFrame, time_ms: str, by: str = SESSION, order: str = ORDER, gap_ms: float = 5000, least_rows: int = 50) -> DataFrame:
    """Sub-sessions of rows in file order, begun where time goes back or by more than gap_ms; short ones are dropped.

    Adds sub_idx, counted among those that stay, and sub_name, ``_sub%02d`` if more than one stays in the session.
    """
    step = F.col(time_ms) - F.lag(time_ms).over(ordered(by, order))
    rows = df.withColumn("_piece", F.sum(F.when((step < 0) | (step > gap_ms), 1).otherwise(0)).over(so_far(by, order)))
    rows = rows.withColumn("_n", F.count("*").over(whole([by, "_piece"]))).filter(F.col("_n") >= least_rows)
    rows = rows.withColumn("sub_idx", F.dense_rank().over(Window.partitionBy(by).orderBy("_piece")))
    many = F.max("sub_idx").over(whole(by)) > 1
    return rows.withColumn("sub_name", F.when(many, F.format_string("_sub%02d", F.col("sub_idx"))).otherwise(F.lit(""))).drop("_piece", "_n")


def add_dt(df: DataFrame, time: str, by: str = SESSION, order: str = ORDER, name: str = "dt", default: float = 0.1) -> DataFrame:
    """Differences of time; the first row of a session has their median, a session of one row the default."""
    rows = df.withColumn(name, F.col(time) - F.lag(time).over(ordered(by, order)))
    return rows.withColumn(name, F.coalesce(F.col(name), F.median(name).over(whole(by)), F.lit(default)))


def relative_time(time: str, by: str = SESSION, order: str = ORDER) -> Column:
    return F.col(time) - F.first(time).over(so_far(by, order))


def fill_both_ways(column: str, by: str = SESSION, order: str = ORDER) -> Column:
    """Forward, then backward."""
    later = ordered(by, order).rowsBetween(0, Window.unboundedFollowing)
    return F.coalesce(F.last(column, ignorenulls=True).over(so_far(by, order)), F.first(column, ignorenulls=True).over(later))


def changed(columns: Sequence[str], by: str = SESSION, order: str = ORDER) -> Column:
    """True where any column differs from the row before, and on the first row. NaN is to be made null before (signal.drop_nan)."""
    w = ordered(by, order)
    differs = [~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in columns]
    flag = differs[0]
    for d in differs[1:]:
        flag = flag | d
    return F.when(F.row_number().over(w) == 1, F.lit(True)).otherwise(flag)


def fix_id(flag: str, by: str = SESSION, order: str = ORDER) -> Column:
    return F.sum(F.col(flag).cast("bigint")).over(so_far(by, order)) - 1


def genuine_fixes(df: DataFrame, flag: str, lat: str, lon: str, by: str = SESSION, order: str = ORDER, least: int = 10, step: float = 1e-7) -> DataFrame:
    """Adds is_fix: the flag if a session has more than `least`, else where lat or lon moved by more than step."""
    w = ordered(by, order)
    moved = (F.abs(F.col(lat) - F.lag(lat).over(w)) > step) | (F.abs(F.col(lon) - F.lag(lon).over(w)) > step)
    enough = F.sum(F.col(flag).cast("bigint")).over(whole(by)) > least
    return df.withColumn("is_fix", F.when(enough, F.col(flag)).otherwise(F.coalesce(moved, F.lit(True))))


def rolling_variance(column: str, rows: int = 8, by: str = SESSION, order: str = ORDER) -> Column:
    """Of this row and the rows - 1 before it, 0 with fewer than two values.

    Welford's recurrence in the order of the rows, with the product (x - new mean) * (x - mean): a limit that a variance
    meets exactly is met or missed as in SQL.
    """
    values = F.collect_list(F.col(column).cast("double")).over(ordered(by, order).rowsBetween(-(rows - 1), 0))
    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, x: Column) -> Column:
        mean = a["mean"] + (x - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("mean"), (a["m2"] + (x - mean) * (x - a["mean"])).alias("m2"))

    return F.aggregate(values, none, add, lambda a: F.when(a["n"] > 1, a["m2"] / (a["n"] - 1)).otherwise(0.0))


def held_for(flag: Column, rows: int = 8, by: str | Sequence[str] = SESSION, order: str = ORDER) -> Column:
    """True where the flag holds on this row and the rows - 1 before it."""
    return F.sum(flag.cast("int")).over(ordered(by, order).rowsBetween(-(rows - 1), 0)) == rows


def zupt_v1(acc: Column, gyro: Column, acc_limit: float = 5.389, gyro_limit: float = 0.753, rows: int = 8, by: str | Sequence[str] = SESSION, order: str = ORDER) -> Column:
    """Stationary: small linear acceleration and turn rate for a number of rows. by may be a window instead of a session."""
    return held_for(F.coalesce((acc < acc_limit) & (gyro < gyro_limit), F.lit(False)), rows, by, order)


def zupt_v2(v1: Column, acc: str, gyro: str, acc_var: float = 3.7683, gyro_var: float = 0.0684, by: str = SESSION, order: str = ORDER) -> Column:
    return v1 & (rolling_variance(acc, by=by, order=order) < acc_var) & (rolling_variance(gyro, by=by, order=order) < gyro_var)


def rising_edges(mask: str, by: str = SESSION, order: str = ORDER) -> Column:
    return F.col(mask) & ~F.coalesce(F.lag(mask).over(ordered(by, order)), F.lit(False))


def clamped_integral(df: DataFrame, step: str, name: str = "velocity", start: str | None = None, reset: str | None = None, by: str | Sequence[str] = SESSION, order: str = ORDER) -> DataFrame:
    """v = max(0, v + step) row by row, from start (or 0), and 0 on rows where reset holds; the first row keeps the start.

    With S the running sum since the last reset, v = S - min(0, least S so far): two windows, no loop.
    """
    keys = [by] if isinstance(by, str) else list(by)
    w = so_far(keys, order)
    first = F.row_number().over(ordered(keys, order)) == 1
    rows = df.withColumn("_step", F.when(first, F.col(start) if start else F.lit(0.0)).otherwise(F.col(step)))
    if reset:
        hit = ~first & F.coalesce(F.col(reset), F.lit(False))
        rows = rows.withColumn("_hit", hit).withColumn("_span", F.sum(F.col("_hit").cast("int")).over(w))
        rows = rows.withColumn("_step", F.when(F.col("_hit"), F.lit(0.0)).otherwise(F.col("_step")))
        keys = [*keys, "_span"]
        w = so_far(keys, order)
    rows = rows.withColumn("_sum", F.sum("_step").over(w))
    return rows.withColumn(name, F.col("_sum") - F.least(F.lit(0.0), F.min("_sum").over(w))).drop("_step", "_sum", "_hit", "_span")


def integrate(column: Column, by: str | Sequence[str] = SESSION, order: str = ORDER, skip_first: bool = True) -> Column:
    """Running sum; the first row counts as 0 if skip_first."""
    if skip_first:
        column = F.when(F.row_number().over(ordered(by, order)) == 1, F.lit(0.0)).otherwise(column)
    return F.sum(column).over(so_far(by, order))


def initial_heading(bearing_deg: str, azimuth_deg: str, by: str = SESSION, order: str = ORDER) -> Column:
    """Radians: the first bearing, or the first azimuth where it's missing, NaN or 0."""
    first = lambda c: F.first(c).over(so_far(by, order))
    bad = first(bearing_deg).isNull() | F.isnan(first(bearing_deg)) | (first(bearing_deg) == 0)
    return F.radians(F.when(bad, first(azimuth_deg)).otherwise(first(bearing_deg)))


def dead_reckon(df: DataFrame, velocity: str, heading: str, dt: str, by: str | Sequence[str] = SESSION, order: str = ORDER) -> DataFrame:
    """Adds east and north: running sums of the velocity's parts."""
    return df.withColumns(
        {
            "east": integrate(F.col(velocity) * F.sin(heading) * F.col(dt), by, order),
            "north": integrate(F.col(velocity) * F.cos(heading) * F.col(dt), by, order),
        }
    )


def unwrap(df: DataFrame, angle: str, name: str, by: str = SESSION, order: str = ORDER, pi_stays: bool = True) -> DataFrame:
    """The angle without jumps of more than pi. pi_stays: a jump of pi up stays, as numpy.unwrap has it; else it counts as one down."""
    d = F.col(angle) - F.lag(angle).over(ordered(by, order))
    turned = d + F.lit(math.pi) - F.lit(TWO_PI) * F.floor((d + F.lit(math.pi)) / F.lit(TWO_PI)) - F.lit(math.pi)
    if pi_stays:
        turned = F.when((turned == -math.pi) & (d > 0), F.lit(math.pi)).otherwise(turned)
    rows = df.withColumn("_fix", F.when(F.abs(d) < math.pi, F.lit(0.0)).otherwise(F.coalesce(turned - d, F.lit(0.0))))
    return rows.withColumn(name, F.col(angle) + F.sum("_fix").over(so_far(by, order))).drop("_fix")


def gradient(value: str, time: str, by: str = SESSION, order: str = ORDER) -> Column:
    """Second-order differences over uneven steps; one-sided at the ends."""
    w = ordered(by, order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    hs, hd = F.col(time) - F.lag(time).over(w), F.lead(time).over(w) - F.col(time)
    inner = (hs * hs * after + (hd * hd - hs * hs) * F.col(value) - hd * hd * before) / (hs * hd * (hd + hs))
    return F.when(hs.isNull(), (after - F.col(value)) / hd).when(hd.isNull(), (F.col(value) - before) / hs).otherwise(inner)


def plain_gradient(value: str, time: str, by: str = SESSION, order: str = ORDER) -> Column:
    """Centred quotients, one-sided at the ends."""
    w = ordered(by, order)
    low, high = F.coalesce(F.lag(value).over(w), F.col(value)), F.coalesce(F.lead(value).over(w), F.col(value))
    t_low, t_high = F.coalesce(F.lag(time).over(w), F.col(time)), F.coalesce(F.lead(time).over(w), F.col(time))
    return F.when(t_high > t_low, (high - low) / (t_high - t_low)).otherwise(F.lit(0.0))


def pair_course(df: DataFrame, east: str, north: str, time: str, by: str = SESSION, order: str = ORDER) -> DataFrame:
    """For each fix the pair with the one before: distance, course in [0, 2 pi), and the time between them; null on the first."""
    w = ordered(by, order)
    de, dn = F.col(east) - F.lag(east).over(w), F.col(north) - F.lag(north).over(w)
    return df.withColumns({"pair_dist": F.sqrt(de * de + dn * dn), "pair_course": wrap_two_pi(F.atan2(de, dn)), "pair_t": (F.col(time) + F.lag(time).over(w)) / 2})


def previous_or_own(column: str, by: str = SESSION, order: str = ORDER) -> Column:
    """The naive forecast: the value before; the first row has its own."""
    return F.coalesce(F.lag(column).over(ordered(by, order)), F.col(column))


def less_first(column: str, by: str = SESSION, order: str = ORDER) -> Column:
    return F.col(column) - F.first(column).over(so_far(by, order))


def first_run_start(df: DataFrame, column: str, above: float, rows: int, by: str = SESSION, order: str = ORDER) -> DataFrame:
    """For each session the first row from which the column stays above a value for a number of rows."""
    w = ordered(by, order).rowsBetween(0, rows - 1)
    held = df.withColumn("_ok", (F.min(column).over(w) > above) & (F.count("*").over(w) == rows))
    return held.filter("_ok").groupBy(by).agg(F.min(order).alias("start_row"))


def middle_moving_row(df: DataFrame, column: str, above: float, by: str = SESSION, order: str = ORDER) -> DataFrame:
    """For each session the row in the middle of those where the column is above a value: element n // 2."""
    moving = df.filter(F.col(column) > above)
    numbered = moving.withColumns({"_k": F.row_number().over(ordered(by, order)) - 1, "_n": F.count("*").over(whole(by))})
    return numbered.filter(F.col("_k") == F.floor(F.col("_n") / 2)).select(by, F.col(order).alias("middle_row"))


def run_lengths(df: DataFrame, columns: Sequence[str], by: str = SESSION, order: str = ORDER) -> DataFrame:
    """One row for each run of equal values: session, run, n."""
    rows = df.withColumn("_new", changed(columns, by, order).cast("int"))
    return rows.withColumn("run", F.sum("_new").over(so_far(by, order))).groupBy(by, "run").agg(F.count("*").alias("n"))


def decimate(df: DataFrame, every: int, order: str = ORDER) -> DataFrame:
    return df.filter(F.col(order) % every == 0)


def dealt(df: DataFrame, by: str = SESSION) -> DataFrame:
    """df dealt by a key over as many tasks as shuffles have, for groups in Python: small rows that cost much time each
    would else be merged into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
