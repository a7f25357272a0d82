"""Simulated positioning outages: choosing windows, physics baselines, and corrected displacement by interval."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from waymark.functions.geo import wrap_pi
from waymark.operators.joins import range_join
from waymark.operators.windows import clamped_integral, ordered


def outage_candidates(samples: DataFrame, time: str, speed: str, flag: str, durations: list[float], by: str = "session_id", order: str = "row_idx", least_speed: float = 2.0, margin: float = 0.1) -> DataFrame:
    """Moving fixes from which an outage of a duration fits between the margins of the session: (session, duration_s, start, end).

    Rows of the duration and of the margin are cut to whole ones. An outage ends at the first fix at or after its duration,
    or at the session's last fix if there's none. One window over fixes and ends finds it.
    """
    spans = samples.groupBy(by).agg(F.count("*").alias("n"), F.median("dt").alias("dt_med"))
    fixes = samples.filter(F.col(flag)).select(by, F.col(order).alias("start_row"), (F.col(speed) > least_speed).alias("moving"))
    rows = fixes.filter("moving").join(spans, by).withColumn("duration_s", F.explode(F.array(*(F.lit(float(d)) for d in durations))))
    rows = rows.withColumns({"dur": F.floor(F.col("duration_s") / F.col("dt_med")), "edge": F.floor(margin * F.col("n"))})
    rows = rows.filter("start_row >= edge AND start_row <= n - dur - edge AND start_row + dur < n")
    none = F.lit(None).cast("bigint")
    ends = rows.select(by, (F.col("start_row") + F.col("dur")).alias("at"), none.alias("fix"), "start_row", "duration_s")
    line = ends.unionByName(fixes.select(by, F.col("start_row").alias("at"), F.col("start_row").alias("fix"), none.alias("start_row"), F.lit(None).cast("double").alias("duration_s")))
    session = Window.partitionBy(by).orderBy("at")
    next_fix = F.min("fix").over(session.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    last_fix = F.max("fix").over(session.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return line.withColumn("end_row", F.coalesce(next_fix, last_fix)).filter("duration_s IS NOT NULL").select(by, "duration_s", "start_row", "end_row")


def choice_order(seed: int = 42, by: str = "session_id") -> Column:
    """A seeded priority of each candidate, of its own for each session and duration: a hash, so it needs no order of rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(by).cast("string"), F.col("duration_s").cast("string"), F.col("start_row").cast("string"), F.col("end_row").cast("string")))


def choose_apart(candidates: DataFrame, most: int = 8, seed: int = 42, by: str = "session_id") -> DataFrame:
    """At most `most` windows of a session and duration that don't overlap, the first of a seeded order that each leaves room for.

    Rows are sorted by session, duration and priority, and go by: a task holds no more than the windows taken so far, so a
    session may have any number of candidates. window_idx counts a group's windows by their start. Equal candidates are one.
    """
    kind = dict(candidates.dtypes)[by]
    keys = [by, "duration_s"]
    rows = candidates.select(*keys, "start_row", "end_row").distinct().withColumn("_order", choice_order(seed, by))
    rows = rows.repartition(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "_order", "start_row", "end_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken, out = None, [], []

        def close() -> None:
            out.extend((*group, a, b, k) for k, (a, b) in enumerate(sorted(taken)))
            taken.clear()

        names = [*keys, "start_row", "end_row"]
        for batch in batches:
            for *own, start, end in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if own != group:
                    if group:
                        close()
                    group = own
                if len(taken) < most and all(end < a or start > b for a, b in taken):
                    taken.append((start, end))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[*names, "window_idx"])
                out.clear()
        if group:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[*names, "window_idx"])

    types = [to_arrow_type(candidates.schema[by].dataType), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    return rows.mapInArrow(run, f"{by} {kind}, duration_s double, start_row bigint, end_row bigint, window_idx bigint")


OUTAGE = ("session_id", "outage_id")


def simulate_physics(samples: DataFrame, outages: DataFrame, fwd: str = "acc_veh_fwd", yaw: str = "gyro_veh_yaw_rate", dt: str = "dt", mask: str | None = None, bucket: int = 512) -> DataFrame:
    """Dead reckoning through each outage, from its first row's truth; with mask, speed is 0 where it holds.

    outages: session_id, outage_id, start_row, end_row, v0, psi0. samples: session_id, row_idx and the signals. Returns a row
    for each sample of an outage with velocity, psi, east, north from its start: a range join, then windows by outage.
    """
    keys = list(OUTAGE)
    rows = range_join(samples, outages, "session_id", "row_idx", "start_row", "end_row", bucket)
    rows = rows.withColumn("_inc", F.col(fwd) * F.col(dt))
    w = ordered(keys, "row_idx")
    first = F.row_number().over(w) == 1
    still = F.coalesce(F.col(mask), F.lit(False)) if mask else F.lit(False)
    rows = rows.withColumn("_start", F.when(still, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("v0") + F.when(first, F.col("_inc")))))
    rows = clamped_integral(rows, "_inc", "velocity", start="_start", reset=mask, by=keys, order="row_idx")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("psi", F.col("psi0") + F.sum(F.col(yaw) * F.col(dt)).over(running))
    step = F.col("velocity") * F.col(dt)
    return rows.withColumns({"east": F.sum(step * F.sin("psi")).over(running), "north": F.sum(step * F.cos("psi")).over(running)}).drop("_inc", "_start")


def biases_before(samples: DataFrame, outages: DataFrame, time: str, still: str, window: float = 60.0, least: int = 50, most_acc: float = 1.0, most_turn: float = 0.1) -> DataFrame:
    """outages with b_fwd, b_lat, b_yaw and calibrated: the means of the signals (fwd, lat, yaw) over the still samples of the
    window that ends with each outage's start, both ends included, clipped; 0 and false with fewer than `least` of them.

    outages: session_id, outage_id and t_start, in the unit of time. The windows are cut at multiples of their length, so it's an
    equi-join of two buckets an outage, and neither side need be small. Null and NaN signals of a still sample don't count.
    """
    keys = list(OUTAGE)
    bucket = lambda c: F.floor(c / window)
    quiet = samples.filter(F.col(still)).select("session_id", F.col(time).alias("_t"), "fwd", "lat", "yaw").withColumn("_bucket", bucket(F.col("_t")))
    spans = outages.select(*keys, "t_start").withColumn("_bucket", F.explode(F.sequence(bucket(F.col("t_start") - window), bucket(F.col("t_start")))))
    own = quiet.join(spans, ["session_id", "_bucket"]).filter((F.col("_t") >= F.col("t_start") - window) & (F.col("_t") <= F.col("t_start")))
    means = own.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.coalesce(F.avg(F.nanvl(c, F.lit(None).cast("double"))), F.lit(0.0)).alias(f"b_{c}") for c in ("fwd", "lat", "yaw")))
    enough = F.coalesce(F.col("_n") >= least, F.lit(False))
    clipped = lambda c, most: F.when(enough, F.greatest(F.lit(-most), F.least(F.lit(most), c))).otherwise(0.0)
    found = outages.join(means, keys, "left").withColumns({"b_fwd": clipped("b_fwd", most_acc), "b_lat": clipped("b_lat", most_acc), "b_yaw": clipped("b_yaw", most_turn), "calibrated": enough})
    return found.drop("_n")


def outage_errors(path: DataFrame, truth: DataFrame) -> DataFrame:
    """Errors at each outage's last row. truth: session_id, outage_id, true_east, true_north (from its start), true_v, true_psi."""
    last = path.groupBy(*OUTAGE).agg(F.max(F.struct("row_idx", "east", "north", "velocity", "psi")).alias("z"), F.sum("dt").alias("actual_dur_s"))
    e = last.join(truth, list(OUTAGE))
    pos = F.sqrt(F.pow(F.col("z.east") - F.col("true_east"), F.lit(2.0)) + F.pow(F.col("z.north") - F.col("true_north"), F.lit(2.0)))
    return e.select(*OUTAGE, "actual_dur_s", pos.alias("pos_err_m"), F.abs(F.col("z.velocity") - F.col("true_v")).alias("vel_err_ms"), F.degrees(F.abs(wrap_pi(F.col("z.psi") - F.col("true_psi")))).alias("head_err_deg"))


def interval_index(path: DataFrame, rows: int = 90, least_s: float = 2.0, dt: str = "dt") -> DataFrame:
    """Adds interval, of `rows` rows of an outage; a last one shorter than least_s joins the one before."""
    w = ordered(list(OUTAGE), "row_idx")
    own = path.withColumn("_k", F.floor((F.row_number().over(w) - 1) / rows).cast("bigint"))
    whole = Window.partitionBy(*OUTAGE)
    own = own.withColumn("_last", F.max("_k").over(whole))
    own = own.withColumn("_tail", F.sum(F.when(F.col("_k") == F.col("_last"), F.col(dt)).otherwise(0.0)).over(whole))
    short = (F.col("_k") == F.col("_last")) & (F.col("_last") > 0) & (F.col("_tail") < least_s)
    return own.withColumn("interval", F.when(short, F.col("_k") - 1).otherwise(F.col("_k"))).drop("_k", "_last", "_tail")


def corrected_displacement(intervals: DataFrame, correction: str) -> DataFrame:
    """Positions from intervals (de, dn, psi_end) whose length is corrected: ds = max(0, |d| + correction), along its own direction or psi_end.

    Adds ds, and the running east and north.
    """
    size = F.sqrt(F.col("de") * F.col("de") + F.col("dn") * F.col("dn"))
    ds = F.greatest(F.lit(0.0), size + F.col(correction))
    way = F.when(size > 1e-3, F.atan2("de", "dn")).otherwise(F.col("psi_end"))
    rows = intervals.withColumn("ds", ds).withColumns({"_e": F.col("ds") * F.sin(way), "_n": F.col("ds") * F.cos(way)})
    w = ordered(list(OUTAGE), "interval").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"east": F.sum("_e").over(w), "north": F.sum("_n").over(w)}).drop("_e", "_n")


def interval_sums(path: DataFrame, dt: str = "dt") -> DataFrame:
    """de, dn, duration and end heading of each interval of a simulated path: speed and heading run on across intervals."""
    step = F.col("velocity") * F.col(dt)
    return path.groupBy(*OUTAGE, "interval").agg(F.sum(step * F.sin("psi")).alias("de"), F.sum(step * F.cos("psi")).alias("dn"), F.sum(dt).alias("dur_s"), F.max_by("psi", "row_idx").alias("psi_end"), F.count("*").alias("n_rows"))
