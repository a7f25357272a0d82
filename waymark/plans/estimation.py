"""Queries of state estimation, models and streams."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import edge, features, fusion, joins, models, outage
from waymark.operators import windows as win
from waymark.plans.motion import _OUT, _ROADS, _outages, _roads, _signals
from waymark.plans.samples import SAMPLES_SQL, samples, table
from waymark.shared import shared_dir
from waymark.streaming import live, machine

QUERIES, ORACLE_SQL = {}, {}
R = 6


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def work_dir(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


_FOLD = f"""WITH RECURSIVE {SAMPLES_SQL}, z AS (SELECT session_id, row_idx, w, dt, radians(k) AS m FROM s),
f(session_id, row_idx, psi) AS (SELECT session_id, row_idx, m FROM z WHERE row_idx = 0 UNION ALL SELECT z.session_id, z.row_idx,
  CASE WHEN q < 0 THEN q + 6.283185307179586 ELSE q END FROM (SELECT z.session_id, z.row_idx, atan2(ALPHA * sin(psi + w * dt) + (1 - ALPHA) * sin(m), ALPHA * cos(psi + w * dt) + (1 - ALPHA) * cos(m)) AS q
  FROM f JOIN z ON z.session_id = f.session_id AND z.row_idx = f.row_idx + 1) z)"""


@query(_FOLD.replace("ALPHA", "0.95") + " SELECT session_id, row_idx, round(psi, 6) AS heading FROM f")
def q_complementary_filter(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("m", F.radians("k"))
    return fusion.complementary_by_group(rows, "w", "dt", "m", 0.95, "session_id", "row_idx").withColumn("heading", F.round("heading", R))


ALPHAS = (1.0, 0.95, 0.97, 0.98)


@query(" UNION ALL ".join(f"(SELECT {a}::DOUBLE AS alpha, * FROM ({_FOLD.replace('ALPHA', str(a))} SELECT session_id, round(avg(psi), 6) AS mean_heading FROM f GROUP BY session_id))" for a in ALPHAS))
def q_alpha_sweep(spark, sf_dir):
    """The filter at several weights over whole sessions: one pass of a session for all weights."""
    rows = samples(spark, sf_dir).withColumn("m", F.radians("k"))
    return fusion.alpha_sweep(rows, "w", "dt", "m", ALPHAS, "session_id", "row_idx").withColumn("mean_heading", F.round("mean_heading", R))


def _filter_rows(rows: DataFrame, outages: DataFrame) -> DataFrame:
    """The samples of each outage with the filter's inputs, a speed in place of a trained model."""
    own = joins.range_join(rows, outages, "session_id", "row_idx", "start_row", "end_row", 64)
    given = {"fwd": F.col("a"), "lat": F.col("w") / 2, "yaw": F.col("w"), "dt": F.lit(0.1), "still": F.col("event_type") == "error", "speed": F.col("value") / 50}
    return own.withColumns(given)


def _rounded_states(found: DataFrame) -> DataFrame:
    return found.select("session_id", "outage_id", "n_rows", *(F.round(c, R).alias(c) for c in ("east", "north", "ve", "vn", "psi")))


@query()
def q_ekf_outage(spark, sf_dir):
    """The filter through each outage, with road headings from its samples."""
    rows = samples(spark, sf_dir)
    road = F.when(F.col("k") > 70, F.radians("k")).otherwise(F.lit(math.nan))
    own = _filter_rows(rows, _outages(rows)).withColumns({"road_heading": road, **{c: F.lit(0.0) for c in ("e0", "n0", "b_fwd", "b_lat", "b_yaw")}})
    return _rounded_states(fusion.fuse_outages(own))


WINDOW_S, LEAST_STILL = 1_000_000.0, 3


def _calibrated(rows: DataFrame) -> DataFrame:
    """Outages with the biases before them. Events are hours apart, so the window is longer than that of samples at 10 Hz."""
    starts = rows.select("session_id", F.col("row_idx").alias("outage_id"), F.col("t").alias("t_start"), F.col("value").alias("e0"), F.col("k").alias("n0"))
    signals = rows.withColumns({"still": F.col("event_type") == "error", "fwd": F.col("a"), "lat": F.col("w") / 2, "yaw": F.col("w")})
    return outage.biases_before(signals, _outages(rows).join(starts, ["session_id", "outage_id"]), "t", "still", WINDOW_S, LEAST_STILL, 0.1, 0.05)


_STILL = f"""q AS (SELECT o.session_id, o.outage_id, count(*) AS n, avg(x.a) AS f, avg(x.w / 2) AS l, avg(x.w) AS y FROM o JOIN s AS g ON g.session_id = o.session_id AND g.row_idx = o.outage_id
JOIN s AS x ON x.session_id = o.session_id AND x.event_type = 'error' AND x.t BETWEEN g.t - {WINDOW_S} AND g.t GROUP BY 1, 2)"""


@query(f"""WITH {SAMPLES_SQL}, {_OUT}, {_STILL} SELECT o.session_id, o.outage_id, coalesce(n >= {LEAST_STILL}, false) AS calibrated,
round(CASE WHEN n >= {LEAST_STILL} THEN greatest(-0.1, least(0.1, f)) ELSE 0 END * 0.7310585786, 6) + 0.0 AS b_fwd, round(CASE WHEN n >= {LEAST_STILL} THEN greatest(-0.1, least(0.1, l)) ELSE 0 END * 0.7310585786, 6) + 0.0 AS b_lat,
round(CASE WHEN n >= {LEAST_STILL} THEN greatest(-0.05, least(0.05, y)) ELSE 0 END * 0.7310585786, 6) + 0.0 AS b_yaw FROM o LEFT JOIN q ON q.session_id = o.session_id AND q.outage_id = o.outage_id""")  # fmt: skip
def q_biases_before_outage(spark, sf_dir):
    """Biases from the still samples in the window before each outage."""
    found = _calibrated(samples(spark, sf_dir))
    return found.select("session_id", "outage_id", "calibrated", *((F.round(F.col(c) * 0.7310585786, R) + F.lit(0.0)).alias(c) for c in ("b_fwd", "b_lat", "b_yaw")))


MARGIN_M, CELL_M = 25.0, 10.0


@query(f"""WITH {SAMPLES_SQL}, {_ROADS} SELECT session_id, row_idx AS outage_id, count(*) AS n_roads, CAST(sum(way_id) AS BIGINT) AS way_sum, round(sum(rh), 6) AS heading_sum FROM s JOIN sh
ON least(e1, e2) <= value + {MARGIN_M} AND greatest(e1, e2) >= value - {MARGIN_M} AND least(n1, n2) <= k + {MARGIN_M} AND greatest(n1, n2) >= k - {MARGIN_M} WHERE event_type = 'click' GROUP BY 1, 2""")  # fmt: skip
def q_roads_near(spark, sf_dir):
    """The roads about each outage's start."""
    starts = samples(spark, sf_dir).filter("event_type = 'click'").select("session_id", F.col("row_idx").alias("outage_id"), F.col("value").alias("x"), F.col("k").alias("y"))
    found = joins.count_roads_near(starts, _roads(table(spark, sf_dir, "supplier")), ["session_id", "outage_id"], MARGIN_M, CELL_M)
    return found.withColumn("heading_sum", F.round("heading_sum", R))


@query()
def q_ekf_matched_outage(spark, sf_dir):
    """The filter through each outage, started with the biases before it, its heading held to the road that its own state is on."""
    rows = samples(spark, sf_dir)
    outages = _calibrated(rows)
    return _rounded_states(fusion.fuse_outages_by_cell(_filter_rows(rows, outages), _roads(table(spark, sf_dir, "supplier")), MARGIN_M, CELL_M))


@query()
def q_gps_smoother(spark, sf_dir):
    fixes = samples(spark, sf_dir).select("session_id", "row_idx", (F.col("value") / 10).alias("east"), (F.col("k") / 10).alias("north"), F.lit(5.0).alias("accuracy"))
    found = fusion.smooth_fixes(fixes)
    return found.select("session_id", "row_idx", F.round("anchor_east", R).alias("anchor_east"), F.round("anchor_north", R).alias("anchor_north"))


@query()
def q_edge_engine(spark, sf_dir):
    """The edge engine over all sessions, windows of 21 rows, with a correction that is linear in the features."""
    rows = _signals(spark, sf_dir).withColumn("dt_sec", F.col("dt") / 10)

    def model(found: DataFrame) -> DataFrame:
        return found.select("session_id", "window_idx", (0.1 * F.col("acc_veh_fwd_mean") + 0.01 * F.col("seg_dur_s")).alias("ds_corr"))

    found = edge.run_engine(rows, model, rows=21)
    return found.select("session_id", "t_idx", *((F.round(c, R) + F.lit(0.0)).alias(c) for c in ("x", "y", "heading", "velocity", "ds_imu", "ds_corr")), "correction_failed")


@query()
def q_ml_loto(spark, sf_dir):
    """Folds by trip over segment features: ridge and boosted trees against the last value."""
    rows = _signals(spark, sf_dir).withColumn("seg", F.floor(F.col("row_idx") / 15))
    found = features.features_58(rows, ["session_id", "seg"])
    w = win.ordered("session_id", "seg")
    found = found.withColumns({"label": F.lead("acc_z_mean").over(w), "trip": F.concat(F.lit("T"), (F.col("session_id") % 4).cast("string"))}).filter("label IS NOT NULL")
    names = ["acc_z_mean", "acc_z_std", "acc_lin_y_mean", "acc_lin_y_std", "a_mag_mean", "w_mag_mean", "al_mag_mean", "seg_dur_s"]
    fits = {"ridge": models.ridge, "boosted": lambda t, f, y: models.boosted(t, f, y, maxIter=5, maxDepth=3)}
    out = models.leave_one_trip_out(found, ["T0", "T1", "T2", "T3"], "trip", names, "label", fits, F.col("acc_z_mean"), clip_sigma=10)
    return out.select("trip", "model", "n_test", *(F.round(c, 4).alias(c) for c in ("rmse", "mae", "median_ae")))


def _stream(spark, sf_dir) -> DataFrame:
    found = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(found.schema).parquet(f"{sf_dir}/events.parque[t]")  # a glob: a file alone is no source
    return stream.withColumns({"ts": F.col("ts").cast("timestamp"), "device": F.col("user_id").cast("string")})


@query("SELECT event_type, CAST(floor(epoch_us(ts) / 2.16e10) AS BIGINT) AS window_no, count(*) AS n, round(avg(value) * 0.7310585786, 6) AS mean_value, max(value) AS max_value FROM events GROUP BY 1, 2")
def q_stream_windows(spark, sf_dir):
    """Event-time windows of a stream; in complete mode, so that the last windows too are there."""
    out = live.tumbling(_stream(spark, sf_dir), "ts", "1 hour", "6 hours", "event_type")
    found = live.run_to_table(out, work_dir(spark), "complete")
    return found.select("event_type", F.floor(F.unix_micros("window.start") / 2.16e10).alias("window_no"), "n", F.round(F.col("mean_value") * 0.7310585786, R).alias("mean_value"), "max_value")


@query("""WITH o AS (SELECT user_id::VARCHAR AS device, epoch_us(ts) AS us, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) - 1 AS i FROM events
WHERE epoch_us(ts) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events)),
g AS (SELECT device, i // 21 AS win, min(us) * 1000 AS first_ns, max(us) * 1000 AS last_ns, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM o GROUP BY 1, 2)
SELECT device, first_ns, last_ns, n, round(m * 0.7310585786, 6) AS mean_value, round(sd, 6) AS std_value FROM g WHERE n = 21""")  # fmt: skip
def q_stream_count_windows(spark, sf_dir):
    """Windows of 21 rows of a user. The watermark is that of the last row, to the millisecond; later rows wait."""
    live.use_state_store(spark)
    stream = _stream(spark, sf_dir).select("device", (F.unix_micros("ts") * 1000).alias("ts_ns"), "value")
    found = live.run_to_table(live.count_windows(stream, 21, "0 seconds"), work_dir(spark), "update")
    return found.withColumns({"mean_value": F.round(F.col("mean_value") * 0.7310585786, R), "std_value": F.round("std_value", R)})


def live_events(events: DataFrame) -> DataFrame:
    """The events of users as those of devices: clicks are fixes, purchases toggle the mode, signups are road segments, all others samples."""
    k = F.get_json_object("props", "$.k").cast("double")
    value = F.col("value")
    kind = F.when(F.col("event_type") == "click", "fix").when(F.col("event_type") == "purchase", "control").when(F.col("event_type") == "signup", "road").otherwise("imu")
    return events.select(
        F.col("user_id").cast("string").alias("device"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), kind.alias("kind"), ((value - 50) / 100).alias("fwd"), ((k - 50) / 1000).alias("lat"), ((k - 50) / 500).alias("yaw"),
        (value / 20).alias("acc"), (k / 100).alias("gyro"), (value / 50).alias("speed_ml"), value.alias("east"), k.alias("north"), (value / 50).alias("speed"), F.radians(k).alias("psi"),
        value.alias("e1"), k.alias("n1"), (value + 40).alias("e2"), (k + 30).alias("n2"), F.lit(math.atan2(40, 30)).alias("heading"),
    )


@query()
def q_stream_fusion(spark, sf_dir):
    """The live machine over the events as a stream. The events are hours apart, so are outages and what a device is remembered for."""
    live.use_state_store(spark)
    hour = 3600 * machine.SECOND
    found = live.run_to_table(live.fused(live_events(_stream(spark, sf_dir)), late="0 seconds", outage_ns=6 * hour, expire_ns=30 * 24 * hour), work_dir(spark), "update")
    return found.select("device", "ts_ns", "mode", "event", *(F.round(c, R).alias(c) for c in ("east", "north", "speed")), "matched", *(F.round(c, R).alias(c) for c in ("separation_m", "drift_pct")), "yaw_deg")
