"""Queries of training tables and folds, and of rules that stand by themselves."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions import signal as sig
from waymark.operators import joins, outage, reports, training
from waymark.operators import windows as win
from waymark.operators.features import SIGNALS_56, SIGNALS_58, STATS
from waymark.plans.motion import _ROADS, _SIGNALS, _SIM, FAR, _roads, _signals, _simulated, _stats_sql
from waymark.plans.samples import SAMPLES_SQL, samples, table
from waymark.shared import written

QUERIES, ORACLE_SQL = {}, {}
R = 6
W = "OVER (PARTITION BY session_id ORDER BY row_idx)"


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def _rounded_stats(signals, digits: int):
    return [(F.round(f"{s}_{n}", digits) + F.lit(0.0)).alias(f"{s}_{n}") for s in signals for n in STATS]


# --- tables ---------------------------------------------------------------------------------------------------


@query(f"""WITH {SAMPLES_SQL}, {_SIGNALS}, f AS (SELECT session_id, row_idx, event_type, count(*) OVER v AS nn, {_stats_sql(SIGNALS_56, " OVER v", 7)} FROM sm WINDOW v AS (PARTITION BY session_id ORDER BY row_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT * EXCLUDE (nn, event_type) FROM f WHERE nn = 20 AND event_type = 'view'""")  # fmt: skip
def q_features56_in_use(spark, sf_dir):
    """Windows of 20 rows, as the model is asked with."""
    rows = _signals(spark, sf_dir)
    found = training.features_at_fixes(rows, rows.filter("event_type = 'view'").select("session_id", "row_idx"), 20)
    return found.select("session_id", "row_idx", *_rounded_stats(SIGNALS_56, 7))


def _fixed_rows(spark, sf_dir):
    """The signals with clicks as fixes, and places and headings from values and k."""
    own = {"fix": F.col("event_type") == "click", "h": F.col("us") / 3.6e9, "v": F.col("value") / 10, "east": F.col("value") * 2, "north": F.col("k") * 2, "heading": F.radians("k")}
    return _signals(spark, sf_dir).withColumns(own)


@query(f"""WITH {SAMPLES_SQL}, {_SIGNALS}, f AS (SELECT session_id, row_idx, event_type, us / 3.6e9 AS h, value / 10 AS y_vel, value * 2 AS e, k * 2 AS n, count(*) OVER v AS nn, {_stats_sql(SIGNALS_56, " OVER v")}
  FROM sm WINDOW v AS (PARTITION BY session_id ORDER BY row_idx ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, e - lag(e) {W} AS de, n - lag(n) {W} AS dn FROM f WHERE event_type = 'click')
SELECT * EXCLUDE (event_type, h, e, n, nn, de, dn), round(h, 6) AS t_fix_s, round(CASE WHEN sqrt(de*de + dn*dn) > 5 THEN CASE WHEN atan2(de, dn) < 0 THEN atan2(de, dn) + 2 * pi() ELSE atan2(de, dn) END END, 6) AS y_course
FROM c WHERE nn = 21 AND y_vel >= 0.5""")  # fmt: skip
def q_velocity_table(spark, sf_dir):
    found = training.velocity_table(_fixed_rows(spark, sf_dir), "fix", "h", "v", "east", "north")
    return found.select("session_id", "row_idx", "y_vel", F.round("t_fix_s", R).alias("t_fix_s"), F.round("y_course", R).alias("y_course"), *_rounded_stats(SIGNALS_56, 5))


@query(f"""WITH {SAMPLES_SQL}, {_SIGNALS}, f AS (SELECT session_id, row_idx, us / 3.6e9 AS h, value / 10 AS v, value * 2 AS e, k * 2 AS n, radians(k) AS h0 FROM s WHERE event_type = 'click'),
p0 AS (SELECT session_id, row_idx AS seg_start, lead(row_idx) {W} AS seg_end, lead(h) {W} - h AS dur, v AS v_k, lead(v) {W} AS v_k1, lead(e) {W} - e AS de, lead(n) {W} - n AS dn, h0 FROM f),
p AS (SELECT * FROM p0 WHERE seg_end - seg_start >= 2 AND dur > 0 AND dur <= 400 AND NOT (v_k < 0.5 AND v_k1 < 0.5)),
g AS (SELECT p.session_id, seg_start, {_stats_sql(SIGNALS_58, digits=8)} FROM p JOIN sm ON sm.session_id = p.session_id AND row_idx BETWEEN seg_start AND seg_end GROUP BY 1, 2),
i0 AS (SELECT p.session_id, seg_start, row_idx, v_k, h0, dt, acc_veh_fwd * dt AS inc, gyro_veh_yaw_rate * dt AS turn FROM p JOIN sm ON sm.session_id = p.session_id AND row_idx > seg_start AND row_idx <= seg_end),
i1 AS (SELECT *, v_k + sum(inc) OVER z AS sv, h0 + sum(turn) OVER z AS psi FROM i0 WINDOW z AS (PARTITION BY session_id, seg_start ORDER BY row_idx {FAR})),
i2 AS (SELECT *, sv - least(0, min(sv) OVER (PARTITION BY session_id, seg_start ORDER BY row_idx {FAR})) AS vel FROM i1),
w AS (SELECT session_id, seg_start, sqrt(pow(sum(vel * sin(psi) * dt), 2) + pow(sum(vel * cos(psi) * dt), 2)) AS ds_imu FROM i2 GROUP BY 1, 2)
SELECT g.*, seg_end, round(dur, 6) AS seg_dur_s, seg_end - seg_start + 1 AS seg_n_samples, v_k1 AS target_a, round(v_k1 - v_k, 6) AS target_b, round(sqrt(de*de + dn*dn) - ds_imu, 5) AS target_c
FROM g JOIN p USING (session_id, seg_start) JOIN w USING (session_id, seg_start)""")  # fmt: skip
def q_segment_table(spark, sf_dir):
    found = training.segment_table(_fixed_rows(spark, sf_dir), "fix", "h", "v", most_s=400.0)
    return found.select("session_id", "seg_start", "seg_end", F.round("seg_dur_s", R).alias("seg_dur_s"), "seg_n_samples", "target_a", F.round("target_b", R).alias("target_b"), F.round("target_c", 5).alias("target_c"), *_rounded_stats(SIGNALS_58, 8))


@query()
def q_ridge_folds(spark, sf_dir):
    """Ridge of target C on the segment table, which is made once, for each fold; trips are the last digits of users."""
    found = training.segment_table(_fixed_rows(spark, sf_dir), "fix", "h", "v", most_s=400.0).withColumn("trip", F.reverse(F.col("session_id").cast("string")))
    names = [*(f"{s}_{n}" for s in SIGNALS_58 for n in STATS), "seg_dur_s", "seg_n_samples"]
    found = written(found.select("trip", "target_c", *names))  # three scans follow
    folds = [str(d) for d in range(10)]
    models = training.ridge_folds(found, folds, "trip", names, "target_c", clip_sigma=10.0)
    out = training.ridge_reports(found, models, "trip", names, "target_c")
    return out.select("fold", "n_test", *(F.round(c, 4).alias(c) for c in ("rmse", "mae", "median_ae")))


# --- rules ----------------------------------------------------------------------------------------------------


@query(f"""WITH {SAMPLES_SQL}, m AS (SELECT session_id, row_idx, event_type = 'click' AS flag, abs(value - lag(value) {W}) > 1e-7 OR abs(k - lag(k) {W}) > 1e-7 AS moved,
  sum((event_type = 'click')::INT) OVER (PARTITION BY session_id) > 14 AS enough FROM s)
SELECT session_id, row_idx, CASE WHEN enough THEN flag ELSE coalesce(moved, true) END AS is_fix FROM m""")  # fmt: skip
def q_genuine_fixes(spark, sf_dir):
    """The flag where a session has over 14 fixes, else where the position moved."""
    rows = samples(spark, sf_dir).withColumn("flag", F.col("event_type") == "click")
    return win.genuine_fixes(rows, "flag", "value", "k", least=14).select("session_id", "row_idx", "is_fix")


@query(f"""WITH {SAMPLES_SQL}, b AS (SELECT session_id, row_idx, CASE WHEN event_type IN ('click', 'view') THEN k WHEN event_type = 'error' THEN 0.0 END AS bearing, value AS azimuth FROM s),
f AS (SELECT session_id, min_by(coalesce(bearing, 'nan'::DOUBLE), row_idx) AS b0, min_by(azimuth, row_idx) AS a0 FROM b GROUP BY 1)
SELECT session_id, round(radians(CASE WHEN isnan(b0) OR b0 = 0 THEN a0 ELSE b0 END), 6) AS heading FROM f""")  # fmt: skip
def q_initial_heading(spark, sf_dir):
    """Clicks and views have a bearing, errors one of 0; for sessions that begin otherwise the azimuth counts."""
    bearing = F.when(F.col("event_type").isin("click", "view"), F.col("k")).when(F.col("event_type") == "error", 0.0)
    rows = samples(spark, sf_dir).withColumn("bearing", bearing)
    rows = rows.withColumn("heading", win.initial_heading("bearing", "value"))
    return rows.filter("row_idx = 0").select("session_id", F.round("heading", R).alias("heading"))


@query(f"""WITH {SAMPLES_SQL}, n AS (SELECT session_id, row_idx, us / 3.6e9 AS h, value AS v, lag(value) {W} AS pv, lead(value) {W} AS nv, lag(us / 3.6e9) {W} AS ph, lead(us / 3.6e9) {W} AS nh FROM s)
SELECT session_id, row_idx, round(CASE WHEN coalesce(nh, h) > coalesce(ph, h) THEN (coalesce(nv, v) - coalesce(pv, v)) / (coalesce(nh, h) - coalesce(ph, h)) ELSE 0 END, 4) AS slope FROM n""")  # fmt: skip
def q_plain_gradient(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("h", F.col("us") / 3.6e9)
    return rows.select("session_id", "row_idx", (F.round(win.plain_gradient("value", "h"), 4) + F.lit(0.0)).alias("slope"))


@query(f"""WITH {SAMPLES_SQL}, a AS (SELECT session_id, row_idx, radians(k * 3) AS z, radians(value) AS x, radians(k - value) AS y, a, w, dt FROM s),
r1 AS (SELECT *, cos(y) * a + sin(y) * dt AS x1, w AS y1, cos(y) * dt - sin(y) * a AS z1 FROM a),
r2 AS (SELECT *, x1 AS x2, cos(x) * y1 - sin(x) * z1 AS y2, sin(x) * y1 + cos(x) * z1 AS z2 FROM r1)
SELECT session_id, row_idx, round(cos(z) * x2 - sin(z) * y2, 6) AS e, round(sin(z) * x2 + cos(z) * y2, 6) AS n, round(z2, 6) AS u FROM r2""")  # fmt: skip
def q_rotation(spark, sf_dir):
    """A vector turned by the matrix of three angles; the SQL turns it about one axis after the other."""
    m = geo.rotation_columns(F.radians(F.col("k") * 3), F.radians("value"), F.radians(F.col("k") - F.col("value")))
    v = (F.col("a"), F.col("w"), F.col("dt"))
    turned = {name: sum((m[3 * i + j] * v[j] for j in range(1, 3)), m[3 * i] * v[0]) for i, name in enumerate("enu")}
    return samples(spark, sf_dir).select("session_id", "row_idx", *((F.round(x, R) + F.lit(0.0)).alias(c) for c, x in turned.items()))


@query(f"""WITH {SAMPLES_SQL}, p AS (SELECT session_id, row_idx, 48 + value / 1000 AS la, 11 + k / 1000 AS lo, 100 + k AS r FROM s)
SELECT session_id, row_idx, round(la - degrees(r / 6371000), 8) AS south, round(la + degrees(r / 6371000), 8) AS north, round(lo - degrees(r / (6371000 * cos(radians(la)))), 8) AS west, round(lo + degrees(r / (6371000 * cos(radians(la)))), 8) AS east FROM p""")  # fmt: skip
def q_point_box(spark, sf_dir):
    box = geo.bounding_box(48 + F.col("value") / 1000, 11 + F.col("k") / 1000, 100 + F.col("k"))
    return samples(spark, sf_dir).select("session_id", "row_idx", *(F.round(v, 8).alias(c) for c, v in box.items()))


@query(f"WITH {SAMPLES_SQL} SELECT session_id, row_idx, round(value, 6) AS displacement FROM s WHERE dt >= 0.5")
def q_a2_round_trip(spark, sf_dir):
    """A displacement to an acceleration and back, over steps of half an hour at least."""
    rows = samples(spark, sf_dir).filter("dt >= 0.5")
    there = rows.withColumn("acc", sig.a2_target(F.col("value"), F.col("dt")))
    return there.select("session_id", "row_idx", F.round(sig.a2_displacement(F.col("acc"), F.col("dt")), R).alias("displacement"))


@query(f"""WITH {SAMPLES_SQL}, x AS (SELECT session_id, value AS y, dt + 0.1 AS sec, session_id % 3 = 0 AS own FROM s), l AS (SELECT 5 * stddev_pop(y) / 3 AS lim FROM x),
g AS (SELECT stddev_pop(y) FILTER (own) AS sd_own, stddev_pop(y) FILTER (NOT own) AS sd_other, 100 * avg(CASE WHEN abs(y) / 3 > lim THEN 1 ELSE 0 END) FILTER (own) AS far_own_pct, 100 * avg(CASE WHEN abs(y) / 3 > lim THEN 1 ELSE 0 END) FILTER (NOT own) AS far_other_pct,
  10 / pow(median(sec) FILTER (own), 2) AS noise_own, 10 / pow(median(sec) FILTER (NOT own), 2) AS noise_other FROM x, l)
SELECT round(sd_own, 6) AS sd_own, round(sd_other, 6) AS sd_other, round(far_own_pct, 6) AS far_own_pct, round(far_other_pct, 6) AS far_other_pct, round(noise_own, 6) AS noise_own, round(noise_other, 6) AS noise_other,
  round(sd_own / greatest(sd_other, 1e-9), 6) AS sd_ratio, round(noise_own / greatest(noise_other, 1e-9), 6) AS noise_ratio, sd_own / greatest(sd_other, 1e-9) > 5 AS noisy FROM g""")  # fmt: skip
def q_noise_report(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("seconds", F.col("dt") + 0.1)
    found = reports.noise_report(rows, "value", "seconds", F.col("session_id") % 3 == 0)
    return found.select(*(F.round(c, R).alias(c) for c in ("sd_own", "sd_other", "far_own_pct", "far_other_pct", "noise_own", "noise_other", "sd_ratio", "noise_ratio")), "noisy")


@query("""WITH g AS (SELECT c_nationkey AS model, avg(c_acctbal) / 100 AS c1, avg(c_acctbal) / 100 * (1 + c_nationkey / 20) AS c2, 60.0::DOUBLE AS naive, c_nationkey % 3 = 0 AS noisy FROM customer GROUP BY c_nationkey)
SELECT model, CASE WHEN naive - c2 > 20 AND 100 * (c2 - c1) / c1 < 50 THEN 'keep' WHEN naive - c2 > 5 AND 100 * (c2 - c1) / c1 < 80 THEN 'normalise by duration' ELSE 'reject' END AS verdict,
  CASE WHEN c2 < naive AND c1 < naive - 12 AND NOT noisy THEN 1 WHEN c2 < naive THEN 2 ELSE 3 END AS case_no FROM g""")  # fmt: skip
def q_model_verdicts(spark, sf_dir):
    """Verdicts by nation, whose mean balances stand for the models' errors."""
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("model")).agg((F.avg("c_acctbal") / 100).alias("c1"))
    c2, naive = F.col("c1") * (1 + F.col("model") / 20), F.lit(60.0)
    return g.select("model", reports.ablation_verdict(F.col("c1"), c2, naive).alias("verdict"), reports.acceleration_case(c2, naive, F.col("c1"), naive - 12, F.col("model") % 3 == 0).alias("case_no"))


@query(f"""WITH {SAMPLES_SQL}, pt AS (SELECT session_id, row_idx, value AS x, k AS y, radians(k * 3) AS hd FROM s), {_ROADS},
m AS (SELECT *, least(1.0, greatest(0.0, ((x - e1) * (e2 - e1) + (y - n1) * (n2 - n1)) / ((e2 - e1) * (e2 - e1) + (n2 - n1) * (n2 - n1)))) AS f FROM pt, sh),
d AS (SELECT *, sqrt(pow(x - e1 - f * (e2 - e1), 2) + pow(y - n1 - f * (n2 - n1), 2)) AS dist, hd - rh AS df FROM m),
t AS (SELECT *, least(abs(df + pi() - 2 * pi() * floor((df + pi()) / (2 * pi())) - pi()), abs(df + 2 * pi() - 2 * pi() * floor((df + 2 * pi()) / (2 * pi())) - pi())) AS turn FROM d),
b AS (SELECT session_id, row_idx, min_by(way_id, (dist, way_id)) AS way_id, min(dist) AS dist FROM t WHERE dist < 50 AND turn <= radians(45.0) GROUP BY 1, 2)
SELECT pt.session_id, pt.row_idx, way_id, round(dist, 6) AS dist FROM pt LEFT JOIN b ON pt.session_id = b.session_id AND pt.row_idx = b.row_idx""")  # fmt: skip
def q_nearest_road(spark, sf_dir):
    """The nearest road within both gates, without a score."""
    points = samples(spark, sf_dir).select("session_id", "row_idx", F.col("value").alias("x"), F.col("k").alias("y"), F.radians(F.col("k") * 3).alias("heading"))
    found = joins.map_match(points, _roads(table(spark, sf_dir, "supplier")), ["session_id", "row_idx"], 50.0, math.radians(45.0), by_score=False)
    return found.select("session_id", "row_idx", "way_id", F.round("dist", R).alias("dist"))


@query(f"""WITH {SAMPLES_SQL}, {_SIM},
z AS (SELECT session_id, outage_id, max(row_idx) AS row_idx, sum(dt) AS dur, max_by(v, row_idx) AS v, max_by(psi, row_idx) AS psi, sum(v * dt * sin(psi)) AS e, sum(v * dt * cos(psi)) AS n FROM j3 GROUP BY 1, 2),
x AS (SELECT z.*, t.value - a.value AS te, t.k - a.k AS tn, t.value / 50 AS tv, radians(t.k) AS tpsi FROM z JOIN s t ON t.session_id = z.session_id AND t.row_idx = z.row_idx JOIN s a ON a.session_id = z.session_id AND a.row_idx = z.outage_id)
SELECT session_id, outage_id, round(dur, 6) AS actual_dur_s, round(sqrt(pow(e - te, 2) + pow(n - tn, 2)), 5) AS pos_err_m, round(abs(v - tv), 5) AS vel_err_ms,
  round(degrees(abs((psi - tpsi + pi()) - 2 * pi() * floor((psi - tpsi + pi()) / (2 * pi())) - pi())), 5) AS head_err_deg FROM x""")  # fmt: skip
def q_outage_errors(spark, sf_dir):
    """Errors at each outage's last row, of which the values and k are the true position."""
    path = _simulated(spark, sf_dir)
    rows = samples(spark, sf_dir).select("session_id", "row_idx", "value", "k")
    ends = path.groupBy("session_id", "outage_id").agg(F.max("row_idx").alias("row_idx"))
    first = rows.select("session_id", F.col("row_idx").alias("outage_id"), F.col("value").alias("_v0"), F.col("k").alias("_k0"))
    truth = ends.join(rows, ["session_id", "row_idx"]).join(first, ["session_id", "outage_id"])
    truth = truth.select("session_id", "outage_id", (F.col("value") - F.col("_v0")).alias("true_east"), (F.col("k") - F.col("_k0")).alias("true_north"), (F.col("value") / 50).alias("true_v"), F.radians("k").alias("true_psi"))
    found = outage.outage_errors(path, truth)
    return found.select("session_id", "outage_id", F.round("actual_dur_s", R).alias("actual_dur_s"), *(F.round(c, 5).alias(c) for c in ("pos_err_m", "vel_err_ms", "head_err_deg")))
