"""Queries of summaries, classifiers, calibrations and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions import geo
from waymark.functions import signal as sig
from waymark.operators import aggregates as agg
from waymark.operators import joins
from waymark.operators import windows as win
from waymark.plans.samples import SAMPLES_SQL, samples, table

QUERIES, ORACLE_SQL = {}, {}
R = 6


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


_REC = f"""{SAMPLES_SQL}, rec AS (SELECT session_id, CASE WHEN k < 25 THEN 30 WHEN k < 50 THEN 60 WHEN k < 75 THEN 120 ELSE 300 END AS duration_s,
  CASE WHEN event_type IN ('click', 'view') THEN 'gyro' WHEN event_type = 'error' THEN 'zupt' ELSE 'hybrid' END AS baseline, value * 0.7310585786 AS pos_err, row_idx, a, w, dt, us FROM s)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    dur = F.when(k < 25, 30).when(k < 50, 60).when(k < 75, 120).otherwise(300)
    base = F.when(F.col("event_type").isin("click", "view"), "gyro").when(F.col("event_type") == "error", "zupt").otherwise("hybrid")
    return samples(spark, sf_dir).select("session_id", dur.alias("duration_s"), base.alias("baseline"), (F.col("value") * 0.7310585786).alias("pos_err"), "row_idx", "a", "w", "dt", "us")


@query(f"WITH {_REC} SELECT session_id, duration_s, count(*) AS n, round(avg(pos_err), 6) AS mean_err FROM rec GROUP BY session_id, duration_s")
def q_group_summary(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("session_id", "duration_s").agg(F.count("*").alias("n"), F.round(F.avg("pos_err"), R).alias("mean_err"))


@query(f"""WITH {_REC} SELECT duration_s, {", ".join(f"round({fn}(CASE WHEN baseline = '{b}' THEN pos_err END), 6) AS {b}_{n}" for b in ("gyro", "zupt", "hybrid") for n, fn in (("mean", "avg"), ("median", "median"), ("max", "max")))} FROM rec GROUP BY duration_s""")
def q_pivot_summary(spark, sf_dir):
    wide = _records(spark, sf_dir).groupBy("duration_s").pivot("baseline", ["gyro", "zupt", "hybrid"]).agg(F.round(F.avg("pos_err"), R).alias("mean"), F.round(F.median("pos_err"), R).alias("median"), F.round(F.max("pos_err"), R).alias("max"))
    return wide


_WIDE = "wide AS (SELECT duration_s, avg(CASE WHEN baseline = 'gyro' THEN pos_err END) AS g, avg(CASE WHEN baseline = 'zupt' THEN pos_err END) AS z, avg(CASE WHEN baseline = 'hybrid' THEN pos_err END) AS h FROM rec GROUP BY duration_s)"


def _wide(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("duration_s").pivot("baseline", ["gyro", "zupt", "hybrid"]).agg(F.avg("pos_err"))


@query(f"WITH {_REC}, {_WIDE} SELECT duration_s, round(100 * (g - h) / g, 6) AS vs_gyro_pct, round(100 * (z - h) / z, 6) AS vs_zupt_pct, CASE WHEN 100 * (g - h) / g > 0 THEN 'better' ELSE 'worse' END AS verdict, 100 * h / 490 < 10 AS compliant FROM wide")
def q_improvement(spark, sf_dir):
    w = _wide(spark, sf_dir)
    gain = agg.improvement_percent(F.col("gyro"), F.col("hybrid"))
    return w.select("duration_s", F.round(gain, R).alias("vs_gyro_pct"), F.round(agg.improvement_percent(F.col("zupt"), F.col("hybrid")), R).alias("vs_zupt_pct"), F.when(gain > 0, "better").otherwise("worse").alias("verdict"), (agg.drift_percent(F.col("hybrid"), F.lit(490.0)) < 10).alias("compliant"))


@query(f"""WITH {_REC}, {_WIDE}, r AS (SELECT max(CASE WHEN duration_s = 30 THEN g END) AS g30, max(CASE WHEN duration_s = 60 THEN g END) AS g60, max(CASE WHEN duration_s = 120 THEN g END) AS g120, max(CASE WHEN duration_s = 300 THEN g END) AS g300 FROM wide)
SELECT round(g60 / g30, 6) AS r1, round(g120 / g60, 6) AS r2, round(g300 / g120, 6) AS r3, CASE WHEN g120 / g60 > 1.1 * (g60 / g30) THEN 'quadratic' WHEN g120 / g60 < 0.9 * (g60 / g30) THEN 'sub-linear' ELSE 'linear' END AS growth FROM r""")  # fmt: skip
def q_growth_class(spark, sf_dir):
    one = _wide(spark, sf_dir).groupBy().pivot("duration_s", [30, 60, 120, 300]).agg(F.first("gyro"))
    r1, r2, r3 = F.col("60") / F.col("30"), F.col("120") / F.col("60"), F.col("300") / F.col("120")
    return one.select(F.round(r1, R).alias("r1"), F.round(r2, R).alias("r2"), F.round(r3, R).alias("r3"), sig.growth_class(r1, r2).alias("growth"))


@query(f"WITH {_REC} SELECT baseline, duration_s, round(188.32 * duration_s / 3600, 6) AS expected_deg, round(avg(abs(w)) / (188.32 * duration_s / 3600), 6) AS ratio FROM rec GROUP BY baseline, duration_s")
def q_expected_drift(spark, sf_dir):
    e = agg.expected_drift(F.col("duration_s"))
    return _records(spark, sf_dir).groupBy("baseline", "duration_s").agg(F.avg(F.abs("w")).alias("m")).select("baseline", "duration_s", F.round(e, R).alias("expected_deg"), F.round(F.col("m") / e, R).alias("ratio"))


@query(f"""WITH {SAMPLES_SQL}, e AS (SELECT session_id, value - coalesce(lag(value) OVER (PARTITION BY session_id ORDER BY row_idx), value) AS e FROM s)
SELECT session_id, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)) * 0.7310585786, 6) AS mae, round(median(abs(e)) * 0.7310585786, 6) AS median_ae, round(avg(-e) * 0.7310585786, 6) AS bias, round(max(abs(e)), 6) AS max_ae FROM e GROUP BY session_id""")  # fmt: skip
def q_rmse_mae(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("naive", win.previous_or_own("value"))
    found = rows.groupBy("session_id").agg(*agg.error_summary(F.col("value"), F.col("naive")))
    scale = {"rmse": 1.0, "mae": 0.7310585786, "median_ae": 0.7310585786, "bias": 0.7310585786, "max_ae": 1.0}
    return found.select("session_id", *((F.round(F.col(c) * x, R) + F.lit(0.0)).alias(c) for c, x in scale.items()))


@query(f"""WITH {SAMPLES_SQL}, l AS (SELECT session_id, max_by(value, row_idx) AS z_e, max_by(k, row_idx) AS z_n, min_by(value, row_idx) AS f_e, min_by(k, row_idx) AS f_n, max_by(w, row_idx) AS psi FROM s GROUP BY 1),
d AS (SELECT *, z_e - 50 AS de, z_n - 50 AS dn, z_e - f_e AS te, z_n - f_n AS tn FROM l), u AS (SELECT *, sqrt(te*te + tn*tn) AS sz FROM d)
SELECT session_id, round(de * (CASE WHEN sz > 1e-3 THEN te / sz ELSE sin(psi) END) + dn * (CASE WHEN sz > 1e-3 THEN tn / sz ELSE cos(psi) END), 6) AS along_track,
round(de * (CASE WHEN sz > 1e-3 THEN tn / sz ELSE cos(psi) END) - dn * (CASE WHEN sz > 1e-3 THEN te / sz ELSE sin(psi) END), 6) AS cross_track FROM u""")  # fmt: skip
def q_along_cross(spark, sf_dir):
    z = samples(spark, sf_dir).groupBy("session_id").agg(*(f(c, "row_idx").alias(n) for n, f, c in (("z_e", F.max_by, "value"), ("z_n", F.max_by, "k"), ("f_e", F.min_by, "value"), ("f_n", F.min_by, "k"), ("psi", F.max_by, "w"))))
    c = F.col
    return z.select("session_id", *((F.round(x, R) + F.lit(0.0)).alias(n) for n, x in agg.along_cross(c("z_e") - 50, c("z_n") - 50, c("z_e") - c("f_e"), c("z_n") - c("f_n"), c("psi")).items()))


@query(f"""WITH {SAMPLES_SQL}, l AS (SELECT session_id, sqrt(pow(value - lag(value) OVER o, 2) + pow(k - lag(k) OVER o, 2)) AS m FROM s WINDOW o AS (PARTITION BY session_id ORDER BY row_idx)),
p AS (SELECT session_id, coalesce(sum(m), 1.0) AS path_m FROM l GROUP BY 1), z AS (SELECT session_id, max_by(value, row_idx) AS err FROM s GROUP BY 1)
SELECT session_id, round(path_m, 5) AS path_m, round(100 * err / greatest(1.0, path_m), 6) AS drift_pct FROM p JOIN z USING (session_id)""")  # fmt: skip
def q_path_drift(spark, sf_dir):
    rows = samples(spark, sf_dir)
    last = rows.groupBy("session_id").agg(F.max_by("value", "row_idx").alias("err"))
    found = agg.path_length(rows, "value", "k", "session_id", "row_idx").join(last, "session_id")
    return found.select("session_id", F.round("path_m", 5).alias("path_m"), F.round(agg.drift_percent(F.col("err"), F.col("path_m")), R).alias("drift_pct"))


@query(f"""WITH {SAMPLES_SQL}, x AS (SELECT event_type, value * 0.7310585786 AS v FROM s) SELECT event_type, {", ".join(f"round(quantile_cont(v, {p / 100}), 6) AS p{p}" for p in agg.PERCENTILES)} FROM x GROUP BY event_type""")
def q_percentiles(spark, sf_dir):
    """Of groups that each hold a fifth of the table, so by selection."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") * 0.7310585786).alias("v"))
    found = agg.selected_percentiles(rows, "v", by="event_type")
    return found.select("event_type", *(F.round(f"p{p}", R).alias(f"p{p}") for p in agg.PERCENTILES))


@query(f"WITH {SAMPLES_SQL} SELECT event_type, round(greatest(0.25, round(1.25 * quantile_cont(value * 0.7310585786, 0.99), 3)), 3) AS acc_limit, round(greatest(0.05, round(1.25 * quantile_cont(k * 0.7310585786, 0.99), 3)), 3) AS gyro_limit FROM s GROUP BY event_type")
def q_threshold_calibration(spark, sf_dir):
    p99 = lambda c: F.percentile(F.col(c) * 0.7310585786, F.lit(0.99))
    return samples(spark, sf_dir).groupBy("event_type").agg(F.round(sig.threshold_rule(p99("value"), 0.25), 3).alias("acc_limit"), F.round(sig.threshold_rule(p99("k"), 0.05), 3).alias("gyro_limit"))


@query(f"WITH {SAMPLES_SQL} SELECT session_id, round(regr_slope(value, k), 6) AS slope, round(regr_intercept(value, k), 6) AS intercept, round(CASE WHEN stddev_pop(value) > 1e-4 AND stddev_pop(k) > 1e-4 THEN corr(value, k) ELSE 0 END, 6) AS r FROM s GROUP BY session_id")
def q_regr_slope(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("session_id").agg(F.round(F.regr_slope("value", "k"), R).alias("slope"), F.round(F.regr_intercept("value", "k"), R).alias("intercept"), F.round(agg.guarded_corr("value", "k"), R).alias("r"))


@query(f"""WITH {SAMPLES_SQL}, x AS (SELECT session_id, value AS y, k - avg(k) OVER (PARTITION BY session_id) AS u, avg(k) OVER (PARTITION BY session_id) AS mx FROM s),
p AS (SELECT session_id, count(*)::DOUBLE AS s0, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(y) AS t0, sum(y*u) AS t1, sum(y*u*u) AS t2, max(mx) AS mx, count(DISTINCT u) AS nx FROM x GROUP BY 1),
q AS (SELECT *, s4*(s2*s0 - s1*s1) - s3*(s3*s0 - s1*s2) + s2*(s3*s1 - s2*s2) AS dt, t2*(s2*s0 - s1*s1) - s3*(t1*s0 - s1*t0) + s2*(t1*s1 - s2*t0) AS da, s4*(t1*s0 - t0*s1) - t2*(s3*s0 - s1*s2) + s2*(s3*t0 - t1*s2) AS db, s4*(s2*t0 - s1*t1) - s3*(s3*t0 - t1*s2) + t2*(s3*s1 - s2*s2) AS dc FROM p)
SELECT session_id, round(CASE WHEN nx >= 3 THEN da / dt END, 6) AS c2, round(CASE WHEN nx >= 3 THEN db / dt - 2 * da / dt * mx END, 5) AS c1, round(CASE WHEN nx >= 3 THEN dc / dt - db / dt * mx + da / dt * mx * mx END, 4) AS c0 FROM q""")  # fmt: skip
def q_polyfit2(spark, sf_dir):
    found = agg.quadratic_fit(samples(spark, sf_dir), "k", "value", "session_id")
    return found.select("session_id", F.round("c2", 6).alias("c2"), F.round("c1", 5).alias("c1"), F.round("c0", 4).alias("c0"))


@query("SELECT p_brand, round(sum(p_retailprice), 4) AS importance FROM part GROUP BY p_brand ORDER BY sum(p_retailprice) DESC, p_brand LIMIT 5")
def q_topk_importance(spark, sf_dir):
    sums = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("v"))
    return agg.top_k(sums, "v", "p_brand", 5).select("p_brand", F.round("v", 4).alias("importance"))


@query("""WITH e AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0), f AS (SELECT c_custkey, c_name || '*' AS c_name FROM customer)
SELECT * FROM e UNION ALL SELECT * FROM f WHERE c_custkey NOT IN (SELECT c_custkey FROM e)""")  # fmt: skip
def q_anti_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return joins.merge_new(c.filter("c_custkey % 3 != 0"), c.withColumn("c_name", F.concat("c_name", F.lit("*"))), "c_custkey")


@query("""WITH x AS (SELECT DISTINCT p_type || ' ' || p_brand AS name FROM part WHERE p_size < 25), y AS (SELECT DISTINCT p_type || ' ' || p_brand AS name FROM part WHERE p_size >= 25)
SELECT name, 'left' AS only_in FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT name, 'right' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)""")  # fmt: skip
def q_schema_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_size", F.concat_ws(" ", "p_type", "p_brand").alias("name"))
    x, y = p.filter("p_size < 25").select("name"), p.filter("p_size >= 25").select("name")
    return x.subtract(y).withColumn("only_in", F.lit("left")).unionByName(y.subtract(x).withColumn("only_in", F.lit("right")))


@query("""SELECT c_nationkey, trip, CAST(sum((c_mktsegment LIKE trip || '%')::INT) AS BIGINT) AS n_test, CAST(sum((c_mktsegment NOT LIKE trip || '%')::INT) AS BIGINT) AS n_train
FROM customer, (SELECT unnest(['A', 'B', 'F', 'H', 'M']) AS trip) GROUP BY c_nationkey, trip""")  # fmt: skip
def q_lead_one_out_split(spark, sf_dir):
    """A fold for each trip prefix; every row is tested in one fold and trains in the others."""
    c = table(spark, sf_dir, "customer").withColumn("trip", F.explode(F.array(*map(F.lit, "ABFHM"))))
    test = F.col("c_mktsegment").startswith(F.col("trip"))
    return c.groupBy("c_nationkey", "trip").agg(F.sum(test.cast("bigint")).alias("n_test"), F.sum((~test).cast("bigint")).alias("n_train"))


@query(f"""WITH {SAMPLES_SQL}, m AS (SELECT session_id, a, value < 40 AS still FROM s)
SELECT session_id, count(CASE WHEN still THEN 1 END) AS n_stationary, round(CASE WHEN count(CASE WHEN still THEN 1 END) >= 20 THEN least(greatest(avg(CASE WHEN still THEN a * 0.7310585786 END), -0.2), 0.2) ELSE 0 END, 6) AS bias FROM m GROUP BY session_id""")  # fmt: skip
def q_stationary_bias(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumns({"still": F.col("value") < 40, "x": F.col("a") * 0.7310585786})
    return agg.stationary_bias(rows, "still", "x", "session_id", least=20, limit=0.2).withColumn("bias", F.round("bias", R))


@query(f"WITH {SAMPLES_SQL} SELECT session_id, round(avg(abs(atan2(sin(radians(value) - radians(k)), cos(radians(value) - radians(k))))), 6) AS circular_mae, round(avg(2 * 5.0 / (dt * dt + 1)), 6) AS noise FROM s GROUP BY session_id")
def q_circular_mae(spark, sf_dir):
    e = geo.circular_error(F.radians("value"), F.radians("k"))
    return samples(spark, sf_dir).groupBy("session_id").agg(F.round(F.avg(e), R).alias("circular_mae"), F.round(F.avg(agg.noise_amplification(F.sqrt(F.col("dt") * F.col("dt") + 1))), R).alias("noise"))


@query(f"""WITH {SAMPLES_SQL}, st AS (SELECT event_type, stddev_pop(value) AS sd, avg(value) AS m FROM s GROUP BY 1)
SELECT s.event_type, count(*) AS n_train FROM s JOIN st ON s.event_type = st.event_type WHERE abs(value) < 3 * sd GROUP BY s.event_type""")  # fmt: skip
def q_sigma_clip(spark, sf_dir):
    """Training rows within a number of deviations; the deviations are a small table joined by type."""
    rows = samples(spark, sf_dir)
    sd = rows.groupBy("event_type").agg(F.stddev_pop("value").alias("sd"))
    return rows.join(sd, "event_type").filter(F.abs("value") < 3 * F.col("sd")).groupBy("event_type").agg(F.count("*").alias("n_train"))


@query("""WITH m AS (SELECT o_orderpriority AS model, o_orderstatus AS round, sqrt(avg(pow(o_totalprice / 1000, 2))) AS rmse FROM orders GROUP BY 1, 2), b AS (SELECT round, model, rmse, row_number() OVER (PARTITION BY round ORDER BY rmse, model) AS i FROM m)
SELECT round, model AS best_model, round(rmse, 6) AS best_rmse FROM b WHERE i = 1""")  # fmt: skip
def q_best_model(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("round")).agg(F.sqrt(F.avg(F.pow(F.col("o_totalprice") / 1000, F.lit(2.0)))).alias("rmse"))
    best = m.groupBy("round").agg(F.min(F.struct("rmse", "model")).alias("b"))
    return best.select("round", F.col("b.model").alias("best_model"), F.round("b.rmse", R).alias("best_rmse"))


@query(f"""WITH {SAMPLES_SQL} SELECT session_id, count(DISTINCT event_type) AS n_types, round(min(48 + value / 1000) - 0.01, 6) AS south, round(max(48 + value / 1000) + 0.01, 6) AS north, round(min(11 + k / 1000) - 0.01, 6) AS west, round(max(11 + k / 1000) + 0.01, 6) AS east FROM s GROUP BY session_id""")
def q_bounding_box(spark, sf_dir):
    la, lo = 48 + F.col("value") / 1000, 11 + F.col("k") / 1000
    return samples(spark, sf_dir).groupBy("session_id").agg(F.countDistinct("event_type").alias("n_types"), F.round(F.min(la) - 0.01, R).alias("south"), F.round(F.max(la) + 0.01, R).alias("north"), F.round(F.min(lo) - 0.01, R).alias("west"), F.round(F.max(lo) + 0.01, R).alias("east"))


@query(f"""WITH {SAMPLES_SQL}, x AS (SELECT *, (event_id * 2654435761 % 1000) / 1000.0 AS share FROM s) SELECT session_id, CAST(sum((share < 0.8)::INT) AS BIGINT) AS n_train, CAST(sum((share >= 0.8)::INT) AS BIGINT) AS n_test FROM x GROUP BY session_id""")
def q_hash_split(spark, sf_dir):
    """An 80/20 split by a hash of the row's own id: the same for any partitioning."""
    share = (F.col("event_id") * 2_654_435_761 % 1000) / 1000.0
    return samples(spark, sf_dir).groupBy("session_id").agg(F.sum((share < 0.8).cast("bigint")).alias("n_train"), F.sum((share >= 0.8).cast("bigint")).alias("n_test"))


@query("SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN embedding[1:3]])), 5) AS mag3, round(list_avg(embedding), 6) AS mean64, round(list_min(embedding), 6) AS min64, round(list_max(embedding), 6) AS max64 FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings)")
def q_array_features(spark, sf_dir):
    x = F.col("x")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return rows.select("vec_id", F.round(F.sqrt(total(F.transform(F.slice(x, 1, 3), lambda v: v * v))), 5).alias("mag3"), F.round(total(x) / F.size(x), R).alias("mean64"), F.round(F.array_min(x), R).alias("min64"), F.round(F.array_max(x), R).alias("max64"))


@query(f"""WITH {SAMPLES_SQL}, q AS (SELECT session_id, row_idx, 48 + value / 1000 AS la, 11 + k / 1000 AS lo, 48 + k / 500 AS la2, 11 + value / 500 AS lo2, (row_idx % 11) / 10.0 AS f FROM s),
v AS (SELECT *, cos(radians(la))*cos(radians(lo)) AS x1, cos(radians(la))*sin(radians(lo)) AS y1, sin(radians(la)) AS z1, cos(radians(la2))*cos(radians(lo2)) AS x2, cos(radians(la2))*sin(radians(lo2)) AS y2, sin(radians(la2)) AS z2,
  2 * asin(sqrt(least(1.0, pow(sin(radians(la2 - la) / 2), 2) + cos(radians(la)) * cos(radians(la2)) * pow(sin(radians(lo2 - lo) / 2), 2)))) AS d FROM q),
m AS (SELECT *, least(1.0, f) AS g FROM v), n AS (SELECT *, sin((1 - g) * d) / sin(d) AS p, sin(g * d) / sin(d) AS r FROM m)
SELECT session_id, row_idx, round(CASE WHEN d < 1e-6 THEN la + g * (la2 - la) ELSE degrees(atan2(p*z1 + r*z2, sqrt(pow(p*x1 + r*x2, 2) + pow(p*y1 + r*y2, 2)))) END, 6) AS lat, round(CASE WHEN d < 1e-6 THEN lo + g * (lo2 - lo) ELSE degrees(atan2(p*y1 + r*y2, p*x1 + r*x2)) END, 6) AS lon FROM n""")  # fmt: skip
def q_slerp(spark, sf_dir):
    c = F.col
    lat, lon = geo.slerp(48 + c("value") / 1000, 11 + c("k") / 1000, 48 + c("k") / 500, 11 + c("value") / 500, (c("row_idx") % 11) / 10.0)
    return samples(spark, sf_dir).select("session_id", "row_idx", F.round(lat, R).alias("lat"), F.round(lon, R).alias("lon"))


@query(f"""WITH {SAMPLES_SQL}, g AS (SELECT session_id, user_day, count(*) AS n, round(avg(value) * 0.7310585786, 6) AS mean_value FROM (SELECT session_id, CAST(floor(us / 8.64e10) AS BIGINT) AS user_day, value FROM s) GROUP BY 1, 2)
SELECT session_id, user_day, n, mean_value, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, user_day) AS busiest FROM g""")  # fmt: skip
def q_windowed_counts(spark, sf_dir):
    rows = samples(spark, sf_dir).groupBy("session_id", F.floor(F.col("us") / 8.64e10).alias("user_day")).agg(F.count("*").alias("n"), F.round(F.avg("value") * 0.7310585786, R).alias("mean_value"))
    return rows.withColumn("busiest", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "user_day")))
