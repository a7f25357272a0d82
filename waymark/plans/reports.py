"""Queries of report filters and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import reports
from waymark.operators.windows import ordered
from waymark.plans import motion
from waymark.plans.samples import SAMPLES_SQL, samples

QUERIES, ORACLE_SQL = {}, {}
R = 6


def query(sql: str):
    def put(fn):
        QUERIES[fn.__name__] = fn
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


_NEXT = "OVER (PARTITION BY session_id ORDER BY row_idx)"
_SEGMENTS = f"g AS (SELECT session_id, row_idx, value / 10 AS v0, lead(value / 10) {_NEXT} AS v1, lead(us / 3.6e9) {_NEXT} - us / 3.6e9 AS dur FROM s WHERE event_type = 'click'), gd AS (SELECT *, (v0 + v1) / 2 * dur AS dist FROM g WHERE v1 IS NOT NULL)"


@query(f"WITH {SAMPLES_SQL}, {_SEGMENTS} SELECT session_id, row_idx, round(dist, 6) AS dist, round(dur, 6) AS dur FROM gd WHERE dist > 10 AND (v0 + v1) / 2 > 2 AND dur >= 2.0")
def q_reliable_segments(spark, sf_dir):
    """Segments between clicks whose bearing counts and that last long enough."""
    w = ordered()
    rows = samples(spark, sf_dir).filter("event_type = 'click'").withColumn("h", F.col("us") / 3.6e9)
    rows = rows.select("session_id", "row_idx", (F.col("value") / 10).alias("v0"), (F.lead("value").over(w) / 10).alias("v1"), (F.lead("h").over(w) - F.col("h")).alias("dur")).filter("v1 IS NOT NULL")
    rows = rows.withColumn("dist", (F.col("v0") + F.col("v1")) / 2 * F.col("dur"))
    rows = rows.filter(reports.reliable_bearing(F.col("dist"), F.col("v0"), F.col("v1")) & reports.long_enough(F.col("dur")))
    return rows.select("session_id", "row_idx", F.round("dist", R).alias("dist"), F.round("dur", R).alias("dur"))


@query(f"WITH {SAMPLES_SQL} SELECT event_type, count(*) AS n_still, round(avg(a), 6) AS mean_a, round(avg(w), 6) AS mean_w FROM s WHERE value / 100 < 0.2 GROUP BY event_type HAVING count(*) > 50")
def q_zero_speed(spark, sf_dir):
    found = reports.zero_speed(samples(spark, sf_dir).withColumn("speed", F.col("value") / 100), "speed", "event_type", ["a", "w"])
    return found.select("event_type", "n_still", F.round("mean_a", R).alias("mean_a"), F.round("mean_w", R).alias("mean_w"))


REFERENCES = {"click": 40.0, "view": 45.5}


@query(f"WITH {SAMPLES_SQL}, r AS (SELECT event_type, avg(value) AS m, CASE event_type WHEN 'click' THEN 40.0 WHEN 'view' THEN 45.5 ELSE 50.0 END AS reference FROM s GROUP BY event_type) SELECT event_type, round(m, 6) AS mean_value, reference::DOUBLE AS reference, round(100 * (reference - m) / reference, 6) AS change FROM r")
def q_reference_values(spark, sf_dir):
    """Means against constants of two kinds, and a default for the others."""
    found = reports.with_reference(samples(spark, sf_dir).groupBy("event_type").agg(F.avg("value").alias("m")), "event_type", REFERENCES, 50.0)
    return found.select("event_type", F.round("m", R).alias("mean_value"), "reference", F.round(100 * (F.col("reference") - F.col("m")) / F.col("reference"), R).alias("change"))


@query(f"WITH {SAMPLES_SQL} SELECT event_type, count(*) AS n_groups, round(median(m), 6) AS median_of_medians FROM (SELECT event_type, session_id, median(value) AS m FROM s GROUP BY 1, 2) GROUP BY 1")
def q_median_of_medians(spark, sf_dir):
    return reports.median_of_medians(samples(spark, sf_dir), "value", "session_id", "event_type").withColumn("median_of_medians", F.round("median_of_medians", R))


@query(f"WITH {SAMPLES_SQL} SELECT session_id, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM s GROUP BY session_id")
def q_sample_deviation(spark, sf_dir):
    return reports.sample_deviation(samples(spark, sf_dir), "value", "session_id").withColumns({"mean": F.round("mean", R), "std": F.round("std", R)})


@query(f"WITH {SAMPLES_SQL} SELECT session_id % 5 AS trip, event_type, CASE WHEN k < 50 THEN 'short' ELSE 'long' END AS span, count(*) AS n, round(avg(abs(a)), 6) AS mean_a_err, round(avg(abs(w)), 6) AS mean_w_err FROM s GROUP BY 1, 2, 3")
def q_trip_means(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumns({"trip": F.col("session_id") % 5, "span": F.when(F.col("k") < 50, "short").otherwise("long"), "a_err": F.abs("a"), "w_err": F.abs("w")})
    return reports.trip_means(rows, ["trip", "event_type", "span"], ["a_err", "w_err"]).withColumns({c: F.round(c, R) for c in ("mean_a_err", "mean_w_err")})


@query(f"WITH {SAMPLES_SQL}, i AS (SELECT event_type, session_id % 5 AS trip, 100 * (avg(value) - avg(k)) / avg(value) AS gain FROM s GROUP BY 1, 2) SELECT event_type, count(*) AS n_rounds, round(avg(gain), 6) AS mean, round(min(gain), 6) AS least, round(max(gain), 6) AS largest, sum((gain > 0)::BIGINT)::BIGINT AS n_better FROM i GROUP BY 1")
def q_improvement_over_rounds(spark, sf_dir):
    rows = samples(spark, sf_dir).groupBy("event_type", (F.col("session_id") % 5).alias("trip")).agg((100 * (F.avg("value") - F.avg("k")) / F.avg("value")).alias("gain"))
    return reports.over_rounds(rows, ["event_type"], "gain").withColumns({c: F.round(c, R) for c in ("mean", "least", "largest")})


_ESTIMATES = ("k", "half", "scaled")


@query(f"WITH {SAMPLES_SQL}, e AS (SELECT session_id, value, unnest(['k', 'half', 'scaled']) AS estimate, unnest([k, value / 2, value * 1.1]) AS x FROM s) SELECT session_id, estimate, round(sum(x), 4) AS total, round(sum(x) / nullif(sum(value), 0), 6) AS ratio, round(avg(abs(x - value)), 6) AS mean_error FROM e GROUP BY 1, 2")
def q_comparison(spark, sf_dir):
    """Each estimate's total, its share of the truth's, and its mean error, by session."""
    rows = samples(spark, sf_dir).withColumns({"half": F.col("value") / 2, "scaled": F.col("value") * 1.1})
    found = reports.comparison(rows, "session_id", "value", _ESTIMATES)
    return found.select("session_id", "estimate", F.round("total", 4).alias("total"), F.round("ratio", R).alias("ratio"), F.round("mean_error", R).alias("mean_error"))


@query(f"SELECT session_id, count(*) AS attempts, round(100.0 * avg(CASE WHEN way_id IS NULL THEN 0 ELSE 1 END), 6) AS match_rate FROM ({motion.ORACLE_SQL['q_map_match']}) GROUP BY session_id")
def q_match_rate(spark, sf_dir):
    return reports.match_rate(motion.q_map_match(spark, sf_dir), F.col("way_id").isNotNull(), "session_id").withColumn("match_rate", F.round("match_rate", R))


@query(f"""WITH {SAMPLES_SQL}, q AS (SELECT *, CAST(floor(us / 3.6e9) AS BIGINT) AS second, row_number() OVER (PARTITION BY session_id, floor(us / 3.6e9) ORDER BY row_idx) AS i FROM s),
p AS (SELECT session_id, second, unnest(['truth', 'raw', 'corrected']) AS path, unnest([value, k, (value + k) / 2]) AS e, unnest([k, value, (value - k) / 2]) AS n FROM q WHERE i = 1)
SELECT session_id, second, path, round(49.0 + degrees(n / 6371000.0), 9) AS lat, round(8.0 + degrees(e / (6371000.0 * cos(radians(49.0)))), 9) AS lon FROM p""")  # fmt: skip
def q_demo_frames(spark, sf_dir):
    """Three paths of each session as latitude and longitude, a row for each unit of time."""
    rows = samples(spark, sf_dir).withColumns({"h": F.col("us") / 3.6e9, "e3": (F.col("value") + F.col("k")) / 2, "n3": (F.col("value") - F.col("k")) / 2})
    found = reports.demo_frames(rows, {"truth": ("value", "k"), "raw": ("k", "value"), "corrected": ("e3", "n3")}, "h", 49.0, 8.0)
    return found.select("session_id", "second", "path", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))
