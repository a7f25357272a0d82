"""The canonical sample view over the events table, in Spark and in SQL.

A user is a session; rows are ordered by (ts, event_id). dt is in hours, its first value the session's median; a and w
stand for forward acceleration and yaw rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.windows import add_dt, number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )
    rows = number_rows(rows, "session_id", ["us", "event_id"]).withColumn("row_idx", F.col("row_idx").cast("bigint"))
    rows = rows.withColumns({"t": F.col("us") / 1e6, "_h": F.col("us") / 3.6e9})
    return add_dt(rows, "_h").withColumns({"a": (F.col("value") - 50) / 100, "w": (F.col("k") - 50) / 500}).drop("_h")


SAMPLES_SQL = """
s0 AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_idx, event_id,
  epoch_us(ts) AS us, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
s1 AS (SELECT *, us / 1e6 AS t, us / 3.6e9 - lag(us / 3.6e9) OVER (PARTITION BY session_id ORDER BY row_idx) AS d FROM s0),
s AS (SELECT *, coalesce(d, median(d) OVER (PARTITION BY session_id), 0.1) AS dt, (value - 50) / 100 AS a, (k - 50) / 500 AS w FROM s1)"""
