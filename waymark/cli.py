"""Command line: ``python -m waymark.cli edge`` and ``python -m waymark.cli adapt``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from waymark.operators.edge import WINDOW_ROWS, no_correction, run_engine
from waymark.operators.models import load
from waymark.sources.preprocess import adapt_sensors
from waymark.sources.readers import edge_csv, sensor_csv, write_csv

def _model(path: str | None):
    if path is None:
        return no_correction
    fitted = load(path)
    return lambda features: fitted.transform(features).select("session_id", "window_idx", "prediction").withColumnRenamed("prediction", "ds_corr")


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="waymark")
    kinds = top.add_subparsers(dest="command", required=True)
    edge = kinds.add_parser("edge", help="trajectory from a file of the edge contract")
    edge.add_argument("--input", required=True)
    edge.add_argument("--model")
    edge.add_argument("--no-model", action="store_true")
    edge.add_argument("--window-samples", type=int, default=WINDOW_ROWS)
    edge.add_argument("--output", required=True)
    adapt = kinds.add_parser("adapt", help="the edge contract from a folder of sensor files")
    adapt.add_argument("--sensor-dir", required=True)
    adapt.add_argument("--output", required=True)
    adapt.add_argument("--mounting-yaw-deg", type=float, default=0.0)
    given = top.parse_args(args)
    spark = SparkSession.builder.appName("waymark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "edge":
        found = run_engine(edge_csv(spark, given.input), _model(None if given.no_model else given.model), given.window_samples)
        write_csv(found.drop("session_id").orderBy("t_idx"), given.output)
    else:
        files = (("Accelerometer", "acc_lin"), ("Gravity", "grav"), ("Gyroscope", "gyro"), ("TotalAcceleration", "acc"))
        sides = [sensor_csv(spark, f"{given.sensor_dir}/{name}.csv", prefix) for name, prefix in files]
        write_csv(adapt_sensors(*sides, yaw_deg=given.mounting_yaw_deg).orderBy("row_idx").drop("session_id", "row_idx", "t"), given.output)


if __name__ == "__main__":
    main()
