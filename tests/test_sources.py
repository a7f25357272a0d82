import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.operators import joins, quality
from waymark.operators.edge import is_stationary, run_engine, window_physics
from waymark.sources import preprocess, readers, schema

HEADER = "GPS LATITUDE (degrees),GPS LONGITUDE (degrees),GPS SPEED (Kmh),TIME SINCE START (ms),ACCELEROMETER X (m/s²),ACCELEROMETER Y (m/s²),ACCELEROMETER Z (m/s²),GRAVITY X (m/s²),GRAVITY Y (m/s²),GRAVITY Z (m/s²),GYROSCOPE X (rad/s),GYROSCOPE Y (rad/s),GYROSCOPE Z (rad/s),GPS ORIENTATION (°)"


@pytest.fixture
def raw(spark, tmp_path):
    lines = [HEADER]
    for i in range(120):
        t = i * 100 if i < 60 else (i - 60) * 100  # the clock is reset
        lat = "" if i % 7 == 3 else f"{48 + (i // 10) / 1000}"
        lines.append(f"{lat},11.5,36,{t},1,2,10,0,0,9.8,0.1,0.2,0.3,90")
    (tmp_path / "S-V1.csv").write_bytes("\n".join(lines).encode("latin-1"))
    return readers.session_csv(spark, str(tmp_path))


def test_headers():
    assert schema.canonical_name(" magnetic field x (µT) ") == schema.canonical_name("MAGNETIC FIELD X (μT)") == "mag_x"
    assert schema.canonical_name("Orientation (Roll ) (A)") == "ori_roll_deg"
    assert schema.canonical_name("Some New (Thing)") == "some_new_thing"


def test_session_csv_and_processing(spark, raw):
    assert [r.time_ms for r in raw.orderBy("row_idx").limit(3).collect()] == [0.0, 100.0, 200.0]
    done = preprocess.process_sessions(raw)
    names = {r.session_id: r["count"] for r in done.groupBy("session_id").count().collect()}
    assert names == {"S-V1_sub01": 60, "S-V1_sub02": 60}
    row = done.orderBy("session_id", "row_idx").first()
    assert row.acc_lin_z == pytest.approx(0.2) and row.gps_speed_ms == pytest.approx(10) and row.is_gnss_update and row.gnss_fix_id == 0
    assert done.filter("gps_lat IS NULL").count() == 0
    report = quality.profile(raw)
    assert report["rows"].first().n_rows == 120
    assert "gps_alt" in report["header"]["missing"]
    assert report["mounting"].first().mounting == "flat_face_up"


def test_required_columns(spark):
    with pytest.raises(ValueError, match="dt_sec"):
        schema.require(spark.createDataFrame([(1.0,)], "acc_x double"))


def test_gpx(spark, tmp_path):
    (tmp_path / "a.gpx").write_text('<gpx><trk><trkseg><trkpt lat="1.5" lon="2.5"><ele>3</ele><time>2026-09-04T07:20:50Z</time><speed>1.25</speed><sat>7</sat></trkpt><trkpt lat="1.6" lon="2.6"><time>2026-09-04T07:20:49Z</time></trkpt></trkseg></trk></gpx>')
    got = readers.gpx(spark, str(tmp_path / "a.gpx")).collect()
    assert [(r.lat, r.lon, r.speed) for r in got] == [(1.6, 2.6, None), (1.5, 2.5, 1.25)]


def test_osm(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"elements":[{"type":"node","id":1,"lat":48.0,"lon":11.0},{"type":"node","id":2,"lat":48.001,"lon":11.0},{"type":"way","id":9,"nodes":[1,2,77],"tags":{"highway":"primary"}},{"type":"way","id":10,"nodes":[1,77]},{"type":"way","id":11,"geometry":[{"lat":48.0,"lon":11.0},{"lat":48.0,"lon":11.001}]}]}')
    elements = readers.osm_elements(spark, str(tmp_path / "a.json"))
    by_nodes = joins.resolve_ways(elements).withColumn("label", readers.road_label()).collect()
    assert [(r.way_id, r.label, len(r.points)) for r in by_nodes] == [(9, "Primary Road", 2)]
    segments = joins.road_segments(readers.osm_ways(elements), 48.0, 11.0).collect()
    assert len(segments) == 1 and segments[0].heading == pytest.approx(1.5708, abs=1e-3) and 70 < segments[0].length_m < 80


def test_sinks_and_cache(spark, raw, tmp_path):
    readers.write_sessions(raw, str(tmp_path / "s"))
    assert readers.sessions(spark, str(tmp_path / "s"), skip=["S-V9"]).count() == 120
    calls = []
    build = lambda: calls.append(1) or spark.range(5).toDF("id")
    assert readers.cached(spark, str(tmp_path / "c"), build).count() == readers.cached(spark, str(tmp_path / "c"), build).count() == 5
    assert len(calls) == 1


def window(spark, rows=91, acc=0.01, fwd=0.005):
    one = {"acc_x": 0.0, "acc_y": 0.0, "acc_z": 9.8, "acc_lin_x": acc, "acc_lin_y": -0.01, "acc_lin_z": 0.02, "gyro_x": 0.001, "gyro_y": -0.001, "gyro_z": 0.002, "acc_veh_fwd": fwd, "gyro_veh_yaw_rate": 0.001, "dt_sec": 0.1}
    return spark.createDataFrame(pd.DataFrame([{"session_id": "a", "row_idx": i, **one} for i in range(rows)]))


def test_edge_stationary_and_moving(spark):
    still = window_physics(window(spark)).withColumn("still", is_stationary()).first()
    assert still.still and still.ds_imu < 0.01 and still.velocity == 0
    moving = window_physics(window(spark, acc=6.0, fwd=0.5)).withColumn("still", is_stationary()).first()
    assert not moving.still and moving.velocity == pytest.approx(0.5 * 9.0)
    fixed = lambda f: f.select("session_id", "window_idx", F.lit(12.6).alias("ds_corr"))
    assert run_engine(window(spark), fixed, skip_still=True).filter("t_idx > 0").first().ds_corr == 0
    assert run_engine(window(spark, acc=6.0, fwd=0.5), fixed, skip_still=True).filter("t_idx > 0").first().ds_corr == 12.6


def test_edge_windows_against_loop(spark):
    import math

    import numpy as np

    rng = np.random.default_rng(5)
    n = 737
    rows = pd.DataFrame({c: rng.normal(0, 2.5, n) for c in schema.EDGE_COLUMNS if c != "dt_sec"} | {"session_id": "a", "row_idx": range(n), "dt_sec": 0.1})
    rows[["gyro_x", "gyro_y", "gyro_z"]] *= 0.1
    model = lambda f: f.select("session_id", "window_idx", (F.col("acc_x_mean") + F.col("seg_n_samples") / 100).alias("ds_corr"))
    got = run_engine(spark.createDataFrame(rows), model).orderBy("t_idx").collect()
    assert [r.t_idx for r in got] == [0, *range(90, 721, 90), 736]
    x = y = v = psi = 0.0
    for k, r in enumerate(got[1:]):
        own = rows.iloc[90 * k : 90 * k + 91]
        raw = (np.sqrt((own[["acc_lin_x", "acc_lin_y", "acc_lin_z"]] ** 2).sum(axis=1)) < 5.389) & (np.sqrt((own[["gyro_x", "gyro_y", "gyro_z"]] ** 2).sum(axis=1)) < 0.753)
        run, mask = 0, []
        for ok in raw:
            run = run + 1 if ok else 0
            mask.append(run >= 8)
        de = dn = 0.0
        for i in range(1, len(own)):
            v = 0.0 if mask[i] else max(0.0, v + own["acc_veh_fwd"].iloc[i] * 0.1)
            psi += own["gyro_veh_yaw_rate"].iloc[i] * 0.1
            de, dn = de + v * math.sin(psi) * 0.1, dn + v * math.cos(psi) * 0.1
        ds = math.hypot(de, dn)
        way = math.atan2(de, dn) if ds > 1e-3 else psi
        ds = max(0.0, ds + own["acc_x"].mean() + len(own) / 100)
        x, y = x + ds * math.sin(way), y + ds * math.cos(way)
        assert (r.x, r.y, r.velocity, r.heading) == (pytest.approx(x, abs=1e-6), pytest.approx(y, abs=1e-6), pytest.approx(v, abs=1e-9), pytest.approx(psi, abs=1e-9))


def test_command_line(spark, tmp_path):
    import numpy as np

    from waymark import cli

    rng = np.random.default_rng(1)
    t = 1_700_000_000_000_000_000 + np.arange(0, 12_000_000_000, 50_000_000)
    for name in ("Accelerometer", "Gravity", "Gyroscope", "TotalAcceleration"):
        pd.DataFrame({"time": t + rng.integers(0, 10_000_000), "x": rng.normal(0, 1, len(t)), "y": 0.1, "z": 9.8 if name == "Gravity" else 0.2}).to_csv(tmp_path / f"{name}.csv", index=False)
    cli.main(["adapt", "--sensor-dir", str(tmp_path), "--output", str(tmp_path / "edge"), "--mounting-yaw-deg", "10"])
    adapted = spark.read.csv(str(tmp_path / "edge"), header=True)
    assert set(schema.EDGE_COLUMNS) <= set(adapted.columns) and 115 <= adapted.count() <= 120
    cli.main(["edge", "--input", str(tmp_path / "edge"), "--no-model", "--output", str(tmp_path / "out")])
    got = spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True).orderBy("t_idx").collect()
    assert [r.t_idx for r in got][:2] == [0, 90] and got[0].x == 0


def test_models(spark):
    import numpy as np

    from waymark.operators import models

    rng = np.random.default_rng(2)
    x = rng.normal(0, 2, (300, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "trip": [f"T{i % 3}" for i in range(300)]}))
    fitted = models.ridge(df, ["a", "b", "c"], "y", 1.0)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    want = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    np.testing.assert_allclose(fitted.stages[-1].coefficients.toArray(), want, rtol=1e-6)
    out = models.leave_one_trip_out(df, ["T0", "T1", "T2"], "trip", ["a", "b", "c"], "y", {"ridge": models.ridge}, F.lit(3.0)).collect()
    rmse = {(r.trip, r.model): r.rmse for r in out}
    assert all(rmse[t, "ridge"] < 0.2 < rmse[t, "naive"] for t in ("T0", "T1", "T2"))


def test_importances_and_heading(spark):
    import math

    import numpy as np

    from waymark.operators import models

    rng = np.random.default_rng(3)
    a = rng.uniform(0, 2 * math.pi, 400)
    df = spark.createDataFrame(pd.DataFrame({"acc_x_mean": np.sin(a), "acc_z_mean": np.cos(a), "noise": rng.normal(size=400), "angle": a}))
    names = ["acc_x_mean", "acc_z_mean", "noise"]
    small = lambda t, f, y: models.boosted(t, f, y, maxIter=8, maxDepth=4, stepSize=0.4, subsamplingRate=1.0, featureSubsetStrategy="all")
    found = models.importances(small(df.withColumn("s", F.sin("angle")), names, "s"), names, df).collect()
    assert found[0].feature == "acc_x_mean" and {r.feature for r in found if r.risky} == {"acc_z_mean"}
    out = models.heading_by_parts(df, df, names, "angle", small).select("angle", "heading_pred").toPandas()
    error = np.abs(np.angle(np.exp(1j * (out["angle"] - out["heading_pred"]))))
    assert error.mean() < 0.1
