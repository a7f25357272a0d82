"""The stateful processors over micro-batches against plain loops, however the batches are cut."""

import math

import numpy as np
import pandas as pd
import pytest
from test_machine import new_machine

from waymark.operators.fusion import smooth_step
from waymark.streaming import live, machine

S = 10**9
#: Times begin here: the watermark stands at zero before the first batch.
BASE = 1000 * S


@pytest.fixture
def streamed(spark, tmp_path):
    live.use_state_store(spark)
    runs = []

    def run(rows: pd.DataFrame, through, batches=2, mode="update", order=None, keys=()):
        """rows as a stream of micro-batches, in an order, through an operator, as written."""
        top = tmp_path / str(len(runs))
        runs.append(top)
        for k, part in enumerate(np.array_split(np.arange(len(rows)) if order is None else order, batches)):
            spark.createDataFrame(rows.iloc[part]).coalesce(1).write.parquet(f"{top}/in/{k:03d}")
        schema = spark.read.parquet(f"{top}/in/000").schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{top}/in")
        return live.run_to_table(through(stream), f"{top}/work", mode, keys).toPandas()

    return run


def closed(rows: pd.DataFrame) -> pd.DataFrame:
    """rows and one of another device, much later, so that the watermark passes them all."""
    last = rows.iloc[-1:].assign(device="~end", ts_ns=int(rows["ts_ns"].max()) + 10**6 * S)
    return pd.concat([rows, last], ignore_index=True)


def own(got: pd.DataFrame) -> pd.DataFrame:
    return got[got["device"] != "~end"].reset_index(drop=True)


def test_latest_hold(streamed):
    rng = np.random.default_rng(1)
    n = 300
    rows = pd.DataFrame({"device": rng.choice(["a", "b"], n), "ts_ns": BASE + np.sort(rng.choice(10**10, n, replace=False)), "sensor": rng.choice(["acc", "gyro", "mag", "other"], n), "x": rng.normal(size=n), "y": 0.0, "z": 1.0})
    got = own(streamed(closed(rows), live.samples_from_sensors)).sort_values(["device", "ts_ns"])
    want = []
    for device, part in rows.groupby("device"):
        held, last = {}, None
        for r in part.itertuples():
            held[r.sensor] = r.x
            if last is None or r.ts_ns - last >= 10**8:
                want.append((device, r.ts_ns, held.get("acc"), held.get("gyro")))
                last = r.ts_ns
    assert got["ts_ns"].tolist() == [w[1] for w in want]
    np.testing.assert_allclose(got["acc_x"].astype(float), np.array([w[2] for w in want], dtype=float))
    np.testing.assert_allclose(got["gyro_x"].astype(float), np.array([w[3] for w in want], dtype=float))


@pytest.mark.parametrize(("n", "size", "want"), [(200, 91, [[0, 90, 91], [91, 181, 91]]), (40, 20, [[0, 19, 20], [20, 39, 20]])])
def test_count_windows(streamed, n, size, want):
    rows = pd.DataFrame({"device": "a", "ts_ns": BASE + np.arange(n), "value": np.arange(n * 1.0)})
    got = streamed(closed(rows), lambda s: live.count_windows(s, size)).sort_values("first_ns")
    got[["first_ns", "last_ns"]] -= BASE
    assert got[["first_ns", "last_ns", "n"]].values.tolist() == want


def test_smoother(streamed):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"device": "a", "ts_ns": BASE + np.arange(80), "east": rng.normal(0, 15, 80).cumsum(), "north": rng.normal(0, 15, 80).cumsum(), "accuracy": 5.0})
    got = own(streamed(closed(rows), live.smoothed)).sort_values("ts_ns")
    state, want = None, []
    for r in rows.itertuples():
        state = smooth_step(state, r.east, r.north, r.accuracy)
        want.append(state[0])
    np.testing.assert_allclose(got["anchor_east"], want)


def trip(seconds: float = 40.0) -> pd.DataFrame:
    """Two devices with samples, fixes that stop now and then, controls and roads."""
    rng = np.random.default_rng(3)
    parts = []
    for device in "ab":
        t = (np.arange(1, int(seconds * 10)) * S) // 10 + rng.integers(0, 10**6, int(seconds * 10) - 1)
        parts.append(pd.DataFrame({"device": device, "ts_ns": t, "kind": "imu", "fwd": rng.normal(0, 0.5, len(t)), "lat": rng.normal(0, 0.2, len(t)), "yaw": rng.normal(0, 0.05, len(t)), "acc": rng.uniform(0.1, 7, len(t)), "gyro": 0.1, "speed_ml": 6.0}))
        at = np.array([0, 1, 2, 9, 10, 11, 12, 18, 22, 26]) * S
        parts.append(pd.DataFrame({"device": device, "ts_ns": at, "kind": "fix", "east": at / S * 5, "north": 3.0, "speed": 5.0, "psi": 1.5}))
        parts.append(pd.DataFrame({"device": device, "ts_ns": np.array([13, 21]) * S, "kind": "control"}))
        e1, n1 = rng.uniform(-50, 300, 40), rng.uniform(-60, 60, 40)
        parts.append(pd.DataFrame({"device": device, "ts_ns": rng.integers(0, 5 * S, 40), "kind": "road", "e1": e1, "n1": n1, "e2": e1 + 80, "n2": n1 + 10, "heading": math.atan2(80, 10)}))
    return pd.concat(parts, ignore_index=True).sort_values(["ts_ns", "device", "kind"], ignore_index=True).astype({"ts_ns": "int64"}).assign(ts_ns=lambda d: d["ts_ns"] + BASE)


def plain(rows: pd.DataFrame, until: int, **limits) -> pd.DataFrame:
    """The machines over all rows by time, without a stream."""
    out = []
    for device, part in rows.groupby("device"):
        box = new_machine(**limits)
        part = part.assign(rank=part["kind"].map(machine.KINDS.index)).sort_values(["ts_ns", "rank"], kind="stable")
        for r in part.to_dict("records"):
            out += [(device, *x) for x in box.take(r["ts_ns"], r["kind"], {"ax": math.nan, "ay": math.nan, **r})]
        out += [(device, *x) for x in box.pass_time(until)]
    return pd.DataFrame(out, columns=list(live.LiveFusion.OUT))


def test_results_dont_depend_on_how_batches_are_cut(streamed):
    rows = trip()
    want = plain(rows, 10**5 * S).sort_values(["device", "ts_ns", "event"], ignore_index=True)
    assert {"lost", "resync", "restored", "imu", "fix", "expired"} <= set(want["event"]) and want["matched"].any()
    rng = np.random.default_rng(4)
    late = np.argsort(rows["ts_ns"].to_numpy() + rng.integers(0, 4 * S, len(rows)), kind="stable")  # rows come up to 4 s late
    every = closed(rows)
    for batches in (1, 3, 20):
        got = own(streamed(every, lambda s: live.fused(s, late="5 seconds"), batches, order=np.r_[late, len(rows)])).sort_values(["device", "ts_ns", "event"], ignore_index=True)
        pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_time_alone_switches_modes(streamed):
    """The last rows of device a come before a batch in which only another device speaks."""
    rows = pd.DataFrame({"device": ["a", "b"], "ts_ns": [BASE, BASE + 5 * S], "kind": "fix", "east": 1.0, "north": 2.0, "speed": 3.0, "psi": 0.0})
    got = streamed(rows, lambda s: live.fused(s, late="0 seconds")).query("device == 'a'")
    assert got[["ts_ns", "mode", "event"]].values.tolist() == [[BASE, "GPS_ACTIVE", "fix"], [BASE + 3 * S, "OUTAGE", "lost"]]


def test_roads_from_the_start(streamed, spark):
    rows = trip().query("kind != 'road'").reset_index(drop=True)
    roads = trip().query("kind == 'road'")
    start = spark.createDataFrame(roads[["device", "e1", "n1", "e2", "n2", "heading"]])
    got = own(streamed(closed(rows), lambda s: live.fused(s, start), 3)).sort_values(["device", "ts_ns", "event"], ignore_index=True)
    want = plain(pd.concat([roads.assign(ts_ns=BASE), rows], ignore_index=True), 10**5 * S).sort_values(["device", "ts_ns", "event"], ignore_index=True)
    assert want["matched"].any()
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_phone_axes_are_turned_by_the_rings_yaw(streamed):
    rng = np.random.default_rng(8)
    n = 700
    t = np.arange(1, n + 1) * S // 10
    v = 10 + 3 * np.sin(t / S)
    a = 3 * np.cos(t / S)
    imu = pd.DataFrame({"device": "a", "ts_ns": BASE + t, "kind": "imu", "yaw": 0.0, "acc": 6.0, "gyro": 0.9, "ax": a * math.cos(0.5) + rng.normal(0, 0.1, n), "ay": a * math.sin(0.5) + rng.normal(0, 0.1, n)})
    fix = pd.DataFrame({"device": "a", "ts_ns": BASE + t - 1, "kind": "fix", "east": 0.0, "north": 0.0, "speed": v, "psi": 0.0})
    rows = pd.concat([imu, fix], ignore_index=True).sort_values("ts_ns", ignore_index=True)
    got = own(streamed(closed(rows), live.fused)).query("event == 'yaw'")
    assert len(got) == 2 and got["yaw_deg"].between(math.degrees(0.5) - 5, math.degrees(0.5) + 5).all()


def test_watermarked_windows_and_bursts(streamed):
    start = pd.Timestamp("2024-01-01")
    minutes = (0, 5, 90, 500, 505, 2000, 4000)
    rows = pd.DataFrame({"device": "a", "at": [start + pd.Timedelta(minutes=k) for k in minutes], "value": np.arange(7.0)})
    got = streamed(rows, lambda s: live.tumbling(s, "at", "10 minutes", "1 hour", "device"), batches=1, mode="append")
    hours = pd.Series([r["start"] for r in got["window"]])
    assert sorted(zip((hours - start) // pd.Timedelta(hours=1), got["n"], got["mean_value"], strict=True)) == [(0, 2, 0.5), (1, 1, 2.0), (8, 2, 3.5), (33, 1, 5.0)]


@pytest.mark.parametrize("mode", ["complete", "update"])
def test_each_group_once_over_several_batches(streamed, mode):
    start = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"device": "a", "at": [start + pd.Timedelta(minutes=20 * k) for k in range(40)], "value": 1.0})
    got = streamed(rows, lambda s: live.tumbling(s, "at", "1 day", "1 hour", "device"), batches=5, mode=mode, order=np.random.default_rng(9).permutation(40), keys=("window", "device"))
    assert sorted(got["n"].tolist()) == [1] + [3] * 13


def test_bursts(streamed):
    start = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"device": "a", "at": [start + pd.Timedelta(minutes=k) for k in (0, 5, 90, 95, 5000)], "value": 1.0})
    got = streamed(rows, lambda s: live.bursts(s, "at", "30 minutes", "device", "10 minutes"), batches=3, mode="complete")
    assert sorted(got["n"].tolist()) == [1, 2, 2]


def test_a_run_goes_on_and_a_batch_again_changes_nothing(spark, tmp_path):
    """A second run takes only new files; a batch whose commit was lost is written to the same place."""
    live.use_state_store(spark)
    schema = "device string, ts_ns bigint, value double"

    def put(k, lo, hi):
        spark.createDataFrame([("a", t, 1.0) for t in range(lo, hi)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        sums = stream.groupBy("device").count()
        return live.run_to_table(sums, f"{tmp_path}/work", "complete").collect()

    put(0, 0, 10)
    put(1, 10, 25)
    assert [r["count"] for r in run()] == [25]
    last = max((tmp_path / "work/state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert [r["count"] for r in run()] == [25]
    put(2, 25, 30)
    assert [r["count"] for r in run()] == [30]


def test_the_tables_stream_is_the_plain_machines(spark):
    """q_stream_fusion's rows over a whole table against machines without a stream."""
    from waymark.plans import estimation

    sf = "/root/testdata/sf0.001"
    events = estimation.live_events(spark.read.parquet(f"{sf}/events.parquet")).toPandas()
    until = int(events["ts_ns"].max()) // 10**6 * 10**6 + 999
    want = plain(events[events["ts_ns"] <= until], until, outage_ns=6 * 3600 * S, expire_ns=30 * 24 * 3600 * S)
    got = estimation.q_stream_fusion(spark, sf).toPandas()
    assert len(got) == len(want) > 500 and {"lost", "restored"} <= set(want["event"])
    order = ["device", "ts_ns", "event", "mode", "east", "north"]
    for c in ("east", "north", "speed", "separation_m", "drift_pct"):
        want[c] = want[c].astype(float).round(6)
    a, b = (x.sort_values(order, ignore_index=True)[list(got.columns)] for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-6)
