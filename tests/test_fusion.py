import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.operators import fusion, joins, outage
from waymark.operators.fusion import Navigator, Noise, smooth_step
from waymark.plans.estimation import QUERIES
from waymark.plans.samples import samples
from waymark.streaming import machine as live
from waymark.streaming.machine import Estimator

# Inputs, and the states that the filter must reach from them.
INPUTS = [(1.2, 0.3, 0.05, 0.1), (0.8, -0.1, 0.02, 0.1), (1.5, 0.2, -0.03, 0.1), (0.9, 0.0, 0.01, 0.1), (1.1, -0.2, 0.04, 0.1)]
AFTER = {
    "predict": [101.04810255735578, 201.62443989666212, 2.2220832702638518, 3.4769899936702235, 0.504, 0.05, -0.03, 0.01],
    "nhc": [100.99292107860282, 201.65499865646484, 2.0188630385623414, 3.5893180152014117, 0.5101900925802947, 0.04999798686386575, -0.031118407347994193, 0.009966700112674184],
    "heading": [101.00293357616874, 201.6496917187192, 2.0559594194660917, 3.5692875644902564, 0.5207661050545762, 0.049998300174201225, -0.030944346301930718, 0.009914785071689466],
    "zupt": [100.44669324319638, 200.68303069321055, 0.006021307948003596, 0.00782288787831531, 0.5077058401236849, 0.06951379815871284, -0.03130385324773107, 0.00997281815551788],
    "speed": [100.9407290849787, 201.56082168552305, 1.826537312156562, 3.2422933573754547, 0.5100063853277672, 0.05188276905012206, -0.031125248826226, 0.009967039260600922],
}


def started():
    nav = Navigator.at(100, 200, 2, 3, 0.5, (0.05, -0.03, 0.01), Noise(4.0, math.radians(2.0), 1e-3, 1e-4))
    for row in INPUTS:
        nav.predict(*row)
    return nav


def test_filter_golden_states():
    nav = started()
    np.testing.assert_allclose(nav.x, AFTER["predict"], atol=1e-6)
    nav.no_side_slip(0.2)
    np.testing.assert_allclose(nav.x, AFTER["nhc"], atol=1e-6)
    nav.heading(0.55, math.radians(8.0))
    np.testing.assert_allclose(nav.x, AFTER["heading"], atol=1e-6)
    nav.stand_still(0.05)
    np.testing.assert_allclose(nav.x, AFTER["zupt"], atol=1e-6)
    nav = started()
    nav.no_side_slip(0.2)
    nav.forward_speed(2.5, 1.8)
    np.testing.assert_allclose(nav.x, AFTER["speed"], atol=1e-6)


def test_filter_fix():
    nav = Navigator.at(0, 0, 1, 1, 0.2, noise=Noise(4.0, math.radians(2.0), 1e-3, 1e-4))
    nav.predict(1, 0.5, 0.02, 0.1)
    nav.fix(5, 6, 1.5, 1.2)
    np.testing.assert_allclose(nav.x, [3.7096214448416465, 4.4409580123317545, 1.4054373681573846, 1.1842168306030538, 0.20291041017993194, -0.00039052681555045484, 0.0010002167201432024, 0.0], atol=1e-6)
    assert np.allclose(nav.p, nav.p.T) and (np.linalg.eigvalsh(nav.p) > 0).all()


def smoothed_plainly(fixes):
    """Anchors after each fix, from lists of whole runs of fixes that agree."""
    anchors, run = [], []
    for k, (e, n, acc) in enumerate(fixes):
        if k == 0:
            anchors.append((e, n))
            continue
        here, band = anchors[-1], max(4.0, acc if acc > 0 else 5.0)
        if math.dist((e, n), here) < band:
            run = []
        else:
            run = [*run, (e, n)] if run and math.dist((e, n), run[-1]) < 3 * band else [(e, n)]
        if len(run) >= 4:
            here, run = tuple(np.mean(run, axis=0)), []
        anchors.append(here)
    return anchors


@pytest.mark.parametrize("seed, spread", [(s, d) for s in range(5) for d in (1.0, 6.0, 30.0)])
def test_smoother_is_that_of_whole_runs(seed, spread):
    rng = np.random.default_rng(seed)
    path = rng.normal(0, spread, (150, 2)).cumsum(axis=0) * rng.integers(0, 2, (150, 1))  # walks, and returns to the start
    fixes = [(e, n, acc) for (e, n), acc in zip(path.tolist(), rng.uniform(-2, 12, 150).tolist(), strict=True)]
    state, got = None, []
    for fix in fixes:
        state = smooth_step(state, *fix)
        got.append(state[:2])
    np.testing.assert_allclose(got, smoothed_plainly(fixes), atol=1e-9)


def test_smoother_in_spark_is_the_same_fold(spark):
    rng = np.random.default_rng(2)
    fixes = pd.DataFrame({"session_id": np.repeat([1, 2], 60), "row_idx": list(range(60)) * 2, "east": rng.normal(0, 20, 120).cumsum(), "north": rng.normal(0, 20, 120).cumsum(), "accuracy": rng.uniform(-1, 9, 120)})
    got = fusion.smooth_fixes(spark.createDataFrame(fixes)).orderBy("session_id", "row_idx").toPandas()
    for s, own in fixes.groupby("session_id"):
        state, want = None, []
        for e, n, a in zip(own["east"], own["north"], own["accuracy"], strict=True):
            state = smooth_step(state, e, n, a)
            want.append(state[0])
        np.testing.assert_allclose(got.loc[got["session_id"] == s, "anchor_east"], want)


def test_complementary_filter_of_long_sessions(spark):
    rng = np.random.default_rng(3)
    n = 3000
    rows = pd.DataFrame({"session_id": np.repeat([1, 2], n), "row_idx": list(range(n)) * 2, "w": rng.normal(0, 0.3, 2 * n), "dt": 0.1, "m": rng.uniform(0, 6.28, 2 * n)})
    got = fusion.complementary_by_group(spark.createDataFrame(rows), "w", "dt", "m", 0.95, "session_id", "row_idx").orderBy("session_id", "row_idx").toPandas()
    for session, own in rows.groupby("session_id"):
        z = complex(math.cos(own["m"].iloc[0]), math.sin(own["m"].iloc[0]))
        want = [z]
        for w, m in own[["w", "m"]].iloc[1:].itertuples(index=False):
            z = 0.95 * z / abs(z) * complex(math.cos(w * 0.1), math.sin(w * 0.1)) + 0.05 * complex(math.cos(m), math.sin(m))
            want.append(z)
        psi = got.loc[got["session_id"] == session, "heading"]
        np.testing.assert_allclose(np.exp(1j * psi.to_numpy()), np.array(want) / np.abs(want), atol=1e-9)


def test_alpha_sweep_takes_whole_sessions(spark):
    rows = samples(spark, "/root/testdata/sf0.001").toPandas().sort_values(["session_id", "row_idx"])
    got = {(r.alpha, r.session_id): r.mean_heading for r in QUERIES["q_alpha_sweep"](spark, "/root/testdata/sf0.001").collect()}
    assert rows.groupby("session_id").size().max() > 40 and len(got) == 4 * rows["session_id"].nunique()
    for session, own in rows.groupby("session_id"):
        for alpha in (1.0, 0.95, 0.97, 0.98):
            track = [math.radians(own["k"].iloc[0]) % (2 * math.pi)]
            for w, dt, k in own[["w", "dt", "k"]].iloc[1:].itertuples(index=False):
                moved, m = track[-1] + w * dt, math.radians(k)
                track.append(math.atan2(alpha * math.sin(moved) + (1 - alpha) * math.sin(m), alpha * math.cos(moved) + (1 - alpha) * math.cos(m)) % (2 * math.pi))
            assert got[alpha, session] == pytest.approx(np.mean(track), abs=2e-6)


class Spy(Navigator):
    """The filter, and a note of each measurement that it is given."""

    def __getattribute__(self, name):
        if name in ("heading", "stand_still", "forward_speed"):
            object.__getattribute__(self, "__dict__").setdefault("notes", []).append(name)
        return super().__getattribute__(name)


@pytest.mark.parametrize("seed", range(6))
def test_live_measurements_follow_from_the_whole_history(seed):
    """Which measurements each row gives, by pandas over all rows so far, against the estimator's own buffers and counters."""
    rng = np.random.default_rng(seed)
    n = 800
    level = np.repeat(rng.choice([0.02, 3.0, 8.0], n // 40), 40)  # parked, a hum, driving
    rows = pd.DataFrame({"acc": level * rng.uniform(0.9, 1.1, n), "gyro": level / 30 * rng.uniform(0.9, 1.1, n), "speed": rng.choice([0.3, 4.0], n), "road": rng.uniform(-3, 3, n)})
    own = Estimator()
    own.start(0, 0, 2.5, 0.3)
    own.nav = Spy(own.nav.x, own.nav.p)
    got = []
    for r in rows.itertuples(index=False):
        own.nav.__dict__["notes"] = []
        own.step(0.2, 0.0, 0.02, r.acc, r.gyro, 0.1, lambda *at, road=r.road: road, r.speed)
        got.append(list(own.nav.__dict__["notes"]))
    still = (rows["acc"] < live.ACC_STILL) & (rows["gyro"] < live.GYRO_STILL)
    wide = rows[["acc", "gyro"]].rolling(live.LOCK_ROWS)
    mean, var = wide.mean(), wide.var(ddof=0)
    locked = (mean["acc"] < live.ACC_STILL) & (mean["gyro"] < live.GYRO_STILL) & (var["acc"] < live.LOCK_ACC_VAR) & (var["gyro"] < live.LOCK_GYRO_VAR)
    streak = still.groupby((~still).cumsum()).cumsum()
    fed, said, want = (~locked).cumsum(), 2.5, []
    for k in range(n):
        notes = ["heading"] if (k + 1) % live.ROAD_EVERY == 0 else []
        if locked[k]:
            notes, said = [*notes, "stand_still"], 0.0
        else:
            notes += ["stand_still"] if streak[k] >= live.STILL_RUN and said < live.VETO_SPEED else []
            if (k + 1) % live.SPEED_EVERY == 0 and fed[k] >= live.SPEED_ROWS:
                notes, said = [*notes, "forward_speed"], rows["speed"][k]
        want.append(notes)
    assert got == want
    assert {"heading", "stand_still", "forward_speed"} == {x for row in got for x in row}


def test_live_bias_from_history():
    own = Estimator()
    for _ in range(60):
        own.remember(0.30, -0.10, 0.02, 0.1, 0.01)
    own.start(0, 0, 0, 0)
    np.testing.assert_allclose(own.nav.x[5:], [0.30, -0.10, 0.02])
    packed = Estimator.unpack(own.pack())
    np.testing.assert_allclose(packed.nav.x, own.nav.x)
    assert packed.history == own.history


def nearest_road(x, y, psi, roads):
    """One road at a time, by angles as complex numbers."""
    best, away = math.nan, 50.0
    for e1, n1, e2, n2, along in roads:
        a, b, p = complex(e1, n1), complex(e2, n2), complex(x, y)
        if abs(b - a) ** 2 < 1e-6:
            continue
        part = ((p - a) * (b - a).conjugate()).real / abs(b - a) ** 2
        d = abs(p - a - min(1.0, max(0.0, part)) * (b - a))
        cos = math.cos(psi - along)
        if d < away and math.acos(min(1.0, abs(cos))) <= math.radians(45):
            best, away = (along if cos >= 0 else along + math.pi), d
    return best


def test_road_at_the_state_is_the_nearest_within_the_gates():
    rng = np.random.default_rng(7)
    found = 0
    for _ in range(400):
        ends = rng.uniform(-80, 80, (rng.integers(0, 9), 4))
        ends[: len(ends) // 4, 2:] = ends[: len(ends) // 4, :2]  # some have no length
        roads = np.column_stack([ends, np.arctan2(ends[:, 2] - ends[:, 0], ends[:, 3] - ends[:, 1])])
        x, y, psi = *rng.uniform(-60, 60, 2), rng.uniform(-7, 7)
        got, want = fusion.matched_heading(x, y, psi, roads), nearest_road(x, y, psi, roads)
        assert math.isnan(got) == math.isnan(want)
        if not math.isnan(want):
            found += 1
            assert abs(fusion.wrap(got - want)) < 1e-9
    assert found > 100


def test_outages_with_roads_and_biases_are_the_plain_loop(spark):
    """Whole outages, of one session that has most rows: roads and starts are found by Spark, states by a loop over pandas."""
    rng = np.random.default_rng(8)
    sizes = {1: 900, 2: 120, 3: 40}
    rows = pd.concat(
        pd.DataFrame({"session_id": s, "row_idx": range(n), "t": np.arange(n) * 0.1, "fwd": rng.normal(0.1, 0.4, n), "lat": rng.normal(0, 0.2, n), "yaw": rng.normal(0.01, 0.1, n), "dt": rng.choice([0.1, 0.12, 0.0, 3.0], n, p=[0.5, 0.4, 0.05, 0.05]),
                      "still": rng.random(n) < 0.6, "speed": np.where(rng.random(n) < 0.3, np.nan, rng.uniform(-1, 9, n)), "east": rng.normal(0, 2, n).cumsum(), "north": rng.normal(0, 2, n).cumsum()})
        for s, n in sizes.items()
    )
    starts = [(1, 100, 400), (1, 150, 260), (1, 700, 899), (2, 5, 90), (3, 3, 39)]
    own = rows.set_index(["session_id", "row_idx"])
    outages = pd.DataFrame([{"session_id": s, "outage_id": a, "start_row": a, "end_row": b, "t_start": own.t[s, a], "e0": own.east[s, a], "n0": own.north[s, a], "v0": 4.0, "psi0": 0.4} for s, a, b in starts])
    ends = rng.uniform(-300, 300, (120, 2))
    roads = pd.DataFrame({"way_id": np.arange(120) // 4, "seg_idx": np.arange(120) % 4, "e1": ends[:, 0], "n1": ends[:, 1], "e2": ends[:, 0] + rng.uniform(-90, 90, 120), "n2": ends[:, 1] + rng.uniform(-90, 90, 120)})
    roads["heading"] = np.arctan2(roads.e2 - roads.e1, roads.n2 - roads.n1)
    samples_df, roads_df = spark.createDataFrame(rows), spark.createDataFrame(roads)
    begun = outage.biases_before(samples_df, spark.createDataFrame(outages), "t", "still", window=20.0, least=50)
    boxes = begun.selectExpr("session_id", "outage_id", "e0 - 10 AS e_lo", "e0 + 10 AS e_hi", "n0 AS n_lo", "n0 AS n_hi")
    near = joins.roads_near(boxes, roads_df, ["session_id", "outage_id"], margin_m=60.0, cell_m=35.0)
    inside = joins.range_join(samples_df, begun, "session_id", "row_idx", "start_row", "end_row", 64)
    got = {(r.session_id, r.outage_id): r for r in fusion.fuse_outages(inside, near).collect()}
    assert len(got) == len(starts)
    corrected = 0
    for o in outages.itertuples(index=False):
        lo, hi = np.array([o.e0 - 70, o.n0 - 60]), np.array([o.e0 + 70, o.n0 + 60])
        pairs = roads[["e1", "n1", "e2", "n2"]].to_numpy().reshape(-1, 2, 2)
        meets = (pairs.min(axis=1) <= hi).all(axis=1) & (pairs.max(axis=1) >= lo).all(axis=1)
        mine = roads[roads.way_id.isin(roads.way_id[meets])][["e1", "n1", "e2", "n2", "heading"]].to_numpy().tolist()
        session = rows[rows.session_id == o.session_id]
        quiet = session[session.still & session.t.between(o.t_start - 20.0, o.t_start)][["fwd", "lat", "yaw"]]
        enough = len(quiet) >= 50
        b = np.clip(quiet.mean(), [-1, -1, -0.1], [1, 1, 0.1]) if enough else np.zeros(3)
        nav = Navigator.at(o.e0, o.n0, 4 * math.sin(0.4), 4 * math.cos(0.4), 0.4, b)
        if enough:
            nav.p[5, 5] = nav.p[6, 6] = 0.15**2
            nav.p[7, 7] = math.radians(0.2) ** 2
        said = 4.0
        inner = session[(session.row_idx > o.start_row) & (session.row_idx <= o.end_row)]
        for r in inner.itertuples(index=False):
            k = r.row_idx - o.start_row
            nav.predict(r.fwd, r.lat, r.yaw, r.dt if 0 < r.dt <= 1 else 0.1)
            nav.no_side_slip()
            road = nearest_road(nav.x[0], nav.x[1], nav.x[4], mine) if k % 5 == 0 else math.nan
            if not math.isnan(road):
                nav.heading(road)
                corrected += 1
            if r.still and said < 1.0:
                nav.stand_still()
            if k >= 20 and k % 10 == 0 and not math.isnan(r.speed):
                said = max(r.speed, 0.0) + 0.957
                nav.forward_speed(said, 1.8)
        found = got[o.session_id, o.outage_id]
        assert found.n_rows == len(inner)
        np.testing.assert_allclose([found[c] for c in ("east", "north", "ve", "vn", "psi", "b_fwd", "b_lat", "b_yaw")], nav.x, atol=1e-6)
    assert corrected > 10


def test_outages_without_roads_rows_or_values(spark):
    """No road near, null signals and an empty table: defined results."""
    rows = pd.DataFrame({"session_id": 1, "outage_id": 2, "row_idx": range(30), "fwd": 0.1, "lat": 0.0, "yaw": 0.0, "dt": 0.1, "speed": np.nan, "e0": 1.0, "n0": 2.0, "v0": 3.0, "psi0": 0.0, "b_fwd": 0.0, "b_lat": 0.0, "b_yaw": 0.0})
    df = spark.createDataFrame(rows).withColumn("still", F.lit(None).cast("boolean"))
    none = spark.createDataFrame([], "session_id bigint, outage_id bigint, roads array<struct<way_id bigint, seg_idx bigint, e1 double, n1 double, e2 double, n2 double, heading double>>")
    a, b = fusion.fuse_outages(df, none).first(), fusion.fuse_outages(df).first()
    assert a == b and a.n_rows == 30 and a.north == pytest.approx(2 + 3 * 3 + 0.1 * 9 / 2, abs=0.2)
    assert fusion.fuse_outages(df.limit(0), none).count() == 0


def test_outages_side_by_side_are_each_alone():
    """Outages of many lengths, with roads, still rows, missing speeds and uneven steps: equal to one after the other, and much faster."""
    import time

    from waymark.operators import filter_steps

    rng = np.random.default_rng(21)
    signals, starts, roads = [], [], []
    for k in range(300):
        n = int(rng.integers(0, 90))
        speed = np.where(rng.random(n) < 0.3, np.nan, rng.uniform(-1, 9, n))
        signals.append([rng.normal(0, 1, n), rng.normal(0, 0.3, n), rng.normal(0, 0.2, n), rng.choice([0.1, 0.1, 0.5, 0.0, 3.0], n), rng.random(n) < 0.3, np.where(rng.random(n) < 0.5, np.nan, rng.uniform(-3, 3, n)), speed])
        starts.append([*rng.normal(0, 5, 2), rng.uniform(0, 10), rng.uniform(-9, 9), *rng.normal(0, 0.05, 3), float(k % 2)])
        m = int(rng.integers(0, 12))
        ends = rng.uniform(-60, 60, (m, 4))
        roads.append(np.column_stack([ends, np.arctan2(ends[:, 2] - ends[:, 0], ends[:, 3] - ends[:, 1])]))
    for near in (None, roads):
        began = time.perf_counter()
        want = np.array([fusion.run_outage(s, x, None if near is None else near[k]).x for k, (s, x) in enumerate(zip(signals, starts, strict=True))])
        alone = time.perf_counter() - began
        began = time.perf_counter()
        got = filter_steps.run_outages(signals, starts, near)
        together = time.perf_counter() - began
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)
        assert together * 3 < alone, (together, alone)
    assert filter_steps.run_outages([], []).shape == (0, 8)
