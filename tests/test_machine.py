"""The live machine of one device: modes, yaw by block sums, biases, and its packed form, by plain state."""

import math

import numpy as np
import pytest

from waymark.operators.aggregates import yaw_alignment
from waymark.operators.fusion import matched_heading
from waymark.streaming import machine as m

S = m.SECOND
FIX = {"east": 10.0, "north": 20.0, "speed": 5.0, "psi": 0.0}
STILL = {"fwd": 0.0, "lat": 0.0, "yaw": 0.0, "acc": 0.1, "gyro": 0.01, "ax": math.nan, "ay": math.nan, "speed_ml": math.nan}


def new_machine(**limits):
    cells = {}
    return m.Machine(m.RoadCells(lambda c: cells.get(c, []), cells.__setitem__), **limits)


def play(events, until=0, own=None, repack=False):
    """Rows of a machine over events (seconds, kind, values)."""
    own, out = own or new_machine(), []
    for at, kind, values in events:
        out += own.take(int(at * S), kind, values)
        if repack and not own.idle:
            packed = own.pack()
            roads = own.roads
            own = m.Machine(roads, own.outage_ns, own.expire_ns)
            own.load(packed)
    return out + list(own.pass_time(int(until * S)))


#: Events (seconds, kind) and what follows: (seconds, mode, event).
CASES = {
    "nothing before the first fix": ([(1, "imu"), (2, "control"), (3, "imu")], 5, []),
    "a fix begins": ([(1, "fix")], 2, [(1, "GPS_ACTIVE", "fix")]),
    "silence begins an outage without any row": ([(1, "fix")], 5, [(1, "GPS_ACTIVE", "fix"), (4, "OUTAGE", "lost")]),
    "a fix at the deadline comes after it": ([(1, "fix"), (4, "fix")], 5, [(1, "GPS_ACTIVE", "fix"), (4, "OUTAGE", "lost"), (4, "GPS_ACTIVE", "fix")]),
    "a fix before it puts it off": ([(1, "fix"), (3, "fix")], 5, [(1, "GPS_ACTIVE", "fix"), (3, "GPS_ACTIVE", "fix")]),
    "a toggle begins an outage, samples move it": ([(1, "fix"), (2, "control"), (2.1, "imu")], 3, [(1, "GPS_ACTIVE", "fix"), (2, "OUTAGE", "lost"), (2.1, "OUTAGE", "imu")]),
    "fixes don't end a toggled outage": ([(1, "fix"), (2, "control"), (2.5, "fix"), (9, "imu")], 10, [(1, "GPS_ACTIVE", "fix"), (2, "OUTAGE", "lost"), (9, "OUTAGE", "imu")]),
    "a toggle ends it after 1.8 s": ([(1, "fix"), (2, "control"), (3, "control"), (4, "fix")], 6, [(1, "GPS_ACTIVE", "fix"), (2, "OUTAGE", "lost"), (3, "RESYNC", "resync"), (4.8, "GPS_ACTIVE", "restored")]),
    "samples go on while it resyncs, toggles don't": ([(1, "fix"), (2, "control"), (3, "control"), (3.5, "imu"), (4, "control"), (4.2, "fix")], 5, [(1, "GPS_ACTIVE", "fix"), (2, "OUTAGE", "lost"), (3, "RESYNC", "resync"), (3.5, "RESYNC", "imu"), (4.8, "GPS_ACTIVE", "restored")]),
    "without a fresh fix the outage goes on": ([(1, "fix"), (2, "control"), (5, "control"), (7, "imu"), (8, "fix")], 9, [(1, "GPS_ACTIVE", "fix"), (2, "OUTAGE", "lost"), (5, "RESYNC", "resync"), (6.8, "OUTAGE", "lost"), (7, "OUTAGE", "imu"), (8, "GPS_ACTIVE", "fix")]),
    "a toggle in an outage of silence": ([(1, "fix"), (5, "control"), (5.5, "fix")], 7, [(1, "GPS_ACTIVE", "fix"), (4, "OUTAGE", "lost"), (5, "RESYNC", "resync"), (6.8, "GPS_ACTIVE", "restored")]),
    "a silent device is forgotten": ([(1, "fix"), (200, "imu"), (201, "fix")], 202, [(1, "GPS_ACTIVE", "fix"), (4, "OUTAGE", "lost"), (101, "WAITING", "expired"), (201, "GPS_ACTIVE", "fix")]),
}


@pytest.mark.parametrize("repack", [False, True])
@pytest.mark.parametrize("name", CASES)
def test_modes(name, repack):
    events, until, want = CASES[name]
    values = {"fix": FIX, "imu": STILL, "control": {}}
    got = play([(t, k, values[k]) for t, k in events], until, new_machine(expire_ns=100 * S), repack)
    assert [(t, mode, event) for t, mode, event, *_ in got] == [(int(t * S), mode, event) for t, mode, event in want]


def test_restored_at_the_last_fix():
    later = FIX | {"east": 500.0}
    got = play([(1, "fix", FIX), (2, "control", {}), (3, "control", {}), (4, "fix", later)], 5)
    assert got[-1][2] == "restored" and got[-1][3] == 500.0


def test_drift_is_a_share_of_the_way():
    rough = STILL | {"acc": 6.0, "gyro": 0.5}
    got = play([(0, "fix", FIX), (0.1, "control", {}), *((0.1 * k, "imu", rough) for k in range(2, 60))])
    way, before = 0.0, (FIX["east"], FIX["north"])
    for r in got[2:]:
        way, before = way + math.dist(before, r[3:5]), r[3:5]
        assert r[7] == pytest.approx(math.dist(r[3:5], (FIX["east"], FIX["north"])))
        assert r[8] == pytest.approx(100 * r[7] / way if way > 1 else 0.0)
    assert way > 20


def test_roads_are_matched_at_the_state():
    rng = np.random.default_rng(5)
    roads = np.column_stack([rng.uniform(-300, 300, (60, 4)), np.zeros(60)])
    roads[:, 4] = np.arctan2(roads[:, 2] - roads[:, 0], roads[:, 3] - roads[:, 1])
    samples = [STILL | {"fwd": float(f), "yaw": float(w), "acc": 6.0, "gyro": 0.9} for f, w in zip(rng.normal(0, 1, 300), rng.normal(0, 0.2, 300), strict=True)]
    got = play([(0, "road", dict(zip(("e1", "n1", "e2", "n2", "heading"), r, strict=True))) for r in roads.tolist()] + [(1, "fix", FIX), (1.1, "control", {}), *((1.2 + 0.1 * k, "imu", s) for k, s in enumerate(samples))], repack=True)
    own = m.Estimator()
    own.start(*(FIX[c] for c in ("east", "north", "speed", "psi")))
    matched = 0
    for k, (s, r) in enumerate(zip(samples, [r for r in got if r[2] == "imu"], strict=True)):
        matched += own.step(*(s[c] for c in ("fwd", "lat", "yaw", "acc", "gyro")), 0.1, lambda e, n, psi: matched_heading(e, n, psi, roads))
        assert r[3] == pytest.approx(own.nav.x[0], abs=1e-6) and r[4] == pytest.approx(own.nav.x[1], abs=1e-6), k
    assert matched > 5


def plain_slopes(t, v):
    return np.r_[(v[1] - v[0]) / (t[1] - t[0]), (v[2:] - v[:-2]) / (t[2:] - t[:-2]), (v[-1] - v[-2]) / (t[-1] - t[-2])]


def test_yaw_ring_is_the_last_1200_rows(spark):
    rng = np.random.default_rng(6)
    n = 2100
    t = np.cumsum(rng.uniform(0.08, 0.12, n))
    v = np.abs(8 + np.cumsum(rng.normal(0, 0.1, n)))
    slope, yaw = np.gradient(v, t), np.radians(37.0)
    ax, ay = slope * np.cos(yaw) + rng.normal(0, 0.3, n), slope * np.sin(yaw) + rng.normal(0, 0.3, n)
    ring, windows, found = m.YawRing(), [], []
    for k in range(n):
        if ring.add(t[k], v[k], ax[k], ay[k]):
            lo = max(0, k + 1 - m.YAW_ROWS)
            g = plain_slopes(t[lo : k + 1], v[lo : k + 1])
            moving = v[lo : k + 1] > m.YAW_MOVING
            own = moving & (np.abs(g) > m.YAW_ACC)
            own = own if own.sum() >= m.YAW_ACC_LEAST else moving
            windows += [(len(found), *r) for r in np.column_stack([ax[lo : k + 1], ay[lo : k + 1], g])[own].tolist()]
            found.append(ring.yaw())
        ring = m.YawRing.unpack(ring.pack())
    assert len(found) == 7 and len(ring.blocks) == 4
    want = yaw_alignment(spark.createDataFrame(windows, "w int, ax double, ay double, g double"), "ax", "ay", "g", "w", least_rows=1).orderBy("w").collect()
    for r, (deg, corr) in zip(want, found, strict=True):
        assert r.mounting_yaw_deg == deg and r.alignment_corr == pytest.approx(corr, abs=1e-9)
    assert abs(found[-1][0] - 37) <= 3 and ring.trusted() is not None


def test_yaw_needs_moving_rows_and_speed():
    ring = m.YawRing()
    for k in range(300):
        ring.add(k * 0.1, 1.0, 0.1, 0.1)
    assert ring.yaw() is None and ring.trusted() is None


def test_biases_of_runs_of_still_rows():
    own = m.Estimator()
    rng = np.random.default_rng(7)
    rows = [(*rng.normal(0.2, 0.05, 3), bool(rng.random() < 0.9)) for _ in range(900)]
    for fwd, lat, yaw, still in rows:
        own.remember(fwd, lat, yaw, 0.1 if still else 9.0, 0.01)
    run, kept = 0, []
    for fwd, lat, yaw, still in rows[-m.BIAS_ROWS :]:
        run = run + 1 if still else 0
        if run >= m.STILL_RUN:
            kept.append((fwd, lat, yaw))
    assert len(kept) >= 50
    np.testing.assert_allclose(own.biases(), np.clip(np.mean(kept, axis=0), -np.array(m.BIAS_LIMITS), m.BIAS_LIMITS))
    assert m.Estimator().biases() is None
