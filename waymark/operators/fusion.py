"""State estimation: an 8-state Kalman filter, the complementary filter and the display smoother.

The filter's recurrence is nonlinear, so within an outage it is a loop; outages are groups of their own and run apart.
State: east, north, their velocities, heading, biases of forward and lateral acceleration and of yaw rate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators import nearby
from waymark.operators.windows import dealt

E, N, VE, VN, PSI, BF, BL, BW = range(8)
POSITION, VELOCITY, BIASES = slice(E, N + 1), slice(VE, VN + 1), slice(BF, BL + 1)
#: Standard deviations of the first state, as fixed values.
START_SIGMA = (5.0, 5.0, 0.5, 0.5, math.radians(5.0), 0.1, 0.1, math.radians(0.5))
NHC_SIGMA, ZUPT_SIGMA, HEADING_SIGMA = 0.2, 0.05, math.radians(8.0)
#: What the speed model is short of, on average.
SPEED_BIAS = 0.957
VETO_SPEED = 1.0


@dataclass(frozen=True)
class Noise:
    """Standard deviations of the process for each second."""

    acc: float = 4.0
    turn: float = math.radians(2.0)
    acc_bias: float = 1e-3
    turn_bias: float = 1e-4


def wrap(angle: float) -> float:
    return (angle + math.pi) % (2 * math.pi) - math.pi


@dataclass
class Navigator:
    """The filter: a state x, its covariance p, and the steps that change them."""

    x: np.ndarray
    p: np.ndarray = field(default_factory=lambda: np.diag(np.square(START_SIGMA)))
    noise: Noise = Noise()

    @classmethod
    def at(cls, east: float, north: float, ve: float, vn: float, psi: float, biases: Sequence[float] = (0.0, 0.0, 0.0), noise: Noise | None = None) -> Navigator:
        return cls(np.array([east, north, ve, vn, psi, *biases], dtype=float), noise=noise or Noise())

    def predict(self, fwd: float, lat: float, yaw: float, dt: float) -> None:
        """Constant acceleration over dt, turned from the vehicle into east and north; the Jacobian has the same blocks."""
        turn = np.array([[math.sin(self.x[PSI]), -math.cos(self.x[PSI])], [math.cos(self.x[PSI]), math.sin(self.x[PSI])]])
        own = np.array([fwd - self.x[BF], lat - self.x[BL]])
        acc = turn @ own
        by_psi = np.array([acc[1], -acc[0]])  # d(acc)/d(psi): a quarter turn
        lever = (dt * dt / 2, dt)  # of position and of velocity
        jac = np.eye(8)
        for pair, reach in ((POSITION, lever[0]), (VELOCITY, lever[1])):
            jac[pair, PSI] = reach * by_psi
            jac[pair, BIASES] = -reach * turn
        jac[E, VE] = jac[N, VN] = dt
        jac[PSI, BW] = -dt
        self.x[POSITION] += self.x[VELOCITY] * dt + lever[0] * acc
        self.x[VELOCITY] += dt * acc
        self.x[PSI] = wrap(self.x[PSI] + (yaw - self.x[BW]) * dt)
        n = self.noise
        spread = np.array([n.acc * lever[0]] * 2 + [n.acc * dt] * 2 + [n.turn * dt] + [n.acc_bias * dt] * 2 + [n.turn_bias * dt])
        self.p = jac @ self.p @ jac.T + np.diag(spread**2)

    def correct(self, h: np.ndarray, residual: np.ndarray, sigma: Sequence[float]) -> None:
        """A measurement with Jacobian h; the covariance in Joseph's form, which stays symmetric and positive."""
        r = np.diag(np.square(sigma))
        gain = np.linalg.solve(h @ self.p @ h.T + r, h @ self.p).T
        rest = np.eye(8) - gain @ h
        self.x = self.x + gain @ residual
        self.x[PSI] = wrap(self.x[PSI])
        self.p = rest @ self.p @ rest.T + gain @ r @ gain.T

    def _row(self, **parts: float) -> np.ndarray:
        h = np.zeros((1, 8))
        for name, value in parts.items():
            h[0, {"ve": VE, "vn": VN, "psi": PSI}[name]] = value
        return h

    def fix(self, east: float, north: float, ve: float, vn: float, pos_sigma: float = 3.0, vel_sigma: float = 0.3) -> None:
        self.correct(np.eye(8)[:4], np.array([east, north, ve, vn]) - self.x[:4], (pos_sigma, pos_sigma, vel_sigma, vel_sigma))

    def forward_speed(self, speed: float, sigma: float) -> None:
        s, c = math.sin(self.x[PSI]), math.cos(self.x[PSI])
        ve, vn = self.x[VE], self.x[VN]
        self.correct(self._row(ve=s, vn=c, psi=ve * c - vn * s), np.array([speed - (ve * s + vn * c)]), (sigma,))

    def no_side_slip(self, sigma: float = NHC_SIGMA) -> None:
        s, c = math.sin(self.x[PSI]), math.cos(self.x[PSI])
        ve, vn = self.x[VE], self.x[VN]
        self.correct(self._row(ve=-c, vn=s, psi=ve * s + vn * c), np.array([ve * c - vn * s]), (sigma,))

    def heading(self, psi: float, sigma: float = HEADING_SIGMA) -> None:
        self.correct(self._row(psi=1.0), np.array([wrap(psi - self.x[PSI])]), (sigma,))

    def stand_still(self, sigma: float = ZUPT_SIGMA) -> None:
        self.correct(np.eye(8)[[VE, VN]], -self.x[[VE, VN]], (sigma, sigma))


#: Of roads matched at the filter's own state, as fixed values: nearer than this, and within this turn either way.
ROAD_GATE_M, ROAD_GATE_RAD = 50.0, math.radians(45.0)
#: Standard deviations of biases (forward, lateral, yaw rate) that were measured before the outage, as fixed values.
CALIBRATED_SIGMA = (0.15, 0.15, math.radians(0.2))
SIGNALS = ("fwd", "lat", "yaw", "dt", "still", "road_heading", "speed")
START = ("e0", "n0", "v0", "psi0", "b_fwd", "b_lat", "b_yaw", "calibrated")
ROADS = ("e1", "n1", "e2", "n2", "heading")


def matched_heading(east: float, north: float, psi: float, roads: np.ndarray) -> float:
    """The heading, either way along it, of the nearest of the roads (rows of ROADS) within both gates; NaN if there's none."""
    if not len(roads):
        return math.nan
    e1, n1, e2, n2, along = roads.T
    de, dn = e2 - e1, n2 - n1
    square = de * de + dn * dn
    part = np.clip(((east - e1) * de + (north - n1) * dn) / np.where(square > 0, square, 1.0), 0.0, 1.0)
    away = np.hypot(east - e1 - part * de, north - n1 - part * dn)
    off = wrap(psi - along)  # works on arrays too
    back = np.abs(off) > math.pi / 2
    turn = np.where(back, math.pi - np.abs(off), np.abs(off))
    away[(turn > ROAD_GATE_RAD) | (away >= ROAD_GATE_M) | (square < 1e-6)] = np.inf
    k = int(np.argmin(away))
    return math.nan if np.isinf(away[k]) else float((along[k] + math.pi) % (2 * math.pi) if back[k] else along[k])


def run_outage(signals: Sequence[np.ndarray], start: Sequence[float], roads: np.ndarray | None = None, speed_sigma: float = 1.8, noise: Noise | None = None) -> Navigator:
    """The filter over one outage's rows, in order: an array for each of SIGNALS (NaN where there's no road or predicted speed).

    start has the values of START. Each row predicts and forbids side slip; every 5th takes a road's heading: that of its own
    column or, with roads, of the road that matches the filter's state there; a still row stops the vehicle unless the speed
    model says that it moves; every 10th from the 20th takes the model's speed. Calibrated biases start with their own spread.
    """
    e0, n0, v0, psi0, *biases, calibrated = start
    nav = Navigator.at(e0, n0, v0 * math.sin(psi0), v0 * math.cos(psi0), wrap(psi0), biases, noise)
    if calibrated:
        nav.p[(BF, BL, BW), (BF, BL, BW)] = np.square(CALIBRATED_SIGMA)
    said = v0
    columns = (np.asarray(c, dtype=float).tolist() for c in signals)
    for k, (fwd, lat, yaw, dt, still, road, speed) in enumerate(zip(*columns, strict=True), start=1):
        nav.predict(fwd, lat, yaw, dt if 0 < dt <= 1.0 else 0.1)
        nav.no_side_slip()
        if k % 5 == 0:
            if roads is not None:
                road = matched_heading(nav.x[E], nav.x[N], nav.x[PSI], roads)
            if not math.isnan(road):
                nav.heading(road)
        if still and said < VETO_SPEED:
            nav.stand_still()
        if k % 10 == 0 and k >= 20 and not math.isnan(speed):
            said = max(0.0, max(0.0, speed) + SPEED_BIAS)
            nav.forward_speed(said, speed_sigma)
    return nav


def _outage_rows(samples: DataFrame) -> DataFrame:
    """A row for each outage: an array for each of SIGNALS by row_idx, and start. Null signals count as NaN; a null still or calibrated is false."""
    keys = ["session_id", "outage_id"]
    given = samples.columns
    value = lambda c: F.col(c).cast("double") if c in given else F.lit(0.0 if c == "calibrated" else math.nan)
    flat = samples.select(*keys, "row_idx", *(F.coalesce(value(c), F.lit(0.0 if c in ("still", "calibrated") else math.nan)).alias(c) for c in (*SIGNALS, *START)))
    rows = flat.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row_idx", *SIGNALS))).alias("_rows"), F.min_by(F.array(*START), "row_idx").alias("start"))
    return rows.select(*keys, "start", *(F.col(f"_rows.{c}").alias(c) for c in SIGNALS))


STATES = ("east", "north", "ve", "vn", "psi", "b_fwd", "b_lat", "b_yaw")


def fuse_outages(samples: DataFrame, roads: DataFrame | None = None, speed_sigma: float = 1.8) -> DataFrame:
    """The filter's end state of each outage. samples: session_id, outage_id, row_idx and the columns SIGNALS and START.

    roads: (session_id, outage_id, roads: array of ROADS) from joins.roads_near; with it, road_heading isn't needed. An outage is
    a row of arrays, so a session's outages run apart, whatever share of all rows it holds; those of a batch step side by side. Null signals count as NaN; a null
    still or calibrated is false.
    """
    keys = ["session_id", "outage_id"]
    rows = _outage_rows(samples)
    if roads is not None:
        own = roads.select(*keys, *(F.col(f"roads.{c}").alias(f"_{c}") for c in ROADS))
        none = F.array().cast("array<double>")
        rows = rows.join(own, keys, "left").withColumns({f"_{c}": F.coalesce(f"_{c}", none) for c in ROADS})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from waymark.operators.filter_steps import run_outages  # which is built on this module

        for batch in batches:
            near = [np.array(r, dtype=float).T.reshape(-1, len(ROADS)) for r in zip(*(batch[f"_{c}"] for c in ROADS), strict=True)] if roads_given else None
            states = run_outages(list(zip(*(batch[c] for c in SIGNALS), strict=True)), [list(x) for x in batch["start"]], near, speed_sigma)
            yield pd.DataFrame({"session_id": batch["session_id"], "outage_id": batch["outage_id"], "n_rows": batch["fwd"].map(len), **dict(zip(STATES, states.T, strict=True))})

    roads_given = roads is not None
    kinds = dict(samples.dtypes)
    schema = f"session_id {kinds['session_id']}, outage_id {kinds['outage_id']}, n_rows bigint, " + ", ".join(f"{c} double" for c in STATES)
    return rows.mapInPandas(run, schema)


def fuse_outages_by_cell(samples: DataFrame, segments: DataFrame, margin_m: float = 1000.0, cell_m: float = 1000.0, speed_sigma: float = 1.8) -> DataFrame:
    """fuse_outages with the roads that joins.roads_near lists for the start of each outage, grown by the margin; no outage has a list of its own.

    Outages that start in one cell share its list of roads (way_id, seg_idx and ROADS), and each looks up those of its own box.
    """
    rows = _outage_rows(samples)
    chunks = nearby.by_cell(rows, ["session_id", "outage_id"], F.get("start", F.lit(0)), F.get("start", F.lit(1)), cell_m)

    def run(points: pa.StructArray, near: pa.StructArray) -> list[pa.Array]:
        from waymark.operators.filter_steps import SharedRoads, run_outages  # which is built on this module

        column = lambda c: points.field(points.type.get_field_index(c))
        start = np.stack(column("start").to_numpy(zero_copy_only=False))
        shared = SharedRoads(nearby.Boxes(near), start[:, START.index("e0")], start[:, START.index("n0")], margin_m)
        signals = [column(c).to_numpy(zero_copy_only=False) for c in SIGNALS]
        states = run_outages(list(zip(*signals, strict=True)), list(start), shared, speed_sigma)
        return [pa.array([len(s) for s in signals[0]], pa.int64()), *(pa.array(c) for c in states.T)]

    kept = [f for f in rows.schema if f.name in ("session_id", "outage_id")]
    return nearby.search(chunks, nearby.ways_of_cells(segments, cell_m, margin_m), kept, "n_rows bigint, " + ", ".join(f"{c} double" for c in STATES), run)


def _headings(w: np.ndarray, dt: np.ndarray, m: np.ndarray, alpha: float) -> np.ndarray:
    """psi of each row, in [0, 2 pi): atan2 of alpha * (psi + yaw dt) and (1 - alpha) * reference; the first row has the reference."""
    out = np.empty(len(m))
    psi = out[0] = m[0] % (2 * math.pi)
    for k, (turn, ref) in enumerate(zip((w * dt)[1:].tolist(), m[1:].tolist(), strict=True), 1):
        moved = psi + turn
        psi = math.atan2(alpha * math.sin(moved) + (1 - alpha) * math.sin(ref), alpha * math.cos(moved) + (1 - alpha) * math.cos(ref)) % (2 * math.pi)
        out[k] = psi
    return out


def complementary_by_group(rows: DataFrame, yaw: str, dt: str, reference: str, alpha: float | str, by: str | Sequence[str], order: str) -> DataFrame:
    """The complementary filter's headings, a group of by at a time. alpha is a number or the name of a column of by."""
    keys = [by] if isinstance(by, str) else list(by)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        own = float(group[alpha].iloc[0]) if isinstance(alpha, str) else alpha
        out = _headings(*(group[c].to_numpy(dtype=float) for c in (yaw, dt, reference)), own)
        return pd.DataFrame({**{c: group[c] for c in keys}, order: group[order], "heading": out})

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, order])
    return dealt(rows.select(*keys, order, yaw, dt, reference), keys[0]).groupBy(*keys).applyInPandas(run, f"{schema}, heading double")


def alpha_sweep(rows: DataFrame, yaw: str, dt: str, reference: str, alphas: Sequence[float], by: str, order: str) -> DataFrame:
    """(alpha, by, mean_heading): the mean of the filter's headings for each weight. A group is read once for all weights."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        signals = [group[c].to_numpy(dtype=float) for c in (yaw, dt, reference)]
        return pd.DataFrame({"alpha": list(alphas), by: group[by].iloc[0], "mean_heading": [_headings(*signals, a).mean() for a in alphas]})

    kind = dict(rows.dtypes)[by]
    return dealt(rows.select(by, order, yaw, dt, reference), by).groupBy(by).applyInPandas(run, f"alpha double, {by} {kind}, mean_heading double")


#: Of the display smoother, as fixed values: least dead-band and default accuracy in metres, fixes that must agree, and how near.
SMOOTHER = {"least": 4.0, "default": 5.0, "agree": 4, "reach": 3.0}


def smooth_step(state: tuple | None, east: float, north: float, accuracy: float) -> tuple:
    """(anchor east, north, pending east, north, count, sums) after a fix.

    Fixes within the dead-band hold the anchor; beyond it, fixes that agree with each other in a row move it to their mean.
    """
    if state is None:
        return (east, north, 0.0, 0.0, 0, 0.0, 0.0)
    ae, an, pe, pn, count, se, sn = state
    band = max(accuracy if accuracy > 0 else SMOOTHER["default"], SMOOTHER["least"])
    if math.hypot(east - ae, north - an) < band:
        return (ae, an, 0.0, 0.0, 0, 0.0, 0.0)
    agrees = count > 0 and math.hypot(east - pe, north - pn) < band * SMOOTHER["reach"]
    count, se, sn = (count + 1, se + east, sn + north) if agrees else (1, east, north)
    if agrees and count >= SMOOTHER["agree"]:
        return (se / count, sn / count, 0.0, 0.0, 0, 0.0, 0.0)
    return (ae, an, east, north, count, se, sn)


def smooth_fixes(fixes: DataFrame, by: str = "session_id", order: str = "row_idx") -> DataFrame:
    """The displayed position after each fix (east, north, accuracy)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        state, out = None, []
        for e, n, acc in zip(group["east"], group["north"], group["accuracy"], strict=True):
            state = smooth_step(state, e, n, acc)
            out.append(state[:2])
        anchors = np.array(out).reshape(-1, 2)
        return pd.DataFrame({by: group[by], order: group[order], "anchor_east": anchors[:, 0], "anchor_north": anchors[:, 1]})

    kinds = dict(fixes.dtypes)
    return dealt(fixes.select(by, order, "east", "north", "accuracy"), by).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, anchor_east double, anchor_north double")
