"""The filter through many outages side by side: one step for all outages of a task that still have rows.

States are rows of an array, covariances a stack of matrices; the recurrence is that of fusion.Navigator and run_outage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

from waymark.operators.fusion import BF, BIASES, BL, BW, CALIBRATED_SIGMA, E, HEADING_SIGMA, N, NHC_SIGMA, POSITION, PSI, ROAD_GATE_M, ROAD_GATE_RAD, SPEED_BIAS, START_SIGMA, VE, VELOCITY, VETO_SPEED, VN, ZUPT_SIGMA, Noise, wrap
from waymark.operators.nearby import Boxes

#: Outages are worked on together up to so many rows, the longest one's length times their number.
CELLS = 500_000


class Filters:
    """States x (k, 8) and covariances p (k, 8, 8). Steps work on the first `live` of them, measurements on those of given numbers."""

    def __init__(self, start: np.ndarray, noise: Noise):
        e0, n0, v0, psi0, b_fwd, b_lat, b_yaw, calibrated = start.T
        self.x = np.stack([e0, n0, v0 * np.sin(psi0), v0 * np.cos(psi0), wrap(psi0), b_fwd, b_lat, b_yaw], axis=1)
        self.p = np.tile(np.diag(np.square(START_SIGMA)), (len(start), 1, 1))
        measured = np.flatnonzero(calibrated)
        for k, sigma in zip((BF, BL, BW), CALIBRATED_SIGMA, strict=True):
            self.p[measured, k, k] = sigma**2
        self.noise = noise

    def predict(self, live: int, fwd: np.ndarray, lat: np.ndarray, yaw: np.ndarray, dt: np.ndarray) -> None:
        x, p = self.x[:live], self.p[:live]
        s, c = np.sin(x[:, PSI]), np.cos(x[:, PSI])
        turn = np.stack([np.stack([s, -c], axis=1), np.stack([c, s], axis=1)], axis=1)
        acc = (turn @ np.stack([fwd - x[:, BF], lat - x[:, BL]], axis=1)[:, :, None])[:, :, 0]
        by_psi = np.stack([acc[:, 1], -acc[:, 0]], axis=1)
        half = dt * dt / 2
        jac = np.tile(np.eye(8), (live, 1, 1))
        for pair, reach in ((POSITION, half), (VELOCITY, dt)):
            jac[:, pair, PSI] = reach[:, None] * by_psi
            jac[:, pair, BIASES] = -reach[:, None, None] * turn
        jac[:, E, VE] = jac[:, N, VN] = dt
        jac[:, PSI, BW] = -dt
        x[:, POSITION] += x[:, VELOCITY] * dt[:, None] + half[:, None] * acc
        x[:, VELOCITY] += dt[:, None] * acc
        x[:, PSI] = wrap(x[:, PSI] + (yaw - x[:, BW]) * dt)
        n = self.noise
        spread = np.stack([n.acc * half] * 2 + [n.acc * dt] * 2 + [n.turn * dt] + [n.acc_bias * dt] * 2 + [n.turn_bias * dt], axis=1)
        p[:] = jac @ p @ jac.transpose(0, 2, 1)
        p[:, range(8), range(8)] += spread**2

    def _correct(self, at: np.ndarray, h: np.ndarray, residual: np.ndarray, sigma: float) -> None:
        """Measurements with Jacobians h (m, r, 8) and residuals (m, r)."""
        p = self.p[at]
        hp = h @ p
        gain = np.linalg.solve(hp @ h.transpose(0, 2, 1) + sigma**2 * np.eye(h.shape[1]), hp).transpose(0, 2, 1)
        rest = np.eye(8) - gain @ h
        x = self.x[at] + (gain @ residual[:, :, None])[:, :, 0]
        x[:, PSI] = wrap(x[:, PSI])
        self.x[at] = x
        self.p[at] = rest @ p @ rest.transpose(0, 2, 1) + sigma**2 * (gain @ gain.transpose(0, 2, 1))

    def _course(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        x = self.x[at]
        return np.sin(x[:, PSI]), np.cos(x[:, PSI]), x[:, VE], x[:, VN], np.zeros((len(at), 1, 8))

    def no_side_slip(self, at: np.ndarray, sigma: float = NHC_SIGMA) -> None:
        s, c, ve, vn, h = self._course(at)
        h[:, 0, VE], h[:, 0, VN], h[:, 0, PSI] = -c, s, ve * s + vn * c
        self._correct(at, h, (ve * c - vn * s)[:, None], sigma)

    def forward_speed(self, at: np.ndarray, speed: np.ndarray, sigma: float) -> None:
        s, c, ve, vn, h = self._course(at)
        h[:, 0, VE], h[:, 0, VN], h[:, 0, PSI] = s, c, ve * c - vn * s
        self._correct(at, h, (speed - (ve * s + vn * c))[:, None], sigma)

    def heading(self, at: np.ndarray, psi: np.ndarray, sigma: float = HEADING_SIGMA) -> None:
        h = np.zeros((len(at), 1, 8))
        h[:, 0, PSI] = 1.0
        self._correct(at, h, wrap(psi - self.x[at, PSI])[:, None], sigma)

    def stand_still(self, at: np.ndarray, sigma: float = ZUPT_SIGMA) -> None:
        h = np.tile(np.eye(8)[[VE, VN]], (len(at), 1, 1))
        self._correct(at, h, -self.x[at][:, [VE, VN]], sigma)


class Roads:
    """The roads of many outages, one list after the other, looked up at all their states at once."""

    def __init__(self, roads: Sequence[np.ndarray]):
        self.sizes = np.array([len(r) for r in roads], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.flat = np.concatenate([np.asarray(r, dtype=float).reshape(-1, 5) for r in roads]) if len(roads) else np.empty((0, 5))
        self.owner = np.repeat(np.arange(len(roads)), self.sizes)

    def headings(self, x: np.ndarray) -> np.ndarray:
        """For each of the first len(x) outages the heading of the nearest road within both gates, either way along it; NaN without one."""
        n = int(self.ends[len(x) - 1]) if len(x) else 0
        out = np.full(len(x), math.nan)
        if not n:
            return out
        owner, (e1, n1, e2, n2, along) = self.owner[:n], self.flat[:n].T
        east, north, psi = x[owner, E], x[owner, N], x[owner, PSI]
        de, dn = e2 - e1, n2 - n1
        square = de * de + dn * dn
        part = np.clip(((east - e1) * de + (north - n1) * dn) / np.where(square > 0, square, 1.0), 0.0, 1.0)
        away = np.hypot(east - e1 - part * de, north - n1 - part * dn)
        off = wrap(psi - along)
        back = np.abs(off) > math.pi / 2
        turn = np.where(back, math.pi - np.abs(off), np.abs(off))
        away[(turn > ROAD_GATE_RAD) | (away >= ROAD_GATE_M) | (square < 1e-6)] = np.inf
        order = np.lexsort((np.arange(n), away, owner))  # of equally near ones the first
        first = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        first = first[np.isfinite(away[first])]
        out[owner[first]] = np.where(back[first], (along[first] + math.pi) % (2 * math.pi), along[first])
        return out


class SharedRoads:
    """One list of roads for many outages, of which each knows those whose ways meet its box; searched a block of pairs at a time."""

    def __init__(self, boxes: Boxes, e: np.ndarray, n: np.ndarray, margin_m: float):
        self.boxes, self.e, self.n, self.margin = boxes, e, n, margin_m

    def of(self, group: np.ndarray) -> SharedRoads:
        return SharedRoads(self.boxes, self.e[group], self.n[group], self.margin)

    def headings(self, x: np.ndarray) -> np.ndarray:
        """As Roads.headings."""
        out = np.full(len(x), math.nan)
        if not len(self.boxes.roads):
            return out
        e1, n1, e2, n2, along = self.boxes.roads.T
        de, dn = e2 - e1, n2 - n1
        square = de * de + dn * dn
        for own in self.boxes.blocks(len(x)):
            e, n, (east, north, psi) = self.e[own], self.n[own], (x[own, c, None] for c in (E, N, PSI))
            known = np.repeat(self.boxes.ways(e - self.margin, e + self.margin, n - self.margin, n + self.margin), self.boxes.sizes, axis=1)
            part = np.clip(((east - e1) * de + (north - n1) * dn) / np.where(square > 0, square, 1.0), 0.0, 1.0)
            away = np.hypot(east - e1 - part * de, north - n1 - part * dn)
            off = wrap(psi - along)
            back = np.abs(off) > math.pi / 2
            turn = np.where(back, math.pi - np.abs(off), np.abs(off))
            away[~known | (turn > ROAD_GATE_RAD) | (away >= ROAD_GATE_M) | (square < 1e-6)] = np.inf
            k = away.argmin(axis=1)
            rows = np.arange(len(k))
            found = np.where(back[rows, k], (along[k] + math.pi) % (2 * math.pi), along[k])
            out[own] = np.where(np.isfinite(away[rows, k]), found, math.nan)
        return out


def _groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of outages, longest first, in groups of at most CELLS rows."""
    order = np.argsort(-sizes, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + max(1, CELLS // max(1, int(sizes[order[lo]])))
        yield order[lo:hi]
        lo = hi


def run_outages(signals: Sequence[Sequence[np.ndarray]], starts: Sequence[Sequence[float]], roads: Sequence[np.ndarray] | SharedRoads | None = None, speed_sigma: float = 1.8, noise: Noise | None = None) -> np.ndarray:
    """The end state of each outage, (k, 8): what run_outage gives for each. signals: for each outage an array for each signal."""
    out = np.empty((len(signals), 8))
    sizes = np.array([len(s[0]) for s in signals], dtype=np.int64)
    for group in _groups(sizes):
        own = [signals[k] for k in group]
        n = sizes[group]
        grid = np.full((len(own[0]), int(n[0]) if len(n) else 0, len(group)), math.nan)
        for k, columns in enumerate(own):
            grid[:, : n[k], k] = [np.asarray(c, dtype=float) for c in columns]
        start = np.array([starts[k] for k in group], dtype=float).reshape(-1, 8)
        filters, said = Filters(start, noise or Noise()), start[:, 2].copy()
        near = None if roads is None else roads.of(group) if isinstance(roads, SharedRoads) else Roads([roads[k] for k in group])
        for t in range(grid.shape[1]):
            live = int(np.searchsorted(-n, -t, side="left"))  # those with more than t rows
            fwd, lat, yaw, dt, still, road, speed = grid[:, t, :live]
            filters.predict(live, fwd, lat, yaw, np.where((dt > 0) & (dt <= 1.0), dt, 0.1))
            filters.no_side_slip(np.arange(live))
            if (t + 1) % 5 == 0:
                along = road if near is None else near.headings(filters.x[:live])
                if len(at := np.flatnonzero(~np.isnan(along))):
                    filters.heading(at, along[at])
            if len(at := np.flatnonzero((still != 0) & (said[:live] < VETO_SPEED))):
                filters.stand_still(at)
            if (t + 1) % 10 == 0 and t + 1 >= 20 and len(at := np.flatnonzero(~np.isnan(speed))):
                said[at] = np.maximum(0.0, np.maximum(0.0, speed[at]) + SPEED_BIAS)
                filters.forward_speed(at, said[at], speed_sigma)
        out[group] = filters.x
    return out
