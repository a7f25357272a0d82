"""The live path of one device as plain state: modes, the estimator, roads by cell, and the mounting yaw's ring of sums.

Nothing here knows of streams: a Machine takes events in the order of their time, and live.py gives them to it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

from waymark.operators.fusion import BF, BL, BW, CALIBRATED_SIGMA, NHC_SIGMA, ROAD_GATE_M, VETO_SPEED, ZUPT_SIGMA, Navigator, matched_heading

SECOND = 1_000_000_000
#: Of the live estimator, as fixed values.
ACC_STILL, GYRO_STILL, STILL_RUN = 5.389, 0.753, 8
ACC_BAND, YAW_BAND = 0.15, 0.02
LOCK_ROWS, LOCK_ACC_VAR, LOCK_GYRO_VAR, LOCK_SIGMA = 10, 0.04, 0.005, 0.02
SPEED_ROWS, SPEED_EVERY, ROAD_EVERY = 20, 10, 5
BIAS_ROWS, BIAS_LEAST, BIAS_LIMITS = 600, 50, (1.0, 1.0, 0.1)
YAW_ROWS, YAW_EVERY, YAW_MOVING, YAW_ACC, YAW_MOVING_LEAST, YAW_ACC_LEAST = 1200, 300, 3.0, 0.3, 100, 50
YAW_LEAST_R, YAW_LEAST_SPEED = 0.6, 2.78
RESYNC_NS = 1_800_000_000


class Estimator:
    """The live estimator of one device: the filter, the stationary rules and the buffers, from and to plain numbers."""

    def __init__(self, nav: Navigator | None = None):
        self.nav, self.n, self.run, self.said = nav, 0, 0, 0.0
        self.acc: list[float] = []
        self.gyro: list[float] = []
        self.fed = 0
        #: (fwd, lat, yaw, still) of the last samples while fixes come.
        self.history: list[tuple[float, float, float, float]] = []

    def remember(self, fwd: float, lat: float, yaw: float, acc: float, gyro: float) -> None:
        self.history = [*self.history, (fwd, lat, yaw, float(acc < ACC_STILL and gyro < GYRO_STILL))][-BIAS_ROWS:]

    def biases(self) -> np.ndarray | None:
        """Means over the history's rows that end a run of 8 still ones, within limits; None with fewer than 50 of them."""
        if not self.history:
            return None
        rows = np.array(self.history)
        upto = np.cumsum(rows[:, 3])
        run = upto - np.maximum.accumulate(np.where(rows[:, 3] == 0, upto, 0))
        own = rows[run >= STILL_RUN, :3]
        return np.clip(own.mean(axis=0), -np.array(BIAS_LIMITS), BIAS_LIMITS) if len(own) >= BIAS_LEAST else None

    def start(self, east: float, north: float, speed: float, psi: float) -> None:
        found = self.biases()
        self.nav = Navigator.at(east, north, speed * math.sin(psi), speed * math.cos(psi), psi, (0.0, 0.0, 0.0) if found is None else found.tolist())
        if found is not None:
            self.nav.p[(BF, BL, BW), (BF, BL, BW)] = np.square(CALIBRATED_SIGMA)
        self.n = self.run = self.fed = 0
        self.said, self.acc, self.gyro = speed, [], []

    def step(self, fwd: float, lat: float, yaw: float, acc: float, gyro: float, dt: float, road: Callable[[float, float, float], float] | None = None, speed: float | None = None, sigma: float = 1.8) -> bool:
        """One sample; road gives the heading of the road at a position and heading, NaN without one. Returns whether a road was matched."""
        nav = self.nav
        self.n += 1
        band = lambda x, limit: 0.0 if abs(x) < limit else x
        nav.predict(band(fwd, ACC_BAND), band(lat, ACC_BAND), band(yaw, YAW_BAND), min(max(dt, 0.01), 1.0))
        nav.no_side_slip(NHC_SIGMA)
        along = road(*(float(nav.x[k]) for k in (0, 1, 4))) if road is not None and self.n % ROAD_EVERY == 0 else math.nan
        if not math.isnan(along):
            nav.heading(along)
        self.run = self.run + 1 if acc < ACC_STILL and gyro < GYRO_STILL else 0
        self.acc, self.gyro = [*self.acc, acc][-LOCK_ROWS:], [*self.gyro, gyro][-LOCK_ROWS:]
        small = len(self.acc) == LOCK_ROWS and np.mean(self.acc) < ACC_STILL and np.mean(self.gyro) < GYRO_STILL
        if small and np.var(self.acc) < LOCK_ACC_VAR and np.var(self.gyro) < LOCK_GYRO_VAR:
            nav.stand_still(LOCK_SIGMA)
            self.said = 0.0
            return not math.isnan(along)
        if self.run >= STILL_RUN and self.said < VETO_SPEED:
            nav.stand_still(ZUPT_SIGMA)
        self.fed = min(self.fed + 1, SPEED_ROWS)  # the speed model's buffer isn't fed while the lock holds
        if speed is not None and self.n % SPEED_EVERY == 0 and self.fed == SPEED_ROWS:
            nav.forward_speed(speed, sigma)
            self.said = speed
        return not math.isnan(along)

    def pack(self) -> tuple:
        nav = self.nav
        return (nav is not None, [] if nav is None else nav.x.tolist(), [] if nav is None else nav.p.ravel().tolist(), self.n, self.run, self.fed, float(self.said), self.acc, self.gyro, [v for h in self.history for v in h])

    @classmethod
    def unpack(cls, packed: tuple) -> Estimator:
        on, x, p, n, run, fed, said, acc, gyro, history = packed
        own = cls(Navigator(np.array(x), np.array(p).reshape(8, 8)) if on else None)
        own.n, own.run, own.fed, own.said, own.acc, own.gyro = n, run, fed, said, list(acc), list(gyro)
        own.history = [tuple(history[k : k + 4]) for k in range(0, len(history), 4)]
        return own


def _sums(x: float, y: float, g: float) -> np.ndarray:
    return np.array([1.0, x, y, g, x * x, y * y, x * y, x * g, y * g, g * g])


def best_yaw(sums: np.ndarray) -> tuple[float, float]:
    """(yaw in degrees, correlation) from the ten sums: the first of the best among 361 angles."""
    n, sx, sy, sg, sxx, syy, sxy, sxg, syg, sgg = sums
    deg = np.arange(-180, 181)
    c, s = np.cos(np.radians(deg)), np.sin(np.radians(deg))
    mean = (c * sx + s * sy) / n
    var, var_g = (c * c * sxx + 2 * c * s * sxy + s * s * syy) / n - mean**2, sgg / n - (sg / n) ** 2
    ok = (var > 1e-8) & (var_g > 1e-8)
    r = np.where(ok, ((c * sxg + s * syg) / n - mean * sg / n) / np.sqrt(np.where(ok, var * var_g, 1.0)), 0.0)
    k = int(np.round(r, 12).argmax())
    return float(deg[k]), float(r[k])


#: A block of the ring: the sums of moving rows and of accelerating ones, apart for its first row, whose neighbour may be gone; its first two rows; its greatest speed.
@dataclass
class Block:
    rows: int = 0
    inner: np.ndarray = field(default_factory=lambda: np.zeros((2, 10)))
    first: np.ndarray = field(default_factory=lambda: np.zeros((2, 10)))
    begin: list[float] = field(default_factory=list)
    fastest: float = -math.inf

    def flat(self) -> list[float]:
        return [float(self.rows), *self.inner.ravel().tolist(), *self.first.ravel().tolist(), self.fastest, *self.begin]

    @classmethod
    def of(cls, flat: list[float]) -> Block:
        return cls(int(flat[0]), np.array(flat[1:21]).reshape(2, 10), np.array(flat[21:41]).reshape(2, 10), list(flat[42:]), flat[41])


class YawRing:
    """The mounting yaw from the last 1,200 samples with a fix's speed, anew after every 300th, from sums by blocks of 300.

    A row (t, speed, ax, ay) counts with its speed's slope to both neighbours; at the window's ends to the one that's there.
    A block keeps the sums of its rows, so a window is some additions, and the oldest block goes whole. Between two
    300th rows the window is the current block and the three before it.
    """

    def __init__(self):
        self.blocks: list[Block] = []
        #: The last two rows.
        self.last: list[tuple[float, float, float, float]] = []

    @staticmethod
    def _row(before: tuple, at: tuple, after: tuple) -> np.ndarray:
        """Sums of one row, as a moving and as an accelerating one."""
        dt = after[0] - before[0]
        slope = (after[1] - before[1]) / dt if dt else 0.0
        own = _sums(at[2], at[3], slope)
        moving = at[1] > YAW_MOVING
        return np.stack([own * moving, own * (moving and abs(slope) > YAW_ACC)])

    def add(self, t: float, speed: float, ax: float, ay: float) -> bool:
        """Takes a row; says whether it's the 300th of its block."""
        row = (t, speed, ax, ay)
        if len(self.last) == 2:  # the row before this one has both neighbours now
            own = self._row(self.last[0], self.last[1], row)
            block = self.blocks[-1]
            if block.rows == 1:
                block.first = own
            else:
                block.inner = block.inner + own
        if not self.blocks or self.blocks[-1].rows == YAW_EVERY:
            self.blocks = [*self.blocks, Block()][-(YAW_ROWS // YAW_EVERY) :]
        block = self.blocks[-1]
        if block.rows < 2:
            block.begin += row
        block.rows += 1
        block.fastest = max(block.fastest, speed)
        self.last = [*self.last, row][-2:]
        return block.rows == YAW_EVERY

    def yaw(self) -> tuple[float, float] | None:
        """(degrees, correlation) over the window; None if too few rows move."""
        rows = sum(b.rows for b in self.blocks)
        if rows < 2:
            return None
        total = sum((b.inner for b in self.blocks), np.zeros((2, 10))) + sum((b.first for b in self.blocks[1:]), np.zeros((2, 10)))
        oldest = self.blocks[0]
        second = tuple(oldest.begin[4:8]) if oldest.rows > 1 else tuple(self.blocks[1].begin[:4])
        first = tuple(oldest.begin[:4])
        total = total + self._row(first, first, second) + self._row(self.last[0], self.last[1], self.last[1])
        moving, accelerating = total
        if moving[0] < YAW_MOVING_LEAST:
            return None
        return best_yaw(accelerating if accelerating[0] >= YAW_ACC_LEAST else moving)

    def trusted(self) -> float | None:
        """The yaw in degrees, where it correlates well enough and the vehicle was fast enough."""
        found = self.yaw()
        return found[0] if found and found[1] > YAW_LEAST_R and max(b.fastest for b in self.blocks) >= YAW_LEAST_SPEED else None

    def pack(self) -> tuple:
        return [v for r in self.last for v in r], [b.flat() for b in self.blocks]

    @classmethod
    def unpack(cls, packed: tuple) -> YawRing:
        own = cls()
        last, blocks = packed
        own.last = [tuple(last[k : k + 4]) for k in range(0, len(last), 4)]
        own.blocks = [Block.of(list(b)) for b in blocks]
        return own


class RoadCells:
    """Road segments (e1, n1, e2, n2, heading) by cells of a grid: one look-up finds all that a position can match.

    cells: anything with get(cell) and put(cell, segments); a segment is entered in every cell of its box, grown by the gate.
    """

    WIDTH = 2 * ROAD_GATE_M

    def __init__(self, get: Callable[[tuple[int, int]], list[float]], put: Callable[[tuple[int, int], list[float]], None]):
        self.get, self.put = get, put

    @classmethod
    def cells_of(cls, segment: tuple[float, ...]) -> Iterator[tuple[int, int]]:
        """The cells that a segment is entered in."""
        e1, n1, e2, n2, _ = segment
        span = lambda a, b: range(math.floor((min(a, b) - ROAD_GATE_M) / cls.WIDTH), math.floor((max(a, b) + ROAD_GATE_M) / cls.WIDTH) + 1)
        return ((cx, cy) for cx in span(e1, e2) for cy in span(n1, n2))

    def enter(self, segment: tuple[float, ...]) -> None:
        """A segment that's there already isn't entered again."""
        for cell in self.cells_of(segment):
            known = list(self.get(cell))
            if tuple(segment) not in {tuple(known[k : k + 5]) for k in range(0, len(known), 5)}:
                self.put(cell, known + [float(v) for v in segment])

    def heading(self, east: float, north: float, psi: float) -> float:
        own = self.get((math.floor(east / self.WIDTH), math.floor(north / self.WIDTH)))
        return matched_heading(east, north, psi, np.array(own, dtype=float).reshape(-1, 5))


#: Kinds of events, in the order in which those of one time are taken.
KINDS = ("road", "fix", "control", "imu")
#: (mode, what happens) -> the mode after it. Pairs that aren't listed change nothing.
TRANSITIONS = {
    ("WAITING", "fix"): "GPS_ACTIVE",
    ("GPS_ACTIVE", "toggle"): "OUTAGE",
    ("GPS_ACTIVE", "silence"): "OUTAGE",
    ("OUTAGE", "toggle"): "RESYNC",
    ("OUTAGE", "fix"): "GPS_ACTIVE",
    ("RESYNC", "resynced"): "GPS_ACTIVE",
}


class Machine:
    """The modes of one device.

    GPS_ACTIVE: the position is the last fix's; samples feed the history of biases and the yaw's ring. A toggle, or no fix
    for outage_ns, begins an OUTAGE: the filter starts from the last fix and takes every sample. An outage that silence
    began ends with the next fix; one that a toggle began lasts until the next toggle, fixes being only compared with.
    That toggle begins a RESYNC of 1.8 s, in which the filter goes on; after it the position is that of the fix that is
    the last one then, or, if that is older than outage_ns, the outage goes on as one of silence. A device without any
    event for expire_ns is forgotten. What time brings is done before the events of the same time.

    take() and pass_time() give rows (ts_ns, mode, event, east, north, speed, matched, separation_m, drift_pct, yaw_deg).
    """

    def __init__(self, roads: RoadCells, outage_ns: int = 3 * SECOND, expire_ns: int = 3600 * SECOND):
        self.roads, self.outage_ns, self.expire_ns = roads, outage_ns, expire_ns
        self.forget()

    def forget(self) -> None:
        self.mode, self.toggled, self.fix, self.resync_at = "WAITING", False, None, 0
        self.seen, self.last_imu, self.moved, self.yaw_deg = -1, -1, 0.0, 0.0
        self.own, self.ring = Estimator(), YawRing()

    @property
    def idle(self) -> bool:
        return self.seen < 0

    def _row(self, ts: int, event: str, matched: bool = False) -> tuple:
        if self.mode in ("OUTAGE", "RESYNC"):
            x = self.own.nav.x
            away = math.hypot(self.fix[1] - x[0], self.fix[2] - x[1])
            return (ts, self.mode, event, float(x[0]), float(x[1]), float(math.hypot(x[2], x[3])), matched, away, 100 * away / self.moved if self.moved > 1 else 0.0, self.yaw_deg)
        e, n, v = self.fix[1:4] if self.fix else (None, None, None)
        return (ts, self.mode, event, e, n, v, matched, 0.0, 0.0, self.yaw_deg)

    def _turn_yaw(self) -> bool:
        found = self.ring.trusted()
        if found is not None:
            self.yaw_deg = found
        return found is not None

    def _go(self, what: str, ts: int) -> bool:
        to = TRANSITIONS.get((self.mode, what))
        if to is None or (self.mode, what) == ("OUTAGE", "fix") and self.toggled:
            return False
        if to == "OUTAGE":
            self._turn_yaw()
            self.own.start(*self.fix[1:5])
            self.toggled, self.last_imu, self.moved = what == "toggle", -1, 0.0
        elif to == "RESYNC":
            self.resync_at = ts + RESYNC_NS
        elif what == "resynced" and ts - self.fix[0] >= self.outage_ns:
            to, self.toggled = "OUTAGE", False
        else:
            self.own.nav = None
        self.mode = to
        return True

    def due(self) -> int | None:
        """When time alone changes something next."""
        if self.idle:
            return None
        times = [self.seen + self.expire_ns]
        if self.mode == "GPS_ACTIVE":
            times.append(self.fix[0] + self.outage_ns)
        if self.mode == "RESYNC":
            times.append(self.resync_at)
        return min(times)

    def pass_time(self, until: int) -> Iterator[tuple]:
        while (at := self.due()) is not None and at <= until:
            if self.mode == "GPS_ACTIVE" and at == self.fix[0] + self.outage_ns:
                self._go("silence", at)
                yield self._row(at, "lost")
            elif self.mode == "RESYNC" and at == self.resync_at:
                self._go("resynced", at)
                yield self._row(at, "restored" if self.mode == "GPS_ACTIVE" else "lost")
            else:
                self.forget()
                yield self._row(at, "expired")

    def take(self, ts: int, kind: str, v: dict) -> Iterator[tuple]:
        """One event. v: the values of its kind: a segment's (road), a fix's, or a sample's."""
        yield from self.pass_time(ts)
        self.seen = ts
        if kind == "road":
            self.roads.enter(tuple(v[c] for c in ("e1", "n1", "e2", "n2", "heading")))
        elif kind == "fix":
            self.fix = (ts, v["east"], v["north"], v["speed"], v["psi"])
            if self._go("fix", ts) or self.mode == "GPS_ACTIVE":
                yield self._row(ts, "fix")
        elif kind == "control":
            if self._go("toggle", ts):
                yield self._row(ts, "lost" if self.mode == "OUTAGE" else "resync")
        elif self.mode != "WAITING":
            yield from self._sample(ts, v)

    def _sample(self, ts: int, v: dict) -> Iterator[tuple]:
        fwd, lat = v["fwd"], v["lat"]
        if math.isnan(fwd):  # phone axes, to be turned by the mounting yaw
            c, s = math.cos(math.radians(self.yaw_deg)), math.sin(math.radians(self.yaw_deg))
            fwd, lat = v["ax"] * c + v["ay"] * s, v["ay"] * c - v["ax"] * s
        if self.mode == "GPS_ACTIVE":
            self.own.remember(fwd, lat, v["yaw"], v["acc"], v["gyro"])
            if not math.isnan(v["ax"]) and self.ring.add(ts / SECOND, self.fix[3], v["ax"], v["ay"]) and self._turn_yaw():
                yield self._row(ts, "yaw")
            return
        dt = 0.1 if self.last_imu < 0 else (ts - self.last_imu) / SECOND
        self.last_imu = ts
        before = self.own.nav.x[:2].copy()
        matched = self.own.step(fwd, lat, v["yaw"], v["acc"], v["gyro"], dt, self.roads.heading, None if math.isnan(v["speed_ml"]) else v["speed_ml"])
        self.moved += float(math.hypot(*(self.own.nav.x[:2] - before)))
        yield self._row(ts, "imu", matched)

    def pack(self) -> tuple:
        last, blocks = self.ring.pack()
        return (self.mode, self.toggled, list(self.fix[1:5]) if self.fix else [], self.fix[0] if self.fix else 0, self.resync_at, self.seen, self.last_imu, self.moved, self.yaw_deg, *self.own.pack(), last, blocks)

    def load(self, packed: tuple) -> None:
        mode, self.toggled, fix, fix_ns, self.resync_at, self.seen, self.last_imu, self.moved, self.yaw_deg, *rest = packed
        self.mode, self.fix = mode, (fix_ns, *fix) if len(fix) else None
        self.own, self.ring = Estimator.unpack(tuple(rest[:10])), YawRing.unpack(tuple(rest[10:]))


MACHINE_STATE = (
    "mode string, toggled boolean, fix array<double>, fix_ns bigint, resync_at bigint, seen bigint, last_imu bigint, moved double, yaw_deg double, "
    "active boolean, x array<double>, p array<double>, n bigint, run bigint, fed bigint, said double, acc array<double>, gyro array<double>, history array<double>, "
    "ring_last array<double>, ring_blocks array<array<double>>"
)
