"""How often the stateful processors go to the state store, which is what short keys' time follows."""

import numpy as np
import pandas as pd
import pytest
from test_machine import new_machine

from waymark.streaming import live
from waymark.streaming.machine import KINDS

S = 10**9


class State:
    """A value, list or map state that counts its writes."""

    def __init__(self):
        self.value, self.map, self.writes = None, {}, 0

    def exists(self):
        return self.value is not None or bool(self.map)

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    put = update

    def clear(self):
        self.value, self.map = None, {}

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key], self.writes = value, self.writes + 1


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def _state(self, name, *_):
        return self.states.setdefault(name, State())

    getValueState = getListState = getMapState = _state

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_rows_make_no_frame():
    made = live.CountWindows(20)
    made.init(Handle())
    rows = pd.DataFrame({"ts_ns": S + np.arange(50)[::-1], "value": np.arange(50.0)})
    assert not list(made.handleInputRows(("a",), iter([rows[:25], rows[25:]]), Clock(0)))
    assert made.waiting.writes == 1
    (got,) = made.handleExpiredTimer(("a",), Clock(2000), None)
    assert got["first_ns"].tolist() == [S, S + 20] and got["mean_value"].tolist() == [39.5, 19.5] and not made.waiting.exists()
    assert not list(made.handleExpiredTimer(("a",), Clock(3000), None))


@pytest.mark.parametrize("batches", [1, 3])
def test_roads_are_written_by_tile(batches):
    rng = np.random.default_rng(6)
    made, box = live.LiveFusion(), new_machine()
    made.init(Handle())
    names = list(live.LiveFusion.FIELDS)[1:]
    e1, n1 = rng.uniform(-300, 1000, 60), rng.uniform(-60, 160, 60)
    events = [(S, "road", dict(zip(names, [np.nan] * len(names), strict=True)) | {"e1": a, "n1": b, "e2": a + 60, "n2": b + 20, "heading": 1.25}) for a, b in zip(e1, n1, strict=True)]
    events += [(k * S, "fix", dict.fromkeys(names, np.nan) | {"east": 10.0 * k, "north": 20.0, "speed": 10.0, "psi": 1.2}) for k in (1, 2, 3)] + [(3 * S + 1, "control", dict.fromkeys(names, np.nan))]
    events += [(3 * S + k * S // 10, "imu", dict.fromkeys(names, np.nan) | {"fwd": 0.1, "lat": 0.0, "yaw": 0.0, "acc": 9.0, "gyro": 1.0, "speed_ml": 10.0}) for k in range(1, 200)]
    events.sort(key=lambda e: (e[0], KINDS.index(e[1])))
    want = [r for e in events for r in box.take(*e)]
    got = []
    for part in np.array_split(np.arange(len(events)), batches):
        rows = [(events[i][0], events[i][1], *(events[i][2][n] for n in names)) for i in part]
        got += [r[1:] for r in made.process("a", rows, events[part[-1]][0])[0]]
    pd.testing.assert_frame_equal(pd.DataFrame(got), pd.DataFrame(want))
    assert any(r[6] for r in want)
    assert made.roads.writes <= 9 * batches
