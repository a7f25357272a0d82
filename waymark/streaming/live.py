"""The live path as Structured Streaming: stateful processors keyed by device, and watermarked windows.

Rows of a device (device, ts_ns, ...) wait in state until the watermark has passed them, and are then taken in the order
of their time, whatever micro-batches they came in: as long as none is later than the stream's delay, the result doesn't
depend on where the batches are cut. Rows later than that are dropped, as everywhere in Structured Streaming. What the
watermark hasn't passed at the end of a bounded input stays waiting.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waymark.operators.fusion import smooth_step
from waymark.streaming.machine import KINDS, MACHINE_STATE, SECOND, Machine, RoadCells

SENSORS = ("acc", "grav", "gyro", "acc_lin", "mag")
SAMPLE_NS = 100_000_000
COUNT_WINDOW = 91
#: Cells of a tile of roads along each side.
TILE_CELLS = 16


class InOrder(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them, and gives them to process() by time, then by their other values.

    FIELDS: the rows' columns besides ts_ns, with their types; floats or strings. Equal rows are all kept.
    """

    FIELDS: dict[str, str] = {}
    OUT: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value of columns: a list state takes each row apart, which is much of a short key's time.
        self.waiting = handle.getValueState("waiting", ", ".join(f"{c} array<{k}>" for c, k in {"ts_ns": "bigint", **self.FIELDS}.items()))

    def handleInputRows(self, key, rows, timerValues):
        columns = ["ts_ns", *self.FIELDS]
        new = [tuple(r) for b in rows if len(b) for r in b[columns].itertuples(index=False)]
        yield from self._release(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._release(key, [], timerValues)

    def _release(self, key, new: list[tuple], timers) -> Iterator[pd.DataFrame]:
        watermark = timers.getCurrentWatermarkInMs()
        until = watermark * 1_000_000 + 999 if watermark > 0 else -1  # rows up to here have come, to the microsecond
        stored = self.waiting.get()
        held = (list(zip(*stored, strict=True)) if stored else []) + new
        ready = sorted((r for r in held if r[0] <= until), key=lambda r: tuple((v is None or v != v, 0 if v is None or v != v else v) for v in self.ranked(r)))
        rest = [r for r in held if r[0] > until]
        out, due = self.process(key[0], ready, until)
        if rest:
            self.waiting.update(tuple(map(list, zip(*rest, strict=True))))
        elif held:
            self.waiting.clear()
        times = [r[0] for r in rest] + ([] if due is None else [due])
        for t in list(self.handle.listTimers()):
            if t > watermark:
                self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(max(watermark + 1, -(-min(times) // 1_000_000)))
        if out:  # a frame for each key, though it be empty, is what takes long
            yield pd.DataFrame(out, columns=list(self.OUT))

    def ranked(self, row: tuple) -> tuple:
        """What rows are ordered by."""
        return row

    def process(self, device: str, ready: list[tuple], until: int) -> tuple[list[tuple], int | None]:
        """Output rows, and when time alone will make more."""
        raise NotImplementedError


class LatestHold(InOrder):
    """A sample of each sensor's latest value whenever 100 ms have passed since the last sample; no interpolation."""

    FIELDS = {"sensor": "string", "x": "double", "y": "double", "z": "double"}
    OUT = ("device", "ts_ns", *(f"{s}_{a}" for s in SENSORS for a in "xyz"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "last_ns bigint, latest array<double>")

    def process(self, device, ready, until):
        last, latest = (None, [math.nan] * (3 * len(SENSORS)))
        if self.held.exists():
            last, latest = self.held.get()
            latest = list(latest)
        out = []
        for ts, sensor, x, y, z in ready:
            if sensor in SENSORS:
                at = 3 * SENSORS.index(sensor)
                latest[at : at + 3] = [x, y, z]
            if last is None or ts - last >= SAMPLE_NS:
                out.append((device, ts, *latest))
                last = ts
        if ready:
            self.held.update((last, latest))
        return out, None


SAMPLE_SCHEMA = "device string, ts_ns bigint, " + ", ".join(f"{s}_{a} double" for s in SENSORS for a in "xyz")


class CountWindows(InOrder):
    """Tumbling windows of a number of rows; what is left over waits for more."""

    FIELDS = {"value": "double"}
    OUT = ("device", "first_ns", "last_ns", "n", "mean_value", "std_value")

    def __init__(self, size: int = COUNT_WINDOW):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rest = handle.getListState("rest", "ts_ns bigint, value double")

    def process(self, device, ready, until):
        if not ready:
            return [], None
        own = (list(self.rest.get()) if self.rest.exists() else []) + ready
        out = []
        while len(own) >= self.size:
            window, own = own[: self.size], own[self.size :]
            values = [v for _, v in window]
            out.append((device, window[0][0], window[-1][0], len(window), float(np.mean(values)), float(np.std(values))))
        if own:
            self.rest.put(own)
        else:  # an empty list can't be stored
            self.rest.clear()
        return out, None


COUNT_SCHEMA = "device string, first_ns bigint, last_ns bigint, n bigint, mean_value double, std_value double"


class SmoothFixes(InOrder):
    """The display smoother over a stream of fixes (ts_ns, east, north, accuracy)."""

    FIELDS = {"east": "double", "north": "double", "accuracy": "double"}
    OUT = ("device", "ts_ns", "anchor_east", "anchor_north")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("smoother", "ae double, an double, pe double, pn double, count bigint, se double, sn double")

    def process(self, device, ready, until):
        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for ts, e, n, acc in ready:
            state = smooth_step(state, e, n, acc)
            out.append((device, ts, *state[:2]))
        if ready:
            self.state.update(state)
        return out, None


SMOOTH_SCHEMA = "device string, ts_ns bigint, anchor_east double, anchor_north double"


class LiveFusion(InOrder):
    """Samples, fixes, controls and roads of a device through its Machine (see machine.py).

    Roads lie in a map from tiles of grid cells to segments in this state, by events or from the initial state, and are
    looked up at the filter's own position. Timers of event time switch modes where no row comes, and forget a silent device.
    """

    FIELDS = {"kind": "string", **dict.fromkeys(("fwd", "lat", "yaw", "acc", "gyro", "ax", "ay", "speed_ml", "east", "north", "speed", "psi", "e1", "n1", "e2", "n2", "heading"), "double")}
    OUT = ("device", "ts_ns", "mode", "event", "east", "north", "speed", "matched", "separation_m", "drift_pct", "yaw_deg")

    def __init__(self, outage_ns: int = 3 * SECOND, expire_ns: int = 3600 * SECOND):
        self.limits = outage_ns, expire_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("machine", MACHINE_STATE)
        self.roads = handle.getMapState("roads", "tx bigint, ty bigint", "segments array<double>")

    def _road_cells(self) -> tuple[RoadCells, Callable[[], None]]:
        """Cells by tiles, of which each is read from the state once, and what writes those that have changed, each once.

        A tile's segments are kept once, in the order in which they came, and entered in its cells again when it's read.
        """
        known: dict[tuple[int, int], list[float]] = {}
        tiles: dict[tuple[int, int], dict[tuple[float, ...], None]] = {}
        changed: set[tuple[int, int]] = set()
        any_stored = self.roads.exists()
        tile_of = lambda cell: (cell[0] // TILE_CELLS, cell[1] // TILE_CELLS)

        def segments_of(tile):
            if tile not in tiles:
                found = self.roads.getValue(tile) if any_stored else None
                flat = list(found[0]) if found else []
                tiles[tile] = {tuple(flat[k : k + 5]): None for k in range(0, len(flat), 5)}
                for segment in tiles[tile]:
                    for cell in RoadCells.cells_of(segment):
                        if tile_of(cell) == tile:
                            known.setdefault(cell, []).extend(segment)
            return tiles[tile]

        def get(cell):
            segments_of(tile_of(cell))
            return known.get(cell, [])

        def put(cell, segments):
            segments_of(tile_of(cell))[tuple(segments[-5:])] = None
            known[cell] = segments
            changed.add(tile_of(cell))

        def write():
            for tile in changed:
                self.roads.updateValue(tile, ([v for segment in tiles[tile] for v in segment],))

        return RoadCells(get, put), write

    def handleInitialState(self, key, initialState, timerValues) -> None:
        cells, write = self._road_cells()
        for segment in initialState[["e1", "n1", "e2", "n2", "heading"]].itertuples(index=False):
            cells.enter(tuple(segment))
        write()

    def ranked(self, row):
        return (row[0], KINDS.index(row[1]) if row[1] in KINDS else len(KINDS), *row[2:])

    def process(self, device, ready, until):
        cells, write = self._road_cells()
        machine = Machine(cells, *self.limits)
        if self.state.exists():
            machine.load(tuple(self.state.get()))
        out = []
        for ts, kind, *values in ready:
            if kind in KINDS:
                found = machine.take(ts, kind, dict(zip(list(self.FIELDS)[1:], (math.nan if v is None else float(v) for v in values), strict=True)))
                out += [(device, *r) for r in found]
        out += [(device, *r) for r in machine.pass_time(until)]
        if not machine.idle:
            write()
            self.state.update(machine.pack())
        elif self.state.exists():
            self.state.clear()
            self.roads.clear()
        return out, machine.due()


FUSION_SCHEMA = "device string, ts_ns bigint, mode string, event string, east double, north double, speed double, matched boolean, separation_m double, drift_pct double, yaw_deg double"


def _stateful(stream: DataFrame, processor: InOrder, schema: str, late: str, initial: DataFrame | None = None) -> DataFrame:
    """Needs the RocksDB state store (use_state_store). The processor travels with its code, as Spark also starts it on the driver, where shipped files aren't.

    Columns that the stream lacks are null.
    """
    given = stream.columns
    own = stream.select("device", F.col("ts_ns").cast("bigint"), F.timestamp_micros(F.floor(F.col("ts_ns") / 1000)).alias("at"), *((F.col(c) if c in given else F.lit(None)).cast(k).alias(c) for c, k in processor.FIELDS.items()))
    package = sys.modules[__name__.partition(".")[0]]
    cloudpickle.register_pickle_by_value(package)
    try:
        start = None if initial is None else initial.groupBy("device")
        return own.withWatermark("at", late).groupBy("device").transformWithStateInPandas(processor, schema, "update", "EventTime", initialState=start)
    finally:
        cloudpickle.unregister_pickle_by_value(package)


def use_state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: How late rows may be.
LATE = "10 seconds"


def samples_from_sensors(stream: DataFrame, late: str = LATE) -> DataFrame:
    return _stateful(stream, LatestHold(), SAMPLE_SCHEMA, late)


def count_windows(stream: DataFrame, size: int = COUNT_WINDOW, late: str = LATE) -> DataFrame:
    return _stateful(stream, CountWindows(size), COUNT_SCHEMA, late)


def smoothed(stream: DataFrame, late: str = LATE) -> DataFrame:
    return _stateful(stream, SmoothFixes(), SMOOTH_SCHEMA, late)


def fused(stream: DataFrame, roads: DataFrame | None = None, late: str = LATE, outage_ns: int = 3 * SECOND, expire_ns: int = 3600 * SECOND) -> DataFrame:
    """Positions and modes of devices. stream: device, ts_ns, kind ('imu', 'fix', 'control' or 'road') and that kind's columns of LiveFusion.FIELDS.

    roads: (device, e1, n1, e2, n2, heading) that devices know from the start. Rows of other kinds are passed over. A null
    value is a NaN; a sample without fwd gives ax and ay, which the mounting yaw turns.
    """
    return _stateful(stream, LiveFusion(outage_ns, expire_ns), FUSION_SCHEMA, late, roads)


def tumbling(stream: DataFrame, time: str, late: str = "1 hour", width: str = "6 hours", *keys: str) -> DataFrame:
    """Counts and means by event-time window, closed by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))


def bursts(stream: DataFrame, time: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Event-time sessions of a key, ended by a gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_to_table(stream: DataFrame, path: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over all that is there now and return its result; path may hold an earlier run, which goes on.

    append: all rows. complete: those of the last micro-batch, which holds the whole table. update: of rows with the same
    keys the one of the last micro-batch that has them; without keys all rows, each micro-batch once. Other modes than
    append are written by micro-batch, each to a place of its own that it overwrites, so one that runs again after a loss
    changes nothing. A stream that has written nothing has no rows.
    """
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    else:
        put = lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")
        q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    try:
        found = spark.read.schema(stream.schema if mode == "append" else T.StructType([*stream.schema, T.StructField("epoch", T.LongType())])).parquet(f"{path}/out")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stream.schema)
    if mode == "append":
        return found
    if mode == "complete":  # of a partition column, so no file is read for it
        last = found.agg(F.max("epoch")).first()[0]
        return found.filter(F.col("epoch") == F.lit(-1 if last is None else last)).drop("epoch")
    if not keys:
        return found.drop("epoch")
    return found.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "epoch").alias("_row")).select("_row.*")
