"""The road cache that follows devices, and the quarantine of unreadable files."""

import gzip
import math

import numpy as np
import pandas as pd
import pytest

from waymark.sources import readers
from waymark.streaming import roads

SCHEMA = "device string, ts_ns bigint, lat double, lon double"
METRE = 1 / 111_194.9  # a degree's part, to the north


def near(a, b, metres):
    d_e = math.radians(b[1] - a[1]) * 6_371_000 * math.cos(math.radians(a[0]))
    d_n = math.radians(b[0] - a[0]) * 6_371_000
    return math.hypot(d_e, d_n) < metres


@pytest.fixture
def source(spark):
    """Ways 100 m apart along a street to the north, each 40 m long."""
    rows = [(k, f"w{k}", "residential", [(48 + (100 * k + 7) * METRE, 11.0), (48 + (100 * k + 47) * METRE, 11.0)]) for k in range(60)]
    return spark.createDataFrame(rows, roads.WAYS)


def ids(cache, version=None):
    return sorted(r.way_id for r in cache.ways(version).collect())


def test_a_moving_device_adds_roads(spark, source, tmp_path):
    """One micro-batch after the other, with a device that moves 100 m in each; against the plain rule."""
    cache = roads.RoadCache(spark, f"{tmp_path}/cache")
    path = [(48 + 100 * k * METRE, 11.0) for k in range(12)]
    for k, (lat, lon) in enumerate(path):
        spark.createDataFrame([("a", 10 * k, 0.0, 0.0), ("a", 10 * k + 5, lat, lon), ("b", 10 * k, None, lon)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k:02d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    cache.follow(stream, lambda: source, f"{tmp_path}/state").awaitTermination()
    centres = []
    for p in path:
        if not any(near(c, p, 180) for c in centres):
            centres.append(p)
    assert sorted((round(r.lat, 9), r.lon) for r in cache.centres().collect()) == sorted((round(a, 9), b) for a, b in centres)
    want = {k for k in range(60) for c in centres if (100 * k + 7) * METRE <= c[0] - 48 + 300 * METRE and (100 * k + 47) * METRE >= c[0] - 48 - 300 * METRE}
    assert ids(cache) == sorted(want)
    versions = cache.versions()
    assert len(versions) == len(centres)
    first = ids(cache, versions[0])
    assert len(first) < len(want)
    again = spark.createDataFrame([("a", 1, *centres[1])], SCHEMA)
    cache.refresh(again, source, versions[1])  # a micro-batch that runs again
    assert ids(cache) == sorted(want) and ids(cache, versions[0]) == first and cache.versions() == versions
    assert cache.ways().count() == len(want)


def test_nothing_near_is_asked_for_again(spark, source, tmp_path):
    cache = roads.RoadCache(spark, f"{tmp_path}/cache")
    far = spark.createDataFrame([("a", 1, 10.0, 10.0)], SCHEMA)
    cache.refresh(far, source, 0)
    assert cache.versions() == [] and ids(cache) == []
    cache.refresh(far.limit(0), source, 1)
    assert cache.versions() == []
    more = source.union(spark.createDataFrame([(99, None, None, [(10.0, 10.0), (10.0, 10.0001)])], roads.WAYS))
    cache.refresh(far, more, 2)
    assert ids(cache) == [99] and cache.versions() == [2]


def test_uncovered_is_the_plain_rule(spark):
    rng = np.random.default_rng(4)
    for lat0 in (0.0, 48.0, 70.0, -33.0):
        held = [(lat0 + a, 11 + b) for a, b in rng.uniform(-0.01, 0.01, (40, 2)).tolist()]
        asked = [(lat0 + a, 11 + b) for a, b in rng.uniform(-0.02, 0.02, (200, 2)).tolist()]
        got = roads.uncovered(spark.createDataFrame(asked, roads.CENTRES), spark.createDataFrame(held, roads.CENTRES), 180.0).collect()
        assert sorted(map(tuple, got)) == sorted(p for p in asked if not any(near(c, p, 180) for c in held))


def test_unreadable_files_are_reported(spark, tmp_path):
    """A good file, one that breaks off within a row, a binary one, a broken archive and an empty one: no file fails the scan."""
    header = "time_ms,acc_x,acc_y\n"
    (tmp_path / "good.csv").write_text(header + "0,1.5,2\n100,2.5,3\n")
    (tmp_path / "cut.csv").write_text(header + "0,1,2\n100,2,3\n200,4")
    (tmp_path / "noise.csv").write_bytes(bytes(np.random.default_rng(1).integers(128, 255, 400, dtype=np.uint8)) + b"\n\x80\x81\n\x90")
    (tmp_path / "archive.csv.gz").write_bytes(gzip.compress(header.encode() * 500)[:40])
    (tmp_path / "empty.csv").write_text("")
    rows, report = readers.session_csv_checked(spark, str(tmp_path), ["time_ms", "acc_x", "acc_y"])
    got = {r.source_file.rsplit("/", 1)[1]: r for r in report.collect()}
    assert {k: r.outcome for k, r in got.items()} == {"good.csv": "read", "cut.csv": "bad rows", "noise.csv": "unreadable", "archive.csv.gz": "unreadable", "empty.csv": "unreadable"}
    assert (got["good.csv"].n_rows, got["good.csv"].n_bad, got["cut.csv"].n_rows, got["cut.csv"].n_bad) == (2, 0, 2, 1)
    assert all(r.n_bytes == (tmp_path / k).stat().st_size for k, r in got.items())
    found = rows.toPandas().sort_values(["session_id", "row_idx"])
    assert found["session_id"].tolist() == ["cut", "cut", "good", "good"] and found["row_idx"].tolist() == [0, 1, 0, 1]
    assert found["time_ms"].tolist() == [0.0, 100.0, 0.0, 100.0]
    assert pd.api.types.is_float_dtype(found["acc_x"])
