"""Window formulations against plain loops on random sessions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import aggregates as agg
from waymark.operators import joins
from waymark.operators import windows as win
from waymark.plans.motion import QUERIES
from waymark.plans.samples import samples


def sessions(seed, n=120, k=3):
    rng = np.random.default_rng(seed)
    t = np.concatenate([np.cumsum(rng.uniform(0.05, 0.2, n)) for _ in range(k)])
    return pd.DataFrame({"session_id": np.repeat(np.arange(k), n), "row_idx": np.tile(np.arange(n), k), "t": t, "x": rng.normal(0, 1, n * k), "y": rng.normal(0, 3, n * k), "flag": rng.random(n * k) < 0.05, "w": rng.normal(0, 2, n * k)})


def ordered(df):
    return df.orderBy("session_id", "row_idx").toPandas()


@pytest.mark.parametrize("seed", [1, 2])
def test_clamped_integral(spark, seed):
    rows = sessions(seed)
    rows["v0"] = 1.5
    got = ordered(win.clamped_integral(spark.createDataFrame(rows), "x", "v", start="v0", reset="flag"))
    for s, own in rows.groupby("session_id"):
        v, want = 1.5, [1.5]
        for x, hit in zip(own["x"][1:], own["flag"][1:], strict=True):
            v = 0.0 if hit else max(0.0, v + x)
            want.append(v)
        np.testing.assert_allclose(got.loc[got["session_id"] == s, "v"], want, atol=1e-9)


def test_held_mask_and_variance(spark):
    rows = sessions(3)
    df = spark.createDataFrame(rows).withColumns({"held": win.held_for(F.abs("x") < 1.2, 4), "var": win.rolling_variance("y")})
    got = ordered(df)
    for s, own in rows.groupby("session_id"):
        run, want = 0, []
        for x in own["x"]:
            run = run + 1 if abs(x) < 1.2 else 0
            want.append(run >= 4)
        assert got.loc[got["session_id"] == s, "held"].tolist() == want
        np.testing.assert_allclose(got.loc[got["session_id"] == s, "var"], own["y"].rolling(8, min_periods=1).var().fillna(0), atol=1e-9)


def test_unwrap_and_gradient(spark):
    rows = sessions(4)
    rows["w"] = np.angle(np.exp(1j * rows["w"].cumsum()))
    got = ordered(win.unwrap(spark.createDataFrame(rows), "w", "u").withColumn("g", win.gradient("y", "t")))
    for s, own in rows.groupby("session_id"):
        mine = got[got["session_id"] == s]
        np.testing.assert_allclose(mine["u"], np.unwrap(own["w"]), atol=1e-9)
        np.testing.assert_allclose(mine["g"], np.gradient(own["y"], own["t"]), atol=1e-8)


def test_split_sessions_edges(spark):
    times = [i * 100 for i in range(60)]  # 60 rows
    times += [times[-1] + 5000 + i * 100 for i in range(50)]  # exactly 5000 ms: no split
    times += [times[-1] + 5001 + i * 100 for i in range(49)]  # split, but 49 rows: dropped
    times += [i * 100 for i in range(50)]  # time goes back: split
    rows = pd.DataFrame({"session_id": "a", "row_idx": range(len(times)), "time_ms": [float(t) for t in times]})
    got = win.split_sessions(spark.createDataFrame(rows), "time_ms").groupBy("sub_idx", "sub_name").count().orderBy("sub_idx").collect()
    assert [tuple(r) for r in got] == [(1, "_sub01", 110), (2, "_sub02", 50)]


def test_fills_and_changes(spark):
    rows = [(1, 0, None, 1.0), (1, 1, 2.0, 1.0), (1, 2, None, 3.0), (1, 3, 5.0, None), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "session_id int, row_idx int, a double, b double")
    got = df.select("session_id", "row_idx", win.fill_both_ways("a").alias("a"), win.changed(["b"]).alias("c")).orderBy("session_id", "row_idx").collect()
    assert [(r.a, r.c) for r in got] == [(2.0, True), (2.0, False), (2.0, True), (5.0, True), (None, True)]


def test_asof_against_pandas(spark):
    rng = np.random.default_rng(6)
    left = pd.DataFrame({"k": 1, "t": np.sort(rng.choice(10_000, 200, replace=False)).astype(float), "i": range(200)})
    right = pd.DataFrame({"k": 1, "t": np.sort(rng.choice(10_000, 80, replace=False)) + 0.5, "v": rng.normal(size=80)})
    l, r = spark.createDataFrame(left), spark.createDataFrame(right)
    near = joins.asof_nearest(l, r, "k", "t", ["v"]).orderBy("i").toPandas()
    back = joins.asof_backward(l, r, "k", "t", ["v"]).orderBy("i").toPandas()
    line = joins.interpolate(l, r, "k", "t", "v").orderBy("i").toPandas()
    want = pd.merge_asof(left, right[["t", "v"]], on="t", direction="nearest")
    gap = np.abs(left["t"].to_numpy()[:, None] - right["t"].to_numpy())
    clear = (np.sort(gap, axis=1)[:, 0] != np.sort(gap, axis=1)[:, 1])
    np.testing.assert_allclose(near["v"][clear], want["v"][clear])
    np.testing.assert_allclose(back["v"], pd.merge_asof(left, right[["t", "v"]], on="t")["v"])
    np.testing.assert_allclose(line["v"], np.interp(left["t"], right["t"], right["v"]))


def test_yaw_alignment_recovers_angle(spark):
    rng = np.random.default_rng(7)
    g = rng.normal(0, 1, 400)
    side = rng.normal(0, 0.01, 400)
    a = math.radians(-35)
    rows = pd.DataFrame({"session_id": 1, "ax": g * math.cos(a) - side * math.sin(a), "ay": g * math.sin(a) + side * math.cos(a), "g": g})
    got = agg.yaw_alignment(spark.createDataFrame(rows), "ax", "ay", "g", "session_id").first()
    assert abs(got["mounting_yaw_deg"] + 35) <= 1 and got["alignment_corr"] > 0.999
    few = agg.yaw_alignment(spark.createDataFrame(rows[:50]), "ax", "ay", "g", "session_id").first()
    assert (few["mounting_yaw_deg"], few["alignment_corr"]) == (0.0, 0.0)


def test_quadratic_fit(spark):
    x = np.linspace(-3, 9, 50)
    rows = pd.DataFrame({"k": 1, "x": x, "y": 2 * x * x - 3 * x + 7})
    got = agg.quadratic_fit(spark.createDataFrame(rows), "x", "y", "k").first()
    assert (got.c2, got.c1, got.c0) == (pytest.approx(2), pytest.approx(-3), pytest.approx(7))


def road(spark, *segments):
    return spark.createDataFrame([(i, 0, *map(float, s), math.atan2(s[2] - s[0], s[3] - s[1])) for i, s in enumerate(segments)], "way_id int, seg_idx int, e1 double, n1 double, e2 double, n2 double, heading double")


@pytest.mark.parametrize("x, y, deg, hit", [(15, 50, 5, 15), (15, 50, 90, None), (65, 50, 0, None), (-22, 50, 10, 22), (10, 50, 185, 10)])
def test_map_match(spark, x, y, deg, hit):
    point = spark.createDataFrame([(1, float(x), float(y), math.radians(deg))], "id int, x double, y double, heading double")
    got = joins.map_match(point, road(spark, (0, 0, 0, 300)), ["id"], 50.0, math.radians(45)).first()
    assert (got["dist"] is None) if hit is None else got["dist"] == pytest.approx(hit, abs=0.5)


def test_geo_round_trip(spark):
    df = spark.createDataFrame([(48.1351, 11.5820, 48.1450, 11.5950)], "a double, b double, c double, d double")
    c = F.col
    e, n = geo.to_east(c("a"), c("b"), c("d")), geo.to_north(c("a"), c("c"))
    got = df.select(geo.to_latitude(c("a"), n).alias("x"), geo.to_longitude(c("a"), c("b"), e).alias("y")).first()
    assert got.x == pytest.approx(48.1450, abs=1e-9) and got.y == pytest.approx(11.5950, abs=1e-9)
    mid = spark.range(1).select(*(x.alias(n) for x, n in zip(geo.slerp(F.lit(12.97), F.lit(77.59), F.lit(12.972), F.lit(77.592), F.lit(0.5)), "xy", strict=True))).first()
    assert mid.x == pytest.approx(12.971, abs=1e-4) and mid.y == pytest.approx(77.591, abs=1e-4)


def test_plans_stay_in_one_exchange(spark):
    """A chain of windows of one session needs one exchange and no Python."""
    rows = spark.createDataFrame(sessions(8))
    df = win.clamped_integral(rows, "x", "v").withColumn("psi", win.integrate(F.col("w") * 0.1))
    plan = win.dead_reckon(df.withColumn("dt", F.lit(0.1)), "v", "psi", "dt")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_map_match_whole_takes_every_road(spark):
    sf = "/root/testdata/sf0.001"
    keys = [r.s_suppkey for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect()]
    want = {}
    for p in samples(spark, sf).select("session_id", "row_idx", "value", "k").collect():
        best = (math.inf, None)
        for key in keys:
            e1, n1, e2, n2 = key * 37 % 490, key * 11 % 100, key * 37 % 490 + 20 + key % 30, key * 17 % 100
            de, dn = e2 - e1, n2 - n1
            f = min(1, max(0, ((p.value - e1) * de + (p.k - n1) * dn) / (de * de + dn * dn)))
            dist = math.hypot(p.value - e1 - f * de, p.k - n1 - f * dn)
            turn = abs(math.remainder(math.radians(p.k * 3) - math.atan2(de, dn), math.pi))  # either way along the road
            if dist <= 25 and turn <= math.radians(30):
                best = min(best, (dist * (1 + turn / math.radians(30)), key))
        want[p.session_id, p.row_idx] = best[1]
    got = {(r.session_id, r.row_idx): r.way_id for r in QUERIES["q_map_match"](spark, sf).collect()}
    assert got == want and any(w is not None and w % 3 for w in want.values())
