"""Training tables against plain loops, and ridge folds against refits."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.operators import models, training
from waymark.operators.features import SIGNALS_56, SIGNALS_58, STATS
from waymark.operators.reports import acceleration_case


@pytest.fixture(scope="module")
def trip():
    rng = np.random.default_rng(11)
    n = 400
    rows = pd.DataFrame({c: rng.normal(size=n) for c in SIGNALS_56[:11]})
    rows.insert(0, "session_id", "s")
    rows["row_idx"], rows["dt"], rows["t"] = np.arange(n), 0.1, np.arange(n) * 0.1
    rows["fix"] = np.isin(rows["row_idx"], [0, 1, 5, 19, 20, 21, 40, 41, 90, 130, 399])
    rows["v"] = np.abs(rng.normal(3, 2, n))
    rows.loc[[40, 41], "v"] = 0.1
    rows["east"], rows["north"], rows["heading"] = rng.normal(0, 20, n).cumsum(), rng.normal(0, 20, n).cumsum(), rng.uniform(0, 6, n)
    return rows


def with_plain_magnitudes(rows):
    out = rows.copy()
    for name, c in (("a_mag", "acc_"), ("w_mag", "gyro_"), ("al_mag", "acc_lin_")):
        out[name] = np.sqrt(sum(out[f"{c}{a}"] ** 2 for a in "xyz"))
    return out


def plain_stats(part, signals):
    return {f"{s}_{k}": f(part[s].to_numpy()) for s in signals for k, f in zip(STATS, (np.mean, np.std, np.min, np.max), strict=True)}


@pytest.mark.parametrize("rows", [20, 21])
def test_velocity_table(spark, trip, rows):
    got = training.velocity_table(spark.createDataFrame(trip), "fix", "t", "v", "east", "north", rows).toPandas().sort_values("row_idx").set_index("row_idx")
    own = with_plain_magnitudes(trip)
    fixes = np.flatnonzero(trip["fix"])
    want = [i for i in fixes if i >= rows - 1 and trip["v"][i] >= 0.5]
    assert got.index.tolist() == want
    for i in want:
        before = fixes[np.searchsorted(fixes, i) - 1]
        de, dn = trip["east"][i] - trip["east"][before], trip["north"][i] - trip["north"][before]
        course = math.atan2(de, dn) % (2 * math.pi) if math.hypot(de, dn) > 5 else math.nan
        assert got["y_course"][i] == pytest.approx(course, nan_ok=True) and got["y_vel"][i] == trip["v"][i]
        for name, value in plain_stats(own.iloc[i - rows + 1 : i + 1], SIGNALS_56).items():
            assert got[name][i] == pytest.approx(value, abs=1e-9), name


def test_segment_table(spark, trip):
    got = training.segment_table(spark.createDataFrame(trip), "fix", "t", "v").toPandas().set_index("seg_start").sort_index()
    own, fixes, want = with_plain_magnitudes(trip), np.flatnonzero(trip["fix"]), {}
    for i, j in zip(fixes, fixes[1:], strict=False):
        if j - i < 2 or not 0 < trip["t"][j] - trip["t"][i] <= 30 or max(trip["v"][i], trip["v"][j]) < 0.5:
            continue
        v, psi, e, n = trip["v"][i], trip["heading"][i], 0.0, 0.0
        for k in range(i + 1, j + 1):
            v, psi = max(0.0, v + trip["acc_veh_fwd"][k] * 0.1), psi + trip["gyro_veh_yaw_rate"][k] * 0.1
            e, n = e + v * math.sin(psi) * 0.1, n + v * math.cos(psi) * 0.1
        way = math.hypot(trip["east"][j] - trip["east"][i], trip["north"][j] - trip["north"][i])
        want[i] = plain_stats(own.iloc[i : j + 1], SIGNALS_58) | {"target_a": trip["v"][j], "target_b": trip["v"][j] - trip["v"][i], "target_c": way - math.hypot(e, n), "seg_n_samples": j - i + 1, "seg_dur_s": trip["t"][j] - trip["t"][i]}
    assert got.index.tolist() == sorted(want) and len(want) >= 5
    for i, values in want.items():
        for name, value in values.items():
            assert got[name][i] == pytest.approx(value, abs=1e-8), (i, name)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(12)
    n = 600
    x = rng.normal(size=(n, 5)) * [1, 10, 0.1, 3, 1] + [0, 100, 5, -4, 0]
    x[:, 4] = 7.0  # constant
    y = x @ [2.0, -0.5, 3.0, 0.2, 0.0] + rng.normal(size=n)
    y[::97] += 400  # beyond ten deviations of the rest
    rows = pd.DataFrame(x, columns=list("abcde"))
    rows["y"], rows["trip"] = y, rng.choice(["T1", "T10", "T2", "T3"], n)
    return rows


def plain_ridge(x, y, alpha=1.0):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean())) / scale
    return y.mean() - w @ mean, w


@pytest.mark.parametrize("clip", [None, 3.0])
def test_ridge_folds_are_refits(spark, table, clip):
    df = spark.createDataFrame(table).repartition(7)
    found = training.ridge_folds(df, ["T1", "T2", "T3", "T9"], "trip", list("abcde"), "y", clip_sigma=clip)
    assert set(found) == {"T1", "T2", "T3", "T9"}
    for fold, (intercept, weights) in found.items():
        rest = table[~table["trip"].str.startswith(fold)]
        if clip:
            rest = rest[np.abs(rest["y"]) < clip * rest["y"].std(ddof=0)]
        i, w = plain_ridge(rest[list("abcde")].to_numpy(), rest["y"].to_numpy())
        assert intercept == pytest.approx(i, rel=1e-9, abs=1e-8)
        np.testing.assert_allclose(weights, w, rtol=1e-8, atol=1e-9)
    reports = {r.fold: r for r in training.ridge_reports(df, found, "trip", list("abcde"), "y").collect()}
    own = table[table["trip"].str.startswith("T1")]
    e = found["T1"][0] + own[list("abcde")].to_numpy() @ found["T1"][1] - own["y"].to_numpy()
    r = reports["T1"]
    assert r.n_test == len(own) and r.rmse == pytest.approx(np.sqrt(np.mean(e**2))) and r.mae == pytest.approx(np.mean(np.abs(e))) and r.median_ae == pytest.approx(np.median(np.abs(e)))
    assert "T9" not in reports


def test_ridge_folds_equal_the_librarys_refits(spark, table):
    df = spark.createDataFrame(table).repartition(3)
    names = list("abcd")
    intercept, weights = training.ridge_folds(df, ["T2"], "trip", names, "y")["T2"]
    model = models.ridge(df.filter("trip != 'T2'"), names, "y")
    want = model.transform(df.filter("trip = 'T2'")).select(*names, "prediction").toPandas()
    np.testing.assert_allclose(intercept + want[names].to_numpy() @ weights, want["prediction"], rtol=2e-3)


def test_nulls_and_folds_without_a_rest(spark, table):
    rows = pd.concat([table, table.iloc[:3].assign(a=math.nan)], ignore_index=True)
    df = spark.createDataFrame(rows).withColumn("a", F.nanvl("a", F.lit(None).cast("double")))
    a = training.ridge_folds(df, ["T1"], "trip", list("abc"), "y")["T1"]
    b = training.ridge_folds(spark.createDataFrame(table), ["T1"], "trip", list("abc"), "y")["T1"]
    np.testing.assert_allclose(a[1], b[1], rtol=1e-9)
    assert training.ridge_folds(df.filter("trip = 'T3'"), ["T3"], "trip", list("abc"), "y") == {}


def test_all_folds_take_one_scan_and_one_exchange(spark, table):
    df = spark.createDataFrame(table)
    plan = training.moment_sums(df, ["T1", "T2", "T3"], "trip", list("abcde"), "y", {"T1": 5.0})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan") == 1


def test_velocity_table_shuffles_no_window_over_samples(spark, trip):
    """Samples are exchanged by session and bucket once; only fixes are sorted by session."""
    df = spark.createDataFrame(trip)
    fixes = df.filter("fix").select("session_id", "row_idx")
    plan = training.features_at_fixes(df, fixes)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize(("mean", "own", "noisy", "want"), [(1.0, 1.0, False, 1), (1.0, 1.0, True, 2), (1.0, 9.0, False, 2), (9.0, 1.0, False, 3)])
def test_acceleration_case(spark, mean, own, noisy, want):
    assert spark.range(1).select(acceleration_case(F.lit(mean), F.lit(5.0), F.lit(own), F.lit(5.0), F.lit(noisy))).first()[0] == want
