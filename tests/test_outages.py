"""Outage candidates, the windows chosen from them, and stationary windows, against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.operators import aggregates, edge, outage


def test_candidates_and_choice(spark):
    rng = np.random.default_rng(5)
    rows = []
    for session, n in ((1, 200), (2, 57), (3, 12)):
        fix = rng.random(n) < 0.2
        rows += [(session, k, 0.1 + 0.01 * rng.random(), float(rng.uniform(0, 6)), bool(fix[k])) for k in range(n)]
    df = pd.DataFrame(rows, columns=["session_id", "row_idx", "dt", "v", "fix"])
    found = outage.outage_candidates(spark.createDataFrame(df), "t", "v", "fix", [0.55, 1.0, 4.0])
    want = set()
    for session, own in df.groupby("session_id"):
        n, step = len(own), own["dt"].median()
        fixes = own.loc[own["fix"], "row_idx"].to_numpy()
        for duration in (0.55, 1.0, 4.0):
            length, margin = int(duration / step), int(0.1 * n)
            for start in fixes:
                if own["v"].iloc[start] > 2 and margin <= start <= n - length - margin and start + length < n:
                    end = fixes[min(np.searchsorted(fixes, start + length), len(fixes) - 1)]
                    want.add((session, duration, int(start), int(end)))
    assert want and {tuple(r) for r in found.collect()} == want


def test_chosen_windows(spark):
    """Disjoint, at most so many; what was refused meets a window of an earlier priority or comes after the last that was taken."""
    rng = np.random.default_rng(6)
    rows = {(s, d, int(a), int(a + rng.integers(1, 40))) for s in range(6) for d in (1.0, 5.5) for a in rng.integers(0, 300, 60)}
    df = spark.createDataFrame(sorted(rows), "session_id bigint, duration_s double, start_row bigint, end_row bigint")
    order = {tuple(r)[:4]: r["o"] for r in df.withColumn("o", outage.choice_order(7)).collect()}
    for most in (3, 100):
        chosen = outage.choose_apart(df.repartition(5), most, 7).collect()
        assert {tuple(r) for r in chosen} == {tuple(r) for r in outage.choose_apart(df.union(df), most, 7).collect()}
        groups = {}
        for r in chosen:
            groups.setdefault((r.session_id, r.duration_s), []).append((r.start_row, r.end_row, r.window_idx))
        for (s, d), own in groups.items():
            own.sort()
            assert [k for *_, k in own] == list(range(len(own))) and len(own) <= most
            assert all(x[1] < y[0] for x, y in zip(own, own[1:], strict=False))
            taken = {(a, b): order[s, d, a, b] for a, b, _ in own}
            for _, _, a, b in (r for r in rows if r[:2] == (s, d) and r[2:] not in taken):
                earlier = [x for x, o in taken.items() if o < order[s, d, a, b]]
                assert any(not (b < x or a > y) for x, y in earlier) or len(earlier) == most
    same = [sorted((a, b) for s, d, a, b, _ in map(tuple, chosen) if (s, d) == key) for key in ((0, 1.0), (0, 5.5))]
    assert same[0] != same[1]


def test_stationary_windows_need_quiet_rows_at_their_end(spark):
    """Eight quiet rows count only where they end the window; half of the rows count anywhere."""
    quiet = {0: range(9, 21), 1: range(8), 2: range(14, 21), 3: range(21)}  # rows of a window, of 21
    rows = []
    for session, still in quiet.items():
        for k in range(21):
            a = 0.1 if k in still else 9.0
            rows.append((session, k, a, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.1))
    names = ["session_id", "row_idx", "acc_lin_x", "acc_lin_y", "acc_lin_z", "gyro_x", "gyro_y", "gyro_z", "acc_veh_fwd", "gyro_veh_yaw_rate", "dt_sec"]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=names))
    found = {r.session_id: r for r in edge.window_physics(df, 21).withColumn("is_still", edge.is_stationary()).collect()}
    assert {s: r.n_tail for s, r in found.items()} == {0: 12, 1: 0, 2: 7, 3: 21}
    assert {s: r.is_still for s, r in found.items()} == {0: True, 1: False, 2: False, 3: True}


@pytest.mark.parametrize(("few", "bins"), [(4096, 1024), (1, 2), (7, 3)])
def test_selected_percentiles_are_the_exact_ones(spark, few, bins):
    rng = np.random.default_rng(8)
    values = {"even": rng.normal(size=500), "ties": rng.integers(0, 4, 300).astype(float), "one": np.array([3.5]), "wide": np.r_[-1e300, 1e300, rng.normal(size=97)], "same": np.full(50, 2.0), "nan": np.r_[np.full(5, np.nan), rng.normal(size=11)]}
    df = spark.createDataFrame(pd.DataFrame([(g, v) for g, own in values.items() for v in own], columns=["g", "v"])).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    names = [f"p{p}" for p in aggregates.PERCENTILES]
    got = {r.g: [r[c] for c in names] for r in aggregates.selected_percentiles(df.repartition(3), "v", by="g", bins=bins, few=few).collect()}
    want = {r.g: [r[c] for c in names] for r in df.groupBy("g").agg(*aggregates.percentiles("v")).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-14, abs=1e-300), g
    whole = aggregates.selected_percentiles(df.filter("g != 'wide'"), "v", bins=bins, few=few).first()
    assert [whole[c] for c in names] == pytest.approx(list(df.filter("g != 'wide'").agg(*aggregates.percentiles("v")).first()), rel=1e-14)
    assert aggregates.selected_percentiles(df.limit(0), "v", by="g").collect() == []
