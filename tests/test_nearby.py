"""Roads about points by cells: against plain loops, and with no row for a pair in any plan."""

import numpy as np
import pandas as pd
import pytest

from waymark.operators import fusion, joins, nearby


@pytest.fixture
def town(spark):
    """Ways of 1 to 3 segments in a small square, many of one shape, and points in it; a point without a place."""
    rng = np.random.default_rng(5)
    shapes = [rng.uniform(0, 120, (rng.integers(2, 5), 2)) for _ in range(60)]
    roads = []
    for way in range(150):
        p = shapes[way % 60]
        roads += [(way, i, *map(float, (*p[i], *p[i + 1])), float(np.arctan2(*(p[i + 1] - p[i])))) for i in range(len(p) - 1)]
    roads = pd.DataFrame(roads, columns=["way_id", "seg_idx", "e1", "n1", "e2", "n2", "heading"])
    points = pd.DataFrame({"id": range(700), "x": rng.uniform(-40, 160, 700), "y": rng.uniform(-40, 160, 700), "heading": rng.uniform(-4, 4, 700)})
    given = spark.createDataFrame(points).union(spark.sql("SELECT 700L, NULL, 1D, 1D"))
    return points, roads, given, spark.createDataFrame(roads)


@pytest.mark.parametrize("by_score", [True, False])
def test_map_match_is_the_plain_search(town, by_score):
    points, roads, given, segments = town
    df = joins.map_match(given, segments, ["id"], 20.0, np.radians(40), by_score)
    got = {r.id: r for r in df.collect()}
    assert len(got) == 701 and got[700].way_id is None
    de, dn = roads.e2 - roads.e1, roads.n2 - roads.n1
    matched = 0
    for p in points.itertuples():
        part = np.clip(((p.x - roads.e1) * de + (p.y - roads.n1) * dn) / (de**2 + dn**2), 0, 1)
        dist = np.sqrt((p.x - roads.e1 - part * de) ** 2 + (p.y - roads.n1 - part * dn) ** 2)
        off = np.abs((p.heading - roads.heading + np.pi) % (2 * np.pi) - np.pi)
        turn = np.minimum(off, np.pi - off)
        score = (dist * (1 + turn / np.radians(40)) if by_score else dist).where((dist <= 20) & (turn <= np.radians(40)), np.inf)
        if np.isinf(score.min()):
            assert got[p.Index].way_id is None and got[p.Index].dist is None
            continue
        k, matched = int(score.argmin()), matched + 1
        assert (got[p.Index].way_id, got[p.Index].seg_idx) == (roads.way_id[k], roads.seg_idx[k]) and abs(got[p.Index].dist - dist[k]) < 1e-9
    assert matched > 200


def test_no_row_for_a_pair(spark, town):
    """No operator after the search has points and roads in rows of their own: pairs neither sort nor spill."""
    points, _, given, segments = town
    plan = joins.map_match(given, segments, ["id"], 20.0)._jdf.queryExecution().executedPlan().toString()
    above = plan.partition("MapInArrow")[0]
    assert "MapInArrow" in plan and "Aggregate" not in above and "Exchange" not in above and "Join" not in above


def test_counts_are_those_of_the_lists(town, monkeypatch):
    monkeypatch.setattr(nearby, "CHUNK", 16)
    points, _, given, segments = town
    boxes = given.selectExpr("id", "x AS e_lo", "x AS e_hi", "y AS n_lo", "y AS n_hi").filter("e_lo IS NOT NULL")
    want = {r.id: r.roads for r in joins.roads_near(boxes, segments, ["id"], 15.0, 30.0).collect()}
    got = {r.id: r for r in joins.count_roads_near(given, segments, ["id"], 15.0, 10.0).collect()}
    assert got.keys() == want.keys() and len(got) > 300
    for k, r in got.items():
        assert (r.n_roads, r.way_sum) == (len(want[k]), sum(x.way_id for x in want[k])) and abs(r.heading_sum - sum(x.heading for x in want[k])) < 1e-9


def test_outages_of_a_cell_share_a_list(spark, town, monkeypatch):
    """The same states as with a list for each outage."""
    monkeypatch.setattr(nearby, "PAIRS", 500)
    rng = np.random.default_rng(6)
    points, _, given, segments = town
    rows = [(i % 7, i, k, *map(float, rng.normal(0, 0.5, 3)), 0.1, bool(rng.random() < 0.3), float(rng.uniform(0, 9)), p.x, p.y, 5.0, p.heading, 0.0, 0.0, 0.0, False) for i, p in enumerate(points.head(200).itertuples()) for k in range(1, 6 + i % 20)]
    names = ["session_id", "outage_id", "row_idx", "fwd", "lat", "yaw", "dt", "still", "speed", "e0", "n0", "v0", "psi0", "b_fwd", "b_lat", "b_yaw", "calibrated"]
    own = spark.createDataFrame(rows, names)
    boxes = own.selectExpr("session_id", "outage_id", "e0 AS e_lo", "e0 AS e_hi", "n0 AS n_lo", "n0 AS n_hi").distinct()
    keys = ["session_id", "outage_id"]
    want = fusion.fuse_outages(own, joins.roads_near(boxes, segments, keys, 15.0, 30.0)).toPandas().sort_values(keys)
    got = fusion.fuse_outages_by_cell(own, segments, 15.0, 10.0).toPandas().sort_values(keys)
    assert len(got) == 200
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), atol=1e-9)
    blind = fusion.fuse_outages(own).toPandas().sort_values(keys)
    assert (np.abs(blind["psi"].to_numpy() - got["psi"].to_numpy()) > 1e-6).sum() > 50
    assert fusion.fuse_outages_by_cell(own.limit(0), segments, 15.0, 10.0).count() == 0
