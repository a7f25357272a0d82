"""Queries against DuckDB on small tables made of cases where the order of float operations decides."""

import duckdb
import pytest

from waymark.plans import registry

#: Points (value, k) of which two roads' ends are equally near but for rounding, or a road turns off by just the gate.
ROAD_POINTS = [(52.87, 60), (11.05, 60), (124.92, 60), (10.35, 60), (50.07, 60), (66.77, 31), (87.93, 32), (46.78, 31), (104.99, 60), (66.2, 31), (18.35, 65)]
#: Windows of 8 k whose variance is 900, in floats 900 or a little less.
VARIANCES = [[22, 8, 46, 32, 73, 67, 79, 1], [10, 3, 65, 53, 9, 66, 79, 31], [79, 72, 29, 10, 6, 75, 56, 25]]
CASES = {
    "q_map_match": [ROAD_POINTS],
    "q_nearest_road": [ROAD_POINTS],
    "q_unwrap": [[(v, 50) for v in (0.0, 245.0, 10.0, 255.0, 400.5, 155.5, 1.0)], [(v, 50) for v in (300.0, 55.0, 300.0, 12.0)]],
    "q_zupt_v2": [[(10.0, k) for k in ks] for ks in VARIANCES],
}


@pytest.mark.parametrize("name", CASES)
def test_matches_sql_at_the_edges(spark, tmp_path, name):
    rows = [(f"TIMESTAMP '2024-01-01' + INTERVAL {i} HOUR", u, v, k) for u, points in enumerate(CASES[name]) for i, (v, k) in enumerate(points)]
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    values = ", ".join(f"({n}::BIGINT, {ts}, {u}::BIGINT, 'click', {v}::DOUBLE, '{{\"k\": {k}}}')" for n, (ts, u, v, k) in enumerate(rows))
    con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {values}) t(event_id, ts, user_id, event_type, value, props)")
    con.execute("CREATE TABLE supplier AS SELECT range AS s_suppkey FROM range(6000)")
    for t in ("events", "supplier"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL[name]}) ORDER BY session_id, row_idx").fetchall()
    assert [tuple(r) for r in df.orderBy("session_id", "row_idx").collect()] == want and len(want) == len(rows)


#: Suppliers and points (value, k) whose distances from two roads are one but for rounding, and pow(a, 2) isn't a * a.
ROUNDED_POWERS = [([200000030, 300000620], (41.9, 30)), (range(6000), (52.376, 60)), (range(6000), (334.9687, 60))]


@pytest.mark.parametrize("keys, point", ROUNDED_POWERS)
def test_nearest_road_of_equals_is_that_of_the_sqls_power(spark, tmp_path, keys, point):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE TABLE events AS SELECT 0::BIGINT AS event_id, TIMESTAMP '2024-01-01' AS ts, 0::BIGINT AS user_id, 'click' AS event_type, {point[0]}::DOUBLE AS value, '{{\"k\": {point[1]}}}' AS props")
    con.execute("CREATE TABLE supplier AS SELECT unnest($1)::BIGINT AS s_suppkey", [list(keys)])
    for t in ("events", "supplier"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df = registry.QUERIES["q_nearest_road"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL['q_nearest_road']})").fetchall()
    assert [tuple(r) for r in df.collect()] == want and want[0][2] is not None
