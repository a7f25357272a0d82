"""Alignment of time series, range joins and map matching."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.geo import to_east, to_north
from waymark.operators import nearby


def _tagged(left: DataFrame, right: DataFrame, by: str, time: str, values: Sequence[str]) -> DataFrame:
    """Both sides in one table; _right is the right row where there is one."""
    keep = left.columns
    a = left.select(*keep, F.lit(None).cast(right.select(F.struct(time, *values)).dtypes[0][1]).alias("_right"))
    b = right.select(*((F.col(c) if c in (by, time) else F.lit(None).cast(dict(left.dtypes)[c])).alias(c) for c in keep), F.struct(time, *values).alias("_right"))
    return a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(0)))


def asof_backward(left: DataFrame, right: DataFrame, by: str, time: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the last right row at or before its time. One exchange, no join: an ignore-nulls window."""
    w = Window.partitionBy(by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = _tagged(left, right, by, time, values).withColumn("_hit", F.last("_right", ignorenulls=True).over(w))
    return rows.filter("_side = 1").select(*left.columns, *(F.col("_hit")[v].alias(v) for v in values))


def asof_nearest(left: DataFrame, right: DataFrame, by: str, time: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the right row nearest in time, of two equally near the earlier."""
    back = Window.partitionBy(by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(time, F.desc("_side")).rowsBetween(0, Window.unboundedFollowing)
    rows = _tagged(left, right, by, time, values).withColumns({"_b": F.last("_right", ignorenulls=True).over(back), "_a": F.first("_right", ignorenulls=True).over(ahead)})
    nearer = F.when(F.col("_b").isNull() | ((F.col("_a")[time] - F.col(time)) < (F.col(time) - F.col("_b")[time])), F.coalesce("_a", "_b")).otherwise(F.col("_b"))
    return rows.filter("_side = 1").withColumn("_hit", nearer).select(*left.columns, *(F.col("_hit")[v].alias(v) for v in values))


def interpolate(left: DataFrame, right: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """left with the right side's value at its time, by a line between the points around it; the end values beyond the ends."""
    back = Window.partitionBy(by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(time, F.desc("_side")).rowsBetween(0, Window.unboundedFollowing)
    rows = _tagged(left, right, by, time, [value]).withColumns({"_b": F.last("_right", ignorenulls=True).over(back), "_a": F.first("_right", ignorenulls=True).over(ahead)})
    t0, t1, v0, v1 = F.col("_b")[time], F.col("_a")[time], F.col("_b")[value], F.col("_a")[value]
    line = F.when(t1 > t0, v0 + (v1 - v0) * (F.col(time) - t0) / (t1 - t0)).otherwise(v0)
    return rows.filter("_side = 1").select(*left.columns, F.coalesce(line, v0, v1).alias(value))


def snap_rows(flag: Column, by: str = "session_id", order: str = "row_idx") -> tuple[Column, Column]:
    """(last flagged row at or before this one, first at or after), held to the first and last flagged row."""
    own = F.when(flag, F.col(order))
    w = Window.partitionBy(by).orderBy(order)
    whole = Window.partitionBy(by)
    before = F.max(own).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(own).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(before, F.min(own).over(whole)), F.coalesce(after, F.max(own).over(whole))


def range_join(samples: DataFrame, ranges: DataFrame, by: str, order: str, low: str, high: str, bucket: int) -> DataFrame:
    """samples in (low, high] of ranges. Ranges are cut into buckets, so it's an equi-join: neither side need be small."""
    cut = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    own = samples.withColumn("_bucket", F.floor(F.col(order) / bucket))
    return own.join(cut, [by, "_bucket"]).filter((F.col(order) > F.col(low)) & (F.col(order) <= F.col(high))).drop("_bucket")


def road_segments(ways: DataFrame, lat0: float, lon0: float, least_m: float = 1.0) -> DataFrame:
    """Segments (way_id, seg_idx, e1, n1, e2, n2, heading, length_m) of ways (way_id, points: array of (lat, lon))."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda i: F.struct(i.alias("i"), F.get("points", i).alias("a"), F.get("points", i + 1).alias("b")))
    rows = ways.filter(F.size("points") >= 2).withColumn("_p", F.explode(pairs))
    la, lo = F.lit(lat0), F.lit(lon0)
    east, north = lambda p: to_east(la, lo, F.col(f"_p.{p}.lon")), lambda p: to_north(la, F.col(f"_p.{p}.lat"))
    rows = rows.select("way_id", F.col("_p.i").alias("seg_idx"), east("a").alias("e1"), north("a").alias("n1"), east("b").alias("e2"), north("b").alias("n2"))
    de, dn = F.col("e2") - F.col("e1"), F.col("n2") - F.col("n1")
    return rows.withColumns({"heading": F.atan2(de, dn), "length_m": F.sqrt(de * de + dn * dn)}).filter(F.col("length_m") >= least_m)


def map_match(points: DataFrame, segments: DataFrame, point_id: Sequence[str], gate_m: float = 25.0, gate_rad: float = math.radians(30), by_score: bool = True) -> DataFrame:
    """points (with x, y, heading) and their best segment's values, null where none is within both gates.

    Points and segments meet in cells of a grid, points as arrays, a segment in every cell of its box, grown by the gate;
    pairs exist only within a task. by_score: the least of distance * (1 + turn / gate), gates inclusive; else the least
    distance, strictly under the gate. Of equally good ones the first by way_id and seg_idx.
    """
    cell_m = gate_m * 0.3
    kinds = {f.name: f for f in segments.schema}
    found = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in ("way_id", "seg_idx")) + ", snap_x double, snap_y double, dist double, road_heading double"
    chunks = nearby.by_cell(points, point_id, F.col("x"), F.col("y"), cell_m)
    return nearby.search(chunks, nearby.segments_of_cells(segments, cell_m, gate_m), points.schema.fields, found, lambda p, r: nearby.match_points(p, r, gate_m, gate_rad, by_score))


def count_roads_near(points: DataFrame, segments: DataFrame, key: Sequence[str], margin_m: float = 1000.0, cell_m: float = 1000.0) -> DataFrame:
    """(*key, n_roads, way_sum, heading_sum) of the roads that roads_near lists for a point's box; points: key, x, y. No list is made."""
    kept = [f for f in points.schema if f.name in key]
    chunks = nearby.by_cell(points.select(*key, "x", "y"), key, F.col("x"), F.col("y"), cell_m)
    found = nearby.search(chunks, nearby.ways_of_cells(segments, cell_m, margin_m), kept, "n_roads bigint, way_sum bigint, heading_sum double", lambda p, r: nearby.count_roads(p, r, margin_m))
    return found.filter("n_roads IS NOT NULL").select(*key, "n_roads", "way_sum", "heading_sum")


def roads_near(boxes: DataFrame, segments: DataFrame, key: Sequence[str], margin_m: float = 1000.0, cell_m: float = 1000.0) -> DataFrame:
    """(*key, roads: array of (e1, n1, e2, n2, heading) by way_id, seg_idx): all segments of each way that meets a box grown by the margin.

    boxes: key, e_lo, e_hi, n_lo, n_hi. Boxes and segments are entered in all cells of a grid that they meet; a pair counts in
    the lowest cell that both have, so it is found once. Boxes without roads have no row.
    """
    cell = lambda c: F.floor(c / cell_m)

    def entered(df: DataFrame, e_lo: Column, e_hi: Column, n_lo: Column, n_hi: Column, tag: str) -> DataFrame:
        df = df.withColumns({f"_e{tag}": e_lo, f"_f{tag}": e_hi, f"_n{tag}": n_lo, f"_o{tag}": n_hi})
        df = df.withColumn("_cx", F.explode(F.sequence(cell(F.col(f"_e{tag}")), cell(F.col(f"_f{tag}")))))
        return df.withColumn("_cy", F.explode(F.sequence(cell(F.col(f"_n{tag}")), cell(F.col(f"_o{tag}")))))

    b = entered(boxes.select(*key, "e_lo", "e_hi", "n_lo", "n_hi"), F.col("e_lo") - margin_m, F.col("e_hi") + margin_m, F.col("n_lo") - margin_m, F.col("n_hi") + margin_m, "b")
    s = entered(segments.select("way_id", "e1", "n1", "e2", "n2"), F.least("e1", "e2"), F.greatest("e1", "e2"), F.least("n1", "n2"), F.greatest("n1", "n2"), "s")
    met = b.join(s, ["_cx", "_cy"]).filter("_es <= _fb AND _fs >= _eb AND _ns <= _ob AND _os >= _nb")
    met = met.filter((F.col("_cx") == cell(F.greatest("_eb", "_es"))) & (F.col("_cy") == cell(F.greatest("_nb", "_ns"))))
    ways = met.select(*key, "way_id").distinct()
    road = F.struct("way_id", "seg_idx", "e1", "n1", "e2", "n2", "heading")
    return ways.join(segments, "way_id").groupBy(*key).agg(F.sort_array(F.collect_list(road)).alias("roads"))


def merge_new(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """existing and those of fresh whose key it lacks."""
    return existing.unionByName(fresh.join(existing.select(key), key, "left_anti").select(*existing.columns))


def resolve_ways(elements: DataFrame) -> DataFrame:
    """(way_id, name, highway, points) of OSM elements (type, id, lat, lon, nodes, tags): ways by their node ids, of known nodes, at least two."""
    nodes = elements.filter("type = 'node'").select(F.col("id").alias("node"), "lat", "lon")
    refs = elements.filter("type = 'way'").select(F.col("id").alias("way_id"), "tags", F.posexplode("nodes").alias("pos", "node"))
    points = refs.join(nodes, "node").groupBy("way_id").agg(F.first("tags").alias("tags"), F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("p"))
    return points.filter(F.size("p") >= 2).select("way_id", F.col("tags.name").alias("name"), F.col("tags.highway").alias("highway"), F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("points"))


def regular_grid(spans: DataFrame, by: str, low: str, high: str, step: float, name: str) -> DataFrame:
    """Times low, low + step, ... under high, for each row of spans."""
    n = F.ceil((F.col(high) - F.col(low)) / step).cast("bigint")
    rows = spans.filter(F.col(high) > F.col(low)).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return rows.select(by, (F.col(low) + F.col("_i") * step).alias(name))


def common_span(sides: Sequence[DataFrame], by: str, time: str) -> DataFrame:
    """For each key the span in which all sides have rows: the latest first time and the earliest last."""
    spans = [s.groupBy(by).agg(F.min(time).alias(f"lo{k}"), F.max(time).alias(f"hi{k}")) for k, s in enumerate(sides)]
    joined = spans[0]
    for s in spans[1:]:
        joined = joined.join(s, by)
    n = range(len(spans))
    pick = lambda f, names: names[0] if len(names) == 1 else f(*names)
    return joined.select(by, pick(F.greatest, [F.col(f"lo{k}") for k in n]).alias("t0"), pick(F.least, [F.col(f"hi{k}") for k in n]).alias("t1"))
