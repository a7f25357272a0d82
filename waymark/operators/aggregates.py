"""Aggregates of profiles, evaluations and reports."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.operators.windows import ordered, run_lengths


def null_counts(df: DataFrame) -> DataFrame:
    """One row for each column: its nulls (NaN counts) and their percentage. One pass; the rows come from a map of the sums."""
    kinds = dict(df.dtypes)
    missing = {c: F.col(f"`{c}`").isNull() | (F.isnan(F.col(f"`{c}`")) if kinds[c] in ("double", "float") else F.lit(False)) for c in df.columns}
    sums = df.agg(F.count("*").alias("n_rows"), *(F.sum(m.cast("bigint")).alias(f"m{k}") for k, m in enumerate(missing.values())))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"m{k}").alias("n_null")) for k, c in enumerate(df.columns))))
    return sums.select("n_rows", cells.alias("c")).select("c.column_name", "c.n_null", (100.0 * F.col("c.n_null") / F.col("n_rows")).alias("null_pct"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat another in all columns."""
    return df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))


def first_of_each(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Rows without repetitions, each with the first place it was seen."""
    return df.groupBy(*columns).agg(F.min(order).alias(order))


def dt_profile(df: DataFrame, dt_ms: str, by: str) -> DataFrame:
    """Sampling statistics of a session; irregular if the deviation is over 20 ms or the median isn't in [80, 120]."""
    d = F.col(dt_ms)
    rows = df.groupBy(by).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_dt"), F.stddev_pop(d).alias("std_dt"), F.min(d).alias("min_dt"), F.max(d).alias("max_dt"),
        F.median(d).alias("median_dt"), (100 * F.avg(F.when(F.abs(d - 100) <= 20, 1.0).otherwise(F.when(d.isNotNull(), 0.0)))).alias("pct_regular"),
    )
    return rows.withColumn("irregular", (F.col("std_dt") > 20) | ~F.col("median_dt").between(80, 120))


def range_check(df: DataFrame, ranges: Sequence[tuple[str, float, float]]) -> DataFrame:
    """For each (column, low, high): least and greatest value and whether both are inside. Null where there are no values."""
    sums = df.agg(*(x for k, (c, _, _) in enumerate(ranges) for x in (F.min(c).cast("double").alias(f"lo{k}"), F.max(c).cast("double").alias(f"hi{k}"))))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"lo{k}").alias("least"), F.col(f"hi{k}").alias("greatest"), ((F.col(f"lo{k}") >= lo) & (F.col(f"hi{k}") <= hi)).alias("in_range")) for k, (c, lo, hi) in enumerate(ranges))))
    return sums.select(cells.alias("c")).select("c.*")


def run_length_stats(df: DataFrame, columns: Sequence[str], by: str, order: str, rate_hz: float = 10.0) -> DataFrame:
    """Statistics of the runs of equal values; a session that never changes has one run and no estimated rate."""
    runs = run_lengths(df, columns, by, order)
    rows = runs.groupBy(by).agg(F.count("*").alias("n_runs"), F.median("n").alias("median_run"), F.avg("n").alias("mean_run"), F.max("n").alias("max_run"), F.min("n").alias("min_run"))
    return rows.withColumn("est_hz", F.when(F.col("n_runs") > 1, rate_hz / F.col("median_run")))


def session_manifest(df: DataFrame, by: str, time: str, flag: str, dt: str) -> DataFrame:
    rows = df.groupBy(by).agg(F.count("*").alias("rows"), (F.max(time) - F.min(time)).alias("duration_sec"), F.sum(F.col(flag).cast("bigint")).alias("gnss_fixes"), (F.avg(dt) * 1000).alias("mean_dt_ms"))
    return rows.withColumns({"duration_min": F.col("duration_sec") / 60, "fix_rate_hz": F.when(F.col("duration_sec") > 0, F.col("gnss_fixes") / F.col("duration_sec")).otherwise(F.lit(0.0))})


def error_summary(truth: Column, guess: Column) -> list[Column]:
    e = guess - truth
    return [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.median(F.abs(e)).alias("median_ae"), F.avg(e).alias("bias"), F.max(F.abs(e)).alias("max_ae")]


def path_length(df: DataFrame, east: str, north: str, by: str, order: str) -> DataFrame:
    """Length of the polyline; 1.0 with fewer than two points."""
    w = ordered(by, order)
    step = F.sqrt(F.pow(F.col(east) - F.lag(east).over(w), F.lit(2.0)) + F.pow(F.col(north) - F.lag(north).over(w), F.lit(2.0)))
    return df.withColumn("_s", step).groupBy(by).agg(F.coalesce(F.sum("_s"), F.lit(1.0)).alias("path_m"))


def drift_percent(error: Column, distance: Column, least: float = 1.0) -> Column:
    return 100 * error / F.greatest(F.lit(least), distance)


def improvement_percent(base: Column, new: Column) -> Column:
    return F.when(base != 0, 100 * (base - new) / base)


def along_cross(de: Column, dn: Column, te: Column, tn: Column, heading: Column) -> dict[str, Column]:
    """The error (de, dn) along and across the true displacement, or the true heading where it's under 1e-3."""
    size = F.sqrt(te * te + tn * tn)
    ue, un = F.when(size > 1e-3, te / size).otherwise(F.sin(heading)), F.when(size > 1e-3, tn / size).otherwise(F.cos(heading))
    return {"along_track": de * ue + dn * un, "cross_track": de * un - dn * ue}


def guarded_corr(x: str, y: str, least: float = 1e-4) -> Column:
    """Pearson's r, 0 where either deviation isn't over least."""
    return F.when((F.stddev_pop(x) > least) & (F.stddev_pop(y) > least), F.corr(x, y)).otherwise(F.lit(0.0))


def quadratic_fit(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Least-squares c2 x^2 + c1 x + c0 by power sums of centred x, solved by Cramer's rule; null where x has under three values."""
    centred = df.withColumn("_u", F.col(x) - F.avg(x).over(Window.partitionBy(by)))
    u, v = F.col("_u"), F.col(y)
    p = lambda k: F.sum(F.pow(u, F.lit(float(k)))) if k else F.count(u).cast("double")
    sums = centred.groupBy(by).agg(*(p(k).alias(f"s{k}") for k in range(5)), *(F.sum(v * F.pow(u, F.lit(float(k)))).alias(f"t{k}") for k in range(3)), F.avg(x).alias("mx"), F.countDistinct(u).alias("n_x"))
    s = [F.col(f"s{k}") for k in range(5)]
    t = [F.col(f"t{k}") for k in range(3)]
    det = lambda a, b, c: a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    rows = [(s[4], s[3], s[2]), (s[3], s[2], s[1]), (s[2], s[1], s[0])]
    right = (t[2], t[1], t[0])
    base = det(*rows)
    own = [det(*(tuple(right[i] if j == k else row[j] for j in range(3)) for i, row in enumerate(rows))) / base for k in range(3)]
    ok = F.col("n_x") >= 3
    m = F.col("mx")
    return sums.select(by, F.when(ok, own[0]).alias("c2"), F.when(ok, own[1] - 2 * own[0] * m).alias("c1"), F.when(ok, own[2] - own[1] * m + own[0] * m * m).alias("c0"))


def yaw_alignment(df: DataFrame, ax: str, ay: str, truth: str, by: str, least_rows: int = 100, step_deg: int = 1) -> DataFrame:
    """The mounting yaw in [-180, 180] at which ax cos + ay sin correlates best with truth; of equals the first.

    The correlation at any angle follows from ten sums, so each session is read once; 361 small rows follow. Sessions with
    fewer rows get yaw 0 and correlation 0.
    """
    x, y, g = F.col(ax), F.col(ay), F.col(truth)
    sums = df.groupBy(by).agg(
        F.count(g).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(g).alias("sg"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
        F.sum(x * g).alias("sxg"), F.sum(y * g).alias("syg"), F.sum(g * g).alias("sgg"),
    )
    rows = sums.withColumn("deg", F.explode(F.sequence(F.lit(-180), F.lit(180), F.lit(step_deg))))
    c, s = F.cos(F.radians(F.col("deg").cast("double"))), F.sin(F.radians(F.col("deg").cast("double")))
    n = F.col("n")
    cov = (c * F.col("sxg") + s * F.col("syg")) / n - (c * F.col("sx") + s * F.col("sy")) / n * F.col("sg") / n
    var = (c * c * F.col("sxx") + 2 * c * s * F.col("sxy") + s * s * F.col("syy")) / n - F.pow((c * F.col("sx") + s * F.col("sy")) / n, F.lit(2.0))
    var_g = F.col("sgg") / n - F.pow(F.col("sg") / n, F.lit(2.0))
    rows = rows.withColumn("r", F.when((var > 1e-8) & (var_g > 1e-8), cov / F.sqrt(var * var_g)).otherwise(F.lit(0.0)))
    best = rows.groupBy(by).agg(F.max_by("deg", F.struct(F.round("r", 12), -F.col("deg"))).alias("yaw"), F.max("r").alias("r"), F.max("n").alias("n"))
    enough = F.col("n") >= least_rows
    return best.select(by, F.when(enough, F.col("yaw")).otherwise(F.lit(0)).cast("double").alias("mounting_yaw_deg"), F.when(enough, F.col("r")).otherwise(F.lit(0.0)).alias("alignment_corr"))


def stationary_bias(samples: DataFrame, mask: str, column: str, by: str, least: int = 50, limit: float = 0.1) -> DataFrame:
    """Mean of the column over stationary rows, held to +-limit; 0 with fewer than `least` of them."""
    own = F.when(F.col(mask), F.col(column))
    mean = F.least(F.greatest(F.avg(own), F.lit(-limit)), F.lit(limit))
    return samples.groupBy(by).agg(F.count(own).alias("n_stationary"), F.when(F.count(own) >= least, mean).otherwise(F.lit(0.0)).alias("bias"))


def zupt_false_positives(df: DataFrame, mask: str, speed_kmh: str, by: str) -> DataFrame:
    """How often stationary rows are faster than 5 and 10 km/h, and their mean and greatest speed; 0 without any."""
    own = F.when(F.col(mask), F.col(speed_kmh))
    share = lambda limit: 100 * F.avg(F.when(own > limit, 1.0).when(own.isNotNull(), 0.0))
    return df.groupBy(by).agg(F.count(own).alias("n_zupt"), *(F.coalesce(x, F.lit(0.0)).alias(name) for name, x in (("fp5_pct", share(5)), ("fp10_pct", share(10)), ("mean_kmh", F.avg(own)), ("max_kmh", F.max(own)))))


def top_k(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(value), tie).limit(k)


def expected_drift(seconds: Column, degrees_per_hour: float = 188.32) -> Column:
    return degrees_per_hour * seconds / 3600


def noise_amplification(seconds: Column, position_noise_m: float = 5.0) -> Column:
    """Acceleration noise that a position's noise makes over a segment."""
    return 2 * position_noise_m / (seconds * seconds)


PERCENTILES = (1, 5, 25, 50, 75, 95, 99)


def percentiles(column: str, points: Sequence[float] = PERCENTILES) -> list[Column]:
    """Exact, with linear interpolation."""
    return [F.percentile(column, F.lit(p / 100)).alias(f"p{p:g}") for p in points]



def selected_percentiles(df: DataFrame, column: str, points: Sequence[float] = PERCENTILES, by: str | None = None, bins: int = 1024, few: int = 4096) -> DataFrame:
    """Exact percentiles with linear interpolation of few, very large groups: (by, p1, p5, ...), or one row without by.

    F.percentile keeps all distinct values of a group in one buffer. Here each percentile's bracket is cut into bins that
    Spark counts, and narrowed to the bin that its rank falls in, until few values are left, or equal ones; those are
    fetched and ranked. Each round is a scan and a small aggregate; brackets are the groups' times the percentiles'.
    Nulls and NaN don't count; a group without a value isn't in the result. df is read once a round: keep it, if it's costly.
    """
    spark, x = df.sparkSession, F.col(column).cast("double")
    key = F.col(by) if by else F.lit(0)
    rows = df.select(key.alias("_g"), x.alias("_x")).filter("_x IS NOT NULL AND NOT isnan(_x)")
    # (group, rank) -> the bracket's ends, both in it, the values below it, and the values in it.
    ends = {r["_g"]: r for r in rows.groupBy("_g").agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).collect()}
    places = {(g, p): (r.n - 1) * p / 100 for g, r in ends.items() for p in points}
    brackets = {(g, k): (ends[g].lo, ends[g].hi, 0, ends[g].n) for (g, _), at in places.items() for k in {math.floor(at), math.ceil(at)}}
    kind = df.schema[by].dataType.simpleString() if by else "int"
    found: dict[tuple, float] = {}
    while open_ones := {b: v for b, v in brackets.items() if b not in found and v[0] < v[1] and v[3] > few}:
        spans = sorted({(g, *v[:2]) for (g, _), v in open_ones.items()}, key=str)
        narrow = F.broadcast(spark.createDataFrame(spans, f"_g {kind}, lo double, hi double"))  # a row for each percentile of each group at most
        met = rows.join(narrow, "_g").filter("_x >= lo AND _x <= hi")
        share = F.least(F.lit(bins - 1), F.floor((F.col("_x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins))
        counts: dict[tuple, list] = {}
        for r in met.groupBy("_g", "lo", "hi", share.alias("bin")).agg(F.count("*").alias("n"), F.min("_x").alias("a"), F.max("_x").alias("b")).collect():
            counts.setdefault((r["_g"], r.lo, r.hi), []).append((r.a, r.b, r.n))
        for (g, k), (lo, hi, below, _) in open_ones.items():
            for a, b, n in sorted(counts[g, lo, hi]):
                if k < below + n:
                    brackets[g, k] = (a, b, below, n)
                    break
                below += n
    found |= {b: v[0] for b, v in brackets.items() if v[0] == v[1]}
    rest = sorted({(g, *v[:2]) for (g, k), v in brackets.items() if (g, k) not in found}, key=str)
    if rest:  # at most `few` values for each
        narrow = F.broadcast(spark.createDataFrame(rest, f"_g {kind}, lo double, hi double"))
        values = {(r["_g"], r.lo, r.hi): r.v for r in rows.join(narrow, "_g").filter("_x >= lo AND _x <= hi").groupBy("_g", "lo", "hi").agg(F.sort_array(F.collect_list("_x")).alias("v")).collect()}
        found |= {(g, k): values[g, v[0], v[1]][k - v[2]] for (g, k), v in brackets.items() if (g, k) not in found}

    def between(g, at: float) -> float:
        low, high = math.floor(at), math.ceil(at)
        return found[g, low] if low == high else (high - at) * found[g, low] + (at - low) * found[g, high]

    out = [((g,) if by else ()) + tuple(between(g, places[g, p]) for p in points) for g in ends]
    return spark.createDataFrame(out, ", ".join(([f"`{by}` {kind}"] if by else []) + [f"p{p:g} double" for p in points]))
