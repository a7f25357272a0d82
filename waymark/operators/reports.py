"""Filters and tables of reports: reliable segments, zero-speed rows, reference values, comparisons, demo frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.geo import to_latitude, to_longitude


def reliable_bearing(distance: Column, v0: Column, v1: Column, least_m: float = 10.0, least_speed: float = 2.0) -> Column:
    """Whether a segment is long and fast enough for its bearing to count."""
    return (distance > least_m) & ((v0 + v1) / 2 > least_speed)


def long_enough(duration: Column, least_s: float = 2.0) -> Column:
    return duration >= least_s


def zero_speed(df: DataFrame, speed: str, by: str | Sequence[str], measures: Sequence[str], limit: float = 0.2, least: int = 50) -> DataFrame:
    """Means of measures over rows slower than limit, for groups with more than `least` of them."""
    keys = [by] if isinstance(by, str) else list(by)
    found = df.filter(F.col(speed) < limit).groupBy(*keys).agg(F.count("*").alias("n_still"), *(F.avg(c).alias(f"mean_{c}") for c in measures))
    return found.filter(F.col("n_still") > least)


def with_reference(df: DataFrame, key: str, values: Mapping[str, float], default: float, name: str = "reference") -> DataFrame:
    """df with a constant looked up by key, or the default. The table of constants is as small as the mapping."""
    known = F.broadcast(df.sparkSession.createDataFrame([(k, float(v)) for k, v in values.items()], f"{key} string, {name} double"))
    return df.join(known, key, "left").withColumn(name, F.coalesce(name, F.lit(float(default))))


def median_of_medians(df: DataFrame, value: str, inner: str | Sequence[str], outer: str | Sequence[str]) -> DataFrame:
    """For each outer group the median of its inner groups' medians."""
    inner, outer = ([x] if isinstance(x, str) else list(x) for x in (inner, outer))
    return df.groupBy(*outer, *inner).agg(F.median(value).alias("_m")).groupBy(*outer).agg(F.count("*").alias("n_groups"), F.median("_m").alias("median_of_medians"))


def sample_deviation(df: DataFrame, value: str, by: str | Sequence[str]) -> DataFrame:
    """Mean and standard deviation with n - 1; null for one row."""
    keys = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def trip_means(df: DataFrame, keys: Sequence[str], errors: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in errors))


def over_rounds(df: DataFrame, by: Sequence[str], improvement: str) -> DataFrame:
    """Mean, least and largest improvement over the rounds of a group, and how many got better."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rounds"), F.avg(improvement).alias("mean"), F.min(improvement).alias("least"), F.max(improvement).alias("largest"), F.sum((F.col(improvement) > 0).cast("bigint")).alias("n_better"))


def comparison(df: DataFrame, by: str, truth: str, estimates: Sequence[str]) -> DataFrame:
    """(by, estimate, total, ratio, mean_error): each estimate's total against the truth's, one row a group and estimate. One pass."""
    aggregates = [x for c in estimates for x in (F.sum(c).alias(f"t_{c}"), F.avg(F.abs(F.col(c) - F.col(truth))).alias(f"e_{c}"))]
    sums = df.groupBy(by).agg(F.sum(truth).alias("_truth"), *aggregates)
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("estimate"), F.col(f"t_{c}").alias("total"), F.col(f"e_{c}").alias("mean_error")) for c in estimates))).alias("x")
    return sums.select(by, "_truth", rows).select(by, "x.estimate", "x.total", (F.col("x.total") / F.nullif("_truth", F.lit(0.0))).alias("ratio"), "x.mean_error")


def match_rate(df: DataFrame, matched: Column, by: str) -> DataFrame:
    """Attempts, and the percentage that matched."""
    return df.groupBy(by).agg(F.count("*").alias("attempts"), (100 * F.avg(matched.cast("double"))).alias("match_rate"))


def demo_frames(df: DataFrame, paths: Mapping[str, tuple[str, str]], time: str, lat0: float, lon0: float, by: str = "session_id", order: str = "row_idx") -> DataFrame:
    """(by, second, path, lat, lon): the first row of each whole second, once for each path of east and north columns."""
    second = F.floor(time).cast("bigint")
    rows = df.withColumn("second", second)
    first = F.row_number().over(Window.partitionBy(by, "second").orderBy(order)) == 1
    rows = rows.withColumn("_first", first).filter("_first")
    places = F.array(*(F.struct(F.lit(p).alias("path"), to_latitude(F.lit(lat0), F.col(n)).alias("lat"), to_longitude(F.lit(lat0), F.lit(lon0), F.col(e)).alias("lon")) for p, (e, n) in paths.items()))
    return rows.select(by, "second", F.explode(places).alias("p")).select(by, "second", "p.path", "p.lat", "p.lon")


def ablation_verdict(with_duration: Column, without: Column, naive: Column) -> Column:
    """Whether a model without its duration features may be kept: from its RMSE, that with them, and the naive one's."""
    gap, rise = naive - without, 100 * (without - with_duration) / with_duration
    return F.when((gap > 20) & (rise < 50), "keep").when((gap > 5) & (rise < 80), "normalise by duration").otherwise("reject")


def acceleration_case(mean_rmse: Column, naive: Column, own_rmse: Column, own_naive: Column, noisy: Column) -> Column:
    """1: beats the naive forecast overall and on the trip of short segments, without noise; 2: overall only, or with noise; 3: not at all."""
    beats, own_beats = mean_rmse < naive, own_rmse < own_naive
    return F.when(beats & own_beats & ~noisy, 1).when(beats, 2).otherwise(3)


def noise_report(df: DataFrame, value: str, seconds: str, own: Column, noise_m: float = 5.0, most_ratio: float = 5.0) -> DataFrame:
    """One row: the deviation of own rows over that of the others, each side's share beyond five deviations of all, the noise
    that a position's error makes at each side's median time and its ratio, and whether the first ratio is over most_ratio.

    Rows with a null, NaN or infinite value don't count. One pass finds the deviation of all, another the rest.
    """
    x = F.col(value)
    fine = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))).withColumn("_own", own)
    limit = fine.agg((5 * F.stddev_pop(value)).alias("_limit"))
    side = lambda flag, c: F.when(F.col("_own") == F.lit(flag), c)
    rows = fine.crossJoin(F.broadcast(limit))  # one row
    far = (F.abs(x) > F.col("_limit")).cast("int")
    parts = {}
    for name, flag in (("own", True), ("other", False)):
        parts[f"sd_{name}"] = F.stddev_pop(side(flag, x))
        parts[f"far_{name}_pct"] = 100 * F.avg(side(flag, far))
        parts[f"noise_{name}"] = 2 * noise_m / F.pow(F.median(side(flag, F.col(seconds))), F.lit(2.0))
    found = rows.agg(*(v.alias(k) for k, v in parts.items()))
    floor = lambda c: F.greatest(F.col(c), F.lit(1e-9))
    found = found.withColumns({"sd_ratio": F.col("sd_own") / floor("sd_other"), "noise_ratio": F.col("noise_own") / floor("noise_other")})
    return found.withColumn("noisy", F.col("sd_ratio") > most_ratio)
