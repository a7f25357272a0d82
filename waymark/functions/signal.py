"""Small signal expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def deadband(x: Column, threshold: float) -> Column:
    return F.when(F.abs(x) < threshold, F.lit(0.0)).otherwise(x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sane_dt(dt: Column, most: float = 1.0, default: float = 0.1) -> Column:
    """dt, or the default where it isn't in (0, most]."""
    return F.when((dt <= 0) | (dt > most) | dt.isNull(), F.lit(default)).otherwise(dt)


def kmh_to_ms(x: Column) -> Column:
    return x / F.lit(3.6)


def a2_target(ds: Column, t: Column) -> Column:
    """The constant acceleration that gives a displacement."""
    return 2 * ds / (t * t)


def a2_displacement(a: Column, t: Column) -> Column:
    return a * t * t / 2


def mounting_class(gx: Column, gy: Column, gz: Column) -> Column:
    """How a phone lies, from mean gravity."""
    return (
        F.when(F.abs(gz) > 9, F.when(gz > 0, "flat_face_up").otherwise("flat_face_down"))
        .when(F.abs(gy) > 9, F.when(gy > 0, "portrait").otherwise("portrait_upside_down"))
        .when(F.abs(gx) > 9, "landscape")
        .otherwise("tilted")
    )


def growth_class(r1: Column, r2: Column) -> Column:
    return F.when(r2 > 1.1 * r1, "quadratic").when(r2 < 0.9 * r1, "sub-linear").otherwise("linear")


def threshold_rule(p99: Column, least: float, digits: int = 3) -> Column:
    return F.greatest(F.lit(least), F.round(1.25 * p99, digits))


def drop_nan(x: Column) -> Column:
    """NaN as null: Spark's ignoreNulls doesn't skip NaN."""
    return F.when(~F.isnan(x), x)
