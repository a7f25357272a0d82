"""Plane and sphere geometry as column expressions. Headings are radians, 0 is north and pi/2 is east."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
TWO_PI = 2 * math.pi


def wrap_pi(x: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(x + F.lit(math.pi), F.lit(TWO_PI)) - F.lit(math.pi)


def wrap_two_pi(x: Column) -> Column:
    """Into [0, 2 pi)."""
    return F.pmod(x, F.lit(TWO_PI))


def wrap_degrees(x: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(x + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def two_way_difference(a: Column, b: Column) -> Column:
    """The angle between two headings, where a road may be driven either way."""
    held = lambda x: x - F.lit(TWO_PI) * F.floor(x / F.lit(TWO_PI)) - F.lit(math.pi)
    return F.least(F.abs(held(a - b + F.lit(math.pi))), F.abs(held(a - b + F.lit(TWO_PI))))


def circular_error(a: Column, b: Column) -> Column:
    return F.abs(F.atan2(F.sin(a - b), F.cos(a - b)))


def magnitude(*axes: Column) -> Column:
    return F.sqrt(sum((a * a for a in axes[1:]), axes[0] * axes[0]))


def to_east(lat0: Column, lon0: Column, lon: Column) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.radians(lon - lon0) * F.cos(F.radians(lat0))


def to_north(lat0: Column, lat: Column) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.radians(lat - lat0)


def to_latitude(lat0: Column, north: Column) -> Column:
    return lat0 + F.degrees(north / F.lit(EARTH_RADIUS_M))


def to_longitude(lat0: Column, lon0: Column, east: Column) -> Column:
    return lon0 + F.degrees(east / (F.lit(EARTH_RADIUS_M) * F.cos(F.radians(lat0))))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def forward_azimuth(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle bearing from the first point to the second, degrees in [0, 360)."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def bounding_box(lat: Column, lon: Column, radius_m: Column) -> dict[str, Column]:
    d_lat = F.degrees(radius_m / F.lit(EARTH_RADIUS_M))
    d_lon = F.degrees(radius_m / (F.lit(EARTH_RADIUS_M) * F.cos(F.radians(lat))))
    return {"south": lat - d_lat, "north": lat + d_lat, "west": lon - d_lon, "east": lon + d_lon}


def slerp(lat1: Column, lon1: Column, lat2: Column, lon2: Column, share: Column) -> tuple[Column, Column]:
    """The point at a share, held to [0, 1], of the great circle; points closer than 1e-6 radians are joined by a line."""
    f = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    unit = lambda lat, lon: (F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat)))
    p, q = unit(lat1, lon1), unit(lat2, lon2)
    angle = haversine(lat1, lon1, lat2, lon2) / F.lit(EARTH_RADIUS_M)
    a, b = F.sin((1 - f) * angle) / F.sin(angle), F.sin(f * angle) / F.sin(angle)
    x, y, z = (a * u + b * v for u, v in zip(p, q, strict=True))
    near = angle < 1e-6
    lat = F.when(near, lat1 + f * (lat2 - lat1)).otherwise(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))))
    lon = F.when(near, lon1 + f * (lon2 - lon1)).otherwise(F.degrees(F.atan2(y, x)))
    return lat, lon


def clamp_projection(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column]:
    """(x, y, distance) of the point of a segment nearest to p."""
    dx, dy = x2 - x1, y2 - y1
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
    a, b = px - x1 - t * dx, py - y1 - t * dy
    return x1 + t * dx, y1 + t * dy, F.sqrt(a * a + b * b)


def rotation_columns(azimuth: Column, pitch: Column, roll: Column) -> list[Column]:
    """Rz * Rx * Ry row by row, angles in radians."""
    ca, sa, cp, sp, cr, sr = F.cos(azimuth), F.sin(azimuth), F.cos(pitch), F.sin(pitch), F.cos(roll), F.sin(roll)
    return [ca * cr - sa * sp * sr, -sa * cp, ca * sr + sa * sp * cr, sa * cr + ca * sp * sr, ca * cp, sa * sr - ca * sp * cr, -cp * sr, sp, cp * cr]


def vehicle_frame(ax: Column, ay: Column, az: Column, gx: Column, gy: Column, gz: Column, wx: Column, wy: Column, wz: Column, yaw_rad: Column) -> dict[str, Column]:
    """Forward, lateral and vertical acceleration and yaw rate.

    Up is the unit gravity vector, or (0, 0, 1) where gravity is under 1e-4. Acceleration's horizontal part is turned by
    the mounting yaw; the yaw rate is the turn rate about up.
    """
    g = magnitude(gx, gy, gz)
    ux, uy, uz = (F.when(g < 1e-4, F.lit(d)).otherwise(c / g) for c, d in ((gx, 0.0), (gy, 0.0), (gz, 1.0)))
    vertical = ax * ux + ay * uy + az * uz
    hx, hy = ax - vertical * ux, ay - vertical * uy
    return {
        "acc_veh_fwd": hx * F.cos(yaw_rad) + hy * F.sin(yaw_rad),
        "acc_veh_lat": hy * F.cos(yaw_rad) - hx * F.sin(yaw_rad),
        "acc_veh_vert": vertical,
        "gyro_veh_yaw_rate": wx * ux + wy * uy + wz * uz,
    }
