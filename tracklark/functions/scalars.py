"""Scalar functions as column expressions: rounding, angles, planar and geographic geometry, buckets, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a degree of latitude, and in one of longitude at the equator.
LAT_M, LON_M = 110540.0, 111320.0


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x: Column | str) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(col(x) + 0.5)


def quantize_um(metres: Column | str) -> Column:
    """Micrometres, halves away from zero."""
    m = col(metres)
    return (F.signum(m) * F.floor(F.abs(m) * 1e6 + 0.5)).cast("long")


def normalize_deg(a: Column | str) -> Column:
    """[0, 360)"""
    return F.pmod(F.pmod(col(a), F.lit(360.0)) + 360.0, F.lit(360.0))


def wrap_180(a: Column | str) -> Column:
    """(-180, 180]"""
    x = normalize_deg(a)
    return F.when(x > 180, x - 360).otherwise(x)


def bearing_difference(a: Column | str, b: Column | str) -> Column:
    """0 to 180"""
    return F.abs(wrap_180(col(a) - col(b)))


def lerp_deg(a: Column | str, b: Column | str, share: Column | str) -> Column:
    """On the shorter arc."""
    return normalize_deg(col(a) + wrap_180(col(b) - col(a)) * col(share))


def bearing_of(east: Column | str, north: Column | str) -> Column:
    """Degrees clockwise from north; null for a step under a micrometre."""
    e, n = col(east), col(north)
    return F.when(F.hypot(e, n) >= 1e-6, normalize_deg(F.degrees(F.atan2(e, n))))


def to_local(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north in metres of an origin."""
    return (lon - lon0) * LON_M * F.cos(F.radians(lat0)), (lat - lat0) * LAT_M


def to_lat_lon(east: Column, north: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    return lat0 + north / LAT_M, lon0 + east / (LON_M * F.cos(F.radians(lat0)))


def to_global(x: Column, y: Column, east: Column, north: Column, heading: Column) -> tuple[Column, Column]:
    """A point x ahead and y left of a pose."""
    h = F.radians(heading)
    return east + x * F.sin(h) - y * F.cos(h), north + x * F.cos(h) + y * F.sin(h)


def to_frame(e: Column, n: Column, east: Column, north: Column, heading: Column) -> tuple[Column, Column]:
    """The inverse of to_global: ahead and left."""
    h = F.radians(heading)
    return (e - east) * F.sin(h) + (n - north) * F.cos(h), -(e - east) * F.cos(h) + (n - north) * F.sin(h)


def point_segment(pe: Column, pn: Column, ae: Column, an: Column, be: Column, bn: Column) -> tuple[Column, Column, Column]:
    """Share along the segment (clamped), distance to it, and the offset to its line, positive to the left."""
    de, dn = be - ae, bn - an
    length2 = de * de + dn * dn
    share = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((pe - ae) * de + (pn - an) * dn) / length2))).otherwise(0.0)
    offset = F.when(length2 > 0, (de * (pn - an) - dn * (pe - ae)) / F.sqrt(length2)).otherwise(0.0)
    return share, F.hypot(pe - (ae + share * de), pn - (an + share * dn)), offset


def segments_cross(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Do ab and cd cross properly? Points are pairs of columns."""
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def first_reason(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that holds, or null."""
    out = F
    for name, condition in checks:
        out = out.when(condition, name)
    return out


def all_reasons(*checks: tuple[str, Column]) -> Column:
    """The names of all checks that hold."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks)))


def bucket(x: Column | str, edges: list[float], unit: str = "") -> Column:
    """Labels like <1, 1-2, >=2; null stays null."""
    v, text = col(x), lambda e: f"{e:g}{unit}"
    out = F.when(v < edges[0], f"<{text(edges[0])}")
    for a, b in zip(edges, edges[1:], strict=False):
        out = out.when(v < b, f"{text(a)}-{text(b)}")
    return out.when(v >= edges[-1], f">={text(edges[-1])}")


def ramp(x: Column | str, low: float, high: float) -> Column:
    """0 up to low, 1 from high, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (col(x) - low) / (high - low)))


def weighted_score(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are not null; the others' weights are left out."""
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    total = add([F.when(p.isNotNull(), w).otherwise(0.0) for p, w in parts])
    return F.when(total > 0, add([F.coalesce(p * w, F.lit(0.0)) for p, w in parts]) / total)


def content_hash(row: Column) -> Column:
    """SHA-256 of the row's JSON; name the struct's fields in sorted order for a canonical hash."""
    return F.sha2(F.to_json(row), 256)


def seeded_hash(seed: str, key: Column | str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}::"), col(key).cast("string")), 256)
