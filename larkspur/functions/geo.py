"""Points, boxes, distances and polygons as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boxes of the areas, tried in this order, and the whole service area (south, north, west, east).
AREA_BOXES = (
    ("staten_island", 40.49, 40.65, -74.26, -74.05), ("bronx", 40.78, 40.92, -73.94, -73.74), ("manhattan", 40.68, 40.88, -74.02, -73.90),
    ("brooklyn", 40.55, 40.74, -74.05, -73.83), ("queens", 40.54, 40.81, -73.96, -73.70),
)
SERVICE_AREA = (40.49, 40.93, -74.26, -73.68)

#: Mean radius of the sphere; distances differ from those on the spheroid by up to half a percent.
EARTH_M = 6371008.8


def valid_point(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def area_by_box(lat: Column, lon: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, *box in reversed(AREA_BOXES):
        out = F.when(in_box(lat, lon, *box), name).otherwise(out)
    return out


def distance_m(lat: Column, lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat, to_lat) * half(lat, to_lat) + F.cos(F.radians(lat)) * F.cos(F.radians(to_lat)) * half(lon, to_lon) * half(lon, to_lon)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def near_box(lat: Column, lon: Column, to_lat: float, to_lon: float, metres: float) -> Column:
    """A box around the circle, for pruning before the distance is computed."""
    import math

    high = math.degrees(metres / EARTH_M) * 1.001
    wide = high / max(0.01, math.cos(math.radians(min(89.0, abs(to_lat) + high))))
    return lat.between(to_lat - high, to_lat + high) & lon.between(to_lon - wide, to_lon + wide)


def in_ring(lat: Column, lon: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Even-odd crossing number over (lon, lat) corners; a ring of fewer than three corners holds nothing."""
    if len(ring) < 3:
        return F.lit(False)
    inside = F.lit(False)
    for (x0, y0), (x1, y1) in zip((ring[-1], *ring[:-1]), ring, strict=True):
        if y0 == y1:
            continue
        crosses = ((F.lit(y1) > lat) != (F.lit(y0) > lat)) & (x0 + (lat - y0) / (y1 - y0) * (x1 - x0) > lon)
        inside = inside != crosses
    return inside


def in_polygon(lat: Column, lon: Column, rings: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Within the box of the outer ring and the ring itself, and in none of the holes."""
    outer, *holes = rings
    xs, ys = zip(*outer, strict=True)
    found = in_box(lat, lon, min(ys), max(ys), min(xs), max(xs)) & in_ring(lat, lon, outer)
    for hole in holes:
        found = found & ~in_ring(lat, lon, hole)
    return found


def area_by_polygon(lat: Column, lon: Column, areas: Sequence[tuple[str, Sequence]]) -> Column:
    """The first area, in the given order, one of whose polygons holds the point."""
    out = F.lit(None).cast("string")
    for name, polygons in reversed(areas):
        held = F.lit(False)
        for rings in polygons:
            held = held | in_polygon(lat, lon, rings)
        out = F.when(held, name).otherwise(out)
    return out
