"""Coordinates: bounds, cells and coarse places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US = (-179.0, 18.0, -60.0, 72.0)
US_CENTRE, CAPITAL = (39.8283, -98.5795), (38.9072, -77.0369)
VAGUE = ("united states", "usa", "nationwide", "unknown")


Box = tuple[float, float, float, float]


def parse_bbox(text: str) -> Box:
    """west,south,east,north; raises ValueError unless west < east and south < north."""
    parts = [float(x) for x in text.split(",")]
    if len(parts) != 4 or parts[0] >= parts[2] or parts[1] >= parts[3]:
        raise ValueError("bbox is west,south,east,north")
    return tuple(parts)


def in_bbox(lat: Column, lon: Column, box: Box = US) -> Column:
    west, south, east, north = box
    return lat.between(south, north) & lon.between(west, east)


def cell(lat: Column, lon: Column, digits: int = 3) -> Column:
    """Key of the grid cell that a point falls in."""
    show = lambda c: F.format_string(f"%.{digits}f", c.cast("double"))
    return F.concat_ws(",", show(lat), show(lon))


def near(lat: Column, lon: Column, point: tuple[float, float], degrees: float) -> Column:
    return (F.abs(lat - point[0]) <= degrees) & (F.abs(lon - point[1]) <= degrees)


def is_general(lat: Column, lon: Column, place: Column) -> Column:
    """No coordinates, a place that names no place, or one that stands for the country or its capital."""
    vague = F.coalesce(F.lower(F.trim(place)).isin(*VAGUE), F.lit(False))
    return lat.isNull() | lon.isNull() | vague | F.coalesce(near(lat, lon, US_CENTRE, 0.1) | near(lat, lon, CAPITAL, 0.15), F.lit(False))


def place_status(place: Column, lat: Column, lon: Column, found: Column) -> Column:
    """How a place came by its coordinates, or why it has none."""
    return (
        F.when(place.isNull() | (F.trim(place) == ""), "missing_where")
        .when(F.length(F.trim(place)) < 3, "invalid_label")
        .when(lat.isNull() | lon.isNull(), "failed")
        .when(~in_bbox(lat, lon), "out_of_bounds")
        .otherwise(F.coalesce(found, F.lit("geocoded")))
    )


def cache_status(hit_lat: Column, fetched_at: Column, as_of: Column, failure_days: int = 7) -> Column:
    """Of a left-joined cache row: hit, fresh_failure (don't ask again yet) or needs_lookup."""
    fresh = fetched_at > as_of - F.make_dt_interval(F.lit(failure_days))
    return F.when(hit_lat.isNotNull(), "hit").when(fetched_at.isNotNull() & fresh, "fresh_failure").otherwise("needs_lookup")


def marker_radius(n: Column, base: float = 6.0, most: float = 18.0) -> Column:
    return F.least(F.lit(most), base + 2.0 * F.log2(n + F.lit(1.0)))
