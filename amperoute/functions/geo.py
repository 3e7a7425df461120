"""Positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_MILES = 3958.7613  # fixed value


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """C29."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_RADIUS_MILES * F.asin(F.sqrt(chord))


def valid_position(lat: Column, lon: Column) -> Column:
    """False, never null, for missing or out-of-range coordinates."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def point(lat: Column, lon: Column) -> Column:
    """Longitude first, as in a point literal."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))
