"""Distances and cells on the earth, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
# fixed values: the projection's centre and the size of a degree there
CENTRE_LAT, CENTRE_LON = 39.0, -106.0


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; the haversine is clamped to [0, 1]."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def metres_east_north(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Equirectangular metres from the projection's centre."""
    import math

    east = F.radians(lon - CENTRE_LON) * (EARTH_M * math.cos(math.radians(CENTRE_LAT)))
    return east, F.radians(lat - CENTRE_LAT) * EARTH_M
