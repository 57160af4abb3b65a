"""Distances and boxes on the globe as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE = 111.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bbox_around(lat: Column, lng: Column, km: Column) -> Column:
    """struct(min_lat, min_lng, max_lat, max_lng) of a square of ``km`` to each side."""
    up = km / KM_PER_DEGREE
    side = km / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat)))
    return F.struct((lat - up).alias("min_lat"), (lng - side).alias("min_lng"), (lat + up).alias("max_lat"), (lng + side).alias("max_lng"))


def in_box(lat: Column, lng: Column, box: Column) -> Column:
    """Whether a point lies in a box or on its edge."""
    return lat.between(box["min_lat"], box["max_lat"]) & lng.between(box["min_lng"], box["max_lng"])
