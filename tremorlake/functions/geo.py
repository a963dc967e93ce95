"""Distances, boxes and grid cells as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremorlake import constants as C


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * C.EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def equirect_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat distance, longitudes scaled by the cosine of the mean latitude."""
    dx = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return C.EARTH_RADIUS_KM * F.sqrt(dx * dx + F.pow(F.radians(lat2 - lat1), 2))


def local_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat distance with the kilometres per degree of the region's mid latitude."""
    dy = (lat2 - lat1) * C.KM_PER_DEG_LAT
    dx = (lon2 - lon1) * (C.KM_PER_DEG_LON_EQUATOR * math.cos(math.radians(C.MID_LATITUDE)))
    return F.sqrt(dx * dx + dy * dy)


def local_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dx = (lon2 - lon1) * math.cos(math.radians(C.MID_LATITUDE))
    return F.sqrt(dx * dx + F.pow(lat2 - lat1, 2))


def in_bbox(lat: Column, lon: Column) -> Column:
    return lat.between(C.MIN_LAT, C.MAX_LAT) & lon.between(C.MIN_LON, C.MAX_LON)


def cell_axis(value: Column, low: float, high: float, size: float, edge: str) -> Column:
    """Cell number along one axis.

    ``drop``: null outside, the top edge in the last cell; ``clamp``: everything outside goes to the edge cells;
    ``halfopen``: null outside and on the top edge.
    """
    n = round((high - low) / size)
    raw = F.floor((value - low) / size).cast("int")
    held = F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1))
    if edge == "clamp":
        return held
    if edge == "drop":
        return F.when(value.between(low, high), held)
    if edge == "halfopen":
        return F.when((value >= low) & (value < high), held)
    raise ValueError(f"edge rule {edge!r}")


def cell(lat: Column, lon: Column, size: float = 1.0, edge: str = "clamp") -> tuple[Column, Column]:
    return cell_axis(lat, C.MIN_LAT, C.MAX_LAT, size, edge), cell_axis(lon, C.MIN_LON, C.MAX_LON, size, edge)


def cell_id(i: Column, j: Column) -> Column:
    return F.format_string("cell_%02d_%02d", i, j)


def cell_area_km2(lat_center: Column, size: float = 1.0) -> Column:
    return (size * C.KM_PER_DEG_LAT) * (size * C.KM_PER_DEG_LON_EQUATOR * F.cos(F.radians(lat_center)))
