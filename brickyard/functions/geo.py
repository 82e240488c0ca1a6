"""Distance, grid and granularity columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brickyard.schema import EARTH_RADIUS_M


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; the root is clamped before ``asin``."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = (F.pow(F.sin((p2 - p1) / 2), F.lit(2.0))
         + F.cos(p1) * F.cos(p2)
         * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0)))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / F.lit(1000.0)


def cell(c: Column, width: float) -> Column:
    """Index of the grid band of ``width`` degrees that holds the coordinate."""
    return F.floor(c / F.lit(width)).cast("bigint")


def spatial_cell(lat: Column, lon: Column, digits: int = 1) -> Column:
    """Coarse cell id of rounded coordinates (about 11 km at one digit)."""
    scale = F.lit(float(10 ** digits))
    return F.concat_ws("_", F.format_number(F.rint(lat * scale) / scale, digits),
                       F.format_number(F.rint(lon * scale) / scale, digits))


# Upper bounds in metres of the granularity labels.
FAR_M = 20_000.0


def granularity(radius_m: Column) -> Column:
    """How local an estimate is, by the distance of the farthest neighbour used."""
    return (F.when(radius_m < 500, "street/block").when(radius_m < 1_500, "neighbourhood")
            .when(radius_m < 5_000, "district").when(radius_m > FAR_M, "municipality")
            .otherwise("area"))
