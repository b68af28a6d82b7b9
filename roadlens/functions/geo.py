"""Geospatial column expressions (GEO-01..09)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadlens.constants import AIRPORT, CITY_CENTRE, EARTH_RADIUS_KM, RISK_JUNCTIONS
from roadlens.functions.common import col, np_round


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km (R = 6371); arguments are Columns or floats.

    The ``asin`` argument is clamped to 1 so rounding noise never yields NULL/NaN.
    """
    def c(x):
        return F.lit(float(x)) if isinstance(x, (int, float)) else col(x)
    la1, lo1, la2, lo2 = (F.radians(c(x)) for x in (lat1, lon1, lat2, lon2))
    a = (F.pow(F.sin((la2 - la1) / 2), 2)
         + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def planar_km(lat1, lon1, lat2: float, lon2: float) -> Column:
    """Flat-earth approximation used by the service: degrees * 111."""
    return F.sqrt(F.pow(col(lat1) - F.lit(lat2), 2) + F.pow(col(lon1) - F.lit(lon2), 2)) * F.lit(111.0)


def anchor_distances(lat="latitude", lon="longitude", anchors=RISK_JUNCTIONS, digits=4) -> list[Column]:
    """GEO-02: one distance column per literal anchor, all in one projection."""
    return [np_round(haversine_km(lat, lon, a_lat, a_lon), digits).alias(f"dist_to_{name}")
            for name, a_lat, a_lon in anchors]


def nearest_anchor(lat="latitude", lon="longitude", anchors=RISK_JUNCTIONS, digits=4) -> tuple[Column, Column]:
    """GEO-03: (distance, index) of the nearest anchor; ties resolve to the first index.

    ``array_min`` over structs orders by distance then index, so ties are exact.
    """
    arr = F.array(*[F.struct(haversine_km(lat, lon, a_lat, a_lon).alias("d"), F.lit(i).alias("i"))
                    for i, (_, a_lat, a_lon) in enumerate(anchors)])
    best = F.array_min(arr)
    return np_round(best["d"], digits).alias("dist_to_nearest_junction"), best["i"].alias("nearest_junction_idx")


def city_distances(lat="latitude", lon="longitude") -> list[Column]:
    """GEO-06: distance to the city centre and the airport, 3 dp."""
    return [np_round(haversine_km(lat, lon, *CITY_CENTRE), 3).alias("dist_to_city_centre"),
            np_round(haversine_km(lat, lon, *AIRPORT), 3).alias("dist_to_airport")]


def radial_band(dist) -> Column:
    """GEO-07: right-closed rings 0-5-10-15-20-inf; distance 0 is band 0 (Q9)."""
    d = col(dist)
    return (F.when(d.isNull(), F.lit(None)).when(d <= 5, 0).when(d <= 10, 1).when(d <= 15, 2)
            .when(d <= 20, 3).otherwise(4))


def grid_cells(lat="latitude", lon="longitude", size: float = 0.01) -> list[Column]:
    """GEO-08: truncating grid cells and a combined id."""
    la = (col(lat) / F.lit(size)).cast("int")
    lo = (col(lon) / F.lit(size)).cast("int")
    return [la.alias("lat_grid_cell"), lo.alias("lon_grid_cell"),
            F.concat_ws("_", la.cast("string"), lo.cast("string")).alias("spatial_grid_id")]


def lat_lon_product(lat="latitude", lon="longitude") -> Column:
    """GEO-09."""
    return np_round(col(lat) * col(lon), 6)


TWO_PI = 2 * math.pi
