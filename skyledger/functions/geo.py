"""Geography helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0

# Upper bounds of |latitude| per climate band.
CLIMATE_BANDS = (
    (23.5, "Tropical"),
    (35.0, "Subtropical"),
    (55.0, "Temperate"),
    (66.5, "Subarctic"),
)
OUTER_BAND = "Polar"


def country_code(station_id: Column) -> Column:
    return F.substring(station_id, 1, 2)


def hemisphere(latitude: Column) -> Column:
    return F.when(latitude >= 0, "Northern").otherwise("Southern")


def climate_zone(latitude: Column) -> Column:
    first_bound, first_name = CLIMATE_BANDS[0]
    zone = F.when(F.abs(latitude) < first_bound, first_name)
    for bound, name in CLIMATE_BANDS[1:]:
        zone = zone.when(F.abs(latitude) < bound, name)
    return zone.otherwise(OUTER_BAND)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half_dlat = F.radians(lat2 - lat1) / 2.0
    half_dlon = F.radians(lon2 - lon1) / 2.0
    chord = F.sin(half_dlat) * F.sin(half_dlat) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.sin(half_dlon) * F.sin(half_dlon)
    # rounding can push the chord a hair above 1 for antipodes
    return F.asin(F.sqrt(F.least(chord, F.lit(1.0)))) * (2.0 * EARTH_RADIUS_KM)
