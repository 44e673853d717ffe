"""Raw tables to staging tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import climate_zone, country_code, hemisphere
from skyledger.schemas import ELEMENTS, RAW_STATIONS


def _element_max(element: str) -> Column:
    """Largest value a station-day has for an element (settles duplicates)."""
    return F.max(F.when(F.col("element") == element, F.col("data_value"))).alias(element)


def stage_daily(raw_daily: DataFrame) -> DataFrame:
    """One unit-converted row per station and day, from rows without a quality flag.

    Conditional aggregates give a single exchange on (station, day) with partial
    aggregation before it. A station that holds a large share of the raw rows is
    therefore reduced inside each map task and still spreads over all reducers
    by day.
    """
    by_day = (
        raw_daily.where(F.col("q_flag").isNull())
        .groupBy("station_id", "obs_date")
        .agg(*[_element_max(e) for e in ELEMENTS])
    )
    tmax, tmin, tavg = F.col("TMAX"), F.col("TMIN"), F.col("TAVG")
    ten = F.lit(10.0)
    return by_day.select(
        "station_id",
        "obs_date",
        (tmax / ten).alias("tmax_celsius"),
        (tmin / ten).alias("tmin_celsius"),
        (tavg / ten).alias("tavg_celsius"),
        F.coalesce(tavg / ten, (tmax + tmin) / F.lit(20.0)).alias("tavg_derived_celsius"),
        (F.col("PRCP") / ten).alias("precipitation_mm"),
        F.col("SNOW").cast("double").alias("snowfall_mm"),
        F.col("SNWD").cast("double").alias("snow_depth_mm"),
        (F.col("AWND") / ten).alias("avg_wind_speed_ms"),
        ((tmax - tmin) / ten).alias("temp_range_celsius"),
    )


def station_years(staged_daily: DataFrame) -> DataFrame:
    """Days per station and year, how many of them have a temperature, the first and the last."""
    return staged_daily.groupBy("station_id", F.year("obs_date").alias("obs_year")).agg(
        F.count("*").alias("days"),
        F.count("tavg_derived_celsius").alias("days_with_temp"),
        F.min("obs_date").alias("first_day"),
        F.max("obs_date").alias("last_day"),
    )


def stage_stations(raw_stations: DataFrame) -> DataFrame:
    """Stations with coordinates, enriched with geography."""
    station_id, latitude = F.col("station_id"), F.col("latitude")
    return (
        raw_stations.where(latitude.isNotNull() & F.col("longitude").isNotNull())
        .select(*RAW_STATIONS.names)
        .withColumns(
            {
                "country_code": country_code(station_id),
                "hemisphere": hemisphere(latitude),
                "climate_zone": climate_zone(latitude),
                "is_us_station": F.coalesce(country_code(station_id) == "US", F.lit(False)),
            }
        )
    )


def duplicate_station_ids(stations: DataFrame) -> DataFrame:
    """Ids that occur more than once. They would repeat every joined observation."""
    return (
        stations.groupBy("station_id")
        .agg(F.count("*").alias("occurrences"))
        .where(F.col("occurrences") > 1)
    )
