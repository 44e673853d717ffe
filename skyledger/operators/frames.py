"""Chart-ready frames over loaded marts, in long (series, value) form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions import display_delta, display_temperature, rainfall


def _long(rows: DataFrame, keys: Sequence[str], series: dict) -> DataFrame:
    wide = rows.select(*keys, *[value.cast("double").alias(name) for name, value in series.items()])
    return wide.unpivot(list(keys), list(series), "series", "value")


def temperature_frame(daily: DataFrame, unit: str = "C") -> DataFrame:
    """Daily maximum, minimum and 7-row mean per station."""
    return _long(
        daily,
        ("station_id", "station_name", "obs_date"),
        {
            "max": display_temperature(F.col("tmax_celsius"), unit),
            "min": display_temperature(F.col("tmin_celsius"), unit),
            "7d avg": display_temperature(F.col("tavg_7d_avg"), unit),
        },
    )


def temperature_change_frame(daily: DataFrame, unit: str = "C") -> DataFrame:
    """Day-over-day change. A difference is scaled to Fahrenheit without offset."""
    return daily.select(
        "station_id",
        "station_name",
        "obs_date",
        display_delta(F.col("temp_change_1d"), unit).alias("temp_change"),
    )


def precipitation_frame(daily: DataFrame) -> DataFrame:
    """Daily precipitation, rainfall and the 30-row total."""
    return daily.select(
        "station_id",
        "station_name",
        "obs_date",
        "precipitation_mm",
        rainfall(F.col("precipitation_mm"), F.col("snowfall_mm")).alias("rainfall_mm"),
        "precip_30d_total",
    )


def snowfall_frame(daily: DataFrame) -> DataFrame:
    """Days with snowfall only."""
    return daily.where(F.col("snowfall_mm") > 0).select(
        "station_id", "station_name", "obs_date", "snowfall_mm"
    )


def monthly_frame(monthly: DataFrame, unit: str = "C") -> DataFrame:
    """Six monthly series per station, keyed by the month label."""
    rain = rainfall(F.col("total_precip_mm"), F.col("total_snowfall_mm"))
    return _long(
        monthly,
        ("station_id", "station_name", "month_label"),
        {
            "avg_temp": display_temperature(F.col("avg_temp_celsius"), unit),
            "total_precip_mm": F.col("total_precip_mm"),
            "rainfall_mm": rain,
            "extreme_heat_days": F.col("extreme_heat_days"),
            "extreme_cold_days": F.col("extreme_cold_days"),
            "total_snowfall_mm": F.col("total_snowfall_mm"),
        },
    )


def target_frame(features: DataFrame, daily: DataFrame, unit: str = "C") -> DataFrame:
    """Actual temperature and next-day target, with the station's name.

    Names are reduced to one per station before the join, so it adds no rows; a
    station without a name keeps its id. Distinct pairs come first: they fold in
    a hash aggregate where the days are read, the minimum then sees a few rows.
    """
    pairs = daily.select("station_id", "station_name").distinct()
    names = pairs.groupBy("station_id").agg(F.min("station_name").alias("name"))
    named = features.join(names, "station_id", "left").withColumn(
        "station_name", F.coalesce("name", "station_id")
    )
    return _long(
        named,
        ("station_id", "station_name", "obs_date"),
        {
            "actual": display_temperature(F.col("tavg_derived_celsius"), unit),
            "next-day target": display_temperature(F.col("target_tavg_next_day"), unit),
        },
    )


def _first_station(features: DataFrame) -> DataFrame:
    first = features.agg(F.min("station_id")).scalar()
    return features.where(F.col("station_id") == first)


def lag_frame(features: DataFrame, unit: str = "C") -> DataFrame:
    """Current, lagged and rolling temperatures of the first station."""
    names = ("tavg_derived_celsius", "tavg_lag_1d", "tavg_lag_7d", "tavg_7d_avg", "tavg_30d_avg")
    return _long(
        _first_station(features),
        ("obs_date",),
        {c: display_temperature(F.col(c), unit) for c in names},
    )


def seasonal_frame(features: DataFrame) -> DataFrame:
    """Seasonal encoding of the first station."""
    return _long(
        _first_station(features),
        ("obs_date",),
        {c: F.col(c) for c in ("season_sin", "season_cos")},
    )
