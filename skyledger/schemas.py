"""Declared table schemas. Nothing in the library infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

# The element codes that are kept at parse time.
ELEMENTS = ("TMAX", "TMIN", "PRCP", "SNOW", "SNWD", "AWND", "TAVG")

# The four table namespaces.
NAMESPACES = ("raw", "staging", "marts", "quality")

RAW_STATIONS = T.StructType(
    [
        T.StructField("station_id", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("elevation", T.DoubleType()),
        T.StructField("state", T.StringType()),
        T.StructField("station_name", T.StringType()),
        T.StructField("gsn_flag", T.StringType()),
        T.StructField("hcn_flag", T.StringType()),
        T.StructField("wmo_id", T.StringType()),
    ]
)

RAW_DAILY = T.StructType(
    [
        T.StructField("station_id", T.StringType(), False),
        T.StructField("obs_date", T.DateType(), False),
        T.StructField("element", T.StringType(), False),
        T.StructField("data_value", T.IntegerType()),
        T.StructField("m_flag", T.StringType()),
        T.StructField("q_flag", T.StringType()),
        T.StructField("s_flag", T.StringType()),
        T.StructField("obs_time", T.StringType()),
    ]
)

#: Columns that may never be NULL in ``raw.daily``.
RAW_DAILY_KEYS = tuple(f.name for f in RAW_DAILY if not f.nullable)

#: What the stored raw table carries on top of RAW_DAILY: the file a row came with, if
#: files are merged one by one, and the partition columns.
RAW_DAILY_STORED = T.StructType(
    RAW_DAILY.fields
    + [
        T.StructField("landing_file", T.StringType()),
        T.StructField("obs_year", T.IntegerType()),
        T.StructField("station_bucket", T.IntegerType()),
    ]
)

DIM_COUNTRY = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("iso3", T.StringType()),
    ]
)

_STATION = (
    "station_id string, station_name string, latitude double, longitude double, "
    "elevation double, state string, country_code string, climate_zone string"
)
_FLAGS = "had_precipitation boolean, had_snowfall boolean, is_extreme_heat boolean, is_extreme_cold boolean"
_ROLLING = (
    "tavg_7d_avg double, precip_7d_avg double, tavg_30d_avg double, precip_30d_total double, "
    "temp_change_1d double, temp_change_7d double"
)
_CHECKS = (
    "check_name string, violation_count bigint, check_result string, description string, "
    "checked_at timestamp"
)

#: Declared schema of every stored table, as DDL.
TABLES = {
    "raw.landed_files": "landing_file string, station_id string, obs_year int, rows bigint",
    "staging.daily_observations": (
        "station_id string, obs_date date, tmax_celsius double, tmin_celsius double, "
        "tavg_celsius double, tavg_derived_celsius double, precipitation_mm double, "
        "snowfall_mm double, snow_depth_mm double, avg_wind_speed_ms double, "
        "temp_range_celsius double"
    ),
    "staging.station_years": (
        "station_id string, obs_year int, days bigint, days_with_temp bigint, first_day date, last_day date"
    ),
    "staging.stations": (
        "station_id string, latitude double, longitude double, elevation double, state string, "
        "station_name string, gsn_flag string, hcn_flag string, wmo_id string, "
        "country_code string, hemisphere string, climate_zone string, is_us_station boolean"
    ),
    "marts.daily_weather": (
        f"{_STATION}, obs_date date, obs_year int, obs_month int, day_of_week int, "
        "day_of_year int, tmax_celsius double, tmin_celsius double, tavg_derived_celsius double, "
        "temp_range_celsius double, precipitation_mm double, snowfall_mm double, "
        f"snow_depth_mm double, avg_wind_speed_ms double, {_ROLLING}, {_FLAGS}"
    ),
    "marts.monthly_summary": (
        "station_id string, station_name string, latitude double, longitude double, state string, "
        "country_code string, climate_zone string, obs_year int, obs_month int, "
        "avg_temp_celsius double, max_temp_celsius double, min_temp_celsius double, "
        "temp_stddev double, total_precip_mm double, days_with_precip bigint, "
        "avg_precip_per_rainy_day_mm double, total_snowfall_mm double, days_with_snow bigint, "
        "extreme_heat_days bigint, extreme_cold_days bigint, observation_count bigint, "
        "temp_observation_count bigint"
    ),
    "marts.prediction_features": (
        "station_id string, obs_date date, obs_year int, obs_month int, day_of_year int, "
        "latitude double, longitude double, elevation double, climate_zone string, "
        "target_tavg_next_day double, tavg_derived_celsius double, tmax_celsius double, "
        "tmin_celsius double, temp_range_celsius double, precipitation_mm double, "
        "snowfall_mm double, avg_wind_speed_ms double, tavg_lag_1d double, tavg_lag_2d double, "
        "tavg_lag_3d double, tavg_lag_7d double, precip_lag_1d double, precip_lag_7d double, "
        "tavg_7d_avg double, tavg_30d_avg double, precip_7d_avg double, precip_30d_total double, "
        "temp_change_1d double, temp_change_7d double, season_sin double, season_cos double, "
        f"{_FLAGS}"
    ),
    "quality.raw_daily": _CHECKS,
    "quality.stations": _CHECKS,
    "quality.marts": _CHECKS,
    "quality.raw_parts": (
        "station_id string, obs_year int, rows bigint, extreme bigint, negative bigint, inverted bigint, newest date"
    ),
    "quality.raw_days": "obs_date date, rows bigint",
    "quality.weather_parts": "rows bigint, with_average bigint, without_name bigint",
    "quality.month_parts": "obs_year int, obs_month int, rows bigint",
    "quality.feature_parts": "rows bigint",
    "quality.malformed": "bad_years bigint, bad_months bigint, bad_values bigint",
    "quality.malformed_batches": "batch_id bigint, bad_years bigint, bad_months bigint, bad_values bigint",
}

#: Columns that a table stores on top for the tables derived from it; readers do not see them.
HIDDEN = {
    "marts.daily_weather": (
        "target_tavg_next_day double, tavg_lag_1d double, tavg_lag_2d double, tavg_lag_3d double, "
        "tavg_lag_7d double, precip_lag_1d double, precip_lag_7d double"
    ),
}
