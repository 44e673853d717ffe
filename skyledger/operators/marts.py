"""Staging tables to the three marts.

Windows are partitioned by station. A staged station has at most one row per
calendar date, so a window partition is bounded by the length of the record
(about 100,000 days since the eighteenth century), however many raw rows, copies
or duplicates one station contributes: those are folded in the (station, day)
aggregation before. Frames count rows, not days; gaps in the dates stay gaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import mean_of_ticks, round_scaled
from skyledger.functions.numeric import stddev_of_ticks, sum_of_ticks

# Column names of the marts, in their order.
STATION_COLUMNS = (
    "station_id", "station_name", "latitude", "longitude",
    "elevation", "state", "country_code", "climate_zone",
)
MEASURES = (
    "tmax_celsius", "tmin_celsius", "tavg_derived_celsius", "temp_range_celsius",
    "precipitation_mm", "snowfall_mm", "snow_depth_mm", "avg_wind_speed_ms",
)
MONTH_KEYS = (
    "station_id", "station_name", "latitude", "longitude",
    "state", "country_code", "climate_zone", "obs_year", "obs_month",
)

# Limits of the extreme-day flags (degrees Celsius).
HEAT_LIMIT, COLD_LIMIT = 35, -20


STATION = ("station_id",)

#: A day's rolling values, lags and changes reach so many rows of its station back.
LOOKBACK_ROWS = 29


def _history(keys: Sequence[str] = STATION):
    return Window.partitionBy(*keys).orderBy("obs_date")


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def daily_weather(staged_daily: DataFrame, staged_stations: DataFrame) -> DataFrame:
    """Observations with station geography, calendar parts, rolling values and flags.

    The join is left to the planner: Spark broadcasts the stations while their
    size is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles on
    station_id beyond it, which is the distribution the windows need anyway.
    """
    return _rolling(_station_days(staged_daily, staged_stations))


def _station_days(staged_daily: DataFrame, staged_stations: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    day = F.col("obs_date")
    calendar = {
        "obs_year": F.year(day),
        "obs_month": F.month(day),
        "day_of_week": F.dayofweek(day) - 1,
        "day_of_year": F.dayofyear(day),
    }
    return staged_daily.join(staged_stations.select(*STATION_COLUMNS), "station_id", "inner").select(
        *STATION_COLUMNS,
        "obs_date",
        *[c.cast("int").alias(name) for name, c in calendar.items()],
        *MEASURES,
        *carried,
    )


def _rolling(days: DataFrame, keys: Sequence[str] = STATION) -> DataFrame:
    temp, rain = F.col("tavg_derived_celsius"), F.col("precipitation_mm")
    history = _history(keys)
    week, month = history.rowsBetween(-6, 0), history.rowsBetween(-LOOKBACK_ROWS, 0)
    rolling = days.select(
        "*",
        F.avg(temp).over(week).alias("tavg_7d_avg"),
        F.avg(rain).over(week).alias("precip_7d_avg"),
        F.avg(temp).over(month).alias("tavg_30d_avg"),
        F.sum(rain).over(month).alias("precip_30d_total"),
        (temp - F.lag(temp, 1).over(history)).alias("temp_change_1d"),
        (temp - F.lag(temp, 7).over(history)).alias("temp_change_7d"),
    )
    return rolling.withColumns(
        {
            "had_precipitation": _holds(rain > 0),
            "had_snowfall": _holds(F.col("snowfall_mm") > 0),
            "is_extreme_heat": _holds(F.col("tmax_celsius") > HEAT_LIMIT),
            "is_extreme_cold": _holds(F.col("tmin_celsius") < COLD_LIMIT),
        }
    )


def _neighbours(daily: DataFrame, keys: Sequence[str] = STATION) -> DataFrame:
    """The daily mart with the next day's target and the lags beside each day."""
    temp, rain = F.col("tavg_derived_celsius"), F.col("precipitation_mm")
    history = _history(keys)
    return daily.select(
        "*",
        F.lead(temp, 1).over(history).alias("target_tavg_next_day"),
        *[F.lag(temp, n).over(history).alias(f"tavg_lag_{n}d") for n in (1, 2, 3, 7)],
        *[F.lag(rain, n).over(history).alias(f"precip_lag_{n}d") for n in (1, 7)],
    )


def station_history(
    staged_daily: DataFrame, staged_stations: DataFrame, bucket: str, splits: int
) -> DataFrame:
    """The daily mart with target and lags, by one shuffle and one sort.

    Rows are shuffled by ``bucket``, each cut into ``splits`` by station, so a
    task holds whole stations of few buckets and can write them partitioned by
    bucket as they come. Both marts are narrow projections of the result.
    """
    split = F.pmod(F.xxhash64("station_id", F.lit("split")), F.lit(splits)).cast("int")
    days = _station_days(staged_daily, staged_stations, (bucket,)).withColumn("_split", split)
    keys = (bucket, "_split", "station_id")
    spread = days.repartition(bucket, "_split")
    return _neighbours(_rolling(spread, keys), keys).drop("_split")


def monthly_summary(daily: DataFrame) -> DataFrame:
    """Monthly statistics per station, rounded to two decimals.

    Means and totals add whole ticks (mean temperatures are multiples of 0.05,
    precipitation of 0.1, snowfall of 1), so they are exact and do not depend
    on the order rows arrive in.
    """
    temp, rain, snow = F.col("tavg_derived_celsius"), F.col("precipitation_mm"), F.col("snowfall_mm")
    wet = F.col("had_precipitation")
    zero = F.lit(0.0)
    return daily.groupBy(*MONTH_KEYS).agg(
        round_scaled(mean_of_ticks(temp, 20), 2).alias("avg_temp_celsius"),
        round_scaled(F.max("tmax_celsius"), 2).alias("max_temp_celsius"),
        round_scaled(F.min("tmin_celsius"), 2).alias("min_temp_celsius"),
        round_scaled(stddev_of_ticks(temp, 20), 2).alias("temp_stddev"),
        round_scaled(sum_of_ticks(F.coalesce(rain, zero), 10), 2).alias("total_precip_mm"),
        F.count_if(wet).alias("days_with_precip"),
        round_scaled(mean_of_ticks(F.when(wet, rain), 10), 2).alias("avg_precip_per_rainy_day_mm"),
        round_scaled(sum_of_ticks(F.coalesce(snow, zero), 1), 2).alias("total_snowfall_mm"),
        F.count_if(F.col("had_snowfall")).alias("days_with_snow"),
        F.count_if(F.col("is_extreme_heat")).alias("extreme_heat_days"),
        F.count_if(F.col("is_extreme_cold")).alias("extreme_cold_days"),
        F.count("*").alias("observation_count"),
        F.count(temp).alias("temp_observation_count"),
    )


def prediction_features(daily: DataFrame) -> DataFrame:
    """Feature table for next-day temperature, one row per day with target and lags.

    Uses the window the daily mart uses; computed in one plan with it, both share
    a single exchange and sort.
    """
    return features_of_history(_neighbours(daily))


def features_of_history(history: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """The feature table from days that carry their target and lags; neither shuffles nor sorts."""
    angle = F.lit(2.0) * F.pi() * F.col("day_of_year") / F.lit(365.0)
    features = history.select(
        "station_id", "obs_date", "obs_year", "obs_month", "day_of_year",
        "latitude", "longitude", "elevation", "climate_zone",
        "target_tavg_next_day",
        "tavg_derived_celsius", "tmax_celsius", "tmin_celsius", "temp_range_celsius",
        "precipitation_mm", "snowfall_mm", "avg_wind_speed_ms",
        *[f"tavg_lag_{n}d" for n in (1, 2, 3, 7)],
        *[f"precip_lag_{n}d" for n in (1, 7)],
        "tavg_7d_avg", "tavg_30d_avg", "precip_7d_avg", "precip_30d_total",
        "temp_change_1d", "temp_change_7d",
        F.sin(angle).alias("season_sin"),
        F.cos(angle).alias("season_cos"),
        "had_precipitation", "had_snowfall", "is_extreme_heat", "is_extreme_cold",
        *carried,
    )
    return features.where(
        F.col("target_tavg_next_day").isNotNull() & F.col("tavg_lag_7d").isNotNull()
    )
