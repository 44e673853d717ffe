"""Column-pruned reads of the marts for a set of stations and a year range.

Both predicates are plain comparisons on stored columns, so the year range
prunes partitions and the station list reaches the Parquet scan. Without a range
all years are read. Rows are sorted only on request, as a global sort is a
shuffle that most callers do not need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions import month_label

# The columns each view shows.
DAILY_COLUMNS = (
    "station_id", "station_name", "obs_date", "obs_year", "obs_month",
    "tmax_celsius", "tmin_celsius", "tavg_derived_celsius", "temp_range_celsius",
    "precipitation_mm", "snowfall_mm", "avg_wind_speed_ms",
    "tavg_7d_avg", "tavg_30d_avg", "precip_7d_avg", "precip_30d_total",
    "temp_change_1d", "had_precipitation", "had_snowfall", "is_extreme_cold", "is_extreme_heat",
)
FEATURE_COLUMNS = (
    "station_id", "obs_date", "tavg_derived_celsius", "target_tavg_next_day",
    "tavg_lag_1d", "tavg_lag_7d", "tavg_7d_avg", "tavg_30d_avg",
    "precipitation_mm", "precip_lag_1d", "temp_change_1d", "temp_change_7d",
    "season_sin", "season_cos",
)
Stations = Sequence[str] | DataFrame | None


Years = tuple[int, int] | None


def _selected(mart: DataFrame, stations: Stations, years: Years) -> DataFrame:
    """Rows of the wanted years and stations; ``None`` means every station.

    A short list becomes an IN predicate. A DataFrame of ids is a semi join, for
    selections too long to write into a plan.
    """
    in_years = mart if years is None else mart.where(F.col("obs_year").between(*years))
    if stations is None:
        return in_years
    if isinstance(stations, DataFrame):
        return in_years.join(stations.select("station_id"), "station_id", "left_semi")
    return in_years.where(F.col("station_id").isin(*stations))


def load_daily(
    mart: DataFrame, stations: Stations = None, years: Years = None, *, ordered: bool = False
) -> DataFrame:
    rows = _selected(mart, stations, years).select(*DAILY_COLUMNS)
    return rows.orderBy("station_id", "obs_date") if ordered else rows


def load_monthly(
    mart: DataFrame, stations: Stations = None, years: Years = None, *, ordered: bool = False
) -> DataFrame:
    rows = (
        _selected(mart, stations, years)
        .where(F.col("avg_temp_celsius").isNotNull())
        .withColumn("month_label", month_label(F.col("obs_year"), F.col("obs_month")))
    )
    return rows.orderBy("station_id", "obs_year", "obs_month") if ordered else rows


def load_features(
    mart: DataFrame, stations: Stations = None, years: Years = None, *, ordered: bool = False
) -> DataFrame:
    rows = _selected(mart, stations, years).select(*FEATURE_COLUMNS)
    return rows.orderBy("station_id", "obs_date") if ordered else rows
