"""Data-quality checks with PASS / WARN / FAIL outcomes.

A suite computes one metric per check and reads each source table once: all
counters over a table are aggregates of one plan, and checks that need a group
(temperature inversions, duplicate ids, orphans) reuse the same grouped rows.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import country_code

Test = Callable[[Column], Column]

# The three outcomes.
OUTCOMES = ("PASS", "WARN", "FAIL")


@dataclass(frozen=True)
class Check:
    """A named rule over one metric; a metric that passes neither test fails."""

    name: str
    description: str
    passes: Test
    warns: Test | None = None
    when_missing: int = 0

    def row(self) -> Column:
        metric = F.col(self.name)
        result = F.when(self.passes(metric), "PASS")
        if self.warns is not None:
            result = result.when(self.warns(metric), "WARN")
        return F.struct(
            F.lit(self.name).alias("check_name"),
            F.coalesce(metric, F.lit(self.when_missing)).cast("bigint").alias("violation_count"),
            result.otherwise("FAIL").alias("check_result"),
            F.lit(self.description).alias("description"),
        )


def none_found(metric: Column) -> Column:
    return metric == 0


def below(limit: int) -> Test:
    return lambda metric: metric < limit


def above(limit: int) -> Test:
    return lambda metric: metric > limit


def at_least(limit: int) -> Test:
    return lambda metric: metric >= limit


def at_most(limit: int) -> Test:
    return lambda metric: metric <= limit


# Check names, limits and descriptions.
RAW_DAILY_CHECKS = (
    Check("null_station_id", "Station ID should never be null", none_found),
    Check("null_obs_date", "Observation date should never be null", none_found),
    Check("future_dates", "Observation dates should not be in the future", none_found, below(100)),
    Check("extreme_temperatures", "Temperatures outside -90 to 60°C range", none_found, below(50)),
    Check("negative_precipitation", "Precipitation values should not be negative", none_found),
    Check("temp_max_less_than_min", "TMAX should be >= TMIN for same station and date", none_found, below(100)),
    Check("data_freshness", "Most recent data should be within 7 days", at_most(7), at_most(30), -1),
    Check("orphan_stations", "Observations should reference known stations", none_found, below(50)),
)
STATION_CHECKS = (
    Check("latitude_out_of_range", "Latitude must be between -90 and 90", none_found),
    Check("longitude_out_of_range", "Longitude must be between -180 and 180", none_found),
    Check("duplicate_station_ids", "Station IDs should be unique", none_found),
    Check("us_station_coverage", "US should have 5000+ stations", above(5000), above(1000)),
    Check("elevation_out_of_range", "Elevation should be between -500m and 9000m", none_found, below(10)),
)
MART_CHECKS = (
    Check("mart_daily_weather_populated", "mart_daily_weather should contain data", above(0)),
    Check("rolling_averages_computed", "7-day rolling averages should be computed", above(0)),
    Check("prediction_targets_exist", "Prediction feature table should have 1000+ rows", above(1000), above(0)),
    Check("monthly_summary_coverage", "Monthly summaries should cover at least 12 months", at_least(12), at_least(3)),
    Check("stations_joined_correctly", "All daily weather records should have a station name", none_found, below(100)),
)
TEMPERATURE_LIMITS = (-900, 600)
ELEVATION_LIMITS = (-500, 9000)


def run_checks(metrics: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One result row per check from a one-row frame with a column per check."""
    return metrics.select(F.inline(F.array(*[c.row() for c in checks]))).withColumn(
        "checked_at", F.current_timestamp()
    )


def _outside(c: Column, limits: tuple[float, float]) -> Column:
    return (c < limits[0]) | (c > limits[1])


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _station_days(raw_daily: DataFrame) -> DataFrame:
    element, value = F.col("element"), F.col("data_value")

    def highest(code: str) -> Column:
        return F.max(F.when(element == code, value))

    return raw_daily.groupBy("station_id", "obs_date").agg(
        F.count("*").alias("rows"),
        F.count_if(
            element.isin("TMAX", "TMIN", "TAVG") & _outside(value, TEMPERATURE_LIMITS)
        ).alias("extreme"),
        F.count_if((element == "PRCP") & (value < 0)).alias("negative"),
        (highest("TMAX") < highest("TMIN")).alias("inverted"),
    )


def _raw_metrics(stations: DataFrame, raw_stations: DataFrame, today: Column, undated: Column, future: Column) -> DataFrame:
    """The eight metrics from one row per station."""
    known = raw_stations.select("station_id").distinct().withColumn("known", F.lit(True))
    station_id = F.col("station_id")
    return stations.join(known, "station_id", "left").agg(
        _total(F.when(station_id.isNull(), F.col("rows"))).alias("null_station_id"),
        undated.alias("null_obs_date"),
        future.alias("future_dates"),
        _total(F.col("extreme")).alias("extreme_temperatures"),
        _total(F.col("negative")).alias("negative_precipitation"),
        _total(F.col("inverted")).alias("temp_max_less_than_min"),
        F.date_diff(today, F.max("newest")).alias("data_freshness"),
        F.count_if(station_id.isNotNull() & F.col("known").isNull()).alias("orphan_stations"),
    )


def validate_raw_daily(
    raw_daily: DataFrame, raw_stations: DataFrame, as_of: datetime.date
) -> DataFrame:
    """Eight checks from one scan of the observations.

    Rows fold to station-days (with partial aggregation, so a hot station is
    reduced where it is read), station-days to stations, stations to one row.
    """
    today, date, rows = F.lit(as_of), F.col("obs_date"), F.col("rows")
    stations = _station_days(raw_daily).groupBy("station_id").agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(date.isNull(), rows)).alias("undated"),
        F.sum(F.when(date > today, rows)).alias("future"),
        F.sum("extreme").alias("extreme"),
        F.sum("negative").alias("negative"),
        F.count_if("inverted").alias("inverted"),
        F.max("obs_date").alias("newest"),
    )
    undated, future = _total(F.col("undated")), _total(F.col("future"))
    return run_checks(_raw_metrics(stations, raw_stations, today, undated, future), RAW_DAILY_CHECKS)


def raw_check_parts(raw_daily: DataFrame) -> DataFrame:
    """What the raw checks need of a station's year, so that years can be checked one by one and merged."""
    return _station_days(raw_daily).groupBy("station_id", F.year("obs_date").alias("obs_year")).agg(
        F.sum("rows").alias("rows"),
        F.sum("extreme").alias("extreme"),
        F.sum("negative").alias("negative"),
        F.count_if("inverted").alias("inverted"),
        F.max("obs_date").alias("newest"),
    )


def raw_day_parts(raw_daily: DataFrame) -> DataFrame:
    """Observations of each day in a bucket: which of them lie in the future depends on the day of asking."""
    return raw_daily.groupBy("station_bucket", "obs_date").agg(F.count("*").alias("rows"))


def merged_raw_daily(
    parts: DataFrame, days: DataFrame, raw_stations: DataFrame, as_of: datetime.date
) -> DataFrame:
    """The checks of :func:`validate_raw_daily` from stored parts. Stored observations have a day and a station."""
    today = F.lit(as_of)
    counts = ("rows", "extreme", "negative", "inverted")
    stations = parts.groupBy("station_id").agg(*[F.sum(c).alias(c) for c in counts], F.max("newest").alias("newest"))
    late = days.where(F.col("obs_date") > today).agg(_total(F.col("rows"))).scalar()
    return run_checks(_raw_metrics(stations, raw_stations, today, F.lit(0).cast("long"), late), RAW_DAILY_CHECKS)


def validate_stations(raw_stations: DataFrame) -> DataFrame:
    """Five checks from one scan of the stations, grouped by id for duplicates."""
    by_id = raw_stations.groupBy("station_id").agg(
        F.count("*").alias("rows"),
        F.count_if(_outside(F.col("latitude"), (-90, 90))).alias("bad_latitude"),
        F.count_if(_outside(F.col("longitude"), (-180, 180))).alias("bad_longitude"),
        F.count_if(_outside(F.col("elevation"), ELEVATION_LIMITS)).alias("bad_elevation"),
    )
    metrics = by_id.agg(
        _total(F.col("bad_latitude")).alias("latitude_out_of_range"),
        _total(F.col("bad_longitude")).alias("longitude_out_of_range"),
        F.count_if(F.col("rows") > 1).alias("duplicate_station_ids"),
        _total(F.when(country_code(F.col("station_id")) == "US", F.col("rows"))).alias(
            "us_station_coverage"
        ),
        _total(F.col("bad_elevation")).alias("elevation_out_of_range"),
    )
    return run_checks(metrics, STATION_CHECKS)


def validate_marts(daily: DataFrame, monthly: DataFrame, features: DataFrame) -> DataFrame:
    """Five checks over the marts, one scan each."""
    return merged_marts(weather_parts(daily), month_parts(monthly), feature_parts(features))


def weather_parts(daily: DataFrame, *keys: str) -> DataFrame:
    return daily.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count("tavg_7d_avg").alias("with_average"),
        F.count_if(F.col("station_name").isNull()).alias("without_name"),
    )


def month_parts(monthly: DataFrame, *keys: str) -> DataFrame:
    months = list(dict.fromkeys([*keys, "obs_year", "obs_month"]))
    return monthly.groupBy(*months).agg(F.count("*").alias("rows"))


def feature_parts(features: DataFrame, *keys: str) -> DataFrame:
    return features.groupBy(*keys).agg(F.count("*").alias("rows"))


def merged_marts(weather: DataFrame, months: DataFrame, features: DataFrame) -> DataFrame:
    """The five checks from counts of any parts of the marts."""
    month = F.col("obs_year") * 100 + F.col("obs_month")
    metrics = weather.agg(
        _total(F.col("rows")).alias("mart_daily_weather_populated"),
        _total(F.col("with_average")).alias("rolling_averages_computed"),
        _total(F.col("without_name")).alias("stations_joined_correctly"),
    ).select(
        "*",
        features.agg(_total(F.col("rows"))).scalar().alias("prediction_targets_exist"),
        months.agg(F.count_distinct(month)).scalar().alias("monthly_summary_coverage"),
    )
    return run_checks(metrics, MART_CHECKS)


@dataclass(frozen=True)
class ColumnRule:
    """A rule over a whole table: the aggregate must equal ``expected``."""

    name: str
    metric: Callable[[], Column]
    expected: int = 0


def not_null(column: str) -> ColumnRule:
    return ColumnRule(f"{column}:not_null", lambda: F.count_if(F.col(column).isNull()))


def accepted_values(column: str, values: Sequence[str]) -> ColumnRule:
    return ColumnRule(
        f"{column}:accepted_values", lambda: F.count_if(~F.col(column).isin(*values))
    )


def expect_equal(name: str, metric: Callable[[], Column], expected: int) -> ColumnRule:
    """A custom aggregate and the value it must have."""
    return ColumnRule(name, metric, expected)


def no_failures(name: str) -> ColumnRule:
    """Expects that "there are no FAIL rows" is true (1)."""
    return expect_equal(
        name, lambda: (F.count_if(F.col("check_result") == "FAIL") == 0).cast("int"), 1
    )


def run_column_rules(table: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """One row per rule, all from a single pass over the table."""
    metrics = table.agg(*[r.metric().cast("bigint").alias(f"m{i}") for i, r in enumerate(rules)])
    rows = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.col(f"m{i}").alias("observed"),
            F.lit(r.expected).cast("bigint").alias("expected"),
            (F.col(f"m{i}") == r.expected).alias("holds"),
        )
        for i, r in enumerate(rules)
    ]
    return metrics.select(F.inline(F.array(*rows)))


#: Rules declared on every quality result table.
RESULT_RULES = (
    not_null("check_name"),
    not_null("check_result"),
    accepted_values("check_result", OUTCOMES),
)
