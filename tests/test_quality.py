"""Every check at the edges of its limits, and the column rules."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from skyledger.operators import quality
from skyledger.schemas import RAW_DAILY, RAW_STATIONS

TODAY = datetime.date(2024, 6, 30)
DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_DAILY)


@pytest.mark.parametrize(
    "suite, name, metric, expected",
    [
        (quality.RAW_DAILY_CHECKS, "null_station_id", 0, "PASS"),
        (quality.RAW_DAILY_CHECKS, "null_station_id", 1, "FAIL"),
        (quality.RAW_DAILY_CHECKS, "null_obs_date", 1, "FAIL"),
        (quality.RAW_DAILY_CHECKS, "future_dates", 0, "PASS"),
        (quality.RAW_DAILY_CHECKS, "future_dates", 99, "WARN"),
        (quality.RAW_DAILY_CHECKS, "future_dates", 100, "FAIL"),
        (quality.RAW_DAILY_CHECKS, "extreme_temperatures", 49, "WARN"),
        (quality.RAW_DAILY_CHECKS, "extreme_temperatures", 50, "FAIL"),
        (quality.RAW_DAILY_CHECKS, "negative_precipitation", 1, "FAIL"),
        (quality.RAW_DAILY_CHECKS, "temp_max_less_than_min", 99, "WARN"),
        (quality.RAW_DAILY_CHECKS, "temp_max_less_than_min", 100, "FAIL"),
        (quality.RAW_DAILY_CHECKS, "data_freshness", 7, "PASS"),
        (quality.RAW_DAILY_CHECKS, "data_freshness", 8, "WARN"),
        (quality.RAW_DAILY_CHECKS, "data_freshness", 30, "WARN"),
        (quality.RAW_DAILY_CHECKS, "data_freshness", 31, "FAIL"),
        (quality.RAW_DAILY_CHECKS, "data_freshness", -1, "PASS"),
        (quality.RAW_DAILY_CHECKS, "data_freshness", None, "FAIL"),
        (quality.RAW_DAILY_CHECKS, "orphan_stations", 49, "WARN"),
        (quality.RAW_DAILY_CHECKS, "orphan_stations", 50, "FAIL"),
        (quality.STATION_CHECKS, "latitude_out_of_range", 1, "FAIL"),
        (quality.STATION_CHECKS, "longitude_out_of_range", 1, "FAIL"),
        (quality.STATION_CHECKS, "duplicate_station_ids", 1, "FAIL"),
        (quality.STATION_CHECKS, "us_station_coverage", 1000, "FAIL"),
        (quality.STATION_CHECKS, "us_station_coverage", 1001, "WARN"),
        (quality.STATION_CHECKS, "us_station_coverage", 5000, "WARN"),
        (quality.STATION_CHECKS, "us_station_coverage", 5001, "PASS"),
        (quality.STATION_CHECKS, "elevation_out_of_range", 9, "WARN"),
        (quality.STATION_CHECKS, "elevation_out_of_range", 10, "FAIL"),
        (quality.MART_CHECKS, "mart_daily_weather_populated", 0, "FAIL"),
        (quality.MART_CHECKS, "rolling_averages_computed", 1, "PASS"),
        (quality.MART_CHECKS, "prediction_targets_exist", 0, "FAIL"),
        (quality.MART_CHECKS, "prediction_targets_exist", 1000, "WARN"),
        (quality.MART_CHECKS, "prediction_targets_exist", 1001, "PASS"),
        (quality.MART_CHECKS, "monthly_summary_coverage", 2, "FAIL"),
        (quality.MART_CHECKS, "monthly_summary_coverage", 11, "WARN"),
        (quality.MART_CHECKS, "monthly_summary_coverage", 12, "PASS"),
        (quality.MART_CHECKS, "stations_joined_correctly", 99, "WARN"),
        (quality.MART_CHECKS, "stations_joined_correctly", 100, "FAIL"),
    ],
)
def test_limits(spark, suite, name, metric, expected):
    (check,) = [c for c in suite if c.name == name]
    metrics = spark.createDataFrame([(metric,)], f"{name} bigint")
    (row,) = quality.run_checks(metrics, [check]).collect()
    assert row.check_result == expected
    assert row.violation_count == (-1 if metric is None else metric)


def observations(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], DDL)


def stations(spark, rows):
    full = [(s, lat, lon, elev, None, "N", None, None, None) for s, lat, lon, elev in rows]
    return spark.createDataFrame(full, RAW_STATIONS)


def by_name(df):
    return {r.check_name: r.violation_count for r in df.collect()}


def test_raw_suite_counts(spark):
    d = datetime.date(2024, 6, 20)
    nullable = DDL
    rows = [
        (None, d, "TMAX", 1, None, None, None, None),
        ("US1", None, "TMAX", 1, None, None, None, None),
        ("US1", None, "PRCP", 2, None, None, None, None),
        ("US1", datetime.date(2024, 7, 2), "PRCP", -1, None, "X", None, None),
        ("US1", d, "TMAX", 601, None, "X", None, None),
        ("US1", d, "TMIN", -901, None, None, None, None),
        ("US1", d, "PRCP", 700, None, None, None, None),
        ("ZZ1", d, "TMAX", 10, None, "G", None, None),
        ("ZZ1", d, "TMIN", 20, None, None, None, None),
        ("ZZ2", d, "SNOW", 20, None, None, None, None),
    ]
    raw = spark.createDataFrame(rows, nullable)
    known = stations(spark, [("US1", 1.0, 1.0, None), ("US1", 2.0, 2.0, None)])
    assert by_name(quality.validate_raw_daily(raw, known, TODAY)) == {
        "null_station_id": 1,
        "null_obs_date": 2,
        "future_dates": 1,
        "extreme_temperatures": 2,
        "negative_precipitation": 1,
        "temp_max_less_than_min": 1,
        "data_freshness": -2,
        "orphan_stations": 2,
    }


def test_raw_suite_on_nothing(spark):
    got = quality.validate_raw_daily(observations(spark, []), stations(spark, []), TODAY).collect()
    results = {r.check_name: (r.violation_count, r.check_result) for r in got}
    assert results.pop("data_freshness") == (-1, "FAIL")
    assert set(results.values()) == {(0, "PASS")}


def test_station_suite_counts(spark):
    rows = [
        ("US1", 95.0, -200.0, None), ("US2", -91.0, 0.0, -501.0), ("US2", 0.0, 181.0, 9001.0),
        ("CA1", None, None, -500.0), ("CA2", 90.0, 180.0, 9000.0),
    ]
    assert by_name(quality.validate_stations(stations(spark, rows))) == {
        "latitude_out_of_range": 2,
        "longitude_out_of_range": 2,
        "duplicate_station_ids": 1,
        "us_station_coverage": 3,
        "elevation_out_of_range": 2,
    }
    assert set(by_name(quality.validate_stations(stations(spark, []))).values()) == {0}


def test_column_rules(spark):
    table = spark.createDataFrame(
        [("a", "PASS"), (None, "FAIL"), ("c", "ODD"), ("d", None)],
        "check_name string, check_result string",
    )
    rules = (
        *quality.RESULT_RULES,
        quality.no_failures("none fail"),
        quality.expect_equal("rows", lambda: F.count("*"), 4),
    )
    got = {r.rule: (r.observed, r.expected, r.holds) for r in quality.run_column_rules(table, rules).collect()}
    assert got == {
        "check_name:not_null": (1, 0, False),
        "check_result:not_null": (1, 0, False),
        "check_result:accepted_values": (1, 0, False),
        "none fail": (0, 1, False),
        "rows": (4, 4, True),
    }
