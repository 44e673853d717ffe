"""Edges of staging, windows and the monthly rollup."""

from __future__ import annotations

import datetime
import math
import random
import statistics

from skyledger.operators import marts, staging
from skyledger.schemas import RAW_DAILY, RAW_STATIONS

SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_DAILY)
S = "US000000001"


def raw(spark, cells):
    """Cells are (station, date, element, value[, q_flag])."""
    rows = [(s, d, e, v, None, q[0] if q else None, None, None) for s, d, e, v, *q in cells]
    return spark.createDataFrame(rows, SCHEMA)


def stations(spark, *ids, lat=10.0):
    rows = [(s, lat, 20.0, 5.0, "AK", f"NAME {s}", None, None, None) for s in ids]
    return spark.createDataFrame(rows, RAW_STATIONS)


def weather(spark, cells, *ids):
    ids = ids or (S,)
    return marts.daily_weather(
        staging.stage_daily(raw(spark, cells)), staging.stage_stations(stations(spark, *ids))
    )


def day(n):
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=n)


def test_duplicates_flags_and_other_elements(spark):
    cells = [
        (S, day(0), "TMAX", 100), (S, day(0), "TMAX", 250), (S, day(0), "TMAX", 400, "G"),
        (S, day(0), "TMIN", 50), (S, day(1), "WT01", 1), (S, day(2), "TMAX", 10, "X"),
    ]
    rows = {r.obs_date: r for r in staging.stage_daily(raw(spark, cells)).collect()}
    assert set(rows) == {day(0), day(1)}
    assert rows[day(0)].tmax_celsius == 25.0
    assert rows[day(0)].tavg_derived_celsius == 15.0
    assert rows[day(0)].temp_range_celsius == 20.0
    assert rows[day(1)].tavg_derived_celsius is None


def test_mean_needs_both_extremes(spark):
    cells = [(S, day(0), "TMAX", 100), (S, day(1), "TAVG", 77), (S, day(1), "TMAX", 90)]
    rows = {r.obs_date: r for r in staging.stage_daily(raw(spark, cells)).collect()}
    assert rows[day(0)].tavg_derived_celsius is None
    assert rows[day(1)].tavg_derived_celsius == 7.7


def test_windows_count_rows_not_days(spark):
    gaps = [0, 1, 2, 10, 11, 30, 31, 32, 60]
    cells = [(S, day(d), "TAVG", 10 * k) for k, d in enumerate(gaps)]
    rows = weather(spark, cells).orderBy("obs_date").collect()
    assert [r.tavg_7d_avg for r in rows][:3] == [0.0, 0.5, 1.0]
    assert rows[8].tavg_7d_avg == statistics.mean(range(2, 9))
    assert rows[8].tavg_30d_avg == statistics.mean(range(9))
    assert rows[0].temp_change_1d is None and rows[6].temp_change_7d is None
    assert rows[7].temp_change_7d == 7.0
    assert rows[0].precip_30d_total is None and rows[0].had_precipitation is False


def test_random_history_matches_plain_python(spark):
    rng = random.Random(3)
    ids = ["US000000001", "CA000000002"]
    series = {s: [rng.choice([None, rng.randrange(0, 400)]) for _ in range(80)] for s in ids}
    cells = [(s, day(n), "PRCP", v) for s in ids for n, v in enumerate(series[s]) if v is not None]
    cells += [(s, day(n), "SNWD", 0) for s in ids for n in range(80)]
    rng.shuffle(cells)
    rows = {(r.station_id, r.obs_date): r for r in weather(spark, cells, *ids).collect()}
    assert len(rows) == 160
    for s in ids:
        for n in range(80):
            last30 = [v / 10 for v in series[s][max(0, n - 29) : n + 1] if v is not None]
            last7 = [v / 10 for v in series[s][max(0, n - 6) : n + 1] if v is not None]
            got = rows[s, day(n)]
            assert (got.precip_30d_total is None) == (not last30)
            if last30:
                assert math.isclose(got.precip_30d_total, sum(last30), abs_tol=1e-9)
            if last7:
                assert math.isclose(got.precip_7d_avg, statistics.mean(last7), abs_tol=1e-9)


def test_calendar_flags_and_orphans(spark):
    sunday = datetime.date(2020, 3, 1)
    cells = [
        (S, sunday, "TMAX", 351), (S, sunday, "TMIN", -201), (S, sunday, "PRCP", 1),
        ("ZZ000000009", sunday, "TMAX", 1),
    ]
    (row,) = weather(spark, cells).collect()
    assert (row.obs_year, row.obs_month, row.day_of_week, row.day_of_year) == (2020, 3, 0, 61)
    assert row.is_extreme_heat and row.is_extreme_cold and row.had_precipitation
    assert row.had_snowfall is False


def test_limits_are_exclusive(spark):
    cells = [(S, day(0), "TMAX", 350), (S, day(0), "TMIN", -200), (S, day(0), "PRCP", 0)]
    (row,) = weather(spark, cells).collect()
    assert not (row.is_extreme_heat or row.is_extreme_cold or row.had_precipitation)


def test_month_with_one_day(spark):
    (row,) = marts.monthly_summary(weather(spark, [(S, day(0), "TAVG", 123)])).collect()
    assert row.avg_temp_celsius == 12.3 and row.temp_stddev is None
    assert row.total_precip_mm == 0.0 and row.avg_precip_per_rainy_day_mm is None
    assert (row.observation_count, row.temp_observation_count) == (1, 1)


def test_month_without_temperature(spark):
    cells = [(S, day(0), "PRCP", 5), (S, day(1), "PRCP", 0), (S, day(2), "SNOW", 7)]
    (row,) = marts.monthly_summary(weather(spark, cells)).collect()
    assert row.avg_temp_celsius is None
    assert (row.total_precip_mm, row.days_with_precip, row.avg_precip_per_rainy_day_mm) == (0.5, 1, 0.5)
    assert (row.total_snowfall_mm, row.days_with_snow) == (7.0, 1)


def test_features_need_target_and_a_week(spark):
    cells = [(S, day(n), "TAVG", 10 * n) for n in range(10)]
    rows = marts.prediction_features(weather(spark, cells)).orderBy("obs_date").collect()
    assert [r.obs_date for r in rows] == [day(7), day(8)]
    first = rows[0]
    assert (first.tavg_lag_1d, first.tavg_lag_2d, first.tavg_lag_3d, first.tavg_lag_7d) == (6, 5, 4, 0)
    assert first.target_tavg_next_day == 8.0
    assert math.isclose(first.season_sin, math.sin(2 * math.pi * 8 / 365))


def test_row_order_does_not_matter(spark):
    rng = random.Random(11)
    cells = [(S, day(n), e, rng.randrange(-300, 300)) for n in range(60) for e in ("TMAX", "TMIN", "PRCP")]
    one = marts.monthly_summary(weather(spark, cells)).orderBy("obs_month").collect()
    rng.shuffle(cells)
    assert marts.monthly_summary(weather(spark, cells)).orderBy("obs_month").collect() == one


def test_station_bands(spark):
    lats = {"A0": 0.0, "B0": 23.4, "C0": 23.5, "D0": -35.0, "E0": 55.0, "F0": -66.5, "G0": None}
    rows = [(f"{k}000000001", v, 1.0, None, None, k, None, None, None) for k, v in lats.items()]
    staged = staging.stage_stations(spark.createDataFrame(rows, RAW_STATIONS)).collect()
    zones = {r.country_code: (r.climate_zone, r.hemisphere) for r in staged}
    assert zones == {
        "A0": ("Tropical", "Northern"),
        "B0": ("Tropical", "Northern"),
        "C0": ("Subtropical", "Northern"),
        "D0": ("Temperate", "Southern"),
        "E0": ("Subarctic", "Northern"),
        "F0": ("Polar", "Southern"),
    }


def test_duplicate_ids_are_reported(spark):
    got = staging.duplicate_station_ids(stations(spark, S, S, "CA000000002")).collect()
    assert [(r.station_id, r.occurrences) for r in got] == [(S, 2)]


def test_unknown_id_is_not_a_us_station(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0, None, None, "N", None, None, None)], RAW_STATIONS)
    assert staging.stage_stations(df).first().is_us_station is False
