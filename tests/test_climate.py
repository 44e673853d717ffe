"""Estimates, profiles, similarity ranking and display frames."""

from __future__ import annotations

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.functions import c_to_f, f_to_c, haversine_km, half_even, rainfall, round_scaled
from skyledger.functions.climate import FEATURES
from skyledger.operators import climate, frames
from skyledger.schemas import RAW_STATIONS, TABLES
from skyledger.sources.lookups import country_dim


def estimates(spark, *places):
    rows = [(f"US{n:09d}", lat, 0.0, elev, None, "N", None, None, None) for n, (lat, elev) in enumerate(places)]
    return climate.estimated_climate(spark.createDataFrame(rows, RAW_STATIONS)).orderBy("station_id").collect()


def test_estimates_by_hand(spark):
    equator, high, polar, below = estimates(spark, (0.0, 0.0), (40.0, 2000.0), (-80.0, None), (0.0, -100.0))
    assert (equator.avg_temp_c, equator.avg_summer_temp_c, equator.avg_winter_temp_c) == (27.0, 27.8, 26.2)
    assert (equator.temp_variability, equator.annual_precip_mm, equator.heat_days_per_year) == (2.0, 1800.0, 16.0)
    assert high.avg_temp_c == -4.0 and high.annual_precip_mm == 900.0
    assert high.annual_snowfall_mm == np.round(800 + 40 * 11.75)
    assert polar.elevation == 0.0 and polar.climate_zone == "Polar"
    assert polar.avg_temp_c == -9.0 and polar.cold_days_per_year == np.round(6 * (23.75 - 15))
    assert polar.annual_precip_mm == 240.0
    assert below.avg_temp_c == 27.0


def test_variability_and_rain_have_floors(spark):
    (pole,) = estimates(spark, (90.0, 0.0))
    assert pole.temp_variability == np.round(2 + 13.5 - 8.1, 1)
    assert pole.annual_precip_mm == 210.0


MONTH = [f.split()[0] for f in TABLES["marts.monthly_summary"].split(", ")]


def months(spark, rows):
    """Rows are (station, year, month, avg, stddev, precip, snow, heat, cold)."""
    full = []
    for station, year, month, avg, dev, rain, snow, heat, cold in rows:
        values = dict.fromkeys(MONTH)
        values |= {
            "station_id": station, "obs_year": year, "obs_month": month, "avg_temp_celsius": avg,
            "temp_stddev": dev, "total_precip_mm": rain, "total_snowfall_mm": snow,
            "extreme_heat_days": heat, "extreme_cold_days": cold,
        }
        full.append(tuple(values[c] for c in MONTH))
    return spark.createDataFrame(full, TABLES["marts.monthly_summary"])


def test_observed_needs_six_months(spark):
    rows = [("A", 2020, m, 1.0, None, 10.0, 0.0, 0, 0) for m in range(1, 6)]
    rows.append(("A", 2021, 1, None, 1.0, 99.0, 9.0, 1, 1))
    assert climate.observed_climate(months(spark, rows)).collect() == []
    rows.append(("A", 2021, 6, 4.0, 2.0, 20.0, 6.0, 3, 1))
    (got,) = climate.observed_climate(months(spark, rows)).collect()
    assert got.avg_temp_c == 1.5 and got.avg_summer_temp_c == 4.0 and got.avg_winter_temp_c == 1.0
    assert got.temp_variability == 2.0
    assert (got.annual_precip_mm, got.annual_snowfall_mm) == (35.0, 3.0)
    assert (got.heat_days_per_year, got.cold_days_per_year) == (1.5, 0.5)


def test_overlay_keeps_estimates_where_nothing_was_observed(spark):
    stations = spark.createDataFrame(
        [(s, 10.0, 0.0, None, None, "N", None, None, None) for s in ("A", "B")], RAW_STATIONS
    )
    rows = [("A", 2020, m, 1.0, None, 10.0, 0.0, 0, 0) for m in (1, 2, 3, 4, 5, 9)]
    rows += [("C", 2020, m, 1.0, None, 10.0, 0.0, 0, 0) for m in range(1, 13)]
    got = {r.station_id: r for r in climate.climate_profiles(stations, months(spark, rows)).collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"].data_source, got["B"].data_source) == ("observed", "estimated")
    assert got["A"].avg_temp_c == 1.0
    assert got["A"].avg_summer_temp_c == got["B"].avg_summer_temp_c
    assert got["A"].temp_variability == got["B"].temp_variability


def profiles(spark, rows):
    """Rows are (station, country, eight feature values)."""
    names = ", ".join(f"{c} double" for c in FEATURES)
    return spark.createDataFrame(
        [(s, f"NAME {s}", country, "Polar", "estimated", *map(lambda v: None if v is None else float(v), values)) for s, country, values in rows],
        f"station_id string, station_name string, country_code string, climate_zone string, data_source string, {names}",
    )


def test_similarity_matches_numpy(spark):
    rng = random.Random(1)
    rows = [(f"S{n:03d}", "US", [rng.choice([None, rng.uniform(-50, 900)]) for _ in FEATURES]) for n in range(40)]
    wanted = dict(zip(FEATURES, [rng.uniform(-50, 900) for _ in FEATURES], strict=True))
    matrix = np.array([[0.0 if v is None else v for v in values] for _, _, values in rows])
    low, span = matrix.min(axis=0), np.ptp(matrix, axis=0)
    scaled = (matrix - low) / span
    target = (np.array(list(wanted.values())) - low) / span
    expected = scaled @ target / (np.linalg.norm(scaled, axis=1) * np.linalg.norm(target))
    got = climate.climate_similarity(profiles(spark, rows), wanted).orderBy("station_id").collect()
    assert np.allclose([r.similarity for r in got], expected)
    assert [r.similarity_pct for r in got] == [round(100 * x, 1) for x in expected]


def test_preferences_in_fahrenheit():
    wanted = climate.DEFAULT_PREFERENCES | {
        "avg_temp_c": 59.0, "avg_summer_temp_c": 77.0, "avg_winter_temp_c": 41.0,
    }
    assert climate.preferences_from_fahrenheit(wanted) == climate.DEFAULT_PREFERENCES


def test_constant_feature_and_zero_vector(spark):
    rows = [("A", "US", [1, 5] + [0] * 6), ("B", "US", [2, 5] + [0] * 6)]
    wanted = dict.fromkeys(FEATURES, 0.0) | {"avg_temp_c": 2.0, "avg_summer_temp_c": 5.0}
    got = {r.station_id: r.similarity for r in climate.climate_similarity(profiles(spark, rows), wanted).collect()}
    assert got == {"A": 0.0, "B": 1.0}


def test_diverse_top_equals_greedy_choice(spark):
    rng = random.Random(9)
    rows = [(f"S{n:03d}", rng.choice(["US"] * 6 + ["CA", "BR", "NO", "RS", "GM"]), rng.randrange(30) / 30) for n in range(200)]
    df = spark.createDataFrame(rows, "station_id string, country_code string, similarity double")
    taken, counts = [], {}
    for station, country, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        if counts.get(country, 0) < 3 and len(taken) < 10:
            taken.append(station)
            counts[country] = counts.get(country, 0) + 1
    got = [r.station_id for r in climate.diverse_top(df, n=10).collect()]
    assert got == taken


def test_match_table_and_radar(spark):
    rows = [(f"S{n}", "US" if n % 2 else "QQ", [n, n + 1.26, n, n, n, n, n, n]) for n in range(6)]
    prefs = dict.fromkeys(FEATURES, 5.0)
    base = profiles(spark, rows)
    top = climate.diverse_top(climate.climate_similarity(base, prefs))
    table = climate.match_table(top, country_dim(spark, [("US", "United States", "USA")]), unit="F").collect()
    assert {r.country for r in table} == {"United States", "QQ"}
    assert "temp_variability" not in table[0].asDict()
    s5 = next(r for r in table if r.station_name == "NAME S5")
    assert (s5.avg_temp_c, s5.avg_summer_temp_c) == (41.0, 43.3)
    radar = climate.radar_frame(base, top, prefs).collect()
    assert len(radar) == 4 * 8
    mine = {r.feature: r.value for r in radar if r.series == "Your preference"}
    assert mine["Avg Temp"] == 1.0 and math.isclose(mine["Summer Temp"], (5 - 1.26) / 5)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_numeric_helpers(spark):
    row = one(
        spark,
        a=round_scaled(F.lit(1.005), 2), b=round_scaled(F.lit(-0.04), 1), c=half_even(F.lit(2.5), 0),
        d=half_even(F.lit(-0.4), 0), e=round_scaled(F.lit(None).cast("double"), 1),
        f=c_to_f(F.lit(100.0)), g=f_to_c(F.lit(212.0)), h=c_to_f(F.lit(None).cast("double")),
        i=rainfall(F.lit(None).cast("double"), F.lit(3.0)), j=rainfall(F.lit(5.0), F.lit(None).cast("double")),
        k=haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)),
    )
    assert (row.a, row.c) == (1.0, 2.0)
    assert math.copysign(1, row.b) == 1 and math.copysign(1, row.d) == 1
    assert (row.e, row.h) == (None, None)
    assert (row.f, row.g, row.i, row.j) == (212.0, 100.0, 0.0, 5.0)
    assert math.isclose(row.k, math.pi * 6371)


def test_frames(spark):
    day = datetime.date(2020, 1, 1)
    daily = spark.createDataFrame(
        [("A", "NA", day, 10.0, None, 5.0, 2.0, 3.0, 1.0, 9.0), ("A", "NA", day, 0.0, 0.0, 0.0, None, None, 0.0, 9.0)],
        "station_id string, station_name string, obs_date date, tmax_celsius double, tmin_celsius double, "
        "tavg_7d_avg double, temp_change_1d double, precipitation_mm double, snowfall_mm double, precip_30d_total double",
    )
    series = {(r.series, r.value) for r in frames.temperature_frame(daily, "F").collect()}
    assert series == {("max", 50.0), ("min", None), ("7d avg", 41.0), ("max", 32.0), ("min", 32.0), ("7d avg", 32.0)}
    changes = [r.temp_change for r in frames.temperature_change_frame(daily, "F").collect()]
    assert changes == [3.6, None]
    assert [r.rainfall_mm for r in frames.precipitation_frame(daily).collect()] == [2.0, 0.0]
    assert frames.snowfall_frame(daily).count() == 1
    with pytest.raises(ValueError):
        frames.temperature_frame(daily, "K")


def test_target_frame_names(spark):
    day = datetime.date(2020, 1, 1)
    features = spark.createDataFrame(
        [("A", day, 1.0, 2.0), ("B", day, 3.0, 4.0)],
        "station_id string, obs_date date, tavg_derived_celsius double, target_tavg_next_day double",
    )
    daily = spark.createDataFrame([("A", "NA"), ("A", "NA")], "station_id string, station_name string")
    got = {(r.station_name, r.series, r.value) for r in frames.target_frame(features, daily).collect()}
    assert got == {("NA", "actual", 1.0), ("NA", "next-day target", 2.0), ("B", "actual", 3.0), ("B", "next-day target", 4.0)}
