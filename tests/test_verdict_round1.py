"""Stored layout, whole histories, unique labels and searches across the date line."""

from __future__ import annotations

import datetime
import math
import random

import pytest

from skyledger.functions.numeric import stddev_of_ticks
from skyledger.operators.directory import with_label
from skyledger.operators.radius import stations_near_points
from skyledger.schemas import RAW_DAILY
from skyledger.sources import load_monthly
from skyledger.sources.warehouse import Warehouse


def _rows(spark, stations, year=2020):
    rows = []
    for k, s in enumerate(stations):
        values = {"station_id": s, "obs_date": datetime.date(year, 1, 1 + k % 28), "element": "TMAX", "data_value": k}
        rows.append(tuple(values.get(c) for c in RAW_DAILY.names))
    return spark.createDataFrame(rows, RAW_DAILY)


def test_bucket_count_is_kept_with_the_table(spark, tmp_path):
    stations = [f"US{k:09d}" for k in range(40)]
    Warehouse(spark, str(tmp_path), station_buckets=64).reload_daily(_rows(spark, stations))
    reopened = Warehouse(spark, str(tmp_path))
    assert reopened.station_buckets == 64
    assert reopened.daily(station_ids=stations).count() == 40
    reopened.replace_station_years(_rows(spark, stations), [2020])
    assert reopened.daily().count() == 40
    assert reopened.stations_with_all_years([2020], stations).count() == 40
    with pytest.raises(ValueError, match="64 station buckets"):
        Warehouse(spark, str(tmp_path), station_buckets=16).daily(station_ids=stations)


def test_all_years_is_the_default(spark):
    columns = "station_id string, obs_year int, obs_month int, avg_temp_celsius double"
    mart = spark.createDataFrame([("A", 1850, 1, 1.0), ("A", 1950, 1, 2.0)], columns)
    assert load_monthly(mart).count() == 2
    assert load_monthly(mart, years=(1900, 2000)).count() == 1
    plan = load_monthly(mart)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_repeated_code_adds_no_row(spark):
    rows = spark.createDataFrame([("x",), ("y",)], "code string")
    labels = spark.createDataFrame([("x", "Two"), ("x", "One")], "code string, name string")
    got = {tuple(r) for r in with_label(rows, "code", labels, "name", "name").select("code", "name").collect()}
    assert got == {("x", "One"), ("y", "y")}


def test_relaxed_search_of_many_points_is_plain_distance(spark):
    rng = random.Random(4)
    places = [(f"S{k}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(400)]
    places += [("E1", 0.0, 179.95), ("E2", 0.0, -179.9), ("P", 89.9, 10.0), ("Q", 89.8, -170.0)]
    stations = spark.createDataFrame(places, "station_id string, latitude double, longitude double")
    points = [(k, lat, lon, r) for k, (lat, lon, r) in enumerate(
        [(0.0, -179.99, 50.0), (89.95, 0.0, 40.0), (10.0, 20.0, 900.0), (-70.0, 179.0, 3000.0), (0.0, 0.0, 30000.0)]
    )]
    asked = spark.createDataFrame(points, "point_id int, latitude double, longitude double, radius_km double")
    got = sorted((r.point_id, r.station_id) for r in stations_near_points(stations, asked, strict_box=False).collect())

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))

    assert got == sorted((k, s) for k, lat, lon, r in points for s, a, b in places if km(lat, lon, a, b) <= r)
    assert {s for k, s in got if k == 0} >= {"E1", "E2"}


def test_deviation_from_exact_sums(spark):
    values = [1.05, 2.5, -3.95, 10.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    mean = sum(values) / 4
    want = math.sqrt(sum((v - mean) ** 2 for v in values) / 3)
    assert abs(df.agg(stddev_of_ticks(df.v, 20)).first()[0] - want) < 1e-12
    assert df.limit(1).agg(stddev_of_ticks(df.v, 20)).first()[0] is None
