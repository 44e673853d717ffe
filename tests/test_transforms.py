"""Stored tables, batch entry points, quality runs and incremental ingest."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import types as T

from skyledger.plans import transforms
from skyledger.schemas import RAW_DAILY, RAW_STATIONS, TABLES
from skyledger.sources import read_daily_files
from skyledger.sources.warehouse import Warehouse
from skyledger.streaming.landing import ingest_landing

S, OTHER = "US000000001", "CA000000002"
DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_DAILY)


def line(station, year, month, element, *values):
    cells = "".join(f"{v:5d}   " for v in values)
    return f"{station}{year}{month:02d}{element}{cells}\n"


@pytest.fixture
def warehouse(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "wh"), station_buckets=2)
    rows = [(s, 10.0, 20.0, 5.0, "AK", f"NAME {s}", None, None, None) for s in (S, OTHER)]
    wh.replace_stations(spark.createDataFrame(rows, RAW_STATIONS))
    return wh


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "one.dly").write_text(
        line(S, 2019, 1, "TAVG", *range(10)) + line(S, 2020, 1, "TAVG", *range(20))
    )
    return folder


def test_declared_schemas_match_the_plans(spark):
    raw = spark.createDataFrame([], DDL)
    tables = transforms.build_marts(raw, spark.createDataFrame([], RAW_STATIONS))
    for name, df in tables.items():
        declared = [(f.name, f.dataType) for f in T.StructType.fromDDL(TABLES[name])]
        assert [(f.name, f.dataType) for f in df.schema] == declared, name


def test_backfill_refresh_and_force(warehouse, landing):
    tables = transforms.backfill(warehouse, str(landing), 2019, 2020)
    counts = {r.table_name: r.rows for r in transforms.table_counts(tables).collect()}
    assert counts == {
        "staging.daily_observations": 30,
        "staging.stations": 2,
        "marts.daily_weather": 30,
        "marts.monthly_summary": 2,
        "marts.prediction_features": 22,
    }
    (landing / "two.dly").write_text(line(OTHER, 2020, 2, "TAVG", 1, 2, 3))
    transforms.refresh(warehouse, str(landing), 2020)
    assert warehouse.read("marts.daily_weather").count() == 33
    transforms.refresh(warehouse, str(landing), 2020, force=True)
    assert warehouse.read("marts.daily_weather").count() == 23


def test_transforms_of_empty_tables(warehouse):
    warehouse.create()
    tables = transforms.run_transforms(warehouse)
    assert {n: df.count() for n, df in tables.items()} == {
        n: 2 if n == "staging.stations" else 0 for n in transforms.TABLES
    }
    assert not warehouse.is_populated("marts.daily_weather")
    outcome = {
        r.check_name: (r.violation_count, r.check_result)
        for r in transforms.run_quality(warehouse, datetime.date(2020, 1, 1))["quality.marts"].collect()
    }
    assert outcome["mart_daily_weather_populated"] == (0, "FAIL")
    assert outcome["stations_joined_correctly"] == (0, "PASS")


def test_quality_tables_are_stored(warehouse, landing):
    transforms.backfill(warehouse, str(landing), 2019, 2020)
    results = transforms.run_quality(warehouse, datetime.date(2020, 1, 25))
    raw = {r.check_name: r for r in results["quality.raw_daily"].collect()}
    assert len(raw) == 8
    assert raw["data_freshness"].violation_count == 5
    assert raw["data_freshness"].check_result == "PASS"
    assert all(r.checked_at is not None for r in raw.values())


def test_loads_prune_years(warehouse, landing):
    transforms.backfill(warehouse, str(landing), 2019, 2020)
    from skyledger.sources import load_daily

    df = load_daily(warehouse.read("marts.daily_weather"), [S], (2020, 2020))
    assert df.count() == 20
    plan = df._jdf.queryExecution().toString()
    assert "obs_year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(station_id" in plan or "EqualTo(station_id" in plan


def test_stream_picks_up_only_new_files(spark, warehouse, landing, tmp_path):
    years, progress = [2019, 2020], str(tmp_path / "progress")

    def run():
        query = ingest_landing(warehouse, str(landing), years, progress)
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    assert run() == 2
    assert warehouse.daily().count() == 30
    assert run() == 0
    (landing / "later.dly").write_text(line(OTHER, 2020, 3, "TMAX", 5, 6))
    assert run() == 1
    batch = Warehouse(spark, str(tmp_path / "batch"), station_buckets=2)
    batch.create()
    batch.replace_station_years(read_daily_files(spark, str(landing), years), years)
    assert sorted(warehouse.daily().collect()) == sorted(batch.daily().collect())


def test_stream_correction_replaces_the_station_year(warehouse, landing, tmp_path):
    progress = str(tmp_path / "progress")
    ingest_landing(warehouse, str(landing), [2019, 2020], progress).awaitTermination()
    (landing / "fix.dly").write_text(line(S, 2020, 1, "TAVG", 99))
    ingest_landing(warehouse, str(landing), [2020], progress).awaitTermination()
    rows = warehouse.daily(years=[2020]).collect()
    assert [(r.station_id, r.data_value) for r in rows] == [(S, 99)]
    assert warehouse.daily(years=[2019]).count() == 10


def test_duplicate_stations_stop_the_run_unless_allowed(spark, warehouse, landing):
    transforms.backfill(warehouse, str(landing), 2019, 2020)
    stations = warehouse.stations()
    warehouse.replace_stations(spark.createDataFrame(stations.collect() * 2, stations.schema))
    with pytest.raises(transforms.DuplicateStations, match=OTHER):
        transforms.run_transforms(warehouse)
    tables = transforms.run_transforms(warehouse, allow_duplicate_stations=True)
    assert tables["marts.daily_weather"].count() == 60


def test_stream_counts_what_it_cannot_read(warehouse, landing, tmp_path):
    good = line(OTHER, 2020, 4, "TMAX", 5)
    (landing / "bad.dly").write_text(good[:11] + "x" + good[12:])
    ingest_landing(warehouse, str(landing), [2019, 2020], str(tmp_path / "p")).awaitTermination()
    rows = warehouse.read("quality.malformed_batches").collect()
    assert [(r.batch_id, r.bad_years, r.bad_months, r.bad_values) for r in rows] == [(0, 1, 0, 0)]
