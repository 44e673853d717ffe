"""Replacement semantics of the stored tables."""

from __future__ import annotations

import datetime
import pathlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skyledger.schemas import RAW_DAILY
from skyledger.sources.versions import ConcurrentChange, Versions
from skyledger.sources.warehouse import Warehouse, ingest_summary, stations_with_all_years

A, B, C = "US000000001", "CA000000002", "NO000000003"


def row(station, year, value=1, element="TMAX", day=1):
    return (station, datetime.date(year, 1, day), element, value, None, None, None, None)


@pytest.fixture
def warehouse(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "wh"), station_buckets=4)
    wh.create()
    return wh


def frame(spark, rows):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_DAILY)
    return spark.createDataFrame(rows, schema)


def stored(wh, **selection):
    return sorted((r.station_id, r.obs_date.year, r.data_value) for r in wh.daily(**selection).collect())


def test_create_is_empty_and_repeatable(warehouse):
    warehouse.create()
    assert stored(warehouse) == []
    assert not warehouse.is_populated("raw.daily")
    assert not warehouse.exists("marts.daily_weather")


def test_replacing_twice_equals_once(spark, warehouse):
    warehouse.append_daily(frame(spark, [row(A, 2020, 1), row(A, 2021, 2), row(B, 2020, 3)]))
    batch = frame(spark, [row(A, 2020, 10)])
    assert warehouse.replace_station_years(batch, [2020])
    once = stored(warehouse)
    assert once == [(B, 2020, 3), (A, 2020, 10), (A, 2021, 2)]
    warehouse.replace_station_years(batch, [2020])
    assert stored(warehouse) == once


def files(wh, table="raw.daily"):
    root = pathlib.Path(wh.path(table))
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def in_force(wh, table="raw.daily"):
    """Data files that the latest snapshot names."""
    folders = wh.versions(table).latest().folders
    return {f: t for f, t in files(wh, table).items() if any(f.startswith(x + "/") for x in folders)}


def test_new_and_kept_rows_are_written_once(spark, warehouse, monkeypatch):
    warehouse.append_daily(frame(spark, [row(A, 2020), row(B, 2020), row(C, 2020), row(C, 2021)]))
    before, written = files(warehouse), []
    add = Warehouse._add
    monkeypatch.setattr(Warehouse, "_add", lambda self, table, version, rows, *more: written.append(rows.count()) or add(self, table, version, rows, *more))
    same = warehouse.bucket(F.lit(A))
    kept = spark.range(1).select(*[(warehouse.bucket(F.lit(s)) == same).cast("int") for s in (B, C)]).first()
    warehouse.replace_station_years(frame(spark, [row(A, 2020, 5), row(A, 2020, 6, "TMIN")]), [2020])
    assert written == [2, sum(kept)]
    added = set(files(warehouse)) - set(before)
    stored_rows = sum(pq.read_metadata(f"{warehouse.path('raw.daily')}/{f}").num_rows for f in added)
    assert stored_rows == 2 + sum(kept)
    assert {f: t for f, t in files(warehouse).items() if f in before} == before
    assert stored(warehouse) == [(B, 2020, 1), (C, 2020, 1), (C, 2021, 1), (A, 2020, 5), (A, 2020, 6)]


def test_first_load_copies_nothing(spark, warehouse, monkeypatch):
    calls = []
    add = Warehouse._add
    monkeypatch.setattr(Warehouse, "_add", lambda self, *args: calls.append(args[1]) or add(self, *args))
    warehouse.replace_station_years(frame(spark, [row(A, 2020), row(B, 2021)]), [2020, 2021])
    assert len(calls) == 1


@pytest.mark.parametrize("fails_at", ["new", "kept", "commit"])
def test_a_write_that_ends_half_way_leaves_the_old_rows(spark, warehouse, monkeypatch, fails_at):
    """Whichever step is lost, readers see the table before, and repeating the run completes it."""
    warehouse.append_daily(frame(spark, [row(A, 2020, 1), row(B, 2020, 2), row(C, 2021, 3)]))
    before = stored(warehouse)
    batch = frame(spark, [row(s, 2020, 50 + k) for k, s in enumerate((A, C))])
    add, calls = Warehouse._add, []

    def broken_add(self, *args):
        calls.append(1)
        if len(calls) == (1 if fails_at == "new" else 2):
            add(self, *args[:2], args[2].limit(1), *args[3:])  # some files are there already
            raise OSError("lost")
        return add(self, *args)

    def broken_commit(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        if fails_at == "commit":
            patch.setattr(Versions, "commit", broken_commit)
        else:
            patch.setattr(Warehouse, "_add", broken_add)
        if fails_at == "kept":  # every station in one partition, so that there is a second step
            patch.setattr(Warehouse, "bucket", lambda self, station_id: F.lit(0))
            warehouse.reload_daily(frame(spark, [row(A, 2020, 1), row(B, 2020, 2), row(C, 2021, 3)]))
            calls.clear()
        with pytest.raises(OSError):
            warehouse.replace_station_years(batch, [2020])
        assert stored(warehouse) == before
        assert Warehouse(spark, warehouse.root).daily().count() == 3
    warehouse.replace_station_years(batch, [2020])
    assert (A, 2020, 50) in stored(warehouse) and (B, 2020, 2) in stored(warehouse)


@pytest.mark.parametrize("table", ["marts.monthly_summary", "quality.malformed"])
def test_a_lost_replacement_keeps_the_old_table(spark, warehouse, table):
    schema = warehouse.schema(table)
    one = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    warehouse.replace_table(table, one)
    stop = one.withColumn(schema.names[0], F.raise_error(F.lit("lost")).cast(schema[0].dataType))
    with pytest.raises(Exception, match="lost"):
        warehouse.replace_table(table, stop)
    assert warehouse.read(table).count() == 1


def test_a_second_writer_is_refused(spark, warehouse):
    versions = warehouse.versions("raw.daily")
    seen = versions.latest()
    warehouse.append_daily(frame(spark, [row(A, 2020)]))
    with pytest.raises(ConcurrentChange):
        versions.commit(seen, [])
    assert stored(warehouse) == [(A, 2020, 1)]


def test_expired_versions_are_removed_and_the_table_stays(spark, warehouse):
    for value in range(4):
        warehouse.replace_station_years(frame(spark, [row(A, 2020, value)]), [2020])
    warehouse.append_daily(frame(spark, [row(B, 2021, 9)]))
    assert warehouse.expire(keep=1) == 3
    assert stored(warehouse) == [(B, 2021, 9), (A, 2020, 3)]
    assert set(files(warehouse)) == set(in_force(warehouse))


def test_emptied_partitions_take_no_job(spark, warehouse):
    warehouse.append_daily(frame(spark, [row(A, year, year) for year in range(1990, 2020)]))
    warehouse.replace_station_years(frame(spark, [row(A, 2000, 1)]), range(1990, 2020))
    assert stored(warehouse) == [(A, 2000, 1)]
    assert len(warehouse.versions("raw.daily").latest().folders) == 1


def test_requested_year_without_rows_is_emptied(spark, warehouse):
    warehouse.append_daily(frame(spark, [row(A, 2020, 1), row(A, 2021, 2), row(B, 2021, 3)]))
    warehouse.replace_station_years(frame(spark, [row(A, 2020, 9)]), [2020, 2021])
    assert stored(warehouse) == [(B, 2021, 3), (A, 2020, 9)]


def test_sole_station_of_a_partition_is_emptied(spark, warehouse):
    warehouse.append_daily(frame(spark, [row(A, 2020, 1), row(A, 2021, 2)]))
    warehouse.replace_station_years(frame(spark, [row(A, 2020, 9)]), [2020, 2021])
    assert stored(warehouse) == [(A, 2020, 9)]
    assert stored(warehouse, years=[2021]) == []


def test_empty_batch_keeps_old_rows(spark, warehouse):
    warehouse.append_daily(frame(spark, [row(A, 2020, 1)]))
    assert not warehouse.replace_station_years(frame(spark, []), [2020])
    assert not warehouse.replace_years(frame(spark, [row(A, 2019)]), [2020])
    assert stored(warehouse) == [(A, 2020, 1)]


def test_rows_outside_requested_years_are_not_loaded(spark, warehouse):
    warehouse.replace_station_years(frame(spark, [row(A, 2020, 1), row(A, 2021, 2)]), [2020])
    assert stored(warehouse) == [(A, 2020, 1)]


def test_whole_year_replacement_drops_other_stations(spark, warehouse):
    warehouse.append_daily(frame(spark, [row(A, 2020), row(B, 2020), row(C, 2020), row(B, 2021, 5)]))
    warehouse.replace_years(frame(spark, [row(A, 2020, 7)]), [2020])
    assert stored(warehouse) == [(B, 2021, 5), (A, 2020, 7)]


def test_reload_truncates_everything(spark, warehouse):
    warehouse.append_daily(frame(spark, [row(A, 2020), row(B, 2021)]))
    warehouse.reload_daily(frame(spark, [row(C, 2019, 4)]))
    assert stored(warehouse) == [(C, 2019, 4)]


def test_selection_by_station_and_year(spark, warehouse):
    warehouse.append_daily(frame(spark, [row(A, 2020, 1), row(A, 2021, 2), row(B, 2020, 3)]))
    assert stored(warehouse, station_ids=[A], years=[2021]) == [(A, 2021, 2)]
    plan = warehouse.daily(station_ids=[A], years=[2021])._jdf.queryExecution().toString()
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "obs_year" in partition_filters and "station_bucket" in partition_filters


@pytest.mark.parametrize("missing", [0, 1, 2])
def test_null_key_is_refused(spark, warehouse, missing):
    bad = list(row(A, 2020))
    bad[missing] = None
    with pytest.raises(Exception, match="NOT NULL constraint failed"):
        warehouse.append_daily(frame(spark, [tuple(bad)]))


def test_stations_are_fully_replaced(spark, warehouse):
    def stations(*ids):
        rows = [(s, 1.0, 2.0, None, None, "N", None, None, None) for s in ids]
        return spark.createDataFrame(rows, warehouse.stations().schema)

    warehouse.replace_stations(stations(A, B))
    warehouse.replace_stations(stations(C))
    assert [r.station_id for r in warehouse.stations().collect()] == [C]


def test_unknown_namespace_is_refused(warehouse):
    with pytest.raises(ValueError):
        warehouse.path("elsewhere.table")


def test_complete_stations_ignore_repeated_years(spark):
    daily = frame(spark, [row(A, 2020), row(A, 2021), row(B, 2020), row(B, 2020, day=2)])
    got = stations_with_all_years(daily, [2020, 2021, 2021]).collect()
    assert [r.station_id for r in got] == [A]


def test_ingest_outcomes(spark):
    ids = [spark.createDataFrame([(s,) for s in group], "station_id string") for group in ([A, B, C], [A, B], [A, A])]
    assert tuple(ingest_summary(*ids).first()) == (1, 1, 1)
