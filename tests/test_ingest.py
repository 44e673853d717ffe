"""Ingest for a location, stations over several files, and the maintained listing."""

from __future__ import annotations

import os

import pytest

from skyledger.operators import directory
from skyledger.plans import transforms
from skyledger.plans.ingest import ingest_location
from skyledger.schemas import RAW_STATIONS
from skyledger.sources.warehouse import Warehouse
from skyledger.streaming.landing import ingest_landing

A, B, C = "US000000001", "US000000002", "CA000000003"


def line(station, year, month, element, *values):
    return f"{station}{year}{month:02d}{element}{''.join(f'{v:5d}   ' for v in values)}\n"


@pytest.fixture
def warehouse(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "wh"), station_buckets=2)
    places = {A: (10.0, 20.0, "AK"), B: (11.0, 20.0, "WA"), C: (60.0, 20.0, None)}
    rows = [(s, lat, lon, 5.0, state, f"NAME {s}", None, None, None) for s, (lat, lon, state) in places.items()]
    wh.replace_stations(spark.createDataFrame(rows, RAW_STATIONS))
    wh.create()
    return wh


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    return folder


def outcomes(df):
    return {r.station_id: (r.outcome, r.rows) for r in df.collect()}


def stored(wh):
    return sorted((r.station_id, str(r.obs_date), r.element, r.data_value) for r in wh.daily().collect())


def test_files_of_other_stations_are_not_opened(warehouse, landing):
    (landing / f"{A}.dly").write_text(line(A, 2020, 1, "TMAX", 1, 2))
    (landing / f"{C}.dly.gz").write_bytes(b"\x1f\x8b not a gzip file")
    assert outcomes(ingest_location(warehouse, str(landing), [2020], station_ids=[A])) == {A: ("loaded", 2)}
    assert outcomes(ingest_location(warehouse, str(landing), [2020], state="AK", country="CA")) == {A: ("loaded", 2)}
    with pytest.raises(Exception, match="(?i)gzip|header|failed"):
        ingest_location(warehouse, str(landing), [2020], country="CA")


def test_outcomes_and_precedence(warehouse, landing):
    (landing / f"{A}.dly").write_text(line(A, 2020, 1, "TMAX", 1, 2) + line(A, 2021, 1, "TMAX", 3))
    (landing / f"{B}.dly").write_text(line(B, 1999, 1, "TMAX", 1))
    got = ingest_location(warehouse, str(landing), [2020, 2021], station_ids=[C, A], state="WA")
    assert outcomes(got) == {A: ("loaded", 3), C: ("errors", 0)}
    assert outcomes(ingest_location(warehouse, str(landing), [2020], country="US")) == {A: ("loaded", 2), B: ("skipped", 0)}
    assert outcomes(ingest_location(warehouse, str(landing), [2020], point=(10.5, 20.0), radius_km=80)) == {
        A: ("loaded", 2), B: ("skipped", 0),
    }
    assert outcomes(ingest_location(warehouse, str(landing), [2020], country="CA")) == {C: ("errors", 0)}
    assert [r[1][:4] for r in stored(warehouse)] == ["2020", "2020", "2021"]
    with pytest.raises(ValueError):
        ingest_location(warehouse, str(landing), [2020])


def test_an_ingest_replaces_years_and_keeps_others(warehouse, landing):
    (landing / f"{A}.dly").write_text(line(A, 2020, 1, "TMAX", 1, 2) + line(A, 2021, 1, "TMAX", 3))
    ingest_location(warehouse, str(landing), [2020, 2021], station_ids=[A])
    (landing / f"{A}.dly").write_text(line(A, 2020, 1, "TMAX", 9))
    ingest_location(warehouse, str(landing), [2020], station_ids=[A])
    assert [(r[1], r[3]) for r in stored(warehouse)] == [("2020-01-01", 9), ("2021-01-01", 3)]
    (landing / f"{A}.dly").write_text("\n")
    (landing / f"{B}.dly").write_text("")
    assert outcomes(ingest_location(warehouse, str(landing), [2020], station_ids=[A, B], force=True)) == {
        A: ("skipped", 0), B: ("errors", 0),
    }
    assert stored(warehouse) == []


def land(folder, name, text, second):
    path = folder / name
    path.write_text(text)
    os.utime(path, (1_700_000_000 + second,) * 2)


def run(warehouse, landing, progress, **options):
    query = ingest_landing(warehouse, str(landing), [2019, 2020], str(progress), scope="file", **options)
    query.awaitTermination()


def test_two_files_of_a_station_keep_both_files_rows(warehouse, landing, tmp_path):
    land(landing, "one.dly", line(A, 2020, 1, "TMAX", 1, 2) + line(B, 2020, 1, "TMAX", 5), 1)
    run(warehouse, landing, tmp_path / "p")
    land(landing, "two.dly", line(A, 2020, 2, "TMAX", 3) + line(A, 2020, 1, "TMIN", 4), 2)
    run(warehouse, landing, tmp_path / "p")
    assert [(r[0], r[1], r[2], r[3]) for r in stored(warehouse)] == [
        (A, "2020-01-01", "TMAX", 1), (A, "2020-01-01", "TMIN", 4), (A, "2020-01-02", "TMAX", 2),
        (A, "2020-02-01", "TMAX", 3), (B, "2020-01-01", "TMAX", 5),
    ]


def test_a_file_that_comes_again_replaces_its_own_rows(spark, warehouse, landing, tmp_path):
    """The second delivery is in another folder, under the same name."""
    land(landing, "one.dly", line(A, 2020, 1, "TMAX", 1, 2) + line(B, 2019, 1, "TMAX", 5), 1)
    land(landing, "two.dly", line(A, 2020, 2, "TMAX", 3), 2)
    run(warehouse, landing, tmp_path / "p")
    again = tmp_path / "again"
    again.mkdir()
    land(again, "one.dly", line(A, 2020, 1, "TMAX", 7), 9)
    run(warehouse, again, tmp_path / "q")
    assert stored(warehouse) == [(A, "2020-01-01", "TMAX", 7), (A, "2020-02-01", "TMAX", 3)]
    empty = tmp_path / "empty"
    empty.mkdir()
    land(empty, "one.dly", line(A, 1999, 1, "TMAX", 7), 10)
    run(warehouse, empty, tmp_path / "r")
    assert stored(warehouse) == [(A, "2020-02-01", "TMAX", 3)]
    landed = warehouse.read("raw.landed_files").collect()
    assert [(r.landing_file, r.station_id, r.obs_year, r.rows) for r in landed] == [("two.dly", A, 2020, 1)]


@pytest.mark.parametrize("per_batch", [1, 10])
def test_the_file_that_landed_last_has_the_cell(warehouse, landing, tmp_path, per_batch):
    land(landing, "b.dly", line(A, 2020, 1, "TMAX", 1, 2), 1)
    land(landing, "a.dly", line(A, 2020, 1, "TMAX", 8), 2)
    land(landing, "c.dly", line(A, 2020, 1, "TMAX", -9999, -9999, 4), 3)
    run(warehouse, landing, tmp_path / "p", max_files_per_batch=per_batch)
    assert [(r[1], r[3]) for r in stored(warehouse)] == [("2020-01-01", 8), ("2020-01-02", 2), ("2020-01-03", 4)]


def test_batch_loads_and_files_share_the_table(spark, warehouse, landing, tmp_path):
    land(landing, "one.dly", line(A, 2020, 1, "TMAX", 1, 2), 1)
    run(warehouse, landing, tmp_path / "p")
    warehouse.append_daily(warehouse.daily().withColumnRenamed("x", "y").limit(0))
    batch = warehouse.daily().where("day(obs_date) = 2")
    warehouse.replace_station_years(batch, [2020])
    assert [r[1] for r in stored(warehouse)] == ["2020-01-02"]


def test_unknown_scope_is_refused(warehouse, landing, tmp_path):
    with pytest.raises(ValueError, match="scope"):
        ingest_landing(warehouse, str(landing), [2020], str(tmp_path / "p"), scope="line")


def test_listing_from_years_equals_the_scan_after_each_replacement(spark, warehouse, landing):
    def check():
        transforms.run_transforms(warehouse)
        scan = directory.available_stations(warehouse.read(transforms.WEATHER)).collect()
        assert directory.available_from_years(warehouse.read(transforms.SPANS), warehouse.read(transforms.STATIONS)).collect() == scan
        return {r.station_id: r.has_temp for r in scan}

    (landing / f"{A}.dly").write_text(line(A, 2020, 1, "TAVG", 1, 2) + line(A, 2021, 1, "PRCP", 3))
    (landing / f"{C}.dly").write_text(line(C, 2020, 1, "PRCP", 1, 2))
    ingest_location(warehouse, str(landing), [2020, 2021], station_ids=[A, C])
    assert check() == {A: True, C: False}
    (landing / f"{A}.dly").write_text(line(A, 2020, 1, "PRCP", 1))
    ingest_location(warehouse, str(landing), [2020], station_ids=[A])
    assert check() == {A: False, C: False}
    warehouse.replace_years(warehouse.daily(years=[2021]).limit(0).union(warehouse.daily(years=[2020]).where(f"station_id = '{C}'")), [2020])
    assert check() == {A: False, C: False}
    warehouse.reload_daily(warehouse.daily().where(f"station_id = '{C}'"))
    assert check() == {C: False}
