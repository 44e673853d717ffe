"""Refreshing only what a change reaches gives what building everything gives."""

from __future__ import annotations

import datetime
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from skyledger.operators import quality
from skyledger.plans import transforms
from skyledger.plans.reach import partitions_to_read, partitions_to_rebuild
from skyledger.schemas import RAW_DAILY, RAW_STATIONS
from skyledger.sources.warehouse import Warehouse

SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_DAILY)
YEARS = range(2000, 2009)
#: Days a year of each station: whole years, a few days a year (windows reach over years), gaps.
DENSITY = {
    "US000000001": dict.fromkeys(YEARS, 60),
    "US000000002": dict.fromkeys(YEARS, 5),
    "CA000000003": {2000: 40, 2003: 10, 2004: 10, 2008: 40},
    "CA000000004": {2001: 28, 2002: 1, 2003: 29, 2005: 30, 2006: 31},
    "NO000000005": {2004: 3},
    "ZZ000000006": dict.fromkeys(YEARS, 20),
}
BUCKETS = 3


def observations(seed, density=DENSITY):
    rng = random.Random(seed)
    rows = []
    for station, years in density.items():
        for year, days in years.items():
            for day in rng.sample(range(365), days):
                date = datetime.date(year, 1, 1) + datetime.timedelta(days=day)
                for element in rng.sample(("TMAX", "TMIN", "TAVG", "PRCP", "SNOW"), rng.choice((1, 3, 5))):
                    rows.append((station, date, element, rng.randrange(-200, 400), None, None, None, None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def stations(spark, shift=0.0):
    rows = [(s, 10.0 + k + shift, 20.0, 5.0, None, f"N{k}", None, None, None) for k, s in enumerate(DENSITY) if s[:2] != "ZZ"]
    return spark.createDataFrame(rows, RAW_STATIONS)


@pytest.fixture
def built(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "wh"), station_buckets=BUCKETS)
    wh.replace_stations(stations(spark))
    wh.reload_daily(frame(spark, observations(1)))
    transforms.run_transforms(wh)
    return wh


def contents(tables):
    return {name: sorted(map(repr, df.collect())) for name, df in tables.items()}


def built_anew(warehouse, root):
    fresh = Warehouse(warehouse.spark, root, station_buckets=BUCKETS)
    fresh.replace_stations(warehouse.stations())
    fresh.reload_daily(warehouse.daily())
    return contents(transforms.run_transforms(fresh))


def folders(warehouse, table):
    return set(warehouse.versions(table).latest().folders)


CHANGES = {
    "a dense station's year": lambda wh, f: wh.replace_station_years(f(observations(2, {"US000000001": {2004: 50}})), [2004]),
    "a sparse station's year": lambda wh, f: wh.replace_station_years(f(observations(3, {"US000000002": {2003: 6}})), [2003]),
    "a year emptied": lambda wh, f: wh.replace_station_years(f(observations(4, {"CA000000004": {2002: 2}})), [2002, 2003]),
    "a whole year for all": lambda wh, f: wh.replace_years(f(observations(5, {"CA000000003": {2004: 12}})), [2004]),
    "a year in a gap": lambda wh, f: wh.replace_station_years(f(observations(6, {"CA000000003": {2001: 2}})), [2001]),
    "a new station": lambda wh, f: wh.append_daily(f(observations(7, {"NO000000005": {2001: 9, 2007: 1}}))),
    "first and last year": lambda wh, f: wh.replace_station_years(f(observations(8, {"US000000002": {2000: 1, 2008: 2}})), [2000, 2008]),
    "everything": lambda wh, f: wh.reload_daily(f(observations(9))),
    "nothing": lambda wh, f: wh.replace_station_years(f([]), [2004]),
}


def test_chain_of_changes_equals_building_anew(spark, built, tmp_path):
    for step, (name, change) in enumerate(CHANGES.items()):
        change(built, lambda rows: frame(spark, rows))
        got = contents(transforms.run_transforms(built))
        want = built_anew(built, str(tmp_path / f"anew{step}"))
        for table in transforms.TABLES:
            assert got[table] == want[table], (name, table)


def test_untouched_partitions_keep_their_files(spark, built):
    before = {t: folders(built, t) for t in (transforms.DAILY, transforms.WEATHER, transforms.MONTHLY, transforms.FEATURES)}
    root = pathlib.Path(built.path(transforms.WEATHER))
    times = {p: p.stat().st_mtime_ns for p in root.rglob("*.parquet")}
    built.replace_station_years(frame(spark, observations(2, {"US000000001": {2004: 50}})), [2004])
    transforms.run_transforms(built)
    bucket = spark.range(1).select(built.bucket(F.lit("US000000001"))).first()[0]
    for table, old in before.items():
        kept = old & folders(built, table)
        assert kept and {f for f in old if not f.endswith(f"station_bucket={bucket}")} <= kept, table
    changed = {f for f in before[transforms.WEATHER] - folders(built, transforms.WEATHER)}
    years = {int(re.search(r"obs_year=(\d+)", f).group(1)) for f in changed}
    assert 2004 in years and 2000 not in years
    assert {p: p.stat().st_mtime_ns for p in times} == times


def test_an_unchanged_table_is_not_written(built, monkeypatch):
    monkeypatch.setattr(Warehouse, "put", lambda *_, **__: pytest.fail("nothing has changed"))
    transforms.run_transforms(built)


def test_other_stations_or_lost_snapshots_rebuild_everything(spark, built, tmp_path):
    old = folders(built, transforms.WEATHER)
    built.replace_stations(stations(spark, shift=1.0))
    assert contents(transforms.run_transforms(built)) == built_anew(built, str(tmp_path / "moved"))
    assert not old & folders(built, transforms.WEATHER)
    for seed in (11, 12):
        built.replace_station_years(frame(spark, observations(seed, {"US000000001": {2004: 50}})), [2004])
    built.expire(keep=1)
    assert contents(transforms.run_transforms(built)) == built_anew(built, str(tmp_path / "expired"))


def test_a_run_that_ends_half_way_is_completed_by_the_next(spark, built, monkeypatch, tmp_path):
    built.replace_station_years(frame(spark, observations(2, {"US000000002": {2004: 7}})), [2004])
    put = Warehouse.put

    def lost(self, table, *args, **kwargs):
        if table == transforms.MONTHLY:
            raise OSError("lost")
        return put(self, table, *args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(Warehouse, "put", lost)
        with pytest.raises(OSError):
            transforms.run_transforms(built)
    built.replace_station_years(frame(spark, observations(3, {"CA000000003": {2003: 4}})), [2003])
    assert contents(transforms.run_transforms(built)) == built_anew(built, str(tmp_path / "anew"))


def reach_by_brute_force(before, now, changed):
    """Partitions whose day windows differ or hold other days, from lists of single days."""
    rebuilt, read = set(changed), set()
    stations_ = {s for s, _, _ in before} | {s for s, _, _ in now}

    def days(spans, station):
        return [(y, b) for s, y, b in sorted(spans) if s == station for _ in range(spans[s, y, b])]

    for station in stations_:
        mine, old = days(now, station), days(before, station)
        for sequence in (mine, old):
            for k, place in enumerate(sequence):
                if place in changed:
                    rebuilt |= set(sequence[max(0, k - 1) : k]) | set(sequence[k : k + 30])
        marks = sorted({y for s, y, b in list(now) + list(before) if s == station and (y, b) in changed})
        for year in marks:
            earlier, later = [d for d in mine if d[0] < year], [d for d in mine if d[0] > year]
            rebuilt |= set(earlier[-1:]) | set(later[:29])
    for station in stations_:
        mine = days(now, station)
        for k, place in enumerate(mine):
            if place in rebuilt:
                read |= set(mine[max(0, k - 29) : k + 2])
    return rebuilt & ({(y, b) for _, y, b in now} | set(changed)), rebuilt | read


def test_reach_by_brute_force(spark):
    rng = random.Random(3)
    keys = "station_id string, obs_year int, station_bucket int, days long"
    for _ in range(6):
        now = {(f"s{k}", y, k % 2): rng.choice((1, 5, 14, 15, 28, 29, 30, 200)) for k in range(5) for y in range(1990, 2004) if rng.random() < 0.7}
        changed = {(rng.randrange(1990, 2004), rng.randrange(2)) for _ in range(2)}
        before = {key: n for key, n in now.items() if key[1:] not in changed or rng.random() < 0.5}
        for key in [k for k in now if k[1:] in changed and rng.random() < 0.4]:
            before.setdefault(key, 3)
            del now[key]
        tables = [spark.createDataFrame([(*k, n) for k, n in spans.items()], keys) for spans in (before, now)]
        rebuilt, read = reach_by_brute_force(before, now, changed)
        got = partitions_to_rebuild(*tables, changed)
        assert got >= rebuilt and got == rebuilt | changed
        assert partitions_to_read(tables[1], got) == read | got


def write_plans(spark, run):
    """Physical plans of the SQL executions that ``run`` starts."""
    store = spark._jsparkSession.sharedState().statusStore()
    first = store.executionsCount()
    run()
    listed = store.executionsList(first, 10_000)
    return [listed.apply(k).physicalPlanDescription() for k in range(listed.size())]


def test_one_station_shuffle_and_sort_serve_both_marts(spark, built):
    """On the stored path: the windows' shuffle and sort, and nothing else until both marts are written."""
    build = transforms._Build(built, True)
    weather = [p for p in write_plans(spark, build.weather) if "InsertIntoHadoopFsRelationCommand" in p]
    features = [p for p in write_plans(spark, build.features) if "InsertIntoHadoopFsRelationCommand" in p]
    assert len(weather) == 1 and len(features) == 1
    final = weather[0].split("== Initial Plan ==")[0]
    tree = final[: final.index("\n\n(1)")] if "\n\n(1)" in final else final
    assert len(re.findall(r"\bExchange \(", tree)) == 1 and "hashpartitioning(station_bucket" in weather[0]
    assert len(re.findall(r"\bSort \(", tree)) == 1
    assert len(re.findall(r"\bWindow \(", tree)) >= 1
    assert "Exchange" not in features[0] and "Sort" not in features[0]


def test_marts_of_the_stored_path_have_few_files(built):
    """The order of the windows lets a task write whole partitions: at most a file per split of a bucket."""
    splits = transforms._Build(built, True)._splits()
    for table in (transforms.WEATHER, transforms.FEATURES):
        root = pathlib.Path(built.path(table))
        for folder in folders(built, table):
            assert len(list((root / folder).glob("*.parquet"))) <= splits, table


def checks(df):
    return {r.check_name: (r.violation_count, r.check_result) for r in df.collect()}


def test_merged_checks_equal_the_full_suites_after_each_change(spark, built):
    as_of = datetime.date(2007, 6, 1)
    for name, change in CHANGES.items():
        change(built, lambda rows: frame(spark, rows))
        tables = transforms.run_transforms(built)
        merged = transforms.run_quality(built, as_of)
        raw = quality.validate_raw_daily(built.daily(), built.stations(), as_of)
        marts = quality.validate_marts(*[tables[t] for t in (transforms.WEATHER, transforms.MONTHLY, transforms.FEATURES)])
        assert checks(merged["quality.raw_daily"]) == checks(raw), name
        assert checks(merged["quality.marts"]) == checks(marts), name
    later = transforms.run_quality(built, datetime.date(2003, 2, 1))["quality.raw_daily"]
    assert checks(later) == checks(quality.validate_raw_daily(built.daily(), built.stations(), datetime.date(2003, 2, 1)))


def test_checks_after_a_refresh_count_what_changed(spark, built, monkeypatch):
    transforms.run_quality(built, datetime.date(2007, 1, 1))
    before = folders(built, transforms.RAW_PARTS)
    built.replace_station_years(frame(spark, observations(2, {"US000000001": {2004: 50}})), [2004])
    transforms.run_transforms(built)
    transforms.run_quality(built, datetime.date(2007, 1, 1))
    assert len(before - folders(built, transforms.RAW_PARTS)) == 1
    monkeypatch.setattr(transforms._Build, "narrow", lambda *_, **__: None)
    assert checks(transforms.run_quality(built, datetime.date(2007, 1, 1))["quality.raw_daily"])["data_freshness"][0] < 0
