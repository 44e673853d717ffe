"""The physical plans keep their promises about shuffles and pushdown."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_point
from skyledger.operators import climate, directory, marts, quality, staging
from skyledger.schemas import RAW_STATIONS, TABLES
from skyledger.sources import state_dim
from skyledger.workload.queries import REGISTRY, Inputs

WRITES_FILES = {
    "dly_roundtrip", "catalogue_roundtrip", "replace_station_years", "replace_years", "force_reload",
    "append_batch", "station_full_replace", "run_transforms_counts", "backfill_counts",
    "refresh_counts", "stream_ingest", "stream_ingest_files", "ingest_location", "available_stations_stored",
}
RAW = (
    "station_id string, obs_date date, element string, data_value int, m_flag string, "
    "q_flag string, s_flag string, obs_time string"
)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange (\w+)\(([^,)]+)", plan(df))


@pytest.fixture
def stored(spark, tmp_path):
    """Empty tables on disk, large enough for no broadcast when it is switched off."""

    def table(name, ddl):
        path = str(tmp_path / name)
        spark.createDataFrame([], ddl).write.parquet(path)
        return spark.read.schema(ddl).parquet(path)

    return table


def test_pivot_has_one_exchange_and_pushes_its_filter(stored):
    df = staging.stage_daily(stored("raw", RAW))
    assert plan(df).count("Exchange hashpartitioning") == 1
    assert "partial_max" in plan(df)
    assert "IsNull(q_flag)" in plan(df)
    read = plan(df).split("ReadSchema: ")[1]
    assert "m_flag" not in read and "s_flag" not in read


def test_marts_share_one_exchange_and_one_sort(stored):
    daily = stored("daily", TABLES["staging.daily_observations"])
    stations = stored("stations", TABLES["staging.stations"])
    features = marts.prediction_features(marts.daily_weather(daily, stations))
    assert plan(features).count("Exchange hashpartitioning") == 1
    assert len(re.findall(r"\bSort \[", plan(features))) == 1


def test_large_station_table_is_not_broadcast(spark, stored):
    daily = stored("daily", TABLES["staging.daily_observations"])
    stations = stored("stations", TABLES["staging.stations"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = marts.daily_weather(daily, stations)
        assert "Broadcast" not in plan(df)
        # the join's distribution serves the windows as well
        assert plan(df).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_raw_quality_reads_observations_once(stored):
    df = quality.validate_raw_daily(stored("raw", RAW), stored("st", RAW_STATIONS), __import__("datetime").date(2020, 1, 1))
    assert len(re.findall(r"FileScan parquet \[[^\]]*data_value", plan(df))) == 1
    assert len(re.findall(r"FileScan parquet", plan(df))) == 2


def test_country_limit_runs_before_the_shuffle(spark):
    df = climate.diverse_top(
        spark.range(1000).selectExpr("cast(id as string) station_id", "cast(id % 2 as string) country_code", "cast(id as double) similarity")
    )
    text = plan(df)
    partial = text.rindex("WindowGroupLimit")
    assert text.count("WindowGroupLimit") == 2
    assert "Exchange" in text[text.index("WindowGroupLimit") : partial]
    assert "TakeOrderedAndProject" in text


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - WRITES_FILES))
def test_no_python_and_no_cartesian_product(name, spark, sf_dir):
    text = plan(entry_point.queries()[name](spark, sf_dir))
    for word in ("Python", "ArrowEval", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text, word


def test_library_never_hints_a_broadcast():
    import pathlib

    import skyledger

    library = pathlib.Path(skyledger.__file__).parent
    for path in library.rglob("*.py"):
        if path.is_relative_to(library / "llm"):  # the text operators have the same test of their own
            continue
        text = path.read_text()
        assert "F.broadcast(" not in text and "crossJoin" not in text, path
        assert "localCheckpoint" not in text, path


def test_code_lists_have_a_known_size(spark):
    rows = spark.range(10**9).selectExpr("cast(id as string) state")
    text = plan(directory.with_label(rows, "state", state_dim(spark), "name", "label"))
    assert "BroadcastHashJoin" in text and "LocalTableScan" in text
    ids = directory.resolve_stations(rows, station_ids=["a", "b"])
    assert "BroadcastHashJoin" in plan(rows.join(ids, rows.state == ids.station_id, "left_semi"))


def test_window_filter_on_station_reaches_the_scan(stored):
    daily = stored("daily", TABLES["staging.daily_observations"])
    stations = stored("stations", TABLES["staging.stations"])
    df = marts.daily_weather(daily, stations).where("station_id = 'X'")
    assert "EqualTo(station_id,X)" in plan(df)


def test_inputs_are_lazy(spark, sf_dir):
    assert set(vars(Inputs(spark, sf_dir))) == {"spark", "sf_dir", "reporting"}
