"""The registered queries: one per operator group, over the derived raw tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions import round_scaled
from skyledger.operators import climate, directory, frames, marts, quality, radius, staging
from skyledger.plans import transforms
from skyledger.plans.ingest import ingest_location as ingest_for_location
from skyledger.session import scratch_path
from skyledger.sources import (
    load_daily,
    load_features,
    load_monthly,
    read_daily_files,
    read_station_catalogue,
)
from skyledger.sources.lookups import country_dim, read_country_dim, state_dim
from skyledger.sources.warehouse import Warehouse, ingest_summary, stations_with_all_years
from skyledger.streaming.landing import ingest_landing
from skyledger.workload import fixtures
from skyledger.workload import params as p

Query = Callable[[SparkSession, str], DataFrame]


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded to six decimals, as the checking SQL rounds them."""
    doubles = {
        f.name: round_scaled(F.col(f.name), digits)
        for f in df.schema
        if isinstance(f.dataType, T.DoubleType)
    }
    return df.withColumns(doubles) if doubles else df


class Inputs:
    """The derived tables and marts of one scale folder, as lazy plans."""

    def __init__(
        self, spark: SparkSession, sf_dir: str, reporting: str = fixtures.REPORTING_SQL
    ):
        self.spark, self.sf_dir, self.reporting = spark, sf_dir, reporting

    @property
    def wide(self) -> Inputs:
        """The same tables spread over many more, sparser stations."""
        return Inputs(self.spark, self.sf_dir, fixtures.WIDE_REPORTING_SQL)

    @cached_property
    def raw_stations(self) -> DataFrame:
        return fixtures.raw_stations(self.spark, self.sf_dir)

    @cached_property
    def raw_daily(self) -> DataFrame:
        return fixtures.raw_daily(self.spark, self.sf_dir, self.reporting)

    @cached_property
    def stg_daily(self) -> DataFrame:
        return staging.stage_daily(self.raw_daily)

    @cached_property
    def stg_stations(self) -> DataFrame:
        return staging.stage_stations(self.raw_stations)

    @cached_property
    def weather(self) -> DataFrame:
        return marts.daily_weather(self.stg_daily, self.stg_stations)

    @cached_property
    def monthly(self) -> DataFrame:
        return marts.monthly_summary(self.weather)

    @cached_property
    def features(self) -> DataFrame:
        return marts.prediction_features(self.weather)

    @cached_property
    def states(self) -> DataFrame:
        return state_dim(self.spark)

    @cached_property
    def countries(self) -> DataFrame:
        return country_dim(self.spark, p.COUNTRIES)

    @cached_property
    def profiles(self) -> DataFrame:
        return climate.climate_profiles(self.raw_stations, self.monthly)

    @cached_property
    def similar(self) -> DataFrame:
        return climate.climate_similarity(self.profiles, climate.DEFAULT_PREFERENCES)

    @cached_property
    def points(self) -> DataFrame:
        supplier = fixtures.given(self.spark, self.sf_dir, "supplier")
        return self.spark.sql(p.POINTS_SQL, supplier=supplier)

    @cached_property
    def us_stations(self) -> DataFrame:
        return directory.resolve_stations(self.raw_stations, country="US")

    @cached_property
    def batch(self) -> DataFrame:
        """A correction: the US observations of 2023, one step higher."""
        us = F.substring("station_id", 1, 2) == "US"
        return self.raw_daily.where(us & (F.year("obs_date") == 2023)).withColumn(
            "data_value", F.col("data_value") + 1
        )

    # -- written forms -----------------------------------------------------

    def warehouse(self, label: str) -> Warehouse:
        return Warehouse(self.spark, scratch_path(self.spark, label), station_buckets=4)

    def loaded_warehouse(self, label: str) -> Warehouse:
        warehouse = self.warehouse(label)
        warehouse.replace_stations(self.raw_stations)
        warehouse.reload_daily(self.raw_daily)
        return warehouse

    def landing(self) -> str:
        path = scratch_path(self.spark, "landing")
        fixtures.daily_lines(self.raw_daily).write.text(path)
        return path


    @cached_property
    def stored_features(self) -> DataFrame:
        """The feature table as written, so that several passes over it do not build it again."""
        layout = {"partition_by": ("obs_year",), "sort_by": ("station_id", "obs_date")}
        return self.warehouse("features").replace_table(transforms.FEATURES, self.features, **layout)

    def backfilled(self) -> dict[str, DataFrame]:
        warehouse = self.warehouse("backfill")
        warehouse.replace_stations(self.raw_stations)
        tables = transforms.backfill(warehouse, self.landing(), *p.YEARS)
        return {"raw.daily": warehouse.daily(), **tables}

    def refreshed(self) -> dict[str, DataFrame]:
        """Tables that were built before the new year's files came, so only what these reach is rebuilt."""
        warehouse = self.loaded_warehouse("refresh")
        transforms.run_transforms(warehouse)
        tables = transforms.refresh(warehouse, self.landing(), 2024)
        return {"raw.daily": warehouse.daily(), **tables}


REGISTRY: dict[str, Callable[[Inputs], DataFrame]] = {}


def register(function: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    REGISTRY[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    def bind(build: Callable[[Inputs], DataFrame]) -> Query:
        return lambda spark, sf_dir: comparable(build(Inputs(spark, sf_dir)))

    return {name: bind(build) for name, build in REGISTRY.items()}


# -- staging and marts ------------------------------------------------------


@register
def stage_daily(i: Inputs) -> DataFrame:
    return i.stg_daily


@register
def stage_stations(i: Inputs) -> DataFrame:
    return i.stg_stations


@register
def mart_daily_weather(i: Inputs) -> DataFrame:
    return i.weather


@register
def mart_monthly_summary(i: Inputs) -> DataFrame:
    return i.monthly


@register
def mart_prediction_features(i: Inputs) -> DataFrame:
    return i.features


@register
def mart_daily_weather_wide(i: Inputs) -> DataFrame:
    return i.wide.weather


@register
def mart_monthly_summary_wide(i: Inputs) -> DataFrame:
    return i.wide.monthly


@register
def mart_prediction_features_wide(i: Inputs) -> DataFrame:
    return i.wide.features


# -- quality ----------------------------------------------------------------


def _raw_quality(i: Inputs) -> DataFrame:
    return quality.validate_raw_daily(i.raw_daily, i.raw_stations, p.AS_OF)


def _mart_quality(i: Inputs) -> DataFrame:
    return quality.validate_marts(i.weather, i.monthly, i.features)


@register
def quality_raw(i: Inputs) -> DataFrame:
    return _raw_quality(i).drop("checked_at")


@register
def quality_stations(i: Inputs) -> DataFrame:
    return quality.validate_stations(i.raw_stations).drop("checked_at")


@register
def quality_marts(i: Inputs) -> DataFrame:
    return _mart_quality(i).drop("checked_at")


@register
def quality_column_checks(i: Inputs) -> DataFrame:
    base = quality.RESULT_RULES
    strict = (*base, quality.no_failures("no_failures"))

    def rules(name: str, table: DataFrame, wanted: Sequence[quality.ColumnRule]) -> DataFrame:
        return quality.run_column_rules(table, wanted).select(F.lit(name).alias("table_name"), "*")

    return (
        rules("q_raw", _raw_quality(i), strict)
        .unionByName(rules("q_stations", quality.validate_stations(i.raw_stations), base))
        .unionByName(rules("q_marts", _mart_quality(i), strict))
    )


@register
def duplicate_stations(i: Inputs) -> DataFrame:
    return staging.duplicate_station_ids(i.raw_stations)


# -- directory ----------------------------------------------------------------


@register
def states_available(i: Inputs) -> DataFrame:
    return directory.states_available(i.raw_stations, i.states)


@register
def countries_available(i: Inputs) -> DataFrame:
    return directory.countries_available(i.raw_stations, i.countries)


@register
def stations_for_state(i: Inputs) -> DataFrame:
    return directory.stations_for_location(i.raw_stations, state=p.STATE)


@register
def stations_for_country(i: Inputs) -> DataFrame:
    return directory.stations_for_location(i.raw_stations, country=p.COUNTRY)


@register
def station_names(i: Inputs) -> DataFrame:
    return directory.station_names(i.raw_stations, "US", p.STATE)


@register
def station_places(i: Inputs) -> DataFrame:
    return directory.station_places(i.raw_stations, p.COUNTRY)


@register
def station_search(i: Inputs) -> DataFrame:
    return directory.search_stations(
        i.raw_stations, p.SEARCH_TEXT, i.states, i.countries, country=p.COUNTRY
    )


@register
def station_coordinates(i: Inputs) -> DataFrame:
    first = i.raw_stations.agg(F.min("station_id")).scalar()
    return directory.station_coordinates(i.raw_stations, first)


@register
def stations_near_point(i: Inputs) -> DataFrame:
    return radius.stations_near_point(i.raw_stations, *p.POINT, p.RADIUS_KM)


@register
def search_then_radius(i: Inputs) -> DataFrame:
    return directory.search_then_radius(
        i.raw_stations, p.SEARCH_TEXT, p.RADIUS_KM, i.states, i.countries, country=p.COUNTRY
    ).select("station_id", "distance_km")


@register
def radius_batch(i: Inputs) -> DataFrame:
    return radius.stations_near_points(i.raw_stations, i.points)


@register
def radius_batch_relaxed(i: Inputs) -> DataFrame:
    return radius.stations_near_points(i.raw_stations, i.points, strict_box=False)


@register
def resolve_stations(i: Inputs) -> DataFrame:
    ways = {
        "state": {"state": p.STATE},
        "country": {"country": p.COUNTRY},
        "point": {"point": p.POINT, "radius_km": p.RADIUS_KM},
    }
    state, country, point = (
        directory.resolve_stations(i.raw_stations, **where).select(
            F.lit(name).alias("chosen_by"), "station_id"
        )
        for name, where in ways.items()
    )
    return state.unionByName(country).unionByName(point)


@register
def available_stations(i: Inputs) -> DataFrame:
    return directory.available_stations(i.weather)


@register
def default_selection(i: Inputs) -> DataFrame:
    return directory.default_selection(directory.available_stations(i.weather))


@register
def restrict_to_selection(i: Inputs) -> DataFrame:
    chosen = directory.resolve_stations(i.raw_stations, country=p.COUNTRY)
    return directory.restrict_to_selection(directory.available_stations(i.weather), chosen)


@register
def capped_sample(i: Inputs) -> DataFrame:
    return directory.capped_sample(i.raw_stations, p.SAMPLE_SIZE, p.SAMPLE_SEED)


# -- climate ------------------------------------------------------------------


@register
def estimated_climate(i: Inputs) -> DataFrame:
    return climate.estimated_climate(i.raw_stations)


@register
def observed_climate(i: Inputs) -> DataFrame:
    return climate.observed_climate(i.monthly)


@register
def climate_profiles(i: Inputs) -> DataFrame:
    return i.profiles


@register
def source_counts(i: Inputs) -> DataFrame:
    return climate.source_counts(i.profiles)


@register
def climate_similarity(i: Inputs) -> DataFrame:
    return climate.ranked(i.similar)


@register
def diverse_top(i: Inputs) -> DataFrame:
    return climate.diverse_top(i.similar).drop("latitude", "longitude", "elevation")


@register
def match_table(i: Inputs) -> DataFrame:
    return climate.match_table(climate.diverse_top(i.similar), i.countries, unit="F")


@register
def radar_frame(i: Inputs) -> DataFrame:
    top = climate.diverse_top(i.similar)
    return climate.radar_frame(i.profiles, top, climate.DEFAULT_PREFERENCES)


# -- loads and frames ---------------------------------------------------------


@register
def load_daily_for_country(i: Inputs) -> DataFrame:
    return load_daily(i.weather, i.us_stations, (2024, 2024), ordered=True)


@register
def load_monthly_for_country(i: Inputs) -> DataFrame:
    return load_monthly(i.monthly, i.us_stations, (2024, 2024), ordered=True)


@register
def load_features_for_country(i: Inputs) -> DataFrame:
    return load_features(i.features, i.us_stations, (2024, 2024), ordered=True)


@register
def frame_temperature(i: Inputs) -> DataFrame:
    return frames.temperature_frame(i.weather)


@register
def frame_temperature_fahrenheit(i: Inputs) -> DataFrame:
    return frames.temperature_frame(i.weather, unit="F")


@register
def frame_temperature_change(i: Inputs) -> DataFrame:
    return frames.temperature_change_frame(i.weather, unit="F")


@register
def frame_precipitation(i: Inputs) -> DataFrame:
    return frames.precipitation_frame(i.weather)


@register
def frame_snowfall(i: Inputs) -> DataFrame:
    return frames.snowfall_frame(i.weather)


@register
def frame_monthly(i: Inputs) -> DataFrame:
    return frames.monthly_frame(load_monthly(i.monthly))


@register
def frame_target(i: Inputs) -> DataFrame:
    return frames.target_frame(i.features, i.weather)


@register
def frame_lags(i: Inputs) -> DataFrame:
    return frames.lag_frame(i.stored_features)


@register
def frame_seasonal(i: Inputs) -> DataFrame:
    return frames.seasonal_frame(i.stored_features)


# -- files and tables -----------------------------------------------------------


@register
def dly_roundtrip(i: Inputs) -> DataFrame:
    return read_daily_files(i.spark, i.landing(), p.YEARS)


@register
def catalogue_roundtrip(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "catalogue")
    fixtures.catalogue_lines(i.raw_stations).write.text(path)
    return read_station_catalogue(i.spark, path)


@register
def replace_station_years(i: Inputs) -> DataFrame:
    warehouse = i.loaded_warehouse("station-years")
    warehouse.replace_station_years(i.batch, p.YEARS)
    return warehouse.daily()


@register
def replace_years(i: Inputs) -> DataFrame:
    warehouse = i.loaded_warehouse("years")
    warehouse.replace_years(i.batch, [2023])
    return warehouse.daily()


@register
def force_reload(i: Inputs) -> DataFrame:
    warehouse = i.loaded_warehouse("reload")
    warehouse.reload_daily(i.batch)
    return warehouse.daily()


@register
def append_batch(i: Inputs) -> DataFrame:
    warehouse = i.loaded_warehouse("append")
    warehouse.append_daily(i.batch)
    return warehouse.daily()


@register
def station_full_replace(i: Inputs) -> DataFrame:
    warehouse = i.warehouse("stations")
    warehouse.replace_stations(i.raw_stations)
    warehouse.replace_stations(i.stg_stations)
    return warehouse.stations()


@register
def already_ingested(i: Inputs) -> DataFrame:
    return stations_with_all_years(i.raw_daily, p.YEARS)


@register
def ingest_outcomes(i: Inputs) -> DataFrame:
    listed = i.raw_stations.where(F.col("wmo_id").isNotNull()).select("station_id")
    landed = listed.union(i.raw_daily.select("station_id"))
    return ingest_summary(i.raw_stations, landed, i.raw_daily)


@register
def populated(i: Inputs) -> DataFrame:
    tables = {
        "raw.stations": i.raw_stations,
        "raw.daily": i.raw_daily,
        "marts.daily_weather": i.weather,
    }
    return transforms.table_counts(tables).withColumn("populated", F.col("rows") > 0)


@register
def run_transforms_counts(i: Inputs) -> DataFrame:
    return transforms.table_counts(transforms.run_transforms(i.loaded_warehouse("transforms")))


@register
def backfill_counts(i: Inputs) -> DataFrame:
    return transforms.table_counts(i.backfilled())


@register
def refresh_counts(i: Inputs) -> DataFrame:
    return transforms.table_counts(i.refreshed())


def _register_stored_contents() -> None:
    """The marts and check results as read back after each way of building them."""
    builds = {
        "stored": lambda i: transforms.run_transforms(i.loaded_warehouse("transforms")),
        "backfilled": Inputs.backfilled,
        "refreshed": Inputs.refreshed,
    }

    def of_build(build, table: str):
        return lambda i: build(i)[table]

    def of_checks(table: str):
        def run(i: Inputs) -> DataFrame:
            warehouse = i.loaded_warehouse("quality")
            transforms.run_transforms(warehouse)
            return transforms.run_quality(warehouse, p.AS_OF)[table].drop("checked_at")

        return run

    for way, build in builds.items():
        for table in (transforms.WEATHER, transforms.MONTHLY, transforms.FEATURES):
            REGISTRY[f"{way}_{table.split('.')[1]}"] = of_build(build, table)
    for table in ("quality.raw_daily", "quality.stations", "quality.marts"):
        REGISTRY[f"stored_{table.replace('.', '_')}"] = of_checks(table)


_register_stored_contents()


@register
def malformed_report(i: Inputs) -> DataFrame:
    warehouse = i.warehouse("malformed")
    warehouse.replace_stations(i.raw_stations)
    landing = scratch_path(i.spark, "damaged")
    fixtures.damaged_lines(fixtures.daily_lines(i.raw_daily)).write.text(landing)
    transforms.backfill(warehouse, landing, *p.YEARS)
    return warehouse.read(transforms.MALFORMED)


@register
def backfilled_without_malformed(i: Inputs) -> DataFrame:
    warehouse = i.warehouse("readable")
    warehouse.replace_stations(i.raw_stations)
    landing = scratch_path(i.spark, "damaged")
    fixtures.damaged_lines(fixtures.daily_lines(i.raw_daily)).write.text(landing)
    transforms.backfill(warehouse, landing, *p.YEARS)
    return warehouse.daily()


@register
def stream_ingest(i: Inputs) -> DataFrame:
    warehouse = i.warehouse("stream")
    checkpoint = scratch_path(i.spark, "stream-progress")
    ingest_landing(warehouse, i.landing(), p.YEARS, checkpoint).awaitTermination()
    return warehouse.daily()


@register
def stream_ingest_files(i: Inputs) -> DataFrame:
    """Every station's lines lie in several files, which come one by one."""
    warehouse, landing = i.warehouse("files"), scratch_path(i.spark, "landing-files")
    lines = fixtures.daily_lines(i.raw_daily)
    lines.repartition(4, F.col("value").substr(18, 4)).write.text(landing)
    checkpoint = scratch_path(i.spark, "files-progress")
    ingest_landing(warehouse, landing, p.YEARS, checkpoint, max_files_per_batch=1, scope="file").awaitTermination()
    return warehouse.daily()


def _chosen_ids(i: Inputs) -> list[str]:
    """A station that reports, one with an old file and one without a file."""
    known = i.raw_daily.join(i.raw_stations.select("station_id"), "station_id", "left_semi")
    reporting, old = known.select("station_id"), fixtures.old_lines(i.raw_stations).select(F.substring("value", 1, 11).alias("station_id"))
    rest = i.raw_stations.select("station_id").join(reporting.union(old), "station_id", "left_anti")
    only_old = old.join(reporting, "station_id", "left_anti")
    return [rows.agg(F.min("station_id")).first()[0] for rows in (reporting, only_old, rest)]


@register
def ingest_location(i: Inputs) -> DataFrame:
    """Outcomes of every station of a location; explicit ids win over state, country and point, and so on."""
    reporting = i.raw_daily.where(F.col("station_id").substr(1, 2) != "ZZ")
    lines = fixtures.daily_lines(reporting).unionByName(fixtures.old_lines(i.raw_stations))
    landing = fixtures.station_files(lines, scratch_path(i.spark, "location"))
    warehouse = i.warehouse("location")
    warehouse.replace_stations(i.raw_stations)
    ways = {
        "ids": {"station_ids": _chosen_ids(i), "state": p.STATE, "country": p.COUNTRY, "point": p.POINT},
        "state": {"state": p.STATE, "country": p.COUNTRY},
        "country": {"country": p.COUNTRY, "point": p.POINT},
        "point": {"point": p.POINT, "radius_km": p.RADIUS_KM},
    }
    rows = [
        ingest_for_location(warehouse, landing, [2024], **where).select(F.lit(way).alias("chosen_by"), "*")
        for way, where in ways.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@register
def countries_from_files(i: Inputs) -> DataFrame:
    """Labels of 230 codes, 200 of which the files name."""
    paths = fixtures.country_files(i.spark, i.sf_dir, scratch_path(i.spark, "countries"))
    stations = i.spark.sql(fixtures.FAR_STATIONS_SQL, raw_stations=i.raw_stations)
    return directory.countries_available(stations, read_country_dim(i.spark, *paths))


@register
def available_stations_stored(i: Inputs) -> DataFrame:
    """The listing from the days per station and year that a refresh has kept up to date."""
    warehouse = i.loaded_warehouse("available")
    transforms.run_transforms(warehouse)
    transforms.refresh(warehouse, i.landing(), 2024)
    return directory.available_from_years(warehouse.read(transforms.SPANS), warehouse.read(transforms.STATIONS))


def _odd_stations(i: Inputs) -> DataFrame:
    return i.spark.sql(fixtures.ODD_STATIONS_SQL, raw_stations=i.raw_stations)


@register
def quality_raw_odd(i: Inputs) -> DataFrame:
    odd = i.spark.sql(fixtures.ODD_DAILY_SQL, raw_daily=i.raw_daily)
    return quality.validate_raw_daily(odd, i.raw_stations, p.AS_OF).drop("checked_at")


@register
def quality_stations_odd(i: Inputs) -> DataFrame:
    return quality.validate_stations(_odd_stations(i)).drop("checked_at")


@register
def duplicate_stations_odd(i: Inputs) -> DataFrame:
    return staging.duplicate_station_ids(_odd_stations(i))


@register
def search_without_match(i: Inputs) -> DataFrame:
    """No name matches, so all stations of the country are listed, without a distance."""
    return directory.search_then_radius(
        i.raw_stations, p.NO_SUCH_NAME, p.RADIUS_KM, i.states, i.countries, country=p.COUNTRY
    ).select("station_id", "distance_km")


@register
def coordinates_of_unknown_station(i: Inputs) -> DataFrame:
    return directory.station_coordinates(i.raw_stations, p.NO_SUCH_NAME)
