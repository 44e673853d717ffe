"""Station directory: listings, labels, name search and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import country_code
from skyledger.operators.radius import stations_near
from skyledger.session import local_table



def _has_coordinates() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def _is_in(country: str) -> Column:
    return country_code(F.col("station_id")) == country


def _place(country: str | None, state: str | None) -> Column:
    """Stations of a US state, or of a country when no state is given."""
    if state:
        return (F.col("state") == state) & _is_in("US")
    if country is None:
        raise ValueError("a country or a state is required")
    return _is_in(country)


def with_label(rows: DataFrame, code: str, dim: DataFrame, label: str, into: str) -> DataFrame:
    """Attach a label for a code; an unknown code stands for itself.

    A code that the list repeats keeps its first label in sort order, so no row
    is doubled.
    """
    lookup = dim.groupBy(F.col("code").alias(code)).agg(F.min(label).alias("_label"))
    return (
        rows.join(lookup, code, "left")
        .withColumn(into, F.coalesce(F.col("_label"), F.col(code)))
        .drop("_label")
    )


def _display(name: str, code: str) -> Column:
    return F.concat(F.col(name), F.lit(" ("), F.col(code), F.lit(")"))


def states_available(stations: DataFrame, states: DataFrame) -> DataFrame:
    codes = (
        stations.where(_is_in("US") & F.col("state").isNotNull() & (F.col("state") != ""))
        .select(F.col("state").alias("code"))
        .distinct()
    )
    return (
        with_label(codes, "code", states, "name", "name")
        .select("code", _display("name", "code").alias("display"))
        .orderBy("display", "code")
    )


def countries_available(stations: DataFrame, countries: DataFrame) -> DataFrame:
    codes = stations.select(country_code(F.col("station_id")).alias("code")).distinct()
    named = with_label(codes, "code", countries, "name", "name")
    return (
        with_label(named, "code", countries, "iso3", "iso3")
        .select("code", _display("name", "iso3").alias("display"))
        .orderBy("display", "code")
    )


def stations_for_location(
    stations: DataFrame, *, state: str | None = None, country: str | None = None
) -> DataFrame:
    """Sorted ids of a state or country. The state test does not ask for a US id."""
    if state:
        wanted = F.col("state") == state
    elif country:
        wanted = _is_in(country)
    else:
        raise ValueError("a country or a state is required")
    return stations.where(wanted).select("station_id").orderBy("station_id")


def station_names(stations: DataFrame, country: str | None, state: str | None = None) -> DataFrame:
    return (
        stations.where(_place(country, state))
        .select("station_id", "station_name")
        .orderBy(F.asc_nulls_last("station_name"), "station_id")
    )


def station_places(stations: DataFrame, country: str | None, state: str | None = None) -> DataFrame:
    """Distinct names with their coordinates."""
    return (
        stations.where(_place(country, state) & _has_coordinates())
        .select(F.col("station_name").alias("name"), "latitude", "longitude")
        .distinct()
        .orderBy(F.asc_nulls_last("name"), "latitude", "longitude")
    )


def search_stations(
    stations: DataFrame,
    query: str,
    states: DataFrame,
    countries: DataFrame,
    *,
    country: str | None = None,
    state: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """The first ``limit`` names that contain ``query``, with a display label.

    ``%`` and ``_`` in the query act as wildcards.
    """
    matches = (
        stations.where(
            _place(country, state)
            & F.upper("station_name").like(f"%{query.upper()}%")
            & _has_coordinates()
        )
        .select(
            F.col("station_name").alias("name"),
            "latitude",
            "longitude",
            "state",
            country_code(F.col("station_id")).alias("country_code"),
        )
        .distinct()
    )
    labelled = with_label(matches, "state", states, "name", "state_name")
    labelled = with_label(labelled, "country_code", countries, "name", "country_name")
    state_part = F.when(F.col("state") != "", F.col("state_name"))
    return (
        labelled.orderBy(
            F.asc_nulls_last("name"), "latitude", "longitude", F.asc_nulls_last("state")
        )
        .limit(limit)
        .select(
            "name",
            F.concat_ws(", ", "name", state_part, "country_name").alias("display"),
            "latitude",
            "longitude",
        )
    )


def station_coordinates(stations: DataFrame, station_id: str | Column) -> DataFrame:
    """One row with the station's coordinates, (0, 0) when it is unknown."""
    found = stations.where(F.col("station_id") == station_id).agg(
        F.count("*").alias("n"),
        F.max("latitude").alias("latitude"),
        F.max("longitude").alias("longitude"),
    )
    return found.select(
        *[F.when(F.col("n") > 0, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in ("latitude", "longitude")]
    )


def search_then_radius(
    stations: DataFrame,
    query: str,
    radius_km: float,
    states: DataFrame,
    countries: DataFrame,
    *,
    country: str | None = None,
    state: str | None = None,
) -> DataFrame:
    """Stations around the best name match; all of the location without a match.

    The match is a scalar subquery, so no row of it travels through the driver
    and no join is needed.
    """
    best = search_stations(
        stations, query, states, countries, country=country, state=state, limit=1
    ).select(F.struct("latitude", "longitude"))
    anchored = stations.withColumn("anchor", best.scalar())
    around = stations_near(
        anchored, F.col("anchor.latitude"), F.col("anchor.longitude"), F.lit(float(radius_km))
    )
    here = (F.col("state") == state) if state else _is_in(country)
    fallback = (
        anchored.where(F.col("anchor").isNull() & here)
        .select("station_id", "station_name", "latitude", "longitude")
        .withColumn("distance_km", F.lit(None).cast("double"))
    )
    return around.unionByName(fallback).orderBy("distance_km", "station_id")


def resolve_stations(
    stations: DataFrame,
    *,
    station_ids: Sequence[str] | None = None,
    state: str | None = None,
    country: str | None = None,
    point: tuple[float, float] | None = None,
    radius_km: float = 50,
) -> DataFrame:
    """Ids for a location. Explicit ids win over state, country and point."""
    if station_ids:
        return local_table(stations.sparkSession, {"station_id": list(station_ids)})
    if state or country:
        return stations_for_location(stations, state=state, country=None if state else country)
    if point:
        lat, lon = (F.lit(float(x)) for x in point)
        return stations_near(stations, lat, lon, F.lit(float(radius_km))).select("station_id")
    raise ValueError("one of station_ids, state, country or point is required")


def available_stations(daily: DataFrame) -> DataFrame:
    """Stations in the daily mart, and whether any of their days has a temperature."""
    return (
        daily.groupBy(
            "station_id", "station_name", "latitude", "longitude", "elevation", "climate_zone"
        )
        .agg((F.count("tavg_derived_celsius") > 0).alias("has_temp"))
        .orderBy(F.desc("has_temp"), F.asc_nulls_last("station_name"), "station_id")
    )


def available_from_years(station_years: DataFrame, staged_stations: DataFrame) -> DataFrame:
    """The same listing from days per station and year, without a scan of the daily mart."""
    shown = ("station_id", "station_name", "latitude", "longitude", "elevation", "climate_zone")
    seen = station_years.groupBy("station_id").agg((F.sum("days_with_temp") > 0).alias("has_temp"))
    return (
        staged_stations.select(*shown)
        .join(seen, "station_id")
        .select(*shown, "has_temp")
        .orderBy(F.desc("has_temp"), F.asc_nulls_last("station_name"), "station_id")
    )


def default_selection(available: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` stations with temperatures, or the first ``n`` if none has any."""
    any_temp = available.agg(F.max("has_temp")).scalar()
    return (
        available.where(F.col("has_temp") == any_temp)
        .orderBy(F.asc_nulls_last("station_name"), "station_id")
        .limit(n)
    )


def restrict_to_selection(available: DataFrame, selected: DataFrame) -> DataFrame:
    return available.join(selected.select("station_id"), "station_id", "left_semi")


def capped_sample(station_ids: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """A repeatable sample that prefers stations likely to report temperature.

    Ids starting with US1 (volunteer rain gauges) come last. Hash order stands
    in for a seeded shuffle, so the sample is the same in any partitioning.
    """
    station_id = F.col("station_id")
    shuffled = F.md5(F.concat(station_id, F.lit(str(seed))))
    return (
        station_ids.select("station_id")
        .orderBy(station_id.startswith("US1"), shuffled, station_id)
        .limit(limit)
        .orderBy("station_id")
    )
