"""Climate profiles and their similarity to a preferred climate."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import (
    climate_zone,
    country_code,
    display_temperature,
    f_to_c,
    half_even,
    mean_of_ticks,
    with_estimates,
)
from skyledger.functions.climate import FEATURES
from skyledger.functions.numeric import sum_of_ticks
from skyledger.operators.directory import with_label

# The default preferred climate.
DEFAULT_PREFERENCES = {
    "avg_temp_c": 15.0,
    "avg_summer_temp_c": 25.0,
    "avg_winter_temp_c": 5.0,
    "temp_variability": 5.0,
    "annual_precip_mm": 800.0,
    "annual_snowfall_mm": 100.0,
    "heat_days_per_year": 5.0,
    "cold_days_per_year": 0.0,
}

# Labels of the features in a comparison chart.
RADAR_LABELS = {
    "avg_temp_c": "Avg Temp",
    "avg_summer_temp_c": "Summer Temp",
    "avg_winter_temp_c": "Winter Temp",
    "temp_variability": "Variability",
    "annual_precip_mm": "Precipitation",
    "annual_snowfall_mm": "Snowfall",
    "heat_days_per_year": "Heat Days",
    "cold_days_per_year": "Cold Days",
}
TEMPERATURE_FEATURES = ("avg_temp_c", "avg_summer_temp_c", "avg_winter_temp_c")
MIN_MONTHS = 6


def preferences_from_fahrenheit(preferences: Mapping[str, float]) -> dict[str, float]:
    """The same preferences with their temperatures turned from Fahrenheit to Celsius."""
    return {
        c: f_to_c(float(v)) if c in TEMPERATURE_FEATURES else float(v)
        for c, v in preferences.items()
    }


def estimated_climate(raw_stations: DataFrame) -> DataFrame:
    """Every station with coordinates and the climate its geography suggests."""
    latitude = F.col("latitude")
    located = raw_stations.where(latitude.isNotNull() & F.col("longitude").isNotNull()).select(
        "station_id",
        "station_name",
        "latitude",
        "longitude",
        F.coalesce("elevation", F.lit(0.0)).alias("elevation"),
        country_code(F.col("station_id")).alias("country_code"),
        climate_zone(latitude).alias("climate_zone"),
    )
    return with_estimates(located).withColumn("data_source", F.lit("estimated"))


def observed_climate(monthly: DataFrame) -> DataFrame:
    """Features of stations with at least six months of temperature.

    Monthly values have two decimals, so means and totals add whole hundredths.
    """
    temp, month = F.col("avg_temp_celsius"), F.col("obs_month")
    years = F.count_distinct("obs_year").cast("double")
    return (
        monthly.where(temp.isNotNull())
        .groupBy("station_id")
        .agg(
            mean_of_ticks(temp, 100).alias("avg_temp_c"),
            mean_of_ticks(F.when(month.isin(6, 7, 8), temp), 100).alias("avg_summer_temp_c"),
            mean_of_ticks(F.when(month.isin(12, 1, 2), temp), 100).alias("avg_winter_temp_c"),
            mean_of_ticks(F.col("temp_stddev"), 100).alias("temp_variability"),
            (sum_of_ticks(F.col("total_precip_mm"), 100) / years).alias("annual_precip_mm"),
            (sum_of_ticks(F.col("total_snowfall_mm"), 100) / years).alias("annual_snowfall_mm"),
            (F.sum("extreme_heat_days").cast("double") / years).alias("heat_days_per_year"),
            (F.sum("extreme_cold_days").cast("double") / years).alias("cold_days_per_year"),
            F.count("*").alias("months"),
        )
        .where(F.col("months") >= MIN_MONTHS)
        .drop("months")
    )


def climate_profiles(raw_stations: DataFrame, monthly: DataFrame) -> DataFrame:
    """Estimates, overlaid feature by feature with whatever was observed."""
    estimate = estimated_climate(raw_stations).alias("e")
    observed = observed_climate(monthly).withColumn("seen", F.lit(True)).alias("o")
    features = [F.coalesce(f"o.{c}", f"e.{c}").alias(c) for c in FEATURES]
    source = F.when(F.col("o.seen"), "observed").otherwise(F.col("e.data_source"))
    return estimate.join(observed, F.col("e.station_id") == F.col("o.station_id"), "left").select(
        *[f"e.{c}" for c in ("station_id", "station_name", "latitude", "longitude", "elevation")],
        "e.country_code",
        "e.climate_zone",
        *features,
        source.alias("data_source"),
    )


def source_counts(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("data_source").agg(F.count("*").alias("stations"))


def _filled(profiles: DataFrame) -> DataFrame:
    return profiles.fillna(0.0, subset=list(FEATURES))


def _bounds(profiles: DataFrame) -> Column:
    """Smallest value and range per feature, as a one-row scalar subquery."""
    parts = []
    for c in FEATURES:
        low, high = F.min(c), F.max(c)
        span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
        parts += [low.alias(f"{c}_low"), span.alias(f"{c}_span")]
    return profiles.agg(F.struct(*parts).alias("bounds")).scalar()


def _scaled(value: Column, feature: str) -> Column:
    return (value - F.col(f"bounds.{feature}_low")) / F.col(f"bounds.{feature}_span")


def _wanted(preferences: Mapping[str, float], feature: str) -> Column:
    return F.lit(float(preferences[feature]))


def climate_similarity(profiles: DataFrame, preferences: Mapping[str, float]) -> DataFrame:
    """Cosine similarity of every profile with one preferred climate.

    Features are scaled to [0, 1] over all profiles; the preference goes through
    the same scaling unclipped. The preference is a set of literals and the
    bounds a scalar subquery, so rows are scored in place without a join.
    """
    filled = _filled(profiles)
    bounded = filled.withColumn("bounds", _bounds(filled))
    here = {c: _scaled(F.col(c), c) for c in FEATURES}
    there = {c: _scaled(_wanted(preferences, c), c) for c in FEATURES}

    def total(terms):
        return reduce(add, terms)

    norms = F.sqrt(total(v * v for v in here.values())) * F.sqrt(
        total(v * v for v in there.values())
    )
    dot = total(here[c] * there[c] for c in FEATURES)
    scored = bounded.withColumns({"dot": dot, "norms": norms})
    similarity = F.col("dot") / F.when(F.col("norms") == 0, F.lit(1.0)).otherwise(F.col("norms"))
    return (
        scored.withColumn("similarity", similarity)
        .withColumn("similarity_pct", half_even(F.col("similarity") * 100.0, 1))
        .drop("bounds", "dot", "norms")
    )


def ranked(similar: DataFrame) -> DataFrame:
    return similar.orderBy(F.desc("similarity"), "station_id")


def diverse_top(similar: DataFrame, n: int = 20, per_country: int = 3) -> DataFrame:
    """Best ``n`` stations with at most ``per_country`` of any country.

    The rank filter becomes a group limit that runs before the shuffle: each task
    forwards only its best few rows of a country, however many stations it has.
    """
    order = (F.desc("similarity"), F.col("station_id"))
    place = F.row_number().over(Window.partitionBy("country_code").orderBy(*order))
    return (
        similar.withColumn("place", place)
        .where(F.col("place") <= per_country)
        .drop("place")
        .orderBy(*order)
        .limit(n)
    )


def match_table(top: DataFrame, countries: DataFrame, *, unit: str = "C") -> DataFrame:
    """The matches as a table with country names, rounded to one decimal."""
    named = with_label(top, "country_code", countries, "name", "country")
    numbers = {
        c: display_temperature(F.col(c), unit) if c in TEMPERATURE_FEATURES else F.col(c)
        for c in FEATURES
        if c != "temp_variability"
    }
    return named.orderBy(F.desc("similarity"), "station_id").select(
        "station_name",
        "country",
        "climate_zone",
        "data_source",
        "similarity_pct",
        *[half_even(value, 1).alias(c) for c, value in numbers.items()],
    )


def radar_frame(
    profiles: DataFrame, top: DataFrame, preferences: Mapping[str, float], n: int = 3
) -> DataFrame:
    """Scaled features of the preference and the best ``n`` matches, in long form."""
    bounds = _bounds(_filled(profiles))
    best = (
        top.orderBy(F.desc("similarity"), "station_id")
        .limit(n)
        .select(
            F.concat(
                "station_name", F.lit(" ("), F.col("similarity_pct").cast("string"), F.lit("%)")
            ).alias("series"),
            *FEATURES,
        )
    )
    wanted = (
        top.sparkSession.range(1)
        .select(F.lit("Your preference").alias("series"))
        .withColumns({c: _wanted(preferences, c) for c in FEATURES})
    )
    scaled = (
        wanted.unionByName(best)
        .withColumn("bounds", bounds)
        .select("series", *[_scaled(F.col(c), c).alias(RADAR_LABELS[c]) for c in FEATURES])
    )
    return scaled.unpivot("series", list(RADAR_LABELS.values()), "feature", "value")
