"""Code lists for display labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import blank_to_null, fixed
from skyledger.schemas import DIM_COUNTRY
from skyledger.session import local_table

# US postal codes that station directories label.
US_STATES = {
    "AK": "Alaska",
    "AL": "Alabama",
    "AR": "Arkansas",
    "AZ": "Arizona",
    "CA": "California",
    "CO": "Colorado",
    "CT": "Connecticut",
    "DC": "District of Columbia",
    "DE": "Delaware",
    "FL": "Florida",
    "GA": "Georgia",
    "HI": "Hawaii",
    "IA": "Iowa",
    "ID": "Idaho",
    "IL": "Illinois",
    "IN": "Indiana",
    "KS": "Kansas",
    "KY": "Kentucky",
    "LA": "Louisiana",
    "MA": "Massachusetts",
    "MD": "Maryland",
    "ME": "Maine",
    "MI": "Michigan",
    "MN": "Minnesota",
    "MO": "Missouri",
    "MS": "Mississippi",
    "MT": "Montana",
    "NC": "North Carolina",
    "ND": "North Dakota",
    "NE": "Nebraska",
    "NH": "New Hampshire",
    "NJ": "New Jersey",
    "NM": "New Mexico",
    "NV": "Nevada",
    "NY": "New York",
    "OH": "Ohio",
    "OK": "Oklahoma",
    "OR": "Oregon",
    "PA": "Pennsylvania",
    "PR": "Puerto Rico",
    "RI": "Rhode Island",
    "SC": "South Carolina",
    "SD": "South Dakota",
    "TN": "Tennessee",
    "TX": "Texas",
    "UT": "Utah",
    "VA": "Virginia",
    "VT": "Vermont",
    "WA": "Washington",
    "WI": "Wisconsin",
    "WV": "West Virginia",
    "WY": "Wyoming",
}


def state_dim(spark: SparkSession, states: dict[str, str] = US_STATES) -> DataFrame:
    return local_table(spark, {"code": list(states), "name": list(states.values())})


def country_dim(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Countries given as ``(code, name, iso3)`` rows."""
    return local_table(
        spark, {name: [row[k] for row in rows] for k, name in enumerate(DIM_COUNTRY.names)}
    )


def read_country_dim(spark: SparkSession, names_path: str, iso3_path: str | None = None) -> DataFrame:
    """Country labels from files the user supplies.

    ``names_path`` is the fixed-width country list that accompanies the station
    catalogue (two-letter code, blank, name). ``iso3_path`` is an optional CSV
    with the header ``code,iso3``. The lists have more than 200 entries and
    change over time, so they are a parameter and not part of the library.
    """
    line = F.col("value")
    names = (
        spark.read.text(names_path)
        .select(fixed(line, 0, 2).alias("code"), blank_to_null(F.substring(line, 4, 80)).alias("name"))
        .where(F.length("code") == 2)
    )
    if iso3_path is None:
        return names.withColumn("iso3", F.lit(None).cast("string"))
    iso3 = spark.read.csv(iso3_path, header=True, schema="code string, iso3 string")
    return names.join(iso3, "code", "left").select(*DIM_COUNTRY.names)
