"""Scan of the fixed-width station catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import blank_to_null, fixed, safe_double
from skyledger.schemas import RAW_STATIONS

# Character layout (0-based, end exclusive) of a catalogue line.
LAYOUT = {
    "station_id": (0, 11),
    "latitude": (12, 20),
    "longitude": (21, 30),
    "elevation": (31, 37),
    "state": (38, 40),
    "station_name": (41, 71),
    "gsn_flag": (72, 75),
    "hcn_flag": (76, 79),
    "wmo_id": (80, 85),
}
MIN_CHARS = 72
NUMBERS = ("latitude", "longitude", "elevation")
KEEP_BLANK = ("station_id", "station_name")


def parse_station_lines(lines: DataFrame) -> DataFrame:
    """Catalogue lines (column ``value``) as RAW_STATIONS rows with coordinates."""
    value = F.col("value")

    def field(name: str):
        text = fixed(value, *LAYOUT[name])
        if name in NUMBERS:
            return safe_double(text).alias(name)
        return (text if name in KEEP_BLANK else blank_to_null(text)).alias(name)

    return (
        lines.where(F.length(value) >= MIN_CHARS)
        .select(*[field(name) for name in RAW_STATIONS.names])
        .dropna(subset=["latitude", "longitude"])
    )


def read_station_catalogue(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_station_lines(spark.read.text(path))
