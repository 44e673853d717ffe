"""Scan of fixed-width daily files: one line per station, month and element.

The line filter runs before the day cells are unfolded, and a line unfolds only
into the cells it really holds and only up to the last day of its month. So
truncated lines and impossible dates need no per-cell date parsing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import blank_to_null, fixed, try_int
from skyledger.schemas import ELEMENTS, RAW_DAILY

# Character layout (0-based, end exclusive) of a daily line.
STATION, YEAR, MONTH, ELEMENT = (0, 11), (11, 15), (15, 17), (17, 21)
HEADER_CHARS, CELL_CHARS, VALUE_CHARS = 21, 8, 5
MISSING_VALUE = "-9999"


def _years(years: Sequence[int]) -> list[int]:
    wanted = sorted(set(years))
    if not wanted:
        raise ValueError("at least one year is required")
    return wanted


def _headers(lines: DataFrame, years: Sequence[int], on_error: str) -> DataFrame:
    value = F.col("value")
    return (
        lines.where(F.length(value) >= HEADER_CHARS)
        .withColumn("year", try_int(fixed(value, *YEAR), on_error))
        .withColumn("element", fixed(value, *ELEMENT))
        .where(F.col("year").isin(_years(years)) & F.col("element").isin(*ELEMENTS))
        .withColumn("month", try_int(fixed(value, *MONTH), on_error))
    )


def _cell(day: Column, offset: int, width: int) -> Column:
    start = (day - 1) * CELL_CHARS + (HEADER_CHARS + offset + 1)
    return F.col("value").substr(start, F.lit(width))


def _day_cells(headers: DataFrame) -> DataFrame:
    # CASE guards make_date: under ANSI mode an impossible month would throw
    first = F.when(
        F.col("month").between(1, 12) & F.col("year").between(1, 9999),
        F.make_date(F.col("year"), F.col("month"), F.lit(1)),
    )
    whole_values = F.floor(
        (F.length("value") - (HEADER_CHARS + VALUE_CHARS)) / float(CELL_CHARS)
    ).cast("int") + F.lit(1)
    days = F.least(F.dayofmonth(F.last_day(F.col("first"))), whole_values)
    return (
        headers.withColumn("first", first)
        .withColumn("days", days)
        .where(F.col("first").isNotNull() & (F.col("days") >= 1))
        .withColumn("day", F.explode(F.sequence(F.lit(1), F.col("days"))))
        .withColumn("text", F.trim(_cell(F.col("day"), 0, VALUE_CHARS)))
        .where(~F.col("text").isin("", MISSING_VALUE))
    )


def _station(from_file: bool) -> Column:
    if from_file:
        return F.regexp_extract("file", r"([^/]+?)(\.[^./]*)*$", 1)
    return fixed(F.col("value"), *STATION)


def parse_daily_lines(
    lines: DataFrame,
    years: Sequence[int],
    *,
    on_error: str = "skip",
    station_from: str = "line",
    carried: Sequence[str] = (),
) -> DataFrame:
    """Daily lines (column ``value``) as RAW_DAILY rows, with further columns of the lines in ``carried``.

    ``on_error='skip'`` leaves out cells whose numbers cannot be read (count
    them with :func:`malformed_counts`); ``'fail'`` stops the job.
    ``station_from='file'`` takes the id from a column ``file`` instead.
    """
    if station_from not in ("line", "file"):
        raise ValueError("station_from must be 'line' or 'file'")
    day = F.col("day")
    cells = _day_cells(_headers(lines, years, on_error))
    rows = cells.select(
        _station(station_from == "file").alias("station_id"),
        F.date_add(F.col("first"), day - 1).alias("obs_date"),
        F.col("element"),
        try_int(F.col("text"), on_error).alias("data_value"),
        blank_to_null(_cell(day, 5, 1)).alias("m_flag"),
        blank_to_null(_cell(day, 6, 1)).alias("q_flag"),
        blank_to_null(_cell(day, 7, 1)).alias("s_flag"),
        F.lit(None).cast("string").alias("obs_time"),
        *carried,
    )
    return rows.where(F.col("data_value").isNotNull()).select(*RAW_DAILY.names, *carried)


def landing_files(spark: SparkSession, path: str) -> DataFrame:
    """``station_id``, ``path`` and ``file`` of every file of a landing directory; none is opened."""
    listed = spark.read.format("binaryFile").load(path).select("path")
    named = listed.withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))
    return named.select(_station(True).alias("station_id"), "path", "file")


def malformed_counts(lines: DataFrame, years: Sequence[int]) -> DataFrame:
    """How many lines and cells ``on_error='skip'`` leaves out (one row)."""
    value = F.col("value")
    bad_lines = lines.where(F.length(value) >= HEADER_CHARS).agg(
        F.count_if(try_int(fixed(value, *YEAR)).isNull()).alias("bad_years"),
        F.count_if(
            try_int(fixed(value, *YEAR)).isin(_years(years))
            & fixed(value, *ELEMENT).isin(*ELEMENTS)
            & try_int(fixed(value, *MONTH)).isNull()
        ).alias("bad_months"),
    )
    bad_cells = _day_cells(_headers(lines, years, "skip")).agg(
        F.count_if(try_int(F.col("text")).isNull()).alias("bad_values")
    )
    return bad_lines.select("*", bad_cells.scalar().alias("bad_values"))


def read_daily_files(
    spark: SparkSession,
    path: str | list[str],
    years: Sequence[int],
    *,
    on_error: str = "skip",
    station_from: str = "line",
) -> DataFrame:
    """Read a landing directory; Spark splits the files into tasks."""
    lines = spark.read.text(path)
    if station_from == "file":
        lines = lines.select("value", F.col("_metadata.file_name").alias("file"))
    return parse_daily_lines(lines, years, on_error=on_error, station_from=station_from)
