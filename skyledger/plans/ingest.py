"""Ingest for a location: only the files of the stations that are asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators.directory import resolve_stations
from skyledger.sources.daily_text import landing_files, parse_daily_lines
from skyledger.sources.warehouse import Warehouse, station_outcomes


def ingest_location(
    warehouse: Warehouse,
    landing: str,
    years: Sequence[int],
    *,
    station_ids: Sequence[str] | None = None,
    state: str | None = None,
    country: str | None = None,
    point: tuple[float, float] | None = None,
    radius_km: float = 50,
    on_error: str = "skip",
    force: bool = False,
) -> DataFrame:
    """Load the requested years of a location's stations; one row per station with its outcome.

    The landing directory holds one file per station, named after it
    (``USW00012345.dly``, with any further suffix). Explicit ids win over state,
    country and point, in that order. The listing is joined with the stations
    that were resolved, and the scan is filtered by file name, so files of other
    stations are not opened. What reaches the driver is the file names of the
    chosen stations, one each.

    Outcomes: ``loaded`` with its rows, ``skipped`` where the file has no row in
    the years, ``errors`` where there is no file or one of no bytes. Rows of skipped and missing
    stations stay as they are; ``force`` empties the observations first, which
    must be asked for with a location that has files.
    """
    spark = warehouse.spark
    warehouse.create()
    requested = resolve_stations(
        warehouse.stations(), station_ids=station_ids, state=state, country=country, point=point, radius_km=radius_km
    ).select("station_id")
    landed = landing_files(spark, landing).join(requested, "station_id", "left_semi")
    names = [r.file for r in landed.select("file").distinct().collect()]
    if not names:
        return station_outcomes(requested, landed, warehouse.daily().limit(0))
    lines = spark.read.text(landing).select("value", F.col("_metadata.file_name").alias("file"))
    batch = parse_daily_lines(lines.where(F.col("file").isin(*names)), years, on_error=on_error, station_from="file")
    if force:
        warehouse.reload_daily(warehouse.daily().limit(0))
    added = warehouse.replace_station_years(batch, years)
    return station_outcomes(requested, landed, warehouse.added_rows(added))
