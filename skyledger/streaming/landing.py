"""Incremental ingest of daily files from a landing directory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyledger.sources.daily_text import malformed_counts, parse_daily_lines
from skyledger.sources.warehouse import Warehouse

MALFORMED = "quality.malformed_batches"
SCOPES = ("station-year", "file")
#: Where a row came from and when that file landed.
CARRIED = {"landing_file": "_metadata.file_name", "landed_at": "_metadata.file_modification_time"}


def ingest_landing(
    warehouse: Warehouse,
    landing: str,
    years: Sequence[int],
    checkpoint: str,
    *,
    max_files_per_batch: int | None = None,
    on_error: str = "skip",
    scope: str = "station-year",
) -> StreamingQuery:
    """Parse files that are new since the last run and replace their station-years.

    Runs until nothing is left, then stops. Replacement is idempotent, so a
    micro-batch that is replayed after a failure leaves the table the same. A
    file must be delivered whole.

    ``scope`` says what a file replaces. With ``"station-year"`` it replaces the
    requested years of its stations, so these belong in one file. With
    ``"file"`` a station may be spread over files: each file replaces what a file
    of its name brought before, and a cell that several files hold is that of the
    file that landed last.

    With ``on_error='skip'`` the unreadable years, months and values are stored
    per micro-batch in ``quality.malformed_batches``; a replay replaces its row.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}, not {scope!r}")
    warehouse.create()

    def replace(lines: DataFrame, batch_id: int) -> None:
        lines = lines.persist()  # the source is read once for the counts and the rows
        try:
            if on_error == "skip":
                counts = malformed_counts(lines, years).withColumn("batch_id", F.lit(batch_id).cast("long"))
                warehouse.put(MALFORMED, counts, by=("batch_id",), replacing={(batch_id,)})
            rows = parse_daily_lines(lines, years, on_error=on_error, carried=tuple(CARRIED))
            if scope == "file":
                warehouse.replace_files(rows, lines.select("landing_file"), years)
            else:
                warehouse.replace_station_years(rows, years)
        finally:
            lines.unpersist()

    reader = warehouse.spark.readStream.format("text")
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    return (
        reader.load(landing)
        .select("value", *[F.col(source).alias(name) for name, source in CARRIED.items()])
        .writeStream.foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
