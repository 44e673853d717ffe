"""Which (year, bucket) partitions a change reaches through windows that count rows.

A window over a station's days reaches a number of rows back, and gaps in the
dates stay gaps, so how many years that is depends on how many days the station
has in each. A small table of days per station and year answers it: a day that
comes fewer than ``LOOKBACK_ROWS`` rows after a changed year has a rolling value
to rebuild, and the last day before a changed year has a new next day.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.operators.marts import LOOKBACK_ROWS
from skyledger.sources.versions import Partition


def partition_table(spark: SparkSession, partitions: Iterable[Partition]) -> DataFrame:
    """Partitions as rows: at most years times buckets of them."""
    found = sorted(partitions)
    columns = {name: pa.array([p[k] for p in found], pa.int32()) for k, name in enumerate(("obs_year", "station_bucket"))}
    return spark.createDataFrame(pa.table(columns))


def _flagged(rows: DataFrame, partitions: Iterable[Partition], name: str) -> DataFrame:
    marks = partition_table(rows.sparkSession, partitions).withColumn(name, F.lit(True))
    return rows.join(marks, ["obs_year", "station_bucket"], "left").fillna(False, [name])


def _by_year():
    return Window.partitionBy("station_bucket", "station_id").orderBy("obs_year")


def _up_to(days: Column) -> Column:
    return F.sum(days).over(_by_year().rowsBetween(Window.unboundedPreceding, 0))


def _pairs(rows: DataFrame, condition: Column) -> set[Partition]:
    found = rows.where(condition).select("obs_year", "station_bucket").distinct().collect()
    return {(r.obs_year, r.station_bucket) for r in found}


def partitions_to_rebuild(before: DataFrame, now: DataFrame, changed: set[Partition]) -> set[Partition]:
    """The changed partitions and those whose windows reach into them.

    ``before`` and ``now`` hold days per station and year (with the bucket) of the
    buckets concerned. Between a changed year and the years after it up to the
    next changed one nothing differs, so counting today's rows is enough.
    """
    keys = ["station_bucket", "station_id", "obs_year"]
    both = before.select(*keys, F.lit(0).cast("long").alias("days")).unionByName(now.select(*keys, "days"))
    years = _flagged(both.groupBy(*keys).agg(F.max("days").alias("days")), changed, "changed")
    end = _up_to(F.col("days"))
    placed = years.select("*", end.alias("end"), (end - F.col("days")).alias("start"))
    earlier = _by_year().rowsBetween(Window.unboundedPreceding, -1)
    marked = placed.select(
        "*",
        F.max(F.when(F.col("changed"), F.col("end"))).over(earlier).alias("changed_end"),
        F.lead("changed", 1, False).over(_by_year()).alias("changed_next"),
    )
    follows = F.coalesce(F.col("start") - F.col("changed_end") < LOOKBACK_ROWS, F.lit(False))
    reached = ~F.col("changed") & (F.col("days") > 0) & (follows | F.col("changed_next"))
    return changed | _pairs(marked, reached)


def partitions_to_read(now: DataFrame, rebuilt: set[Partition]) -> set[Partition]:
    """The rebuilt partitions with the rows that their windows see before and after them."""
    years = _flagged(now.where(F.col("days") > 0), rebuilt, "rebuilt")
    end = _up_to(F.col("days"))
    placed = years.select("*", end.alias("end"), (end - F.col("days")).alias("start"))
    later = _by_year().rowsBetween(1, Window.unboundedFollowing)
    marked = placed.select(
        "*",
        F.min(F.when(F.col("rebuilt"), F.col("start"))).over(later).alias("next_start"),
        F.lag("rebuilt", 1, False).over(_by_year()).alias("rebuilt_before"),
    )
    seen = F.coalesce(F.col("next_start") - F.col("end") < LOOKBACK_ROWS, F.lit(False)) | F.col("rebuilt_before")
    return rebuilt | _pairs(marked, seen)
