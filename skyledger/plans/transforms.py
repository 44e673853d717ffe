"""The tables in dependency order, and the batch entry points around them."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators import marts, quality, staging
from skyledger.plans.reach import partition_table, partitions_to_read, partitions_to_rebuild
from skyledger.sources.daily_text import malformed_counts, read_daily_files
from skyledger.sources.station_text import read_station_catalogue
from skyledger.sources.versions import Partition, Snapshot
from skyledger.sources.warehouse import PARTITIONS, Warehouse

DAILY, STATIONS, SPANS = "staging.daily_observations", "staging.stations", "staging.station_years"
WEATHER, MONTHLY, FEATURES = "marts.daily_weather", "marts.monthly_summary", "marts.prediction_features"
TABLES = (DAILY, STATIONS, WEATHER, MONTHLY, FEATURES)
MALFORMED = "quality.malformed"
RAW_PARTS, RAW_DAYS = "quality.raw_parts", "quality.raw_days"
WEATHER_PARTS, MONTH_PARTS, FEATURE_PARTS = "quality.weather_parts", "quality.month_parts", "quality.feature_parts"


def build_marts(raw_daily: DataFrame, raw_stations: DataFrame) -> dict[str, DataFrame]:
    """All five tables as lazy plans, without writing anything."""
    daily, stations = staging.stage_daily(raw_daily), staging.stage_stations(raw_stations)
    weather = marts.daily_weather(daily, stations)
    return {
        DAILY: daily,
        STATIONS: stations,
        WEATHER: weather,
        MONTHLY: marts.monthly_summary(weather),
        FEATURES: marts.prediction_features(weather),
    }


class DuplicateStations(ValueError):
    """A station id occurs more than once and would repeat its observations."""


def require_unique(stations: DataFrame) -> None:
    found = staging.duplicate_station_ids(stations).orderBy("station_id").limit(5).collect()
    if found:
        ids = ", ".join(r.station_id for r in found)
        raise DuplicateStations(f"station ids must be unique before the join; see {ids}")


def run_transforms(
    warehouse: Warehouse, *, allow_duplicate_stations: bool = False, full: bool = False
) -> dict[str, DataFrame]:
    """Bring the stored tables up to date with the raw tables; each reads its inputs as stored.

    Every table remembers the snapshots it was derived from. Only (year, bucket)
    partitions whose input changed since are rebuilt, with those that their
    windows reach; the files of all others stay. A first run, another station
    dimension or ``full`` rebuild everything.

    Duplicate stations would multiply their observations and with them the
    window partitions, so they stop the run unless they are allowed.

    The marts are partitioned by year and station bucket and sorted by station
    inside a file, so year ranges prune partitions and station lists skip row
    groups. One shuffle and one sort by station serve both: the daily mart is
    stored with the next day's target and the lags beside it, which readers of
    the mart do not see, and the features are a projection of what is stored.
    """
    build = _Build(warehouse, full)
    build.stations()
    if not allow_duplicate_stations:
        require_unique(warehouse.read(STATIONS))
    build.narrow(DAILY, "raw.daily", staging.stage_daily)
    build.narrow(SPANS, DAILY, staging.station_years)
    build.weather()
    build.narrow(MONTHLY, WEATHER, marts.monthly_summary)
    build.features()
    return {name: warehouse.read(name) for name in TABLES}


class _Build:
    """One run over the stored tables in dependency order.

    A step first pins the snapshots of its inputs and works with those, so a
    writer that comes in between is seen by the next run and not lost.
    """

    def __init__(self, warehouse: Warehouse, full: bool):
        self.warehouse, self.full = warehouse, full

    def _pin(self, *sources: str) -> dict[str, int]:
        return {name: self.warehouse.versions(name).latest().number for name in sources}

    def _changes(self, table: str, source: str, pinned: dict[str, int]) -> set[Partition] | None:
        return None if self.full else self.warehouse.changes(table, source, pinned[source])

    def stations(self) -> None:
        pinned = self._pin("raw.stations")
        if self._changes(STATIONS, "raw.stations", pinned) != set():
            raw = self.warehouse.read("raw.stations", at=pinned["raw.stations"])
            self.warehouse.put(STATIONS, staging.stage_stations(raw), inputs=pinned)

    def narrow(
        self,
        table: str,
        source: str,
        derive: Callable[[DataFrame], DataFrame],
        sort_by: Sequence[str] = ("station_id",),
    ) -> None:
        """A table whose rows depend on rows of their own partition of ``source`` only."""
        pinned = self._pin(source)
        changed = self._changes(table, source, pinned)
        if changed != set():
            rows = derive(self.warehouse.read(source, changed, at=pinned[source], hidden=True))
            rows = self.warehouse.with_partition(rows)
            self.warehouse.put(table, rows, replacing=changed, by=PARTITIONS, sort_by=sort_by, inputs=pinned)

    def _reach(self, pinned: dict[str, int]) -> tuple[set[Partition] | None, set[Partition] | None]:
        """Partitions of the daily mart to rebuild and to read for it; None for all."""
        changed = self._changes(WEATHER, DAILY, pinned)
        if changed is None or self._changes(WEATHER, STATIONS, pinned) != set():
            return None, None
        if not changed:
            return changed, changed
        spans = self.warehouse.versions(SPANS)
        old = spans.at(self.warehouse.versions(WEATHER).latest().inputs[SPANS])
        if old is None:
            return None, None
        buckets = {bucket for _, bucket in changed}

        def of_buckets(snapshot: Snapshot) -> DataFrame:
            wanted = [key for key in snapshot.partitions() if key[1] in buckets]
            return self.warehouse.read(SPANS, wanted, at=snapshot.number, hidden=True)

        now = of_buckets(spans.at(pinned[SPANS]))
        rebuilt = partitions_to_rebuild(of_buckets(old), now, changed)
        return rebuilt, partitions_to_read(now, rebuilt)

    def weather(self) -> None:
        warehouse, pinned = self.warehouse, self._pin(DAILY, STATIONS, SPANS)
        rebuilt, read = self._reach(pinned)
        if rebuilt == set():
            return
        days = warehouse.read(DAILY, read, at=pinned[DAILY], hidden=True)
        stations = warehouse.read(STATIONS, at=pinned[STATIONS])
        history = marts.station_history(days, stations, "station_bucket", self._splits())
        if rebuilt is not None and rebuilt != read:
            here = partition_table(warehouse.spark, rebuilt)
            history = history.join(here, ["obs_year", "station_bucket"], "left_semi")
        warehouse.put(WEATHER, history, replacing=rebuilt, by=PARTITIONS, in_order=True, inputs=pinned)

    def _splits(self) -> int:
        """Parts of a bucket, so that the windows have about as many tasks as the session has reducers."""
        reducers = int(self.warehouse.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(1, -(-reducers // self.warehouse.station_buckets))

    def features(self) -> None:
        pinned = self._pin(WEATHER)
        changed = self._changes(FEATURES, WEATHER, pinned)
        if changed != set():
            history = self.warehouse.read(WEATHER, changed, at=pinned[WEATHER], hidden=True)
            rows = marts.features_of_history(history, ("station_bucket",))
            self.warehouse.put(FEATURES, rows, replacing=changed, by=PARTITIONS, in_order=True, inputs=pinned)


def run_quality(warehouse: Warehouse, as_of: datetime.date, *, full: bool = False) -> dict[str, DataFrame]:
    """Run and store the three suites.

    The counts behind the checks are stored per (year, bucket) and brought up to
    date where their input changed, then merged; ``full`` counts everything anew.
    """
    build = _Build(warehouse, full)
    build.narrow(RAW_PARTS, "raw.daily", quality.raw_check_parts)
    build.narrow(RAW_DAYS, "raw.daily", quality.raw_day_parts, sort_by=("obs_date",))
    build.narrow(WEATHER_PARTS, WEATHER, lambda rows: quality.weather_parts(rows, *PARTITIONS), sort_by=())
    build.narrow(MONTH_PARTS, MONTHLY, lambda rows: quality.month_parts(rows, *PARTITIONS), sort_by=())
    build.narrow(FEATURE_PARTS, FEATURES, lambda rows: quality.feature_parts(rows, *PARTITIONS), sort_by=())
    stations = warehouse.stations()
    results = {
        "quality.raw_daily": quality.merged_raw_daily(
            warehouse.read(RAW_PARTS), warehouse.read(RAW_DAYS), stations, as_of
        ),
        "quality.stations": quality.validate_stations(stations),
        "quality.marts": quality.merged_marts(
            warehouse.read(WEATHER_PARTS), warehouse.read(MONTH_PARTS), warehouse.read(FEATURE_PARTS)
        ),
    }
    return {name: warehouse.replace_table(name, rows) for name, rows in results.items()}


def load_catalogue(warehouse: Warehouse, path: str) -> None:
    warehouse.replace_stations(read_station_catalogue(warehouse.spark, path))


def _read_landing(
    warehouse: Warehouse, landing: str, years: Sequence[int], on_error: str
) -> DataFrame:
    """Observations of the landing directory; what they leave out is counted in MALFORMED."""
    if on_error == "skip":
        lines = warehouse.spark.read.text(landing)
        warehouse.replace_table(MALFORMED, malformed_counts(lines, years))
    return read_daily_files(warehouse.spark, landing, years, on_error=on_error)


def backfill(
    warehouse: Warehouse, landing: str, first_year: int, last_year: int, *, on_error: str = "skip"
) -> dict[str, DataFrame]:
    """Load an inclusive range of years in one job, then bring every table up to date.

    With ``on_error='skip'`` the unreadable years, months and values of this run
    are stored in ``quality.malformed``; ``'fail'`` stops at the first of them.
    """
    years = range(first_year, last_year + 1)
    warehouse.create()
    warehouse.replace_station_years(_read_landing(warehouse, landing, years, on_error), years)
    return run_transforms(warehouse)


def refresh(
    warehouse: Warehouse, landing: str, year: int, *, force: bool = False, on_error: str = "skip"
) -> dict[str, DataFrame]:
    """Load one year, then rebuild what it reaches. ``force`` truncates the observations first.

    ``on_error`` is that of :func:`backfill`.
    """
    warehouse.create()
    batch = _read_landing(warehouse, landing, [year], on_error)
    if force:
        warehouse.reload_daily(batch)
    else:
        warehouse.replace_station_years(batch, [year])
    return run_transforms(warehouse)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    counts = [
        rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, rows in tables.items()
    ]
    total = counts[0]
    for other in counts[1:]:
        total = total.unionByName(other)
    return total


