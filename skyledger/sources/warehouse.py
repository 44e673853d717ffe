"""Tables as versioned Parquet folders under one root, and the ways to replace their rows.

``raw.daily`` is partitioned by year and by a hash bucket of the station id, and
so are the tables derived from it. A replacement reads only the (year, bucket)
partitions its stations fall into, writes new and kept rows once, each into a
folder of its own, and puts them in force with one rename (see ``versions``).
Readers that ask for years or stations prune to theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.schemas import HIDDEN, NAMESPACES, RAW_DAILY, RAW_DAILY_KEYS, RAW_DAILY_STORED, RAW_STATIONS, TABLES
from skyledger.sources.versions import Partition, Snapshot, Versions, changed_partitions, named, partition_of, without

PARTITIONS = ("obs_year", "station_bucket")
DEFAULT_BUCKETS = 16
LANDED = "raw.landed_files"
#: Files that a task of an ordered write keeps open; beyond that Spark sorts the rest by partition.
OPEN_FILES = 300


class Warehouse:
    """Path-based tables: ``{root}/{namespace}/{table}``.

    The number of station buckets is stored with the first snapshot of
    ``raw.daily`` and read from there ever after; asking for another number is
    refused, as rows would be looked for in partitions they are not in.
    """

    def __init__(self, spark: SparkSession, root: str, station_buckets: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self._asked = station_buckets
        self._buckets: int | None = None

    @property
    def station_buckets(self) -> int:
        if self._buckets is None:
            stored = self.versions("raw.daily").latest()
            if stored is None:
                self._buckets = self._asked or DEFAULT_BUCKETS
            else:
                self._buckets = stored.layout["station_buckets"]
                if self._asked not in (None, self._buckets):
                    raise ValueError(f"raw.daily is stored with {self._buckets} station buckets, not {self._asked}")
        return self._buckets

    # -- paths and plain tables ------------------------------------------

    def path(self, table: str) -> str:
        namespace, _, name = table.partition(".")
        if namespace not in NAMESPACES or not name:
            raise ValueError(f"table must be one of {NAMESPACES} plus a name, not {table!r}")
        return f"{self.root}/{namespace}/{name}"

    def versions(self, table: str) -> Versions:
        return Versions(self.spark, self.path(table))

    def exists(self, table: str) -> bool:
        return bool(self.versions(table).numbers())

    def schema(self, table: str, *, hidden: bool = False) -> T.StructType:
        """Declared columns, with ``hidden`` also what is stored for tables derived from this one."""
        if table == "raw.stations":
            return RAW_STATIONS
        if table == "raw.daily":
            return RAW_DAILY_STORED if hidden else RAW_DAILY
        declared = T.StructType.fromDDL(TABLES[table])
        if not hidden:
            return declared
        more = T.StructType.fromDDL(HIDDEN[table]).fields if table in HIDDEN else []
        keys = [T.StructField(c, T.IntegerType()) for c in PARTITIONS if c not in declared.names]
        return T.StructType(declared.fields + more + keys)

    def read(
        self,
        table: str,
        partitions: Iterable[Partition] | None = None,
        *,
        at: int | None = None,
        hidden: bool = False,
    ) -> DataFrame:
        """A stored table with its declared columns, in their declared order.

        ``partitions`` leaves the files of all others untouched; ``at`` reads an
        older snapshot that is still kept.
        """
        versions = self.versions(table)
        snapshot = versions.latest() if at is None else versions.at(at)
        if snapshot is None:
            raise LookupError(f"{table} is not stored" if at is None else f"{table} has no snapshot {at}")
        rows = versions.read(self._stored_schema(table), named(snapshot.folders, partitions))
        return rows.select(*self.schema(table, hidden=hidden).names)

    def _stored_schema(self, table: str) -> T.StructType:
        """All columns that files or folder names may hold."""
        schema = self.schema(table, hidden=True)
        return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])

    def create(self) -> None:
        """Create the raw tables without rows where missing."""
        if not self.exists("raw.stations"):
            self.replace_stations(self._empty(RAW_STATIONS))
        if not self.exists("raw.daily"):
            self._commit_daily(None, [])

    def _empty(self, schema: T.StructType) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _add(
        self, table: str, version: str, rows: DataFrame, by: Sequence[str], sort_by: Sequence[str] = ()
    ) -> tuple[str, ...]:
        """Write rows into a version that is not in force yet; the partition folders it has then.

        ``by`` rebalances first: AQE splits partitions that are too large and
        joins ones that are too small, so one year does not end up in one task
        and files stay of useful size.
        """
        if by:
            rows = rows.hint("rebalance", *[F.col(c) for c in by])
        if sort_by:
            rows = rows.sortWithinPartitions(*by, *sort_by)
        rows.write.mode("append").partitionBy(*by).parquet(f"{self.path(table)}/{version}")
        return self.versions(table).written(version, len(by))

    @contextmanager
    def _open_files(self) -> Iterator[None]:
        """Writers keep a file per partition open, so that rows are not sorted by partition again."""
        name = "spark.sql.maxConcurrentOutputFileWriters"
        before = self.spark.conf.get(name, "0")
        self.spark.conf.set(name, str(OPEN_FILES))
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def put(
        self,
        table: str,
        rows: DataFrame,
        *,
        replacing: set[Partition] | None = None,
        by: Sequence[str] = (),
        sort_by: Sequence[str] = (),
        in_order: bool = False,
        inputs: Mapping[str, int] | None = None,
    ) -> Snapshot:
        """Store rows in place of the partitions ``replacing``, or of the whole table.

        A replaced partition without new rows is gone; the files of the others
        stay as they are. ``in_order`` writes rows as they come, for plans whose
        tasks already hold few partitions and sorted rows.
        """
        versions = self.versions(table)
        before, version = versions.latest(), versions.new_folder()
        if in_order:
            with self._open_files():
                rows.write.partitionBy(*by).parquet(f"{self.path(table)}/{version}")
            folders = versions.written(version, len(by))
        else:
            folders = self._add(table, version, rows, by, sort_by)
        kept = without(before.folders, replacing) if before and replacing is not None else []
        return versions.commit(before, [*kept, *folders], inputs=dict(inputs or {}))

    def replace_table(
        self,
        table: str,
        rows: DataFrame,
        *,
        partition_by: Sequence[str] = (),
        sort_by: Sequence[str] = (),
    ) -> DataFrame:
        """Create or replace a whole table from a query and return it as stored."""
        self.put(table, rows, by=partition_by, sort_by=sort_by)
        return self.read(table)

    def changes(self, table: str, source: str, upto: int | None = None) -> set[Partition] | None:
        """Partitions of ``source`` that changed since ``table`` was derived from it; None if unknown.

        ``upto`` names the snapshot of ``source`` to compare with, the latest by default.
        """
        own = self.versions(table).latest()
        if own is None or source not in own.inputs:
            return None
        versions = self.versions(source)
        now = versions.latest() if upto is None else versions.at(upto)
        return changed_partitions(versions.at(own.inputs[source]), now)

    def expire(self, keep: int = 2) -> int:
        """Remove versions that only older snapshots name, of every table; how many folders went."""
        tables = ("raw.stations", "raw.daily", *TABLES)
        return sum(self.versions(t).expire(keep) for t in tables if self.exists(t))

    def is_populated(self, table: str) -> bool:
        return self.exists(table) and not self.read(table).limit(1).isEmpty()

    # -- raw.stations -----------------------------------------------------

    def replace_stations(self, stations: DataFrame) -> None:
        """Full replacement of the station dimension."""
        self.put("raw.stations", stations.select(*RAW_STATIONS.names))

    def stations(self) -> DataFrame:
        return self.read("raw.stations")

    # -- raw.daily --------------------------------------------------------

    def bucket(self, station_id: Column) -> Column:
        return F.pmod(F.xxhash64(station_id), F.lit(self.station_buckets)).cast("int")

    def with_partition(self, rows: DataFrame) -> DataFrame:
        """Rows with the partition columns that their day and station fall into."""
        missing = {}
        if "obs_year" not in rows.columns:
            missing["obs_year"] = F.year("obs_date")
        if "station_bucket" not in rows.columns:
            missing["station_bucket"] = self.bucket(F.col("station_id"))
        return rows.withColumns(missing) if missing else rows

    def daily(
        self, *, years: Sequence[int] | None = None, station_ids: Sequence[str] | None = None
    ) -> DataFrame:
        """Observations, pruned to partitions of the years and stations asked for."""
        snapshot = self.versions("raw.daily").latest()
        wanted = None if years is None else [key for key in snapshot.partitions() if key[0] in set(years)]
        rows = self.read("raw.daily", wanted, at=snapshot.number, hidden=True)
        if years is not None:
            rows = rows.where(F.col("obs_year").isin(*years))
        if station_ids is not None:
            buckets = [self.bucket(F.lit(s)) for s in station_ids]
            rows = rows.where(
                F.col("station_bucket").isin(*buckets) & F.col("station_id").isin(*station_ids)
            )
        return rows.select(*RAW_DAILY.names)

    def _checked(self, rows: DataFrame) -> DataFrame:
        """Rows ready to store. A NULL key stops the job, as NOT NULL would."""

        def required(name: str) -> Column:
            stop = F.raise_error(F.lit(f"NOT NULL constraint failed: {name}"))
            kind = RAW_DAILY[name].dataType
            return F.when(F.col(name).isNull(), stop.cast(kind)).otherwise(F.col(name)).alias(name)

        file = F.col("landing_file") if "landing_file" in rows.columns else F.lit(None).cast("string")
        keyed = rows.select(
            *[required(c) if c in RAW_DAILY_KEYS else F.col(c) for c in RAW_DAILY.names],
            file.alias("landing_file"),
        )
        return self.with_partition(keyed)

    def _add_daily(self, version: str, rows: DataFrame) -> tuple[str, ...]:
        return self._add("raw.daily", version, rows, PARTITIONS, ("station_id", "obs_date"))

    def _commit_daily(self, before: Snapshot | None, folders: Iterable[str]) -> None:
        layout = {"station_buckets": self.station_buckets}
        self.versions("raw.daily").commit(before, folders, layout=layout)

    def _start(self) -> tuple[Versions, Snapshot | None, str]:
        versions = self.versions("raw.daily")
        return versions, versions.latest(), versions.new_folder()

    def append_daily(self, rows: DataFrame) -> None:
        _, before, version = self._start()
        added = self._add_daily(version, self._checked(rows))
        self._commit_daily(before, [*(before.folders if before else ()), *added])

    def reload_daily(self, rows: DataFrame) -> None:
        """Truncate and load."""
        _, before, version = self._start()
        self._commit_daily(before, self._add_daily(version, self._checked(rows)))

    def replace_station_years(self, batch: DataFrame, years: Sequence[int]) -> tuple[str, ...]:
        """Replace the requested years of every station that has rows in ``batch``.

        A requested year with no new rows is emptied for those stations. An
        empty batch changes nothing. Running it twice is the same as once, so a
        failed run is repaired by repeating it. Returns the folders of the new
        rows, none if nothing changed.

        The batch is evaluated once, into its new folders; which stations and
        partitions it has is then read from there.
        """
        versions, before, version = self._start()
        wanted = set(years)
        added = self._add_daily(version, self._checked(batch).where(F.col("obs_year").isin(*wanted)))
        buckets = {bucket for _, bucket in map(partition_of, added)}
        if not buckets:
            return ()
        touched = {(year, bucket) for year in wanted for bucket in buckets}
        fetched = self.added_rows(added).select("station_id").distinct()
        self._merge(before, touched, added, lambda old: old.join(fetched, "station_id", "left_anti"))
        return added

    def added_rows(self, folders: Iterable[str]) -> DataFrame:
        """The stored observations of some folders, for instance those a replacement has added."""
        return self.versions("raw.daily").read(self._stored_schema("raw.daily"), folders)

    def _merge(
        self, before: Snapshot | None, touched: set[Partition], added: Sequence[str], keep: Callable[[DataFrame], DataFrame]
    ) -> None:
        """Put ``added`` in force with what is kept of the touched partitions, written once beside it."""
        folders = before.folders if before else ()
        old, kept = named(folders, touched), ()
        if old:
            rows = keep(self.added_rows(old)).select(*RAW_DAILY_STORED.names)
            kept = self._add_daily(self.versions("raw.daily").new_folder(), rows)
        self._commit_daily(before, [*without(folders, touched), *added, *kept])

    def replace_files(self, batch: DataFrame, files: DataFrame, years: Sequence[int]) -> None:
        """Replace what the ``files`` (column ``landing_file``) held in the requested years.

        ``batch`` has observations with their ``landing_file`` and ``landed_at``.
        A file that comes again replaces its own rows only, wherever they are. A
        cell (station, day, element) that several files hold is that of the file
        that landed last, of equally late ones the last in name order; a file
        may hold a cell more than once, which staging settles.
        """
        versions, before, version = self._start()
        wanted = F.col("obs_year").isin(*set(years))
        cell = ["station_id", "obs_date", "element"]
        last = F.max(F.struct("landed_at", "landing_file")).over(Window.partitionBy(*cell))
        newest = batch.withColumn("_last", last).where(F.col("_last.landing_file") == F.col("landing_file"))
        added = self._add_daily(version, self._checked(newest.select(*RAW_DAILY.names, "landing_file")).where(wanted))
        earlier = self._landed_before(files).where(wanted).select(*PARTITIONS).distinct().collect()
        touched = {tuple(r) for r in earlier} | {partition_of(f) for f in added}
        if not touched:
            return
        names = files.select("landing_file").distinct()
        # Spark takes the size of packed files for that of the rows; a broadcast would bring all cells to the driver
        new = self.added_rows(added).select(*cell).distinct().hint("merge")

        def keep(old: DataFrame) -> DataFrame:
            others = old.join(names, "landing_file", "left_anti")
            return others.join(new, cell, "left_anti")

        self._merge(before, touched, added, keep)
        now = self.read("raw.daily", touched, hidden=True).where(F.col("landing_file").isNotNull())
        landed = now.groupBy("landing_file", "station_id", *PARTITIONS).agg(F.count("*").alias("rows"))
        self.put(LANDED, landed, replacing=touched, by=PARTITIONS)

    def _landed_before(self, files: DataFrame) -> DataFrame:
        """Station-years that the files brought so far, from a table with a row for each."""
        if not self.exists(LANDED):
            return self._empty(self.schema(LANDED, hidden=True))
        landed = self.read(LANDED, hidden=True)
        return landed.join(files.select("landing_file").distinct(), "landing_file", "left_semi")

    def replace_years(self, batch: DataFrame, years: Sequence[int]) -> bool:
        """Replace whole years for all stations, unless ``batch`` is empty."""
        _, before, version = self._start()
        wanted = set(years)
        added = self._add_daily(version, self._checked(batch).where(F.col("obs_year").isin(*wanted)))
        if not added:
            return False
        kept = [f for f in (before.folders if before else ()) if partition_of(f)[0] not in wanted]
        self._commit_daily(before, [*kept, *added])
        return True

    def stations_with_all_years(
        self, years: Sequence[int], station_ids: Sequence[str] | None = None
    ) -> DataFrame:
        """Stations that already have observations in every requested year."""
        return stations_with_all_years(self.daily(years=years, station_ids=station_ids), years)


def stations_with_all_years(daily: DataFrame, years: Sequence[int]) -> DataFrame:
    wanted = sorted(set(years))
    return (
        daily.where(F.year("obs_date").isin(*wanted))
        .groupBy("station_id")
        .agg(F.count_distinct(F.year("obs_date")).alias("n"))
        .where(F.col("n") == len(wanted))
        .select("station_id")
    )


def station_outcomes(requested: DataFrame, landed: DataFrame, parsed: DataFrame) -> DataFrame:
    """Every requested station with its outcome and its rows: loaded, skipped (no rows) or errors (no file)."""
    with_file = landed.select("station_id").distinct().withColumn("has_file", F.lit(True))
    with_rows = parsed.groupBy("station_id").agg(F.count("*").alias("rows"))
    outcome = F.when(F.col("rows") > 0, "loaded").when(F.col("has_file"), "skipped").otherwise("errors")
    return (
        requested.select("station_id").distinct()
        .join(with_file, "station_id", "left")
        .join(with_rows, "station_id", "left")
        .select("station_id", outcome.alias("outcome"), F.coalesce("rows", F.lit(0)).alias("rows"))
    )


def ingest_summary(requested: DataFrame, landed: DataFrame, parsed: DataFrame) -> DataFrame:
    """Stations per outcome: loaded, skipped (no rows) or errors (no file)."""
    with_file = landed.select("station_id").distinct().withColumn("has_file", F.lit(True))
    with_rows = parsed.select("station_id").distinct().withColumn("has_rows", F.lit(True))
    status = (
        F.when(F.col("has_rows"), "loaded").when(F.col("has_file"), "skipped").otherwise("errors")
    )
    return (
        requested.select("station_id")
        .join(with_file, "station_id", "left")
        .join(with_rows, "station_id", "left")
        .agg(*[F.count_if(status == s).alias(s) for s in ("loaded", "skipped", "errors")])
    )
