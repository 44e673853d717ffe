"""Helpers shared by the text operators: settled tables, code shipping, batches of text."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import scratch_path

#: Column names and types of the documents table.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"

#: Bytes of text that a task holds as arrays at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, as ``--py-files`` would; once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_skyledger_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="skyledger-py-"), "skyledger_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._skyledger_shipped = True


@contextmanager
def arrow_records(spark: SparkSession, records: int | None) -> Iterator[None]:
    """At most so many rows in an Arrow batch, for rows whose texts or sets can be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if records is not None and int(before) > records:
        spark.conf.set(name, str(records))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def reader_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows in a batch of the Parquet reader, so that no array of whole texts grows large in the executors."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), rows)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffles_dropped(spark: SparkSession, drop: bool) -> Iterator[None]:
    """Let Spark (from 4.1 on) delete a query's shuffle files when the query ends, without waiting for garbage collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    if drop:
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        if drop:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settle(df: DataFrame, label: str, partition_by: str | None = None, records: int | None = None, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    Lineage ends there: later losses of executors recompute nothing before it,
    and rows keep the values they were written with. ``records`` bounds the rows
    of an Arrow batch on the way; ``drop_shuffles`` deletes the shuffle files of
    the write at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{label}")
    writer = df.write.option("compression", "zstd")
    with arrow_records(spark, records), shuffles_dropped(spark, drop_shuffles):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._settled_at = path
    return stored


def emptied(settled: DataFrame) -> None:
    """Overwrite a settled table with nothing once no later step reads it, so that its space is free."""
    spark = settled.sparkSession
    spark.createDataFrame([], settled.schema).write.mode("overwrite").parquet(settled._settled_at)


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """Whether the row belongs to the held-out part; a null id does not."""
    part = F.crc32(F.col(column).cast("string")) % modulus
    return F.coalesce(part == remainder, F.lit(False))


def plain_words(column: Column) -> Column:
    """The text with null as empty."""
    return F.coalesce(column, F.lit(""))


def as_bytes(texts: Iterable) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]


def slices(frame: pd.DataFrame, limit: int = SLICE_BYTES) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """The frame in runs of rows whose texts have about ``limit`` bytes; no text is cut."""
    texts = as_bytes(frame["text"])
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield frame.iloc[first:i], texts[first:i]
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield frame.iloc[first:], texts[first:]


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def semi_join_null_safe(docs: DataFrame, keys: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` (all columns, whatever their names) whose key occurs in ``keys``."""
    right = keys.select(F.col(column).alias("_skyledger_key")).distinct()
    return docs.join(right, docs[column].eqNullSafe(right["_skyledger_key"]), how)
