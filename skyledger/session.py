"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import math
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_local_fallback: weakref.WeakKeyDictionary[SparkSession, str] = weakref.WeakKeyDictionary()

#: Settings the plans are tuned for. All are stock Spark options; a cluster
#: may override any of them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_table(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """Rows the caller already holds, as a table whose size the planner knows.

    An Arrow table becomes a local relation; Spark then broadcasts it in a join
    if it is small and shuffles it if not. A plain list would have no known size.
    """
    return spark.createDataFrame(
        pa.table({name: pa.array(values, pa.string()) for name, values in columns.items()})
    )


def sized_for(
    input_bytes: int, shuffled_share: float = 0.25, reducer_mb: int = 256, split_mb: int = 128
) -> dict[str, str]:
    """Partition settings for a job that reads ``input_bytes`` of raw tables.

    Reducers get about ``reducer_mb`` each at every size, which a task sorts
    without spilling much; there are 200 at least, and AQE joins what turns out
    small. Scan splits have ``split_mb``. The number of shuffle blocks is maps x
    reducers; raise both parameters together to have fewer.
    """
    mb = 1024**2
    reducers = math.ceil(input_bytes * shuffled_share / (reducer_mb * mb))
    return {
        "spark.sql.shuffle.partitions": str(max(reducers, 200)),
        "spark.sql.files.maxPartitionBytes": str(split_mb * mb),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(reducer_mb * mb),
    }


def build_session(app: str = "skyledger", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: there all tasks
    run on this machine. On a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _local_fallback.get(spark)
    if base is None:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_fallback[spark] = tempfile.mkdtemp(prefix="skyledger-")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created or removed."""
    return f"{shared_dir(spark)}/skyledger/{label}-{uuid.uuid4().hex}"
