"""Frozen intermediates that survive the loss of an executor.

``freeze`` writes a DataFrame once, as a table in the shared folder the cluster
names in ``spark.checkpoint.dir``, and reads it back.  The copy is columnar, so
later readers prune it, and its size is known to the planner.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
# Spark's switch for deleting a query's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Tables frozen on the way to each result that ``freeze_alone`` is making.
_on_the_way: list[list[DataFrame]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder; a local one only when the master is local."""
    root = spark.conf.get(_KEY, None)
    if root:
        return root.rstrip("/")
    if not (spark.conf.get("spark.master", None) or "").startswith("local"):
        raise ValueError(f"Set {_KEY} to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set(_KEY, root)
    return root


def _session_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/tidemark/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's frozen tables; results planned on them end here."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def freeze(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Compute ``df`` once and cut its lineage; what it shuffled leaves the disk."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    frozen = spark.read.schema(df.schema).parquet(path)
    frozen._frozen_at = path
    if _on_the_way:
        _on_the_way[-1].append(frozen)
    return frozen


def freeze_alone(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Freeze what ``make`` plans and delete the tables that were frozen on the way."""
    _on_the_way.append([])
    try:
        frozen = freeze(make(), label)
    finally:
        made = _on_the_way.pop()
    discard(*(t for t in made if t is not frozen))
    if _on_the_way:
        _on_the_way[-1].append(frozen)
    return frozen


def discard(*tables: DataFrame) -> None:
    """Delete frozen tables that nothing will read again."""
    for frozen in tables:
        path = frozen.sparkSession._jvm.org.apache.hadoop.fs.Path(frozen._frozen_at)
        path.getFileSystem(frozen.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of a scanned table that has fewer scan units than cores.

    Worth its small shuffle before costly row-wise work; a table of many scan
    units is returned as it is.  ``scan`` must be a plain read, not a query.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, *keys)
