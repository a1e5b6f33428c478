"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local master may go without, and then uses /tmp."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = "/tmp/quillworks-checkpoints"
    return root.rstrip("/")


#: What :func:`store` has written and nobody has discarded; goes when Python ends.
_left: dict[str, None] = {}


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it back, so that later plans start there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.unregister(_clear)
        atexit.register(_clear)
    _left[path] = None
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what :func:`store` wrote."""
    if path := getattr(df, "_stored_at", None):
        _delete(path)


def _delete(path: str) -> None:
    jvm, context = SparkContext._jvm, SparkContext._active_spark_context
    if jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    _left.pop(path, None)


def _clear() -> None:
    for path in [*_left]:
        _delete(path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs: its cleaner acts on what the driver has collected as garbage, first
    Python's handles, then the plans behind them."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer splits than these, as files of one row group have; wide scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def fingerprint_maps(spark: SparkSession, path: str) -> DataFrame:
    """bench and fp of JSON files that each map benchmarks to lists of SHA-256 fingerprints."""
    from pyspark.sql import functions as F

    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    maps = files.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("bench", "fps"))
    return maps.select("bench", F.explode("fps").alias("fp")).distinct()
