"""Session helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a local master without one, a folder under /tmp."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "/tmp/quillworks-checkpoints"
    return root.rstrip("/")


#: What :func:`store` has written and nobody has discarded; goes when Python ends.
_left: dict[str, None] = {}


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.unregister(_clear)
        atexit.register(_clear)
    _left[path] = None
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(path: str) -> None:
    jvm, context = SparkContext._jvm, SparkContext._active_spark_context
    if jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    _left.pop(path, None)


def _clear() -> None:
    """Deletes what lazy results were still reading from."""
    for path in [*_left]:
        _delete(path)


def discard(*tables: DataFrame) -> None:
    """Deletes what :func:`store` wrote."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            _delete(path)


#: A table of so many rows, of a few longs each, may be sent to every task.
FEW_ROWS = 1 << 18


def few(table: DataFrame) -> DataFrame:
    """``table`` (stored; a few longs a row) marked for broadcast if its rows are few."""
    return F.broadcast(table) if table.limit(FEW_ROWS + 1).count() <= FEW_ROWS else table.hint("shuffle_merge")


#: A key of more rows than this goes to several tasks; the most frequent keys, so many at most, are looked at.
SPLIT_ROWS, SPLIT_KEYS = 256, 20_000


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], by: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has at most one row a key, on ``key``. Rows of a frequent key are dealt by ``by`` over copies of its
    row in ``right``. A key beyond the SPLIT_KEYS most frequent has less than that part of ``left``. ``counts``, if known, has the keys with their ``count``."""
    keys = [key] if isinstance(key, str) else key
    counts = left.groupBy(*keys).count() if counts is None else counts
    often = F.broadcast(counts.where(F.col("count") > SPLIT_ROWS).orderBy(F.desc("count"), *keys).limit(SPLIT_KEYS).select(*keys, F.ceil(F.col("count") / SPLIT_ROWS).cast("int").alias("_copies")))
    dealt = left.join(often, keys, "left").withColumn("_copy", F.pmod(F.xxhash64(by), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    copied = right.join(often, keys, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return dealt.join(copied, [*keys, "_copy"], how).drop("_copy")


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs: its cleaner acts on what the driver has collected as garbage, first
    Python's handles, then the plans behind them."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def with_own_ids(docs: DataFrame, step: Callable[[DataFrame], DataFrame], *more: str) -> DataFrame:
    """``step`` of ``docs``, where each row without doc_id is a document of its own, above all ids; its doc_id is null again in
    what ``step`` returns, and so are such ids in the columns ``more``."""
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return step(docs)
    top = docs.agg(F.max("doc_id")).first()[0]
    top, kind = -1 if top is None else top, docs.schema["doc_id"].dataType
    # stored, as the numbers are not the same in each reading
    named = store(nameless.withColumn("doc_id", (F.lit(top) + 1 + F.monotonically_increasing_id()).cast(kind)), "nameless")
    out = step(docs.where("doc_id is not null").unionByName(named))
    return out.withColumns({c: F.when(F.col(c) <= top, F.col(c)) for c in ("doc_id", *more)})


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text):
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; where its scan has fewer splits than there are cores, as files of one row group have, its rows are dealt to all."""
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
