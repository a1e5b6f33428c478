"""Structured Streaming over growing folders of books and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillworks.functions import quality
from quillworks.functions import text as tx
from quillworks.plans.recipes import Recipe
from quillworks.sources import epub

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def book_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Chapters of EPUB files as they arrive."""
    books = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "*.epub").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return epub.chapters(books)


def document_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """Rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def scored_stream(documents: DataFrame, recipe: Recipe) -> DataFrame:
    """Documents that pass a recipe, with their type and score: every operator in it works row by row."""
    scored = quality.scored(documents, recipe)
    return scored.withColumn("reject_reason", quality.rejected(recipe)).where("reject_reason is null").withColumn("content_type", quality.content_type("text")).drop("reject_reason", "gate", "density", "bits")


def first_seen(documents: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """Documents whose text no document within ``delay`` had before."""
    keyed = documents.withColumn("text_sha", F.sha2(tx.given("text"), 256)).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(["text_sha"])


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows by key and window of event time; rows later than ``delay`` are left out."""
    return events.withWatermark(time, delay).groupBy(F.window(time, size), key).count()
