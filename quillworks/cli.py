"""Command line: curate books, validate or merge examples, show a folder's statistics."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillworks.operators import duplicates, order
from quillworks.plans import build as plan
from quillworks.plans import recipes
from quillworks.sources import epub, sinks
from quillworks.sources.tables import fingerprint_maps, store
from quillworks.streaming import files as streams


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quillworks", description=__doc__)
    p.add_argument("input_dir", help="a folder of EPUB files; a JSON Lines file or pattern with --validate or --merge")
    p.add_argument("-o", "--output", default="dataset.jsonl")
    p.add_argument("--format", choices=sinks.FORMATS, default="jsonl")
    p.add_argument("--style", choices=("instruction", "completion", "chat"), default="instruction")
    p.add_argument("--recipe", choices=tuple(recipes.RECIPES), default="balanced")
    p.add_argument("--min-chars", type=int)
    p.add_argument("--max-chars", type=int)
    p.add_argument("--quality-threshold", type=float)
    p.add_argument("--similarity", type=float)
    p.add_argument("--no-dedup", action="store_true")
    p.add_argument("--redact-pii", action="store_true")
    p.add_argument("--shard", type=int)
    p.add_argument("--lightweight", action="store_true")
    p.add_argument("--include-front-matter", action="store_true")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--config")
    p.add_argument("--save-config")
    p.add_argument("--per-file", action="store_true")
    p.add_argument("--split-domain", action="store_true")
    p.add_argument("--quality-csv")
    p.add_argument("--pack", action="store_true")
    p.add_argument("--pack-max-tokens", type=int, default=2048)
    p.add_argument("--validate", action="store_true")
    p.add_argument("--merge", action="store_true")
    p.add_argument("--license")
    p.add_argument("--fingerprints", help="a JSON Lines file of bench and fp (SHA-256 of a text), or a folder of JSON maps from benchmarks to lists of these")
    p.add_argument("--tokenizer", help="a public vocabulary's name or a tokenizers file: est_tokens then counts its tokens")
    p.add_argument("--stream", action="store_true", help="append the chapters of new books to the output folder until stopped, as Parquet")
    p.add_argument("--jobs", type=int, help="partitions of books that are read at a time; all cores if not given")
    p.add_argument("--no-recursive", action="store_true")
    return p


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    chosen = recipes.recipe(a.recipe, a.config, min_chars=a.min_chars, max_chars=a.max_chars, quality=a.quality_threshold, similarity=a.similarity)
    if a.save_config:
        recipes.save(chosen, a.save_config)
        return 0
    spark = SparkSession.builder.appName("quillworks").getOrCreate()
    kind = sinks.format_of(a.output, a.format)
    if a.validate:
        plan.validate(sinks.read_jsonl(spark, a.input_dir)).groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("mean")).orderBy("bin").show()
        return 0
    if a.merge:
        rows = sinks.read_jsonl(spark, a.input_dir, lenient=True)
        sinks.write(duplicates.canonical(rows.withColumn("__at", F.monotonically_increasing_id()), "__at").drop("__at"), a.output, kind)
        return 0
    if a.stream:
        query = streams.book_stream(spark, a.input_dir).writeStream.format("parquet").option("checkpointLocation", f"{a.output}_checkpoint").start(a.output)
        query.awaitTermination()
        return 0
    books = epub.files(spark, a.input_dir, not a.no_recursive)
    if a.jobs:
        books = books.coalesce(a.jobs)
    chapters, metadata = epub.chapters(books, a.include_front_matter), epub.metadata(books)
    if a.stats:
        plan.folder_stats(chapters).show(1000, False)
        return 0
    if a.license:
        chapters = epub.licensed(chapters, metadata, a.license)
    options = plan.Options(chosen, a.style, a.redact_pii, a.lightweight, not a.no_dedup, pack=a.pack_max_tokens if a.pack else None, tokenizer=a.tokenizer)
    known = None
    if a.fingerprints:
        known = spark.read.json(a.fingerprints) if a.fingerprints.endswith(".jsonl") else fingerprint_maps(spark, a.fingerprints)
    built = plan.build(chapters, options, metadata, known)
    if not built.funnel["quality_passed"]:
        print("no chunk passed", file=sys.stderr)
        return 1
    if a.per_file:
        sinks.write(built.examples.withColumn("file", sinks.file_name_of(F.col("source"))), a.output, kind, by=["file"])
    elif a.split_domain and not a.pack:
        sinks.write(built.examples.withColumn("type", F.col("content_type")), a.output, kind, by=["type"])
    elif a.shard:
        # stored, as the numbers are not the same in each reading
        rows = store(built.examples.withColumn("__at", F.monotonically_increasing_id()), "examples")
        sinks.write(order.contiguous_shards(rows, "__at", a.shard).drop("__at"), a.output, kind, by=["shard"])
    else:
        sinks.write(built.examples, a.output, kind)
    if a.quality_csv:
        sinks.write_csv(plan.quality_table(built.scored), a.quality_csv)
    plan.report(built, options).write.text(f"{a.output.rpartition('.')[0] or a.output}_report")
    return 0


if __name__ == "__main__":
    sys.exit(main())
