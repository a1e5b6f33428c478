"""The registered queries: every operator over the driver's tables.

Documents stand for chapters: source, doc_id as the chapter's place, "Chapter <doc_id>" as its title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.functions import private, quality, tokens
from quillworks.functions import text as tx
from quillworks.operators import contamination, duplicates, formats, order
from quillworks.plans import build as plan
from quillworks.plans.recipes import RECIPES, Recipe
from quillworks.sources import epub, epub_writer, html
from quillworks.sources.tables import spread

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("source", F.col("doc_id").alias("chapter_index"), F.format_string("Chapter %d", "doc_id").alias("chapter_title"), "text", "lang")


def _metric(name: str) -> None:
    """A query of doc_id and one rounded metric."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tx.measured(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", quality.rounded(F.col(f"metrics.{name}"), 4).alias(name))

    QUERIES[name] = run


for _name in ("density", "blank_ratio", "avg_sentence_len", "lexical_diversity", "structure", "flesch", "naturalness"):
    _metric(_name)


@query
def entropy(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", quality.rounded(tx.entropy("text"), 4).alias("entropy"))


@query
def normalize_native(spark, sf_dir):
    clean = tx.normalize("text", compose=False)
    return documents(spark, sf_dir).select("doc_id", F.md5(clean).alias("text_md5"), F.length(clean).cast("long").alias("n"))


@query
def normalize_nfkc(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(tx.normalize("text")).alias("text_md5"))


@query
def token_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.token_estimate("text").alias("est_tokens"))


@query
def tokens_precise(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tokens.precise_tokens("text").alias("n_tokens"))


@query
def entropy_filter(spark, sf_dir):
    return documents(spark, sf_dir).where(tx.entropy("text") >= 3.0).select("doc_id")


def scored(spark, sf_dir, recipe: Recipe) -> DataFrame:
    df = quality.scored(documents(spark, sf_dir), recipe)
    return df.withColumn("reason", quality.rejected(recipe))


@query
def quality_dims(spark, sf_dir):
    return scored(spark, sf_dir, RECIPES["balanced"]).where("gate is null").select("doc_id", *(F.col(f"dims.{k}").alias(k) for k in quality.WEIGHTS))


@query
def quality_score(spark, sf_dir):
    return scored(spark, sf_dir, RECIPES["balanced"]).select("doc_id", "score", F.coalesce("gate", F.lit("")).alias("gate"))


@query
def reject_histogram(spark, sf_dir):
    return scored(spark, sf_dir, RECIPES["balanced"]).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def _recipe(name: str) -> None:
    def run(spark, sf_dir):
        return scored(spark, sf_dir, RECIPES[name]).where("reason is null").select("doc_id", "score")

    QUERIES[f"recipe_{name}"] = run


for _name in RECIPES:
    _recipe(_name)


@query
def classify(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", quality.content_type("text").alias("content_type"))


@query
def domain_hist(spark, sf_dir):
    typed = documents(spark, sf_dir).select(quality.content_type("text").alias("content_type"), tx.token_estimate("text").alias("t"))
    return typed.groupBy("content_type").agg(F.count("*").alias("n"), quality.rounded(F.sum("t") / F.count("t"), 4).alias("avg_tokens"))


@query
def front_matter(spark, sf_dir):
    title = F.split("text", "\n")[0]
    return documents(spark, sf_dir).select("doc_id", quality.front_matter(title, F.col("text")).alias("front_matter"))


@query
def pii_detect(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", private.detected("text").alias("pii")).where(F.size("pii") > 0)
    return found.select("doc_id", *(F.coalesce(F.array_join(F.try_element_at("pii", F.lit(k)), "|"), F.lit("")).alias(k) for k in private.PATTERNS))


@query
def pii_redact(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(private.masked("text")).alias("text_md5"))


@query
def pii_totals(spark, sf_dir):
    found = documents(spark, sf_dir).select(F.explode(private.detected("text")).alias("kind", "values"))
    return found.groupBy("kind").agg(F.sum(F.size("values")).cast("long").alias("total"))


@query
def keep_first(spark, sf_dir):
    return duplicates.name_dedup(table(spark, sf_dir, "pages").select("url"), "url").distinct()


@query
def merge_short(spark, sf_dir):
    out = order.merge_short(chapters(spark, sf_dir))
    return out.select("source", "chapter_index", "chapter_title", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"), "lang")


@query
def chunk_windows(spark, sf_dir):
    cut = documents(spark, sf_dir).select("doc_id", F.posexplode(order.windows("text", 2000, 200)).alias("chunk_no", "chunk"))
    return cut.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("chunk").alias("chunk_md5"))


@query
def chunk_semantic(spark, sf_dir):
    paragraphs = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    cut = documents(spark, sf_dir).select("doc_id", F.posexplode(order.semantic_chunks(paragraphs, 2000, 200)).alias("chunk_no", "chunk"))
    return cut.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("chunk").alias("chunk_md5"))


@query
def exact_dedup(spark, sf_dir):
    return duplicates.exact(documents(spark, sf_dir), "doc_id").select("doc_id")


@query
def merge_distinct(spark, sf_dir):
    docs = documents(spark, sf_dir)
    again = docs.withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    return duplicates.merge([docs, again], "doc_id").select("doc_id", "lang", "source")


@query
def shingle_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", duplicates.shingle_count("text").alias("n_shingles"))


@query
def near_dup_keep(spark, sf_dir):
    return duplicates.without_near_duplicates(documents(spark, sf_dir), "doc_id").select("doc_id")


@query
def near_dup_pairs(spark, sf_dir):
    return duplicates.near_duplicates(documents(spark, sf_dir), "doc_id", measure="slots").select("ord", "of")


@query
def contam_phrase(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", quality.benchmark_phrase("text").alias("phrase"))


@query
def contam_table(spark, sf_dir):
    return contamination.contained(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def fingerprints(spark, sf_dir) -> DataFrame:
    """The benchmark's fingerprints, and those of one source's documents as a second benchmark."""
    held = documents(spark, sf_dir).where("source = 'src3'").select(F.lit("held").alias("bench"), F.sha2("text", 256).alias("fp"))
    return table(spark, sf_dir, "benchmark").select(F.lit("bench").alias("bench"), F.sha2("text", 256).alias("fp")).union(held)


@query
def contam_sha(spark, sf_dir):
    return duplicates.fingerprinted(documents(spark, sf_dir), fingerprints(spark, sf_dir)).where("bench is not null").select("doc_id", "bench")


def chunks(spark, sf_dir) -> DataFrame:
    return chapters(spark, sf_dir).withColumns({"content_type": quality.content_type("text"), "quality": F.lit(5.0), "est_tokens": tx.token_estimate("text")})


@query
def fmt_instruction(spark, sf_dir):
    out = formats.instruction(chunks(spark, sf_dir))
    return out.select("instruction", "input", F.md5("response").alias("response_md5"), "source", "chapter", "chapter_index", "domain", "content_type", "quality_score", "est_tokens")


@query
def fmt_completion(spark, sf_dir):
    out = formats.completion(chunks(spark, sf_dir))
    return out.select("prompt", F.md5("completion").alias("completion_md5"), "chapter_index", "content_type", "est_tokens")


def _said(messages):
    return F.md5(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"))


@query
def fmt_chat(spark, sf_dir):
    return formats.chat(chunks(spark, sf_dir)).select(_said(F.col("messages")).alias("messages_md5"), "chapter_index", "est_tokens")


@query
def conversation_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return rows.select("conv_id", F.size("messages").cast("long").alias("n"), _said(F.col("messages")).alias("messages_md5"))


@query
def pack(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").alias("response"))
    packed = order.pack(docs, "doc_id")
    return packed.select("pack_start", "packed_count", "packed_tokens", F.md5("response").alias("response_md5"))


@query
def shard(spark, sf_dir):
    return order.contiguous_shards(documents(spark, sf_dir).select("doc_id"), "doc_id", 7).select("doc_id", F.col("shard").cast("long").alias("shard"))


@query
def export_pretrain(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").alias("response"))
    return formats.pretrain(docs, "doc_id").select(F.md5("text").alias("text_md5"), "split")


@query
def export_sft(spark, sf_dir):
    return formats.sft(formats.instruction(chunks(spark, sf_dir))).select(_said(F.col("messages")).alias("messages_md5"))


@query
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.html_to_text("html").alias("text"))


@query
def html_strip_regex(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html.strip_tags("html")).alias("text_md5"))


@query
def epub_chapters(spark, sf_dir):
    return epub.chapters(epub_writer.books_of_pages(table(spark, sf_dir, "pages")))


@query
def epub_metadata(spark, sf_dir):
    return epub.metadata(epub_writer.books_of_pages(table(spark, sf_dir, "pages")))


@query
def validate_hist(spark, sf_dir):
    examples = documents(spark, sf_dir).select(F.col("text").alias("response"))
    return plan.validate(examples).groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query
def source_quality(spark, sf_dir):
    kept = scored(spark, sf_dir, RECIPES["balanced"]).where("reason is null")
    return kept.groupBy("source").agg(F.count("*").alias("n"), plan.mean_of_hundredths("score").alias("avg_quality"))


@query
def report(spark, sf_dir):
    df = scored(spark, sf_dir, RECIPES["balanced"])
    kept = F.col("reason").isNull()
    tokens_ = F.when(kept, tx.token_estimate("text"))
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(kept).alias("kept"),
        F.sum(tokens_).alias("tokens"),
        plan.mean_of_hundredths(F.when(kept, F.col("score"))).alias("avg_quality"),
        F.max(F.when(kept, F.col("score"))).alias("best"),
        F.min(F.when(kept, F.col("score"))).alias("worst"),
    )


@query
def score_by_label(spark, sf_dir):
    """Mean score of labelled documents: the rubric held against people's verdicts."""
    labels = table(spark, sf_dir, "labels")
    df = scored(spark, sf_dir, RECIPES["balanced"]).join(labels, "doc_id")
    return df.groupBy(F.col("quality").cast("long").alias("quality")).agg(F.count("*").alias("n"), plan.mean_of_hundredths("score").alias("avg_score"))


@query
def table_stats(spark, sf_dir):
    names = ("documents", "benchmark", "conversations")
    out = [plan.table_stats(table(spark, sf_dir, n), n) for n in names]
    return out[0].union(out[1]).union(out[2])


@query
def build_examples(spark, sf_dir):
    own = documents(spark, sf_dir)
    given = own.select("source", F.col("doc_id").cast("int").alias("chapter_index"), F.format_string("Chapter %d", "doc_id").alias("chapter_title"), "text", F.substring(F.sha2("text", 256), 1, 16).alias("file_hash"))
    return plan.build(given).examples.select("instruction", "input", "response", "chapter_index", "quality_score", "est_tokens")
