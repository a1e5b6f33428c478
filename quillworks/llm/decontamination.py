"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations alone.

Words are runs of digits, letters a-z (A-Z lower-cased) and anything outside ASCII. Each item gives its windows of ``span``
words. All words of the corpus are counted; the two rarest terms of each window are its anchors. The index holds the
postings (document, position) of all anchor terms. A window's rarest list, shifted by the term's offset, is intersected
with its second list; what is left is compared with the document's words.

Counts and index fold case by the engine's own lower(), which is fast and folds more than A-Z: it finds all that the
exact words find, and the comparison is by those.

Null texts have no words, null items no windows. doc_id names a document; repeated rows get the same figures each. A row without
doc_id has no hits in the report, as in its SQL; drop_contaminated judges it all the same. An item of
fewer words than a window is one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillworks.llm.common import ascii_lower, release, store, with_own_ids

SPAN = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Anchor terms are broadcast up to this many (of at most some 100 bytes each, on average); beyond, they are joined by a shuffle.
BROADCAST_TERMS = 200_000


def words(text):
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def folded(text):
    """As many words, with case folded further."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """item_id, phrase (words joined by spaces), terms (array) of each distinct window."""
    split = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = split.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - span, F.lit(0)))).alias("s"))
    cut = starts.select("item_id", F.slice("w", F.col("s") + 1, F.lit(span)).alias("terms"))
    return cut.select("item_id", F.array_join("terms", " ").alias("phrase"), "terms").distinct()


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences of each word in all documents."""
    return docs.select(F.explode(folded(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))


def anchors(phrases: DataFrame, counts: DataFrame, n: int = 2) -> DataFrame:
    """For each row of ``phrases`` (window, terms) its ``n`` rarest places: window, rank (1 the rarest), term, offset."""
    each = phrases.select("window", F.posexplode("terms").alias("offset", "term")).withColumn("term", F.lower("term"))
    known = each.join(counts, "term", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    ranked = known.withColumn("rank", F.row_number().over(Window.partitionBy("window").orderBy("times", "term", "offset")))
    return ranked.where(F.col("rank") <= n).select("window", "rank", "term", "offset")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional postings of ``terms``: term, doc_id, pos."""
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    placed = docs.select("doc_id", F.posexplode(folded(F.col("text"))).alias("pos", "term"))
    return placed.join(F.broadcast(terms) if few else terms.hint("shuffle_merge"), "term").select("term", "doc_id", "pos")


def phrase_matches(docs: DataFrame, postings: DataFrame, anchored: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, window, start and length of every place of every window of ``phrases`` (window, terms)."""

    def shifted(rank: int) -> DataFrame:
        own = anchored.where(F.col("rank") == rank).select("term", "window", "offset")
        return postings.join(own, "term").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0").select("doc_id", "window", "start")

    sized = phrases.select("window", "terms", F.size("terms").alias("n"))
    single = shifted(1).join(sized.where("n = 1").select("window"), "window", "left_semi")
    both = shifted(1).join(shifted(2), ["doc_id", "window", "start"], "left_semi").unionByName(single.select("doc_id", "window", "start"))
    places = both.join(sized, "window").groupBy("doc_id").agg(F.collect_set(F.struct("start", "window", "terms")).alias("places"))
    read = docs.join(places, "doc_id").select("doc_id", "places", words(F.col("text")).alias("w"))
    exact = F.filter("places", lambda c: F.slice("w", c["start"] + 1, F.size(c["terms"])) == c["terms"])
    return read.select("doc_id", F.explode(exact).alias("c")).select("doc_id", "c.window", "c.start", F.size("c.terms").alias("length")).distinct()


def proximity_matches(docs: DataFrame, items: DataFrame, within: int = SPAN) -> DataFrame:
    """doc_id, item_id, first, second: places of an item's two rarest distinct words in a stretch of a document that holds all its
    words, in any order. Words that no document has do not count; two at least must be left. The stretch's ends are at most
    ``within`` words apart, or as many as the item's own."""
    words_of = folded(F.col("text"))
    reach = F.greatest(F.lit(within), F.size(words_of) - 1)
    whole = items.select("item_id", F.array_distinct(words_of).alias("terms"), reach.alias("reach")).where("size(terms) > 1")
    whole = store(whole.withColumn("window", F.monotonically_increasing_id()), "items")
    counts = term_counts(docs)
    present = whole.select("window", F.explode("terms").alias("term")).join(counts, "term").groupBy("window").agg(F.collect_list("term").alias("terms"))
    whole = store(whole.drop("terms").join(present.where("size(terms) > 1"), "window"), "known")
    anchored = store(anchors(whole.select("window", "terms"), counts).join(whole.select("window", "reach"), "window"), "anchors")
    postings = store(index(docs, anchored.select("term").distinct()), "index")
    sides = [postings.join(anchored.where(F.col("rank") == r).select("term", "window", "reach"), "term").select("doc_id", "window", "reach", F.col("pos").alias(name), F.floor(F.col("pos") / F.col("reach")).alias("cell")) for r, name in ((1, "first"), (2, "second"))]
    near = sides[1].drop("reach").withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    pairs = sides[0].join(near, ["doc_id", "window", "cell"]).where(F.abs(F.col("first") - F.col("second")) <= F.col("reach"))
    read = docs.select("doc_id", words_of.alias("w")).dropDuplicates().join(pairs.join(whole.select("window", "item_id", "terms"), "window"), "doc_id")
    low, high = F.least("first", "second"), F.greatest("first", "second")
    since = F.greatest(high - F.col("reach"), F.lit(0))

    def holds(start, length):
        return F.size(F.array_except("terms", F.slice("w", (start + 1).cast("int"), length.cast("int")))) == 0

    around = holds(since, low + F.col("reach") - since + 1)
    return read.where(around).where(F.exists(F.sequence(since, low), lambda s: holds(s, F.col("reach") + 1))).select("doc_id", "item_id", "first", "second").distinct()


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_hit (words in windows), item_ids (found items, sorted as strings) for each row of ``docs``."""
    spark = docs.sparkSession
    cut = store(windows(items, span), "windows")
    phrases = store(cut.select("phrase", "terms").distinct().withColumn("window", F.monotonically_increasing_id()), "phrases")
    anchored = store(anchors(phrases, term_counts(docs)), "anchors")
    release(spark)
    postings = store(index(docs, anchored.select("term").distinct()), "index")
    hits = store(phrase_matches(docs.select("doc_id", "text"), postings, anchored, phrases), "hits")
    release(spark)
    before = Window.partitionBy("doc_id").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    new = hits.select("doc_id", "start", (F.col("start") + F.col("length")).alias("end"), F.coalesce(F.max(F.col("start") + F.col("length")).over(before), F.lit(0)).alias("until"))
    covered = new.groupBy("doc_id").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "until"), F.lit(0))).alias("n_hit"))
    named = cut.join(phrases.select("phrase", "window"), "phrase").select("window", F.col("item_id").cast("string").alias("item"))
    found = hits.select("doc_id", "window").distinct().join(named, "window").groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    counted = docs.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ANY_CASE)).cast("long").alias("n_words"))
    return counted.join(covered.join(found, "doc_id"), "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    )


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    return contamination(docs.select("doc_id", "text"), items).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with their own columns. Rows without doc_id are judged each by itself."""

    def clean(named: DataFrame) -> DataFrame:
        return named.join(contamination(named.select("doc_id", "text"), items).where("n_hit > 0").select("doc_id"), "doc_id", "left_anti").select(*named.columns)

    return with_own_ids(docs, clean)
