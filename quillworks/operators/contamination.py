"""Documents that hold a benchmark text word for word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillworks.functions.text import given

#: Items without an inner word are tried against each document; more of them are refused.
SHORT_ITEMS = 1000


def contained(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc, item) for every item whose text is part of the document's, in any case.

    A part's inner words are whole words of the document, so documents and items meet on the inner word of the item that fewest
    documents hold. Ids and words alone are joined; texts come to the pairs that meet.
    """
    wanted = items.select(F.col(item), F.lower(given(text)).alias("__item")).where("length(__item) > 0")
    split = F.split("__item", " ")
    wanted = wanted.withColumn("__inner", F.filter(F.slice(split, 2, F.greatest(F.size(split) - 2, F.lit(0))), lambda w: w != ""))
    lower = docs.select(F.col(doc), F.lower(given(text)).alias("__doc"))
    inner = wanted.select(F.explode(F.array_distinct("__inner")).alias("__word")).distinct()
    words = lower.select(doc, F.explode(F.array_distinct(F.split("__doc", " "))).alias("__word")).join(inner, "__word")
    held = words.groupBy("__word").agg(F.count("*").alias("__n"))
    # an item with an inner word that no document has is in none
    terms = wanted.select(item, "__item", F.explode("__inner").alias("__word")).join(held, "__word", "left")
    chosen = terms.groupBy(item, "__item").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__word").alias("w"))).alias("__least"))
    pairs = chosen.where("__least.n > 0").select(item, "__item", F.col("__least.w").alias("__word")).join(words, "__word")
    found = pairs.join(lower, doc).where(F.contains("__doc", "__item")).select(doc, item)
    short = wanted.where("size(__inner) = 0").select(item, "__item").limit(SHORT_ITEMS + 1).collect()
    if len(short) > SHORT_ITEMS:
        raise ValueError(f"more than {SHORT_ITEMS} items have no inner word")
    for row in short:
        found = found.union(lower.where(F.contains("__doc", F.lit(row["__item"]))).select(doc, F.lit(row[item]).alias(item)))
    return found.distinct()
