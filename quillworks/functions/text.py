"""Text cleaning and metrics as columns.

The patterns mean the same to Java's and RE2's regular expressions; white space is Unicode's, words are letters, digits and
underscores of any script. Nulls count as empty texts.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"[\p{L}\p{N}_]+"
ALNUM = r"[\p{L}\p{N}]"
SENTENCE_END = "[.!?]+"

# The same sets for Java alone, which tries the parts of a class one by one: the frequent ones come first.
_SOLID = rf"[\x21-\x7E[^{SPACE}]]"
_ALNUM = r"[a-zA-Z0-9\p{L}\p{N}]"
_WORD = r"[a-zA-Z0-9_\p{L}\p{N}]+"
_BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: Phrases whose frequent use marks generated prose.
TRANSITIONS = ["however", "therefore", "furthermore", "moreover", "additionally", "consequently", "nevertheless", "in addition", "on the other hand", "as a result", "importantly", "notably", "specifically"]


def given(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def without(text: Column, pattern: str) -> Column:
    """How many characters are left without the matches: cheaper than a list of them."""
    return F.length(F.regexp_replace(text, pattern, ""))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words_between_spaces(text: Column) -> Column:
    """How many runs other than white space."""
    return count(text, _SOLID + "+")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition; Spark has no built-in function for it, so texts beyond ASCII go through Python."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def normalize(text: Column | str, compose: bool = True) -> Column:
    """Cleans line ends, invisible characters, runs of blanks, page numbers on lines of their own."""
    t = given(text)
    if compose:
        t = nfkc(t)
    t = F.regexp_replace(t, r"\r\n|\r", "\n")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}\x{200C}\x{200D}\x{FEFF}\x{AD}]", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: ~x.rlike(r"\A[\p{Nd}]+\z"))
    return strip(F.array_join(lines, "\n"))


def token_estimate(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(given(text)) / 4)).cast("long")


def density(text: Column | str) -> Column:
    """Letters and digits among the characters other than white space."""
    t = given(text)
    close = F.replace(t, F.lit(" "), F.lit(""))
    solid = F.length(close) - without(close, _SOLID + "+")
    return F.coalesce(F.try_divide(F.length(t) - without(t, _ALNUM + "+"), solid), F.lit(0.0))


def blank_ratio(text: Column | str) -> Column:
    lines = F.split(given(text), "\n")
    return F.size(F.filter(lines, lambda x: x.rlike(rf"\A[{SPACE}]*\z"))) / F.size(lines)


def structure(text: Column | str) -> Column:
    t = given(text)
    parts = [(r"(?md)^#{1,6}[\x09-\x0D\x1C-\x20]", 0.3), (r"(?md)^[*-][\x09-\x0D\x1C-\x20]", 0.2), (r"(?md)^[0-9]+\.[\x09-\x0D\x1C-\x20]", 0.2), ("(?i)chapter|section|part|introduction|conclusion|summary", 0.3)]
    total = sum((F.when(t.rlike(p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in parts), F.lit(0.0))
    return F.least(total, F.lit(1.0))


@F.pandas_udf(T.DoubleType())
def _entropy(texts: pd.Series) -> pd.Series:
    import numpy as np

    def bits(text: str) -> float:
        if not text:
            return 0.0
        _, counts = np.unique(np.frombuffer(text.lower().encode("utf-32-le"), np.uint32), return_counts=True)
        share = counts / len(text)
        return float(-(share * np.log2(share)).sum())

    return texts.map(bits)


def entropy(text: Column | str) -> Column:
    """Bits a character, counted in Arrow batches: exploding the characters would shuffle a row for each."""
    return _entropy(given(text))


def measured(df: DataFrame, text: str = "text", to: str = "metrics", barrier: bool = False, known_density: Column | None = None) -> DataFrame:
    """``df`` with a struct of all metrics in column ``to``; ``known_density`` spares the text's density.

    Sentences and words are split once, in columns of their own, which every metric then reads; of a metric that nobody asks
    for, nothing is computed. ``barrier`` passes the struct through a generator of one row: a filter on the metrics then reads
    them, where Spark would else push it down and evaluate each metric anew for each of its mentions.
    """
    kept = df.columns
    t = given(text)
    df = df.withColumns({"__t": t, "__lower": F.lower(t)})
    df = df.withColumns({"__pieces": F.transform(F.split("__t", SENTENCE_END), strip), "__words": F.regexp_extract_all("__lower", F.lit(_WORD), F.lit(0))})

    def longer(k: int) -> Column:
        return F.filter("__pieces", lambda s: F.length(s) > k)

    df = df.withColumns(
        {
            "__n2": F.size(longer(2)),
            "__s5": F.transform(longer(5), lambda s: F.struct(F.length(s).alias("chars"), words_between_spaces(s).cast("double").alias("n"), F.lower(F.regexp_extract(s, _SOLID + "+", 0)).alias("first"))),
            # runs of vowels, told by their last ones, as all vowels stand in words; a word without any counts one
            "__syllables": F.length("__lower") - without(F.col("__lower"), "[aeiouy](?![aeiouy])") + F.size(F.filter("__words", lambda w: ~w.rlike("[aeiouy]"))),
        }
    )

    def sums(values) -> Column:
        """How many, their sum, and that of their squares."""
        zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
        return F.aggregate(values, zero, lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))

    df = df.withColumns({"__a": sums(F.transform("__s5", lambda s: s["n"])), "__b": sums(F.transform(F.filter("__s5", lambda s: s["chars"] > 10), lambda s: s["n"])), "__firsts": F.size(F.array_distinct(F.transform("__s5", lambda s: s["first"])))})
    metrics = _metrics(density("__t") if known_density is None else known_density)
    return df.select(*kept, (F.explode(F.array(metrics)) if barrier else metrics).alias(to))


def _metrics(density_: Column) -> Column:
    n, total = F.col("__a.n"), F.size("__words")
    variance = (n * F.col("__a.q") - F.col("__a.s") * F.col("__a.s")) / (n * n)
    wide = F.greatest(F.lit(0.0), F.col("__b.n") * F.col("__b.q") - F.col("__b.s") * F.col("__b.s")) / (F.col("__b.n") * F.col("__b.n"))
    std = F.when(variance > 0, F.sqrt(variance)).otherwise(F.lit(1.0))
    known = sum((F.when(F.contains("__lower", F.lit(p)), 1).otherwise(0) for p in TRANSITIONS), F.lit(0))
    natural = 0.4 * F.least(std / 8, F.lit(1.0)) + 0.3 * F.greatest(F.lit(0.0), 1 - known / 8) + 0.3 * (F.col("__firsts") / n)
    ease = 206.835 - 1.015 * (total / F.col("__n2")) - 84.6 * (F.col("__syllables") / total)
    return F.struct(
        F.length("__t").alias("n"),
        F.when(n > 0, F.col("__a.s") / n).otherwise(F.lit(0.0)).alias("avg_sentence_len"),
        F.when(total > 0, F.size(F.array_distinct("__words")) / total).otherwise(F.lit(0.0)).alias("lexical_diversity"),
        F.when((F.col("__n2") > 0) & (total > 0), F.greatest(F.lit(0.0), F.least(F.lit(100.0), ease)) / 100).otherwise(F.lit(0.5)).alias("flesch"),
        F.when(n < 4, F.lit(0.7)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), natural))).alias("naturalness"),
        F.col("__b.n").alias("sentences"),
        F.when(F.col("__b.n") >= 3, F.sqrt(wide)).alias("sentence_spread"),
        density_.alias("density"),
        blank_ratio("__t").alias("blank_ratio"),
        structure("__t").alias("structure"),
        (F.length("__t") - without(F.col("__t"), r"[\x20-\x7E\n]+")).alias("printable"),
    )
