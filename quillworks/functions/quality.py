"""Ten-dimension quality score, content type, front matter and benchmark phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillworks.functions import text as tx
from quillworks.plans.recipes import Recipe

#: Dimensions and their weights.
WEIGHTS = {
    "completeness": 0.12,
    "clarity": 0.12,
    "coherence": 0.08,
    "density": 0.12,
    "structure": 0.08,
    "length": 0.08,
    "formatting": 0.08,
    "uniqueness": 0.12,
    "readability": 0.10,
    "naturalness": 0.10,
}
FIRST_DENSITY, MOST_BLANKS = 0.35, 0.55

#: Marks of each content type.
CODE_MARKS = ["function", "def ", "class ", "import ", "if __name__", "public static", "int main", "var ", "const ", "=>", "->", "::"]
SPEECH_MARKS = ["said", "asked", "replied", "exclaimed"]
TECHNICAL_MARKS = ["algorithm", "function", "parameter", "implementation", "database", "server", "api", "http", "protocol", "framework", "library", "configuration", "syntax"]

#: Titles of front and back matter.
FRONT_MATTER = r"copyright|table\s*of\s*contents|index|glossary|about\s*the\s*auth(or|ress)|acknowledg(e|ment)s|foreword|preface|introduction\s*$|dedication|disclaimer|license|colophon|credits|also\s*by|praise\s*for|title\s*page|notes?$"

#: Phrases of public benchmarks.
BENCHMARK_PHRASES = [
    "the acceleration due to gravity is approximately",
    "which of the following is not a prime number",
    "the capital of Australia is",
    "the chemical symbol for gold is",
    "def has_close_elements",
    "def get_positive",
    "def count_distinct_characters",
    "def numerical_letter_grade",
    "def below_threshold",
    "from typing import List",
    "Natalia sold clips to 48 of her friends",
    "Janet's ducks lay 16 eggs per day",
    "A bat and a ball cost $1.10",
    "choose the option that best completes the pattern",
    "which of the following is the correct ordering",
]


def dimensions(metrics: str, entropy: str, least: int, most: int) -> dict[str, Column]:
    """Unrounded dimensions from 0 to 1 (formatting may be negative for scripts beyond ASCII), of ``measured`` metrics."""
    m = lambda name: F.col(f"{metrics}.{name}")
    n, a = m("n"), m("avg_sentence_len")
    short = (n - least) / F.lit(float(500 - least)) if least != 500 else F.lit(1.0)
    length = F.when(n < 500, short).when(n <= 4000, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - (n - 4000) / F.lit(float(most))))
    return {
        "completeness": F.least(m("sentences") / 8, F.lit(1.0)),
        "clarity": F.when(a.between(8, 35), 1 - F.abs(a - 20) / 30).otherwise(F.lit(0.0)),
        "coherence": F.when(m("sentences") >= 3, F.greatest(F.lit(0.0), 1 - m("sentence_spread") / 20)).otherwise(F.lit(0.5)),
        "density": F.least(m("density") / 0.7, F.lit(1.0)),
        "structure": m("structure"),
        "length": F.greatest(F.lit(0.0), F.least(F.lit(1.0), length)),
        "formatting": 1 - (n - m("printable")) / F.greatest(m("printable"), F.lit(1)),
        "uniqueness": 0.5 * m("lexical_diversity") + 0.5 * F.least(F.col(entropy) / 7, F.lit(1.0)),
        "readability": m("flesch"),
        "naturalness": m("naturalness"),
    }


def gate(text: Column | str, least: int, most: int, density: Column | None = None) -> Column:
    """The scorer's own reason to reject, or null; the cheap tests come first. ``density``, if known, is that of texts of fit length."""
    t = tx.given(text)
    return F.when(~F.length(t).between(least, most), "length").when((tx.density(t) if density is None else density) < FIRST_DENSITY, "low_density").when(tx.blank_ratio(t) > MOST_BLANKS, "high_blanks")


def rounded(value: Column, digits: int) -> Column:
    """Half up, by the same two operations in any engine."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def scored(df: DataFrame, recipe: Recipe, text: str = "text") -> DataFrame:
    """``df`` with gate, dims (struct of rounded tenths, null behind the gate), score (0 behind it), density and bits (entropy).

    Texts behind the gate are not measured: the metrics see an empty text there.
    """
    t = tx.given(text)
    out = df.withColumn("__density", F.when(F.length(t).between(recipe.min_chars, recipe.max_chars), tx.density(t)))
    out = out.withColumn("gate", gate(text, recipe.min_chars, recipe.max_chars, F.col("__density")))
    out = out.withColumn("__open", F.when(F.col("gate").isNull(), t).otherwise(F.lit("")))
    out = tx.measured(out, "__open", "__m", barrier=True, known_density=F.when(F.col("gate").isNull(), F.col("__density")).otherwise(F.lit(0.0))).withColumn("bits", tx.entropy("__open"))
    exact = dimensions("__m", "bits", recipe.min_chars, recipe.max_chars)
    out = out.withColumn("dims", F.when(F.col("gate").isNull(), F.struct(*(rounded(c * 10, 1).alias(k) for k, c in exact.items()))))
    total = sum((F.col(f"dims.{k}") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("score", F.when(F.col("gate").isNull(), rounded(total, 2)).otherwise(F.lit(0.0)))
    return out.withColumn("density", F.col("__m.density")).drop("__density", "__open", "__m")


def rejected(recipe: Recipe) -> Column:
    """The first reason against a row of :func:`scored`, or null for rows that stay."""
    return (
        F.when(F.col("gate").isNotNull(), F.col("gate"))
        .when(F.col("bits") < recipe.entropy, "low_entropy")
        .when(F.col("density") < recipe.min_density, "low_density")
        .when(F.col("score") < recipe.quality, "below_threshold")
    )


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def content_type(text: Column | str) -> Column:
    # a variable's value is computed once, where each branch would lower the text and count its words anew
    known = F.transform(F.array(F.lower(tx.given(text))), lambda t: F.struct(t.alias("t"), F.greatest(tx.words_between_spaces(t), F.lit(1)).alias("w")))
    return F.transform(known, lambda x: _content_type(x["t"], x["w"]))[0]


def _content_type(t: Column, w: Column) -> Column:
    code = sum((occurrences(t, k) for k in CODE_MARKS), F.lit(0))
    speech = tx.count(t, "[\"'][^\\n]*?[\"']") + sum((occurrences(t, k) for k in SPEECH_MARKS), F.lit(0)) + tx.count(t, "(?md)^[\"']")
    technical = sum((occurrences(t, k) for k in TECHNICAL_MARKS), F.lit(0))
    listed = tx.count(t, r"(?md)^[-*0-9]\.[\x09-\x0D\x1C-\x20]") + tx.count(t, r"\|[^\n]*\|")
    return (
        F.when(code / w > 0.02, "code")
        .when(speech / w > 0.03, "dialogue")
        .when(technical / w > 0.01, "technical")
        .when(listed > F.greatest(F.lit(3.0), 0.05 * w), "reference")
        .otherwise("narrative")
    )


def front_matter(title: Column, text: Column) -> Column:
    name = F.lower(tx.strip(tx.given(title)))
    body = tx.strip(tx.given(text))
    first = F.lower(F.split(body, "\n")[0])
    return name.rlike(FRONT_MATTER) | ((F.length(body) < 150) & (F.length(name) > 0) & first.rlike(FRONT_MATTER))


def benchmark_phrase(text: Column | str) -> Column:
    """The first benchmark phrase in the text, cut to 40 characters; null if none."""
    return F.transform(F.array(F.lower(tx.given(text))), lambda t: F.coalesce(*(F.when(t.contains(p.lower()), F.lit(p[:40])) for p in BENCHMARK_PHRASES)))[0]
