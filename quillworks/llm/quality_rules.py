"""Quality rules: counts per document, failure rates per host, verdicts joined back.

Each document is measured by itself. Failures are summed by host; a host's rate of each rule is shrunk towards the
rate of all hosts by a beta prior that the hosts' own spread gives (method of moments); a host whose shrunk rate of
some rule passes ``HOST_RATE`` fails with all its documents. Null hosts form one host. Null and empty texts count as no
words, and so fail. Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillworks.llm.common import store

#: A host fails when the shrunk share of its documents that break some rule is over this.
HOST_RATE = 0.6
#: The prior counts as at most and at least so many documents.
PRIOR_DOCUMENTS = (1.0, 1e6)

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5


def repeated_words(words: list[bytes], width: int = REPEAT_WINDOW) -> int:
    """Words that lie in windows of ``width`` words found at least twice."""
    import numpy as np

    n = len(words) - width + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, np.int64)
    twice[order[1:][same]] = twice[order[:-1][same]] = 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[width : width + n] -= twice
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def measure_text(text: str) -> tuple[int, int, int, int, int, int]:
    """The counts of ``MEASURES``: words are runs other than ASCII white space; windows are compared by a 64-bit hash."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.encode().split()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        len(lines),
        repeated_words(words),
    )


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in MEASURES]))
def _measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([(name, pa.int64()) for name in MEASURES])
    for texts in batches:
        yield pa.array([dict(zip(MEASURES, measure_text(text.as_py() or ""), strict=True)) for text in texts], kind)


def measures(docs: DataFrame, text: str = "text", to: str = "measures") -> DataFrame:
    """``docs`` with a struct of counts in column ``to``."""
    return docs.withColumn(to, _measures(F.col(text)))


def base_failed(m: str):
    """Too few words, or over a fifth of them in repeated windows."""
    return F.expr(f"{m}.n_words < 10 or 100 * {m}.n_repeat_words > 20 * {m}.n_words")


def failures(m: str) -> dict:
    """The rules whose rates hosts are judged by."""
    return {"base": base_failed(m), "symbols": F.expr(f"10 * {m}.n_symbols > {m}.word_chars"), "lines": F.expr(f"10 * {m}.n_dup_lines > 3 * {m}.n_lines")}


def host_verdicts(measured: DataFrame, host: str = "source", m: str = "measures") -> DataFrame:
    """host, n_docs, and per rule n_<rule> and rate_<rule> (shrunk), and host_failed."""
    rules = failures(m)
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), *(F.count_if(f).alias(f"n_{r}") for r, f in rules.items()))
    hosts = store(hosts, "hosts")
    row = hosts.agg(*(x for r in rules for x in (F.avg(F.expr(f"n_{r} / n_docs")).alias(f"m_{r}"), F.var_pop(F.expr(f"n_{r} / n_docs")).alias(f"v_{r}")))).first()
    low, high = PRIOR_DOCUMENTS
    for r in rules:
        mean, spread = row[f"m_{r}"] or 0.0, row[f"v_{r}"] or 0.0
        strength = min(max(mean * (1 - mean) / spread - 1, low), high) if spread > 0 else high
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"n_{r}") + mean * strength) / (F.col("n_docs") + strength))
    return hosts.withColumn("host_failed", F.greatest(*(F.col(f"rate_{r}") for r in rules)) > HOST_RATE)


def judge(measured: DataFrame, verdicts: DataFrame, host: str = "source", m: str = "measures", failed: str = "base_failed", kept: str = "kept") -> DataFrame:
    """``measured`` with columns ``failed`` and ``kept``. Spark broadcasts the verdicts only if their measured size allows."""
    return (
        measured.withColumn("__host", F.col(host))
        .join(verdicts.select(F.col("host").alias("__of"), "host_failed"), F.col("__host").eqNullSafe(F.col("__of")), "left")
        .withColumn(failed, base_failed(m))
        .withColumn(kept, ~F.col(failed) & ~F.coalesce("host_failed", F.lit(False)))
        .drop("__host", "__of", "host_failed")
    )


def verdicts_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept, one row per row of ``docs`` (doc_id, source, text)."""
    measured = store(measures(docs.select("doc_id", "source", "text")).drop("text"), "measures")
    return judge(measured, host_verdicts(measured)).select("doc_id", *(f"measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    hosts = host_verdicts(measures(docs.select("source", "text")).drop("text"))
    own = docs.columns
    packed = docs.select(F.struct(*own).alias("given"), "source", "text")
    return judge(measures(packed).drop("text"), hosts).where("kept").select("given.*")
