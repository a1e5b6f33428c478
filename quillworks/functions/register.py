"""Functions for SQL: ``register(spark)`` makes them known to a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillworks.functions import text as tx
from quillworks.operators.order import semantic_pieces
from quillworks.sources import html

#: Native ones, as SQL.
EXPRESSIONS = {
    "quill_token_estimate(t STRING) RETURNS BIGINT": "greatest(1, floor(length(coalesce(t, '')) / 4))",
    "quill_masked_email(t STRING) RETURNS STRING": r"regexp_replace(coalesce(t, ''), '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b', '[EMAIL_REDACTED]')",
    "quill_fingerprint(t STRING) RETURNS STRING": "sha2(coalesce(t, ''), 256)",
}


@F.udtf(returnType="chunk_no: int, chunk: string")
class Chunks:
    """quill_chunks(text, size, overlap): one row a chunk."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        if not 0 <= overlap < size:
            raise ValueError("overlap must be from 0 to below the size")
        yield from enumerate(semantic_pieces(text or "", size, overlap))


def register(spark: SparkSession) -> list[str]:
    """The names that SQL then knows: quill_nfkc, quill_entropy and quill_html_text of a text, the native ones, and the table function quill_chunks."""
    for name, f in (("quill_nfkc", tx._nfkc), ("quill_entropy", tx._entropy), ("quill_html_text", html._text_nodes)):
        spark.udf.register(name, f)
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("quill_chunks", Chunks)
    return ["quill_nfkc", "quill_entropy", "quill_html_text", *(h.partition("(")[0] for h in EXPRESSIONS), "quill_chunks"]
