"""Byte-level BPE encoding and decoding.

Texts of up to ``chunk_chars`` are encoded as they are. Longer ones are cut into overlapping chunks, which are
pre-tokenised in parallel. In each overlap the pre-token boundaries of both chunks are compared. A pre-token depends on the text
from its start on alone, so from a boundary that both have, both go on alike: there the text is cut, and each piece is encoded by
itself. Where an overlap holds no common boundary (one enormous word, say), the chunks on its two sides stay one piece.

Long texts are told by their MD5, so equal ones are encoded once and no row number is needed that might change between two
readings. Null and empty texts give empty lists. Rows keep all their columns; repeated rows each get their ids. An empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillworks.llm.common import spread_join

CHUNK_CHARS = 1 << 14
OVERLAP_CHARS = 1 << 9

#: No decision on a boundary looks further ahead than this.
LOOKAHEAD = 4


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoder(ranks_path: str, pattern: str):
    """An Arrow UDF from text to ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import tiktoken

        bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        for texts in batches:
            ids = [np.asarray(bpe.encode_ordinary(text.as_py() or ""), np.int32) for text in texts]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))

    return encode


def decoder(ranks_path: str):
    """An Arrow UDF from ids to raw bytes; null ids give null."""

    @F.arrow_udf(T.BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = read_ranks(ranks_path)
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            table[rank] = piece
        for batch in batches:
            yield pa.array([None if not x.is_valid else b"".join([table[i] for i in x.values.to_pylist()]) for x in batch], pa.binary())

    return decode


def boundaries(text: str, pattern, start: int = 0) -> list[int]:
    """Ends of the pre-tokens from ``start`` on that what may follow ``text`` cannot move: not those of white space up to its end."""
    sure = len(text[: len(text) - LOOKAHEAD].rstrip())
    return [end for end in (m.end() for m in pattern.finditer(text, start)) if end < sure]


def resynchronised(text: str, core: int, pattern) -> int | None:
    """The first place after ``core`` where pre-tokens counted from 0 and from ``core`` both end, but after no white space: how that
    is split depends on what follows."""
    own = set(boundaries(text, pattern))
    return next((at for at in boundaries(text, pattern, core) if at in own and not text[at - 1].isspace()), None)


CHUNKS = "key string, k int, start long, body string, last boolean"


def _cut(size: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                starts = range(0, len(text), size)
                for some in (starts[i : i + 64] for i in range(0, len(starts), 64)):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": [key] * len(some),
                            "k": pa.array([s // size for s in some], pa.int32()),
                            "start": pa.array(some, pa.int64()),
                            "body": [text[s : s + size + overlap] for s in some],
                            "last": [s + size >= len(text) for s in some],
                        }
                    )

    return cut


def _seams(size: int, pattern: str):
    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern)
        for batch in batches:
            cuts = [len(body) if last else resynchronised(body, size, split) for body, last in zip(batch["body"].to_pylist(), batch["last"].to_pylist(), strict=True)]
            yield batch.append_column("cut", pa.array(cuts, pa.int64()))

    return seams


def stitched(texts: DataFrame, pattern: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """key, first (the number of its first chunk) and piece of each piece of ``texts`` (key, text), equal ones once."""
    chunks = texts.mapInArrow(_cut(chunk_chars, overlap_chars), CHUNKS).dropDuplicates(["key", "k"])
    chunks = chunks.mapInArrow(_seams(chunk_chars, pattern), f"{CHUNKS}, cut long")
    in_order = Window.partitionBy("key").orderBy("k")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    # a chunk begins where the one before it was cut, or else at its own start; it opens a piece in the first case
    chunks = chunks.withColumn("cut", F.col("cut") + F.col("start")).withColumns({"begin": F.lag("cut").over(in_order), "no": F.count("cut").over(before)})
    begin, end = F.coalesce("begin", "start"), F.coalesce("cut", F.col("start") + chunk_chars)
    parts = chunks.select("key", "no", "k", F.substring("body", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "")
    return parts.groupBy("key", "no").agg(F.min("k").alias("first"), whole.alias("piece")).select("key", "first", "piece")


def _free(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def parts(docs: DataFrame, ranks_path: str, pattern: str, text: str, to: str, key: str, chunk_chars: int, overlap_chars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of ``docs`` whose texts are encoded as they are; the other rows with their text's MD5 in ``key``; and ``key`` and the
    ids, in column ``to``, of each different one of these texts."""
    if not 2 * LOOKAHEAD < overlap_chars <= chunk_chars:
        raise ValueError("the overlap must be longer than the lookahead and no longer than a chunk")
    if "(?<" in pattern:
        raise ValueError("a pre-token may not depend on what stands before it")
    short = docs.where(F.col(text).isNull() | (F.length(text) <= chunk_chars))
    long = docs.where(F.length(text) > chunk_chars).withColumn(key, F.md5(text))
    pieces = stitched(long.select(F.col(key).alias("key"), F.col(text).alias("text")), pattern, chunk_chars, overlap_chars).withColumn("ids", encoder(ranks_path, pattern)(F.col("piece")))
    joined = pieces.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "ids"))), lambda x: x["ids"])).alias(to))
    return short, long, joined.withColumnRenamed("key", key)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", to: str = "ids", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``docs`` with the ids of each whole text in column ``to`` (replaced if there), as the tiktoken library's encode_ordinary gives them."""
    rest = [c for c in docs.columns if c != to]
    key, by = _free("_key", rest), "doc_id" if "doc_id" in rest else rest[0]
    short, long, joined = parts(docs.select(*rest), ranks_path, pattern, text, to, key, chunk_chars, overlap_chars)
    short = short.withColumn(to, encoder(ranks_path, pattern)(F.col(text)))
    return short.unionByName(spread_join(long, joined, key, by).select(*rest, to))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", to: str = "bytes") -> DataFrame:
    """``df`` with the raw bytes of the ids in column ``to``."""
    return df.withColumn(to, decoder(ranks_path)(F.col(ids)))


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digester(ranks_path: str, pattern: str | None):
    """An Arrow UDF from texts (or, without a pattern, ids) to DIGEST. Ids are decoded and digested text by text: none are kept."""

    @F.arrow_udf(DIGEST)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import hashlib

        import tiktoken

        ranks = read_ranks(ranks_path)
        bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if pattern else None
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            table[rank] = piece
        for batch in batches:
            rows = []
            for x in batch:
                ids = bpe.encode_ordinary(x.as_py() or "") if bpe else x.values.to_pylist()
                rows.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"".join([table[i] for i in ids])).hexdigest()))
            columns = [*zip(*rows, strict=True)] or [[]] * 3
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and hex SHA-256 of the ids (decimal, joined by spaces) and of the decoded bytes."""
    short, long, joined = parts(docs.select("doc_id", "text"), ranks_path, pattern, "text", "ids", "key", CHUNK_CHARS, OVERLAP_CHARS)
    own = short.select("doc_id", digester(ranks_path, pattern)(F.col("text")).alias("d"))
    stored = joined.select("key", digester(ranks_path, None)(F.col("ids")).alias("d"))
    return own.unionByName(spread_join(long.select("doc_id", "key"), stored, "key", "doc_id").select("doc_id", "d")).select("doc_id", "d.*")
