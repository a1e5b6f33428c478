"""Removal of repeated passages by an enhanced suffix array.

A byte goes if a string of ``width`` bytes that covers it also starts in a document of smaller id. Every such string holds
an anchor: the least hash of its ``gram``-byte pieces. So two places can share a string only around a shared anchor.

1. Each task hashes its documents' bytes, picks the anchors, and takes short hashes of the bytes to their left and right: a
   shared string reaches half of its rest on one side. Anchors that several documents of a batch of texts share on a side
   stay there, and both their sides are told to others once; the other anchors are shipped, packed by bucket.
2. A bucket's anchors are sorted; those that two documents share with one side go back to the documents that shipped them.
3. Around these anchors the context that the strings with this anchor can cover is cut out, and each distinct context
   of a batch is shipped once. A bucket's contexts of one anchor form one text; its suffix array with common prefix
   lengths is scanned with a stack for intervals of ``width`` or more, whose left extensions tell which repeats are
   maximal. Each occurrence in a document above the interval's least one is a removed run.
4. Runs come back to their documents and are cut out.

Null and empty texts have no bytes. Rows that repeat a doc_id count as one document: they never remove each other's bytes.
Rows without doc_id keep all bytes and remove none, as in the SQL.
Anchors and contexts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillworks.llm.common import discard, release, shuffle_width, store

WIDTH, GRAM = 50, 20
BUCKETS = 4
#: Bytes of text whose anchors are shipped together.
BATCH_BYTES = 1 << 24
#: Hashing works on pieces of so many bytes.
PIECE = 1 << 20
#: Suffix arrays are built over about so many contexts.
TEXTS_AT_ONCE = 10_000


def gram_hashes(data, gram: int):
    """64-bit hashes of all ``gram``-byte pieces (9 to 24 bytes) of a uint8 array."""
    import numpy as np

    n = len(data) - gram + 1
    padded = np.ascontiguousarray(data)
    words = np.lib.stride_tricks.as_strided(padded, (len(data) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    mixed = np.zeros(n, np.uint64)
    for at in sorted({*range(0, gram - 7, 8), gram - 8}):
        mixed = (mixed ^ words[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def sliding(values, width: int, op):
    """``op`` (minimum or maximum) over all windows of ``width``."""
    span = 1
    while span * 2 <= width:
        values = op(values[:-span], values[span:])
        span *= 2
    return op(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def anchors(data, width: int = WIDTH, gram: int = GRAM):
    """Positions and hashes of the anchors of a uint8 array: of every window of ``width`` bytes, its least grams."""
    import numpy as np

    if len(data) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, found, reach = [], [], width - gram
    for start in range(0, len(data) - width + 1, PIECE):
        first = max(0, start - reach)  # grams before start whose windows reach into this piece
        hashes = gram_hashes(data[first : start + PIECE + 2 * width], gram)
        least = sliding(hashes, reach + 1, np.minimum)
        spread = sliding(np.concatenate([np.zeros(reach, np.uint64), least, np.zeros(reach, np.uint64)]), reach + 1, np.maximum)
        picked = np.flatnonzero(hashes == spread)
        picked = picked[(picked + first >= start) & (picked + first < start + PIECE)] if start + PIECE < len(data) - width + 1 else picked[picked + first >= start]
        at.append(picked + first)
        found.append(hashes[picked])
    return np.concatenate(at), np.concatenate(found)


def contexts(data, at, width: int = WIDTH, gram: int = GRAM):
    """For each anchor the bytes that strings of ``width`` around it can cover, as rows; 255, in no UTF-8, stands beyond the ends."""
    import numpy as np

    reach = width - gram
    padded = np.full(len(data) + 2 * reach, 255, np.uint8)
    padded[reach : reach + len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + gram)[at]


def row_hashes(rows):
    import numpy as np

    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    mixed = np.zeros(len(rows), np.uint64)
    for word in wide.view(np.uint64).T:
        mixed = (mixed ^ word) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def suffix_array(text: bytes, starts, depth: int):
    """``starts`` in the order of the ``depth`` bytes from them on, and the common prefix (up to ``depth``) of each with the one before."""
    import numpy as np

    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text + b"\xff" * (depth + 7), np.uint8), depth + 7 - (depth + 7) % 8)[starts]
    keys = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.lexsort(keys.T[::-1])
    rows = rows[order][:, :depth]
    common = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), depth)
    return np.asarray(starts)[order], common


def common_prefix_intervals(common, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, end) of the common-prefix intervals of ``least`` or more, inner ones first, by a scan with a stack."""
    stack: list[tuple[int, int]] = []
    for i, c in enumerate([*common, 0]):
        first = i - 1
        while stack and stack[-1][0] > c:
            length, first = stack.pop()
            yield length, first, i
        if c >= least and (not stack or stack[-1][0] < c):
            stack.append((int(c), first))


def maximal_repeats(texts: list[bytes], least: int) -> Iterator[tuple]:
    """(length, texts, offsets: an array each) of every repeat of ``least`` bytes or more that no byte extends on either side in all
    its places, with all its places. The texts hold no byte 255."""
    import numpy as np

    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    counts = np.maximum(sizes - least + 1, 0)
    if not counts.sum():
        return
    starts = np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    whole = b"\xff".join(texts) + b"\xff"
    order, common = suffix_array(whole, starts, int(sizes.max()))
    owner = np.searchsorted(ends, order, "right")
    left = ends[owner] - 1 - order
    common[1:] = np.minimum(common[1:], np.minimum(left[1:], left[:-1]))
    # suffixes that share less with both neighbours stand in no interval
    near = np.append(common[1:], 0) >= least
    order, owner, common = (x[near | (common >= least)] for x in (order, owner, common))
    offset = order - begins[owner]
    data = np.frombuffer(whole, np.uint8)
    before = np.where(offset > 0, data[order - 1].astype(np.int64), -1 - owner)
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    for length, first, end in common_prefix_intervals(common.tolist(), least):
        if changes[end - 1] > changes[first]:
            yield length, owner[first:end], offset[first:end]


def _pack(*columns) -> bytes:
    import numpy as np
    import zstandard

    return zstandard.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 1)


def _unpack(blob: bytes, *kinds):
    import numpy as np
    import zstandard

    data, out, at = zstandard.decompress(blob), [], 0
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(data[at : at + size], kind))
        at += size
    return out


def _rows(bucket, kind, blob) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int8()), pa.array(blob, pa.binary())], ["bucket", "kind", "blob"])


#: Rows between the steps. What a task settles by itself goes by bucket of documents, what others must see by bucket of anchors.
SHIPPED, SETTLED, GATHERED = "bucket int, kind byte, blob binary", "bucket int, blob binary", "doc_id long, blob binary"
LOCAL, SENT = 0, 1


def _settled(buckets: int, doc, *columns) -> pa.RecordBatch:
    """Columns of 32-bit numbers, by bucket of documents."""
    import numpy as np

    parts = [(b, _pack(d, *(c.astype(np.uint32) for c in more))) for b, d, *more in _by_document(doc % buckets, doc, *columns)]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["bucket", "blob"])


def _passed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    import numpy as np

    local = np.flatnonzero(batch["kind"].to_numpy() == LOCAL)
    if len(local):
        kept = batch.take(pa.array(local))
        yield pa.RecordBatch.from_arrays([kept["bucket"], kept["blob"]], ["bucket", "blob"])


def _gather(columns: int):
    """One row a document of all that was settled about it."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        parts = [_unpack(blob.as_py(), np.int64, *[np.uint32] * columns) for batch in batches for blob in batch["blob"]]
        if not parts:
            return
        doc, *more = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        rows = [(d, _pack(*own)) for d, *own in _by_document(doc, *more)]
        for at in range(0, len(rows), 1000):
            ids, blobs = zip(*rows[at : at + 1000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "blob"])

    return gather


def _by_document(doc, *columns):
    """(doc, columns) by document, for arrays in any order."""
    import numpy as np

    order = np.argsort(doc, kind="stable")
    cuts = np.flatnonzero(np.diff(doc[order])) + 1
    for own in np.split(order, cuts) if len(doc) else []:
        yield int(doc[own[0]]), *(c[own] for c in columns)


def _pair_key(code, half, side: int):
    """One key for an anchor and what stands on one side of it."""
    import numpy as np

    mixed = (code ^ (half.astype(np.uint64) << np.uint64(1) | np.uint64(side))) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ mixed >> np.uint64(29)


def _several(key, doc):
    """Which rows' key stands in two documents."""
    import numpy as np

    order = np.lexsort((doc, key))
    starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    many = np.maximum.reduceat(doc[order], starts) > np.minimum.reduceat(doc[order], starts)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(many, np.diff(np.append(starts, len(key))))
    return out


def _ship_anchors(width: int, gram: int, buckets: int):
    reach = width - gram
    half = -(-reach // 2)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, at, code, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
            target = (code % np.uint64(buckets)).astype(np.int32)
            keys = [_pair_key(code, left, 0), _pair_key(code, right, 1)]
            here = [_several(k, doc) for k in keys]
            out = {"bucket": [], "kind": [], "blob": []}

            def add(b, k, blob):
                for name, x in zip(out, (b, k, blob), strict=True):
                    out[name].append(x)

            alone = ~(here[0] | here[1])
            for b, *columns in _by_document(target[alone], code[alone], left[alone], right[alone], doc[alone], at[alone].astype(np.uint32)):
                add(b, SENT, _pack(*columns))
            # of places that stay here, both sides are told to the others: each may be what a place elsewhere shares
            known, first = np.unique(np.concatenate([k[~alone] for k in keys]), return_index=True)
            for b, k in _by_document(np.tile(target[~alone], 2)[first], known):
                add(b, SENT + 1, _pack(k))
            for b, d, a in _by_document(doc[~alone] % buckets, doc[~alone], at[~alone].astype(np.uint32)):
                add(b, LOCAL, _pack(d, a))
            yield _rows(*out.values())

        for batch in batches:
            for d, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                at, code = anchors(data, width, gram)
                for some in np.array_split(np.arange(len(at)), -(-len(at) // (1 << 16))) if len(at) else []:
                    rows = contexts(data, at[some], width, gram)
                    sides = [(row_hashes(x) >> np.uint64(48)).astype(np.uint16) for x in (rows[:, reach - half : reach + gram], rows[:, reach : reach + gram + half])]
                    held.append((np.full(len(some), d, np.int64), at[some], code[some], *sides))
                size += len(data)
                if size >= BATCH_BYTES and held:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return ship


def _match_anchors(buckets: int):
    return lambda batches: _matched_anchors(buckets, batches)


def _matched_anchors(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of anchors that another document has as well, with the same bytes on one side."""
    import numpy as np

    sent, leads = [], [np.empty(0, np.uint64)]
    for batch in batches:
        yield from _passed(batch)
        for kind, blob in zip(batch["kind"].to_pylist(), batch["blob"], strict=True):
            if kind == SENT:
                sent.append(_unpack(blob.as_py(), np.uint64, np.uint16, np.uint16, np.int64, np.uint32))
            elif kind == SENT + 1:
                leads += _unpack(blob.as_py(), np.uint64)
    if not sent:
        return
    code, left, right, doc, at = (np.concatenate(x) for x in zip(*sent, strict=True))
    known = np.unique(np.concatenate(leads))
    del sent, leads
    keep = np.zeros(len(code), bool)
    for side, half in enumerate((left, right)):
        key = _pair_key(code, half, side)
        keep |= _several(key, doc)
        if len(known):
            keep |= known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
    yield _settled(buckets, doc[keep], at[keep])


def _ship_contexts(width: int, gram: int, buckets: int):
    span = 2 * (width - gram) + gram
    reach = width - gram

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, at, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            code, anchor = row_hashes(rows), row_hashes(rows[:, reach : reach + gram])
            order = np.lexsort((at, doc, code))
            doc, at, rows, code, anchor = doc[order], at[order], rows[order], code[order], anchor[order]
            new = np.ones(len(code), bool)
            new[1:] = code[1:] != code[:-1]
            low = doc[new][np.cumsum(new) - 1]
            covered = doc > low
            out = {"bucket": [], "kind": [], "blob": []}

            def add(b, k, blob):
                for name, x in zip(out, (b, k, blob), strict=True):
                    out[name].append(x)

            # a context that a smaller document here has: all its strings go
            whole, start, end = _covers(at[covered], rows[covered], width, gram)
            for b, *columns in _by_document(doc[covered][whole] % buckets, doc[covered][whole], start, end):
                add(b, LOCAL, _pack(*columns))
            first = np.flatnonzero(doc == low)
            for b, own in _by_document((anchor[first] % np.uint64(buckets)).astype(np.int32), first):
                add(b, SENT, _pack(anchor[own], code[own], doc[own], at[own].astype(np.uint32), rows[own].view(f"V{span}").ravel()))
            yield _rows(*out.values())

        for batch in batches:
            for d, text, blob in zip(batch["doc_id"].to_pylist(), batch["text"], batch["blob"], strict=True):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                at = np.unique(_unpack(blob.as_py(), np.uint32)[0]).astype(np.int64)
                at = at[at + gram <= len(data)]
                for some in np.array_split(at, -(-len(at) // (1 << 16))) if len(at) else []:
                    held.append((np.full(len(some), d, np.int64), some, contexts(data, some, width, gram)))
                    size += len(some)
                    if size >= 1 << 17:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return ship


def _covers(at, rows, width: int, gram: int):
    """Which contexts hold a string at all, and (from, to) of what their strings cover."""
    import numpy as np

    reach = width - gram
    before = (rows[:, :reach] != 255).sum(1)
    after = (rows[:, reach + gram :] != 255).sum(1)
    whole = before + gram + after >= width
    return whole, (at - before)[whole].astype(np.uint32), (at + gram + after)[whole].astype(np.uint32)


def _match_contexts(width: int, gram: int, buckets: int):
    span = 2 * (width - gram) + gram
    reach = width - gram

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Removed runs."""
        import numpy as np

        sent = []
        for batch in batches:
            yield from _passed(batch)
            sent += [_unpack(blob.as_py(), np.uint64, np.uint64, np.int64, np.uint32, f"V{span}") for kind, blob in zip(batch["kind"].to_pylist(), batch["blob"], strict=True) if kind == SENT]
        if not sent:
            return
        anchor, code, doc, at, rows = (np.concatenate(x) for x in zip(*sent, strict=True))
        del sent
        order = np.lexsort((at, doc, code, anchor))
        anchor, code, doc, at, rows = (x[order] for x in (anchor, code, doc, at, rows))
        rows = rows.view(np.uint8).reshape(-1, span)
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (anchor[1:] != anchor[:-1])
        low = doc[new][np.cumsum(new) - 1]
        covered = doc > low
        whole, start, end = _covers(at[covered].astype(np.int64), rows[covered], width, gram)
        yield _settled(buckets, doc[covered][whole], start, end)
        # one context of each kind, in its least document; kinds of one anchor can share strings
        kind = np.flatnonzero(new)
        places = np.zeros(len(code), np.int64)  # of the kind in that document: these rows follow the first
        places[kind] = np.add.reduceat((~covered).astype(np.int64), kind)
        twin = np.zeros(len(kind), bool)
        same = anchor[kind][1:] == anchor[kind][:-1]
        twin[1:] |= same
        twin[:-1] |= same
        kind = kind[twin]
        # only contexts that agree with another on one half, from the anchor on, can share a string: it reaches that far on one side
        half = -(-reach // 2)
        near = np.zeros(len(kind), bool)
        for part in (rows[kind][:, reach - half : reach + gram], rows[kind][:, reach : reach + gram + half]):
            _, back, times = np.unique(row_hashes(part), return_inverse=True, return_counts=True)
            near |= times[back] > 1
        kind = kind[near]
        found_doc, found_at, found_end = [], [], []
        cuts = np.flatnonzero(anchor[kind][1:] != anchor[kind][:-1]) + 1
        cuts = [c for c, d in zip(cuts, np.append(cuts, len(kind))[1:], strict=True) if c // TEXTS_AT_ONCE != d // TEXTS_AT_ONCE]  # an anchor's contexts stay together
        for some in np.split(kind, cuts):
            texts = [rows[i].tobytes() for i in some]
            lead = [len(t) - len(t.lstrip(b"\xff")) for t in texts]
            texts = [t.strip(b"\xff") for t in texts]
            own, lead = doc[some], np.array(lead)
            # every string of a context holds its anchor, so what goes of it is one run
            begin, end = np.full(len(some), span), np.zeros(len(some), np.int64)
            for length, which, offset in maximal_repeats(texts, width):
                later = own[which] > own[which].min()
                which, offset = which[later], offset[later] + lead[which[later]]
                np.minimum.at(begin, which, offset)
                np.maximum.at(end, which, offset + length)
            hit = np.flatnonzero(end)
            times = places[some[hit]]
            every = np.repeat(some[hit] - np.cumsum(times) + times, times) + np.arange(times.sum())
            found_doc.append(doc[every])
            found_at.append(at[every].astype(np.int64) - reach + np.repeat(begin[hit], times))
            found_end.append(at[every].astype(np.int64) - reach + np.repeat(end[hit], times))
        if found_doc:
            yield _settled(buckets, *(np.concatenate(x) for x in (found_doc, found_at, found_end)))

    return match


def cut(data: bytes, spans) -> tuple[bytes, int]:
    """What is left of ``data`` without the (from, to) spans, and how many runs went."""
    kept, last, runs = [], 0, 0
    for start, end in sorted(spans):
        if start > last or not runs:
            kept.append(data[last:start])
            runs += 1
        last = max(last, end)
    kept.append(data[last:])
    return b"".join(kept), runs


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for text, blob in zip(batch["text"], batch["blob"], strict=True):
            data = (text.as_py() or "").encode()
            spans = {*zip(*(a.tolist() for a in _unpack(blob.as_py(), np.uint32, np.uint32)), strict=True)} if blob.is_valid else ()
            kept, runs = cut(data, spans)
            for name, x in zip(out, (len(data), len(data) - len(kept), runs, kept), strict=True):
                out[name].append(x)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary())], ["doc_id", *out])


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) for each row of ``docs`` (doc_id, text)."""
    if not (8 < gram <= 24 and gram <= width):
        raise ValueError("gram must be from 9 to 24 and not above width")
    spark = docs.sparkSession
    texts, n = docs.select("doc_id", "text"), shuffle_width(spark)
    buckets = BUCKETS * n
    places = texts.where("doc_id is not null").mapInArrow(_ship_anchors(width, gram, buckets), SHIPPED).repartition(n, "bucket").mapInArrow(_match_anchors(buckets), SETTLED)
    places = store(places.repartition(n, "bucket").mapInArrow(_gather(1), GATHERED), "places")
    release(spark)
    around = texts.join(places, "doc_id").select("doc_id", "text", "blob").mapInArrow(_ship_contexts(width, gram, buckets), SHIPPED)
    spans = around.repartition(n, "bucket").mapInArrow(_match_contexts(width, gram, buckets), SETTLED)
    spans = store(spans.repartition(n, "bucket").mapInArrow(_gather(2), GATHERED), "spans")
    discard(places)
    release(spark)
    return texts.join(spans, "doc_id", "left").select("doc_id", "text", "blob").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes left."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
