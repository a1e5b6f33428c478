"""N-gram Jaccard join: which documents' sets of word shingles are alike enough.

Shingles are 64-bit hashes (see :mod:`shingles`); equal sets are one node, told by 128 bits. All shingles of all sets are counted,
in buckets of hash ranges; those of one set alone cannot match and go. The order of shingles is that of these counts, the rarest
first, so sets over the threshold share one of the first ``n - need + 1`` of both, where ``need`` is the overlap their two sizes ask
for. Sizes lie in narrow bands, and a tile holds the postings of one shingle and one band of the smaller set's size: a larger set
posts into the tiles of the bands that it can link with, each time as far as that band's sizes ask.

In a tile every set first tries one leader, the set with fewest rarer shingles, in rounds as long as they find much, so
that a large group of near copies takes one pair a member. Then the pairs of sets in different components go on whose shared posting
lies within both prefixes for their very sizes. Pairs are settled by the bit counts of their hashed bitmaps, which bound
the overlap from above, and by intersecting sorted arrays. Rows of one key (a leader's, a label's) are dealt over several tasks.

Null or wordless texts have empty sets, linked with nothing. Texts with fewer words than a shingle form one shingle. Each row is a
document: rows that repeat a doc_id, with the same text or another, get a row each; so does a row without one, whose doc_id and
whose component_id, if it holds no other row, are null. Very long texts are hashed slice by slice; their arrays must fit a task.
An empty table gives an empty one. Of ``docs`` only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillworks.llm.common import discard, few, shuffle_width, spread_join, store, with_own_ids
from quillworks.llm.graph import components
from quillworks.llm.shingles import set_id, shingle_sets

SIGNATURE_BITS = 2048
#: Sets of so many shingles together are dealt to buckets at a time.
BLOCK = 1 << 18
#: Sets that a task remembers, so as to send each but once.
REMEMBERED = 1 << 16
#: A band ends at so many hundredths above its start; small sizes are bands of their own.
BAND_PERCENT = 8
MOST_STARS = 3
#: A bucket's keys are counted in so many parts, by their first bits, one after another.
PARTS = 8
#: Rows of postings or pairs in an Arrow batch.
ROWS = 1 << 16


def bitmap(shingles) -> bytes:
    """One bit for each hash of a shingle."""
    import numpy as np

    marks = np.zeros(SIGNATURE_BITS, bool)
    marks[shingles % np.uint64(SIGNATURE_BITS)] = True
    return np.packbits(marks).tobytes()


def band_starts(most: int = 1 << 31) -> list[int]:
    """The least size of each band."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * (100 + BAND_PERCENT) // 100)))
    return starts


def needed(x, y, percent: int):
    """The least overlap of linked sets of sizes ``x`` and ``y``."""
    return -(-percent * (x + y) // (100 + percent))


def _sets(k: int, seed: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(len(s), *(set_id(s, seed) if len(s) else (None, None))) for s in shingle_sets(batch["text"], k)]
            columns = [*zip(*own, strict=True)] or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n", "set", "check"])

    return sets


DEALT = "home int, bucket int, sets binary, sizes binary, keys binary, counts binary"
DEALT_NAMES = [x.split()[0] for x in DEALT.split(", ")]


def _dealt(homes, buckets, edges, sets, sizes, keys=None, counts=None, places=None) -> pa.RecordBatch:
    """Rows of DEALT: row i has the ``edges[i]:edges[i+1]`` of sets and sizes and the ``places[i]:places[i+1]`` of keys and counts."""
    import numpy as np

    def cut(values, at) -> pa.Array:
        if values is None:
            return pa.nulls(len(homes), pa.binary())
        return pa.Array.from_buffers(pa.binary(), len(homes), [None, pa.py_buffer((np.asarray(at) * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    return pa.RecordBatch.from_arrays([pa.array(homes, pa.int32()), pa.array(buckets, pa.int32()), cut(sets, edges), cut(sizes, edges), cut(keys, places), cut(counts, places)], DEALT_NAMES)


def _deal(k: int, seed: int, bits: int, homes: int):
    """Each set's shingles by bucket (the first ``bits`` bits; the 32 after them are the key), and, for the set's home, its size
    and number of different keys."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        seen: set = set()
        ids, tokens, sizes, held = [], [], [], 0

        def blocks() -> Iterator[pa.RecordBatch]:
            set_ids, n = np.array(ids, np.int64), np.array([len(t) for t in tokens], np.uint32)
            at_home = np.argsort(set_ids.view(np.uint64) % np.uint64(homes), kind="stable")
            of = (set_ids.view(np.uint64) % np.uint64(homes)).astype(np.int32)[at_home]
            firsts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            edges = np.r_[firsts, len(of)]
            yield _dealt(of[firsts], np.full(len(firsts), -1, np.int32), edges, set_ids[at_home], np.array(sizes, np.uint32)[at_home], n[at_home], None, edges)
            token, owner = np.concatenate(tokens), np.repeat(np.arange(len(ids)), n)
            order = np.argsort((token >> np.uint64(32)).astype(np.uint16), kind="stable")
            token, owner = token[order], owner[order]
            bucket = (token >> np.uint64(32)).astype(np.int32)
            run = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])])
            row = np.flatnonzero(np.r_[True, bucket[run][1:] != bucket[run][:-1]])
            lengths = np.diff(np.r_[run, len(token)]).astype(np.uint32)
            yield _dealt(np.full(len(row), -1, np.int32), bucket[run[row]], np.r_[row, len(run)], set_ids[owner[run]], lengths, (token & np.uint64(0xFFFFFFFF)).astype(np.uint32), None, np.r_[run[row], len(token)])

        for batch in batches:
            for own in shingle_sets(batch["text"], k):
                if not len(own) or (both := set_id(own, seed)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(both)
                token = own >> np.uint64(32 - bits)
                ids.append(both[0])
                sizes.append(len(own))
                tokens.append(token[np.r_[True, token[1:] != token[:-1]]])
                held += len(own)
                if held >= BLOCK:
                    yield from blocks()
                    ids, tokens, sizes, held = [], [], [], 0
        if ids:
            yield from blocks()

    return deal


def _by(column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """The rows of each value of ``column``, by which they are sorted."""
    held, now = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row[column] != now and held:
                yield now, held
                held = []
            now = row[column]
            held.append(row)
    if held:
        yield now, held


def _count(homes: int):
    """Counts the keys of each bucket and sends those that occur twice to the homes of their sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def whole(rows: list, column: str, kind):
            return np.concatenate([np.frombuffer(r[column], kind) for r in rows])

        for bucket, rows in _by("bucket", batches):
            if bucket < 0:  # sizes, on their way home
                for r in rows:
                    yield _dealt([r["home"]], [-1], [0, len(r["sets"]) // 8], np.frombuffer(r["sets"], np.int64), np.frombuffer(r["sizes"], np.uint32), np.frombuffer(r["keys"], np.uint32), None, [0, len(r["keys"]) // 4])
                continue
            keys, sets = whole(rows, "keys", np.uint32), whole(rows, "sets", np.int64)
            run_of = np.repeat(np.arange(len(sets), dtype=np.int32), whole(rows, "sizes", np.uint32))
            del rows[:]
            for part in range(PARTS):
                some = np.flatnonzero(keys // np.uint32((1 << 32) // PARTS) == part)
                if len(some):
                    yield from shared(bucket, keys[some], sets[run_of[some]])

    def shared(bucket: int, keys, owner) -> Iterator[pa.RecordBatch]:
        import numpy as np

        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        times = np.diff(np.r_[first, len(keys)])
        times = np.repeat(times, times)
        keys, owner, times = (x[times > 1] for x in (keys, owner, times))
        if not len(keys):
            return
        home = (owner.view(np.uint64) % np.uint64(homes)).astype(np.int32)
        order = np.lexsort((owner, home))
        home, owner, keys, times = home[order], owner[order], keys[order], np.minimum(times[order], 0xFFFFFFFF).astype(np.uint32)
        run = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        row = np.flatnonzero(np.r_[True, home[run][1:] != home[run][:-1]])
        yield _dealt(home[run[row]], np.full(len(row), bucket, np.int32), np.r_[row, len(run)], owner[run], np.diff(np.r_[run, len(keys)]).astype(np.uint32), keys, times, np.r_[run[row], len(keys)])

    return count


#: ``spot`` names a tile: the shingle's bucket and key, then the band. ``place`` is the set's size, the rank of the shingle in it, and
#: whether it can meet sets no smaller there.
POSTINGS = "spot long, set long, place long"
BAND_BITS = 10


def _post(percent: int):
    """The postings of each home's sets."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        starts = np.array(band_starts())
        for _, rows in _by("home", batches):
            heads, parts = ([r for r in rows if (r["bucket"] < 0) == is_head] for is_head in (True, False))
            if not parts:
                continue
            ids, at = np.unique(np.concatenate([np.frombuffer(r["sets"], np.int64) for r in heads]), return_index=True)
            n, keys_of = (np.concatenate([np.frombuffer(r[c], np.uint32) for r in heads]).astype(np.int64)[at] for c in ("sizes", "keys"))
            owner = np.concatenate([np.repeat(np.frombuffer(r["sets"], np.int64), np.frombuffer(r["sizes"], np.uint32)) for r in parts])
            token = np.concatenate([(np.frombuffer(r["keys"], np.uint32).astype(np.int64)) | (r["bucket"] << 32) for r in parts])
            times = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in parts])
            order = np.lexsort((token, times, owner))
            owner, token = owner[order], token[order]
            new = np.r_[True, (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])]  # equal sets come from several tasks
            owner, token = np.searchsorted(ids, owner[new]), token[new]
            shared = np.bincount(owner, minlength=len(ids))
            own = keys_of - shared
            rank = own[owner] + np.arange(len(owner)) - np.r_[0, np.cumsum(shared)][owner]
            band = np.searchsorted(starts, n, "right") - 1
            least = np.maximum(-(-percent * n // 100), 1)
            within = n - needed(n, n, percent)  # the last rank at which a set meets one no smaller
            some = np.flatnonzero(own <= n - least)  # others share too little with all sets
            down = 0
            while len(some):
                tile = band[some] - down
                reached = (tile >= 0) & (starts[tile + 1] - 1 >= least[some])
                some, tile = some[reached], tile[reached]
                last, tile_of = np.full(len(ids), -1), np.zeros(len(ids), np.int64)
                last[some] = n[some] - needed(n[some], np.maximum(starts[tile], least[some]), percent)
                tile_of[some] = tile
                i = np.flatnonzero(rank <= last[owner])
                for cut in (i[j : j + ROWS] for j in range(0, len(i), ROWS)):
                    o = owner[cut]
                    small = (rank[cut] <= within[o]) if down == 0 else np.zeros(len(cut), bool)
                    columns = (token[cut] << BAND_BITS | tile_of[o], ids[o], n[o] << 32 | rank[cut] << 1 | small)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in POSTINGS.split(", ")])
                down += 1

    return post


def _arrays(k: int, seed: int):
    """The sets that are wanted (rows of doc_id, wanted, text), with bitmap and array."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                found = [(wanted, len(own), bitmap(own), own.tobytes()) for wanted, own in zip(part["wanted"].to_pylist(), shingle_sets(part["text"], k), strict=True) if len(own) and set_id(own, seed)[0] == wanted]
                columns = [*zip(*found, strict=True)] or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["set", "n", "bits", "shingles"])

    return arrays


@F.arrow_udf(T.LongType())
def _overlap(left: pa.Array, right: pa.Array) -> pa.Array:
    import numpy as np

    def common(a: bytes, b: bytes) -> int:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        at = np.searchsorted(y, x)
        return int((y[np.minimum(at, len(y) - 1)] == x).sum())

    return pa.array([common(a.as_py(), b.as_py()) for a, b in zip(left, right, strict=True)], pa.int64())


@F.arrow_udf(T.LongType())
def _apart(left: pa.Array, right: pa.Array) -> pa.Array:
    """Bits in which two bitmaps differ."""
    import numpy as np

    width = SIGNATURE_BITS // 8
    x, y = (np.frombuffer(b"".join(v.as_py() for v in side), np.uint64).reshape(-1, width // 8) for side in (left, right))
    return pa.array(np.bitwise_count(x ^ y).sum(1).astype(np.int64))


def verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: bitmaps first, then sorted arrays."""

    def with_both(of: DataFrame, *columns: str) -> DataFrame:
        for side, other in ("ab", "ba"):
            of = spread_join(of, arrays.select(F.col("set").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side, by=other)
        return of

    close = store(with_both(pairs, "n", "bits").where((100 + percent) * (F.col("n_a") + F.col("n_b") - _apart("bits_a", "bits_b")) >= 2 * percent * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "close")
    exact = with_both(close, "n", "shingles").withColumn("common", _overlap("shingles_a", "shingles_b"))
    links = store(exact.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b"), "links")
    discard(close)
    return links


def linked_sets(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that links reach, for each row of ``docs`` (doc_id, text)."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    named = with_own_ids(docs.select("doc_id", "text"), lambda named: _linked(named, k, percent), "component_id")
    return named.select("doc_id", "n_shingles", "component_id")


def _linked(docs: DataFrame, k: int, percent: int, seed: int = 0) -> DataFrame:
    width = shuffle_width(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    sets = store(texts.mapInArrow(_sets(k, seed), "doc_id long, n long, set long, check long"), "sets")
    reps = store(sets.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), (F.min("check") != F.max("check")).alias("clash")), "reps")
    if not reps.where("clash").isEmpty():  # two sets with the same 64 bits: told apart by other hashes
        discard(sets, reps)
        return _linked(docs, k, percent, seed + 1)

    # A bucket a task at most, as a power of two, and a home a task: what is sent grows with the shingles, not with buckets times homes.
    bits, homes = min(max(1, width.bit_length() - 1), 16), width
    dealt = texts.mapInArrow(_deal(k, seed, bits, homes), DEALT)
    to_bucket = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.col("home"))
    counted = dealt.repartition(width, to_bucket).sortWithinPartitions("bucket").mapInArrow(_count(homes), DEALT)
    posted = store(counted.repartition(width, "home").sortWithinPartitions("home").mapInArrow(_post(percent), POSTINGS), "postings")
    tiles = posted.groupBy("spot").agg(F.count("*").alias("count"), F.min("set").alias("low"), F.max("set").alias("high"), F.bool_or(F.col("place") % 2 == 1).alias("met"))
    tiles = store(tiles.where("met and low < high").select("spot", "count"), "tiles")
    met = spread_join(posted, tiles.select("spot"), "spot", by="set", counts=tiles)
    shared = store(met.select("spot", "set", F.expr("cast(place >> 32 as int)").alias("n"), F.expr("cast((place & 4294967295) >> 1 as int)").alias("rank"), (F.col("place") % 2 == 1).alias("small")), "shared")
    discard(posted)

    wanted = store(shared.select("set").distinct().join(reps, "set").select(F.col("set").alias("wanted"), F.col("rep").alias("doc_id")), "wanted")
    found = texts.join(few(wanted), "doc_id").select("doc_id", "wanted", "text").mapInArrow(_arrays(k, seed), "set long, n long, bits binary, shingles binary")
    arrays = store(found.dropDuplicates(["set"]), "arrays")
    discard(wanted)

    labels, links = None, []
    for turn in range(MOST_STARS):
        mine = _labelled(shared, labels)
        first = F.struct(F.col("rank"), F.xxhash64("set", F.lit(turn)), F.col("set"), F.col("label"))
        leaders = mine.groupBy("spot").agg(F.min(first).alias("top"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        leaders = leaders.select("spot", F.col("top.set").alias("leader"), F.col("top.label").alias("its"))
        tried = spread_join(mine, leaders, "spot", by="set", counts=tiles).where("label != its")
        best = tried.groupBy("set", "leader").agg(F.count("*").alias("times")).groupBy(F.col("set").alias("a")).agg(F.max_by("leader", F.struct("times", "leader")).alias("b"))
        pairs = store(best, "pairs")
        links.append(verified(pairs, arrays, percent))
        n_tried, n_found = pairs.count(), links[-1].count()
        discard(pairs)
        if n_found:
            discard(*([] if labels is None else [labels]))
            labels = components(_all(links))
        if 10 * n_found < n_tried or not n_found:
            break

    # What is left: sets of different components whose shared posting lies within both prefixes.
    mine = _labelled(shared, labels)
    mixed = mine.groupBy("spot").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("spot")
    mine = spread_join(mine, mixed, "spot", by="set", counts=tiles)
    sides = [mine.select("spot", "small", *(F.col(c).alias(f"{c}_{x}") for c in ("set", "n", "rank", "label"))) for x in "ab"]
    need = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}")
    fits = (F.col("label_a") != F.col("label_b")) & F.expr(f"(n_a < n_b or n_a = n_b and set_a < set_b) and 100 * n_a >= {percent} * n_b") & (F.col("rank_a") <= F.col("n_a") - need) & (F.col("rank_b") <= F.col("n_b") - need)
    left, right = sides[0].where("small").drop("small"), sides[1].drop("small").withColumnRenamed("spot", "spot_b")
    last = left.join(right, (F.col("spot") == F.col("spot_b")) & fits)
    pairs = store(last.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")).distinct(), "pairs")
    links.append(verified(pairs, arrays, percent))
    if links[-1].count() or labels is None:
        discard(*([] if labels is None else [labels]))
        labels = components(_all(links))
    discard(pairs, shared, tiles, arrays, *links)

    # Each set's component; a set of one document without links needs no row.
    placed = store(labels.join(reps, labels.node == reps.set).select("node", "label", "rep"), "placed")
    least = placed.groupBy("label").agg(F.min("rep").alias("component_id"))
    linked = spread_join(placed.select("node", "label"), least, "label", by="node").select(F.col("node").alias("set"), "component_id")
    alone = reps.where("copies > 1").join(labels, F.col("set") == F.col("node"), "left_anti").select("set", F.col("rep").alias("component_id"))
    components_of = store(linked.unionByName(alone), "components")
    discard(placed, labels, reps)
    out = spread_join(sets.select("doc_id", F.col("n").alias("n_shingles"), "set"), components_of, "set", by="doc_id", how="left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``postings`` with the label of each set, its own id where it has none."""
    if labels is None:
        return postings.withColumn("label", F.col("set"))
    return postings.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group of linked documents, with its own columns: that of the least doc_id. Rows without doc_id
    are documents of their own, after all others: one stays if it links to none before it. Of rows that repeat a doc_id the one
    whose text comes first stays, if any may."""

    def least(named: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        linked = store(linked_sets(named, k, percent), "linked")
        gone = store(linked.where("doc_id != component_id").select("doc_id").distinct(), "gone")
        kept = named.join(few(gone), "doc_id", "left_anti")
        again = store(linked.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
        discard(linked)
        if again.isEmpty():
            return kept
        first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
        rank = "_rank"
        while rank in named.columns:
            rank += "_"
        once = kept.join(few(again), "doc_id", "left_semi").withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
        return kept.join(few(again), "doc_id", "left_anti").unionByName(once)

    return with_own_ids(docs, least)
