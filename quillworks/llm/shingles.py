"""Word shingles of whole texts as 64-bit hashes, in vectorised passes over Arrow buffers.

A-Z are lower-cased; words are runs of anything but blanks (space, \\t to \\r). A text's set is that of its runs of ``k`` words; with
fewer words the whole sequence is one shingle, without words the set is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: So many bytes are hashed at a time.
SLICE = 1 << 18
#: Longer words are hashed by themselves: a polynomial modulo a power of two is no good hash of very long words.
LONG_WORD = 64

BASE, MIX = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

_tables: dict = {}


def _letters():
    """Per byte: a random 64-bit coefficient (the same for either case of A-Z), and whether it is no blank."""
    import numpy as np

    if "letters" not in _tables:
        drawn = np.random.default_rng(20_071).integers(0, MASK, 256, np.uint64, endpoint=True)
        folded, solid = np.arange(256), np.ones(256, bool)
        folded[65:91] += 32
        solid[[9, 10, 11, 12, 13, 32]] = False
        _tables["letters"] = drawn[folded], solid
    return _tables["letters"]


def _powers(n: int):
    """Powers of BASE and of its inverse, ``n`` at least."""
    import numpy as np

    if len(_tables.get("powers", ((),))[0]) < n:
        size = max(n, 1 << 16)
        rows = []
        for step in (BASE, pow(BASE, -1, 1 << 64)):
            row = np.full(size, step, np.uint64)
            row[0] = 1
            rows.append(np.multiply.accumulate(row))
        _tables["powers"] = tuple(rows)
    return _tables["powers"]


def _word_codes(data, starts, ends):
    """Codes of the words of ``data`` (bytes) and how many of them each document has; documents are data[starts[i]:ends[i]], end to end."""
    import numpy as np
    import xxhash

    letters, solid = _letters()
    inside = solid[data]
    open_, close = inside.copy(), inside.copy()
    open_[1:] &= ~inside[:-1]
    close[:-1] &= ~inside[1:]
    some = ends > starts
    open_[starts[some]] = inside[starts[some]]
    close[ends[some] - 1] = inside[ends[some] - 1]
    first, last = np.flatnonzero(open_), np.flatnonzero(close) + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * up[: len(data)], out=sums[1:])
    codes = (sums[last] - sums[first]) * down[first] if len(first) else np.empty(0, np.uint64)
    for i in np.flatnonzero(last - first > LONG_WORD):
        codes[i] = xxhash.xxh3_64_intdigest(data[first[i] : last[i]].tobytes().lower())
    codes ^= codes >> np.uint64(29)
    codes *= np.uint64(MIX)
    codes ^= codes >> np.uint64(32)
    return codes, np.searchsorted(first, ends) - np.searchsorted(first, starts)


def _long_codes(data):
    """Codes of the words of one long document, slice by slice."""
    import numpy as np
    import xxhash

    _, solid = _letters()
    found, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        if end < len(data):
            blanks = np.flatnonzero(~solid[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:  # a word of more than a slice
                while end < len(data) and solid[data[end]]:
                    ahead = np.flatnonzero(~solid[data[end : end + SLICE]])
                    end = end + int(ahead[0]) if len(ahead) else min(end + SLICE, len(data))
                code = np.array([xxhash.xxh3_64_intdigest(data[at:end].tobytes().lower())], np.uint64)
                code ^= code >> np.uint64(29)
                code *= np.uint64(MIX)
                found.append(code ^ (code >> np.uint64(32)))
                at = end
                continue
        found.append(_word_codes(data[at:end], np.array([0]), np.array([end - at]))[0])
        at = end
    return np.concatenate(found)


def _mixed(codes, k: int):
    """A code of every ``k`` words in a row."""
    import numpy as np

    n = max(len(codes) - k + 1, 0)
    mixed = np.full(n, k, np.uint64)
    for i in range(k):
        mixed = (mixed ^ codes[i : i + n]) * np.uint64(MIX)
        mixed ^= mixed >> np.uint64(32)
    return mixed * np.uint64(BASE)


def _sorted_set(codes):
    import numpy as np

    codes = np.sort(codes)
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    return codes[new]


def shingle_sets(texts: pa.Array, k: int) -> Iterator:
    """The sorted distinct shingles of each text, as arrays of uint64; null and wordless texts have none."""
    import numpy as np

    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        part = data[offsets[at] : offsets[end]]
        edges = offsets[at : end + 1] - offsets[at]
        if len(part) > SLICE:
            codes, counts = (own := _long_codes(part)), np.array([len(own)])
        else:
            codes, counts = _word_codes(part, edges[:-1], edges[1:])
        rows, begin = _mixed(codes, k), 0
        for n in counts.tolist():
            if n >= k:
                yield _sorted_set(rows[begin : begin + n - k + 1])
            else:
                yield _mixed(codes[begin : begin + n], n) if n else np.empty(0, np.uint64)
            begin += n
        at = end


def set_id(shingles, seed: int = 0) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    import xxhash

    code = xxhash.xxh3_128_intdigest(shingles.tobytes(), seed)
    return (code >> 64) - (1 << 63), (code & MASK) - (1 << 63)
