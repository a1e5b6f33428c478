"""Plain versions of the corpus operators."""

from __future__ import annotations

import collections
import hashlib
import re
import string
import zlib

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def components(docs, k=4, percent=85):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((top(a), top(b)))
                    parent[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def without_repeats(docs, width=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha of what is left)}"""
    first, out = {}, {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for j in range(len(data) - width + 1):
            if first.setdefault(data[j : j + width], i) < i:
                gone[j : j + width] = b"\1" * width
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(data), sum(gone), spans, sha(bytes(c for c, g in zip(data, gone, strict=True) if not g)))
    return out


def contamination(docs, items, span=10):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    windows = collections.defaultdict(set)
    for i, text in items:
        w = words(text)
        for s in range(max(1, len(w) - span + 1) if w else 0):
            windows[tuple(w[s : s + span])].add(str(i))
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[x]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    """((start, rank, kind, end), ...) in order."""
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]
            if good():
                found.append((m.start(), rank, kind, m.end()))
    return sorted(found)


def measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    split = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, repeated = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    places = collections.defaultdict(list)
    for s in range(len(split) - 4):
        places[tuple(split[s : s + 5])].append(s)
    covered = {s + j for found in places.values() if len(found) > 1 for s in found for j in range(5)}
    return len(split), sum(map(len, split)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def licenses(text):
    """(n_words, n_base, first, last, labels)"""
    w, starts, labels = words(text), [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        for i in range(len(w) - len(parts) + 1):
            if w[i : i + len(parts)] == parts:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def crc(text):
    return zlib.crc32((text or "").encode())


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]
