"""License scans by exact set-similarity join.

Words are runs of digits, letters a-z (A-Z lower-cased) and anything outside ASCII. Three base phrases are found wherever
their words stand one after another. Beyond them, each template is a set of words, and a text block is any run of as many words as the
template has, and ``SLACK`` hundredths more: wherever it starts, however long the template. A block matches if it holds ``PERCENT``
of the template's different words or more; short templates must so stand nearly as they are.

Template words are ordered by how many documents of the whole corpus hold them, the rarest first. A block needs ``ceil(PERCENT |T|)``
of them, so it must hold one of the first ``|T| - need + 1``: the prefix filter, by which only the surroundings of such words are
looked at. Texts of fewer words than needed go by the length filter, and surroundings whose first shared word stands so far back that
those behind it cannot suffice by the positional filter. What is left is settled by a window that slides over the places of
the template's words.

The templates are parameters and few: their index goes to every task. Null and empty texts have no words and no labels; texts of any
length are scanned whole, in time that grows with their words. Each row is judged by itself, so repeated rows, and rows without doc_id,
get figures of their own. Of ``docs`` only doc_id and text are read. An empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Well-known sentences of public licences and notices.
TEMPLATES = {
    "apache": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution international license to view a copy of this license visit",
    "copyright": "copyright all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "mit-notice": "released under the mit license",
    "mpl": "this source code form is subject to the terms of the mozilla public license if a copy of the mpl was not distributed with this file you can obtain one at",
    "apache-notice": "licensed under the apache license version 2.0",
    "cc-by-nc-notice": "licensed under cc by nc 4.0",
    "gpl-notice": "licensed under the gnu general public license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
    "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
    "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-text": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
    "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear "
    "in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to "
    "anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a "
    "compiled binary for any purpose commercial or non commercial and by any means",
}
#: Endings of template names that are not part of the label.
KINDS = ("-notice", "-text")

PERCENT, SLACK = 90, 20
MOST_TEMPLATES = 10_000

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def label_of(template: str) -> str:
    for kind in KINDS:
        template = template.removesuffix(kind)
    return template


def block_words(template: str, slack: int = SLACK) -> int:
    """Words in a block of a template."""
    return -(-len(words(template)) * (100 + slack) // 100)


def phrase_places(text_words: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """(word index, label) of each place of each phrase."""
    found = []
    for phrase, label in phrases.items():
        parts = phrase.split()
        rare, at = parts[0], -1
        for _ in range(text_words.count(rare)):
            at = text_words.index(rare, at + 1)
            if text_words[at : at + len(parts)] == parts:
                found.append((at, label))
    return found


class TemplateIndex:
    """Templates by the rarest of their words."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], percent: int = PERCENT, slack: int = SLACK) -> None:
        self.rank, self.need, self.size, self.prefixes = {}, {}, {}, {}
        for name, text in templates.items():
            ordered = sorted(set(words(text)), key=lambda w: (counts.get(w, 0), w))
            if not ordered:
                continue
            self.rank[name] = {w: i for i, w in enumerate(ordered)}
            self.need[name] = need = -(-percent * len(ordered) // 100)
            self.size[name] = block_words(text, slack)
            for w in ordered[: len(ordered) - need + 1]:
                self.prefixes.setdefault(w, set()).add(name)

    def blocks(self, text_words: list[bytes]) -> Iterator[tuple[str, int, int, float]]:
        """(template, start, end, containment) of the best block of each run of matching blocks that overlap: its first and, past it,
        its last word among the template's."""
        places: dict[str, list[int]] = {}
        for w in self.prefixes.keys() & set(text_words):
            at = [i for i, x in enumerate(text_words) if x == w]
            for name in self.prefixes[w]:
                if len(text_words) >= self.need[name]:
                    places.setdefault(name, []).extend(at)
        for name, starts in places.items():
            for low, high in _stretches(sorted(starts), self.size[name], len(text_words)):
                yield from self._slide(name, text_words, low, high)

    def _slide(self, name: str, text_words: list[bytes], low: int, high: int) -> Iterator[tuple[str, int, int, float]]:
        rank, need, size = self.rank[name], self.need[name], self.size[name]
        hits = [(i, text_words[i]) for i in range(low, high) if text_words[i] in rank]
        known = {w for _, w in hits}
        if len(known) < need or len(rank) - min(rank[w] for w in known) < need:
            return
        held: Counter = Counter()
        first, best = 0, None
        for at, w in hits:
            held[w] += 1
            while hits[first][0] <= at - size:
                gone = hits[first][1]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                first += 1
            if len(held) >= need:
                own = (len(held), hits[first][0], at + 1)
                if best is not None and own[1] >= best[2]:
                    yield name, best[1], best[2], best[0] / len(rank)
                    best = None
                if best is None or own[0] > best[0]:
                    best = own
        if best is not None:
            yield name, best[1], best[2], best[0] / len(rank)

    def scan(self, text_words: list[bytes]) -> dict[str, float]:
        """Each matching template's best containment over all blocks."""
        best: dict[str, float] = {}
        for name, _, _, share in self.blocks(text_words):
            best[name] = max(share, best.get(name, 0.0))
        return best


def _stretches(places: list[int], size: int, n: int) -> Iterator[tuple[int, int]]:
    """The parts of a text, from and to, whose blocks of ``size`` words can hold one of the places; parts that meet are one."""
    low = high = None
    for p in places:
        if high is not None and p - size + 1 <= high:
            high = min(n, p + size)
            continue
        if high is not None:
            yield low, high
        low, high = max(0, p - size + 1), min(n, p + size)
    if high is not None:
        yield low, high


def template_counts(docs: DataFrame, templates: dict[str, str]) -> dict[bytes, int]:
    """How many documents hold each word of the templates: no more rows than the templates have words."""
    wanted = frozenset(w for t in templates.values() for w in words(t))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                total.update(wanted.intersection(words(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.binary()), pa.array([*total.values()], pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


def matching_blocks(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, template, first_word, end_word (past the last) and containment of the best block of every run of matching blocks that overlap."""
    index = _indexed(docs, templates)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, *b) for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True) for b in index.blocks(words(text.as_py()))]
            columns = [*zip(*rows, strict=True)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "template", "first_word", "end_word", "containment"])

    return docs.select("doc_id", "text").mapInArrow(found, "doc_id long, template string, first_word long, end_word long, containment double")


def _indexed(docs: DataFrame, templates: dict[str, str] | None) -> TemplateIndex:
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return TemplateIndex(templates, template_counts(docs, templates))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (base and templates'; a notice has its licence's) and score, the best containment (1 with a base phrase), for each row of ``docs`` (doc_id, text)."""
    index = _indexed(docs, templates)
    base = {k.encode(): v for k, v in (PHRASES if phrases is None else phrases).items()}
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                split = words(text.as_py())
                places = phrase_places(split, base)
                found = index.scan(split)
                own = {name for _, name in places}
                starts = [at for at, _ in places]
                more = {label_of(name) for name in found}
                rows.append((len(split), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | more)), 1.0 if places else max(found.values(), default=0.0)))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, [*schema][1:], strict=True))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(label, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
