"""DuckDB SQL for the registered queries."""

from __future__ import annotations

import re

from quillworks.functions import private, quality
from quillworks.functions.text import ALNUM, SPACE, TRANSITIONS, WORD
from quillworks.operators import duplicates, formats
from quillworks.plans.recipes import RECIPES, Recipe

LINE = r"[\x09-\x0D\x1C-\x20]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{SPACE}]+|[{SPACE}]+\z', '', 'g')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(pattern)}))"


def words(x: str) -> str:
    return count(x, f"[^{SPACE}]+")


def sentences(x: str, k: int) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '[.!?]+'), lambda s: {strip('s')}), lambda s: length(s) > {k})"


def normalized(t: str) -> str:
    t = rf"regexp_replace({t}, '\r\n|\r', chr(10), 'g')"
    t = rf"regexp_replace({t}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}\x{{AD}}]', '', 'g')"
    t = rf"regexp_replace({t}, '[ \t]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    lines = rf"list_filter(list_transform(string_split({t}, chr(10)), lambda x: {strip('x')}), lambda x: NOT regexp_matches(x, '\A\p{{Nd}}+\z'))"
    return strip(f"array_to_string({lines}, chr(10))")


DENSITY = rf"CASE WHEN {count('t', f'[^{SPACE}]')} > 0 THEN {count('t', ALNUM)} / {count('t', f'[^{SPACE}]')} ELSE 0.0 END"
BLANK = rf"len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\A[{SPACE}]*\z'))) / len(string_split(t, chr(10)))"
AVG_SENTENCE = f"CASE WHEN len(s5) > 0 THEN list_sum(list_transform(s5, lambda s: {words('s')})) / len(s5) ELSE 0.0 END"
DIVERSITY = "CASE WHEN len(lw) > 0 THEN len(list_distinct(lw)) / len(lw) ELSE 0.0 END"
STRUCTURE = (
    rf"least(0.0::DOUBLE + CASE WHEN regexp_matches(t, '(?m)^#{{1,6}}{LINE}') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(t, '(?m)^[*-]{LINE}') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END"
    rf" + CASE WHEN regexp_matches(t, '(?m)^[0-9]+\.{LINE}') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(t, '(?i)chapter|section|part|introduction|conclusion|summary') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE)"
)
FLESCH = f"CASE WHEN len(s2) > 0 AND len(lw) > 0 THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * (len(lw) / len(s2)) - 84.6::DOUBLE * (list_sum(list_transform(lw, lambda w: greatest(1, {count('w', '[aeiouy]+')}))) / len(lw)))) / 100 ELSE 0.5::DOUBLE END"
KNOWN = " + ".join(f"CASE WHEN contains(lower(t), {quoted(p)}) THEN 1 ELSE 0 END" for p in TRANSITIONS)
VARIANCE = "((len(w5) * list_sum(list_transform(w5, lambda x: (x * x)::DOUBLE)) - list_sum(w5)::DOUBLE * list_sum(w5)::DOUBLE) / (len(w5) * len(w5)))"
NATURAL = (
    f"CASE WHEN len(s5) < 4 THEN 0.7::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.4::DOUBLE * least(CASE WHEN {VARIANCE} > 0 THEN sqrt({VARIANCE}) ELSE 1.0::DOUBLE END / 8, 1.0::DOUBLE)"
    f" + 0.3::DOUBLE * greatest(0.0::DOUBLE, 1 - ({KNOWN}) / 8) + 0.3::DOUBLE * (len(list_distinct(list_transform(s5, lambda s: lower(regexp_extract(s, '[^{SPACE}]+'))))) / len(s5)))) END"
)

#: Texts with what several metrics share: sentences over 2, 5 and 10 characters, words, sentence lengths, bits a character.
BASE = f"""
WITH d0 AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
letters AS (SELECT doc_id, c, count(*) AS k FROM (SELECT doc_id, unnest(string_split(lower(t), '')) AS c FROM d0) WHERE c <> '' GROUP BY ALL),
bits AS (SELECT doc_id, -sum((k / n) * log2(k / n)) AS e FROM letters JOIN (SELECT doc_id, length(t) AS n FROM d0) USING (doc_id) GROUP BY doc_id),
d1 AS (SELECT d0.*, coalesce(e, 0.0::DOUBLE) AS e, {sentences('t', 2)} AS s2, {sentences('t', 5)} AS s5, {sentences('t', 10)} AS s10, regexp_extract_all(lower(t), '{WORD}') AS lw FROM d0 LEFT JOIN bits USING (doc_id)),
d2 AS (SELECT *, list_transform(s5, lambda s: {words('s')}) AS w5, list_transform(s10, lambda s: {words('s')}) AS w10 FROM d1),
m AS (SELECT doc_id, source, t, e, length(t) AS n, s10, w10, {DENSITY} AS density, {BLANK} AS blank, {AVG_SENTENCE} AS a, {DIVERSITY} AS diversity, {STRUCTURE} AS structure, {FLESCH} AS flesch, {NATURAL} AS natur,
  {count('t', r'[\x20-\x7E\n]')} AS printable FROM d2)
"""


def dimensions(r: Recipe) -> str:
    q = "(len(w10) * list_sum(list_transform(w10, lambda x: (x * x)::DOUBLE)) - list_sum(w10)::DOUBLE * list_sum(w10)::DOUBLE)"
    exact = {
        "completeness": "least(len(s10) / 8, 1.0::DOUBLE)",
        "clarity": "CASE WHEN a BETWEEN 8 AND 35 THEN 1 - abs(a - 20) / 30 ELSE 0.0::DOUBLE END",
        "coherence": f"CASE WHEN len(s10) >= 3 THEN greatest(0.0::DOUBLE, 1 - sqrt(greatest(0.0::DOUBLE, {q}) / (len(w10) * len(w10))) / 20) ELSE 0.5::DOUBLE END",
        "density": "least(density / 0.7::DOUBLE, 1.0::DOUBLE)",
        "structure": "structure",
        "length": f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN n < 500 THEN {f'(n - {r.min_chars}) / {500 - r.min_chars}' if r.min_chars != 500 else '1.0'} WHEN n <= 4000 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (n - 4000) / {r.max_chars}) END))",
        "formatting": "1 - (n - printable) / greatest(printable, 1)",
        "uniqueness": "0.5::DOUBLE * diversity + 0.5::DOUBLE * least(e / 7, 1.0::DOUBLE)",
        "readability": "flesch",
        "naturalness": "natur",
    }
    return ", ".join(f"floor(({x}) * 10 * 10 + 0.5::DOUBLE) / 10 AS q_{k}" for k, x in exact.items())


def scored(r: Recipe) -> str:
    """Adds g (gate), the dims, score and reason to the metrics."""
    total = "0.0::DOUBLE" + "".join(f" + q_{k} * {w}::DOUBLE" for k, w in quality.WEIGHTS.items())
    return f"""{BASE},
g AS (SELECT *, CASE WHEN NOT n BETWEEN {r.min_chars} AND {r.max_chars} THEN 'length' WHEN density < {quality.FIRST_DENSITY} THEN 'low_density' WHEN blank > {quality.MOST_BLANKS} THEN 'high_blanks' END AS gate FROM m),
q AS (SELECT *, {dimensions(r)} FROM g),
sc AS (SELECT *, CASE WHEN gate IS NULL THEN floor(({total}) * 100 + 0.5::DOUBLE) / 100 ELSE 0.0::DOUBLE END AS score FROM q),
scored AS (SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN e < {r.entropy} THEN 'low_entropy' WHEN density < {r.min_density} THEN 'low_density' WHEN score < {r.quality} THEN 'below_threshold' END AS reason FROM sc)
"""


def metric(name: str, column: str) -> str:
    return f"{BASE} SELECT doc_id, floor(({column}) * 10000 + 0.5::DOUBLE) / 10000 AS {name} FROM m"


BALANCED = scored(RECIPES["balanced"])


def mean(which: str = "") -> str:
    """Mean score, from a sum of whole hundredths."""
    return f"floor(sum(round(score * 100)::BIGINT){which} / count(score){which} / 100 * 10000 + 0.5::DOUBLE) / 10000"


def occurrences(marks: list[str]) -> str:
    return " + ".join(f"(length(l) - length(replace(l, {quoted(k)}, ''))) // {len(k)}" for k in marks)


def _content_type() -> str:
    speech = count("l", "[\"'][^\\n]*?[\"']") + " + " + occurrences(quality.SPEECH_MARKS) + " + " + count("l", "(?m)^[\"']")
    listed = count("l", rf"(?m)^[-*0-9]\.{LINE}") + " + " + count("l", r"\|[^\n]*\|")
    return f"""CASE WHEN ({occurrences(quality.CODE_MARKS)}) / w > 0.02 THEN 'code' WHEN ({speech}) / w > 0.03 THEN 'dialogue'
  WHEN ({occurrences(quality.TECHNICAL_MARKS)}) / w > 0.01 THEN 'technical' WHEN ({listed}) > greatest(3.0, 0.05 * w) THEN 'reference' ELSE 'narrative' END"""


TYPED = f"""WITH l AS (SELECT *, lower(coalesce(text, '')) AS l FROM documents), l2 AS (SELECT *, greatest({words('l')}, 1) AS w FROM l),
typed AS (SELECT doc_id, source, coalesce(text, '') AS text, {_content_type()} AS content_type, greatest(1, length(coalesce(text, '')) // 4) AS est_tokens FROM l2)
"""


def found(kind: str) -> str:
    return f"list_slice(regexp_extract_all(coalesce(text, ''), {quoted(private.PATTERNS[kind])}), 1, 5)"


def masked() -> str:
    t = "coalesce(text, '')"
    for kind, pattern in private.PATTERNS.items():
        t = f"regexp_replace({t}, {quoted(pattern)}, '[{kind.upper()}_REDACTED]', 'g')"
    return t


def _template(fmt: str) -> str:
    return " || ".join("'Chapter ' || doc_id" if part == "%1$s" else "source" if part == "%2$s" else quoted(part) for part in re.split(r"(%[12]\$s)", fmt) if part)


TEMPLATE = "CASE (('0x' || right(md5(source), 1))::INT) % 4 " + " ".join(f"WHEN {i} THEN {_template(t)}" for i, t in enumerate(formats.TEMPLATES)) + " END"
INPUT = "'Context: ' || source || ' — Chapter: Chapter ' || doc_id"

MERGED = """WITH o AS (SELECT source, doc_id, coalesce(text, '') AS text, lang, CASE WHEN row_number() OVER w = 1 OR length(coalesce(text, '')) >= 500 THEN 1 ELSE 0 END AS opens FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS island FROM o),
g AS (SELECT source, min(doc_id) AS chapter_index, string_agg('Chapter ' || doc_id, ' + ' ORDER BY doc_id) AS chapter_title, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text, arg_min(lang, doc_id) AS lang FROM i GROUP BY source, island)
SELECT source, chapter_index, chapter_title, md5(text) AS text_md5, length(text) AS n, lang FROM g"""

WINDOWS = f"""WITH c AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
k AS (SELECT doc_id, t, n, unnest(range(0, CASE WHEN n <= 2000 THEN 1 ELSE (n - 2000) // 1800 + 2 END)) AS i FROM c),
x AS (SELECT doc_id, i, CASE WHEN n <= 2000 THEN t ELSE substr(t, i * 1800 + 1, 2000) END AS chunk, n FROM k)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, md5(chunk) AS chunk_md5 FROM x WHERE n <= 2000 OR length({strip('chunk')}) > 0"""

PACKED = """WITH RECURSIVE r AS (SELECT coalesce(text, '') AS t, length(coalesce(text, '')) // 4 + 3 AS cost, row_number() OVER (ORDER BY doc_id, text) AS i FROM documents),
f AS (SELECT i, cost AS used, i - 1 AS p FROM r WHERE i = 1
  UNION ALL SELECT r.i, CASE WHEN f.used + r.cost > 2048 THEN r.cost ELSE f.used + r.cost END, CASE WHEN f.used + r.cost > 2048 THEN r.i - 1 ELSE f.p END FROM f JOIN r ON r.i = f.i + 1)
SELECT f.p::BIGINT AS pack_start, count(*) AS packed_count, sum(cost)::BIGINT AS packed_tokens, md5(trim(string_agg('<|begin|>' || chr(10) || t || chr(10) || '<|end|>' || chr(10), '' ORDER BY f.i), chr(10) || ' ')) AS response_md5
FROM f JOIN r USING (i) GROUP BY f.p"""

#: Chunks of paragraphs: z holds, run by run, the sums of their lengths; w walks from chunk to chunk.
SEMANTIC = f"""WITH RECURSIVE d AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS t FROM documents),
p AS (SELECT doc_id, {strip('x')} AS x, i FROM (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS x, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS i FROM d WHERE length(t) > 2000)),
q AS (SELECT doc_id, x, length(x) > 2000 AS large, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM p WHERE x <> ''),
o AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, large ORDER BY i) AS run FROM q),
z AS (SELECT *, list_transform(range(0, len(xs) + 1), lambda k: coalesce(list_sum(list_transform(xs[1:k], lambda x: length(x) + 2)), 0)::BIGINT) AS ends
  FROM (SELECT doc_id, min(i) AS pos, list(x ORDER BY i) AS xs FROM o WHERE NOT large GROUP BY doc_id, run)),
w AS (SELECT doc_id, pos, xs, ends, 0::BIGINT AS no, 0::BIGINT AS lead, greatest(1, len(list_filter(ends, lambda e: e <= 2002)) - 1)::BIGINT AS stop, 0::BIGINT AS start FROM z
  UNION ALL SELECT doc_id, pos, xs, ends, no + 1, own, greatest(stop + 1, len(list_filter(ends, lambda e: e <= 2002 + ends[stop + 1] - CASE WHEN own < stop THEN ends[stop + 1] - ends[own + 1] - 2 ELSE -2 END)) - 1)::BIGINT, stop
  FROM (SELECT *, CASE WHEN head < stop AND ends[stop + 1] - ends[head + 1] + length(xs[stop + 1]) > 2000 THEN stop ELSE head END AS own
    FROM (SELECT *, CASE WHEN ends[start + 1] >= ends[stop + 1] - 202 THEN CASE WHEN ends[lead + 1] >= ends[stop + 1] - 202 THEN lead ELSE start END
      ELSE start + len(list_filter(ends[start + 1:stop], lambda e: e < ends[stop + 1] - 202)) END AS head FROM w WHERE stop < len(xs)))),
k AS (SELECT doc_id, pos, no, array_to_string(xs[lead + 1:stop], chr(10) || chr(10)) AS c FROM w
  UNION ALL SELECT doc_id, i, k, substr(x, k * 1800 + 1, 2000) FROM (SELECT doc_id, i, x, unnest(range(0, (length(x) - 2000) // 1800 + 2)) AS k FROM o WHERE large)
  UNION ALL SELECT doc_id, 0, 0, t FROM d WHERE length(t) <= 2000)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, no) - 1 AS chunk_no, md5(c) AS chunk_md5 FROM k WHERE pos = 0 OR length({strip('c')}) > 0"""

STRIPPED = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g')"
for _tag in ("aside", "footer", "header", "nav", "script", "style"):
    STRIPPED = rf"regexp_replace({STRIPPED}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', '', 'g')"

CHAT = """'system:You are a knowledgeable assistant trained on ' || source || '.|user:Explain the key concepts from "Chapter ' || doc_id || '" in ' || source || '.|assistant:' || text"""


def near(measure: str, threshold: float = 0.85) -> str:
    """Tables kept as the strict leader rule leaves them: walk has one row, with the last list of rows that went."""
    code = " + ".join(f"u[i + {j}] * {w}" for j, w in enumerate(duplicates.weights()))
    values = ", ".join(f"({s}, {a}, {b})" for s, (a, b) in enumerate(duplicates.functions()))
    rows = duplicates.HASHES // duplicates.BANDS
    like = "len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))" if measure == "sigset" else f"len(list_filter(list_zip(a, b), lambda z: z[1] = z[2])) / {duplicates.HASHES}"
    return f"""WITH RECURSIVE c AS (SELECT doc_id, list_transform(string_split(t, ''), lambda c: unicode(c)::BIGINT) AS u FROM (SELECT doc_id, {strip("lower(coalesce(text, ''))")} AS t FROM documents) WHERE length(t) >= {duplicates.GRAM}),
g AS (SELECT DISTINCT doc_id, ({code}) % {duplicates.PRIME} AS x FROM (SELECT doc_id, u, unnest(range(1, len(u) - {duplicates.GRAM - 2})) AS i FROM c)),
f(s, slope, shift) AS (VALUES {values}),
v AS (SELECT doc_id, s, min((slope * x + shift) % {duplicates.PRIME}) AS v FROM g, f GROUP BY 1, 2),
sets AS (SELECT doc_id, list(v ORDER BY s) AS sig FROM v GROUP BY 1),
band AS (SELECT doc_id, b, list_slice(sig, b * {rows} + 1, b * {rows} + {rows}) AS k FROM sets, range({duplicates.BANDS}) r(b)),
cand AS (SELECT DISTINCT x.doc_id AS early, y.doc_id AS late FROM band x JOIN band y ON x.b = y.b AND x.k = y.k AND x.doc_id < y.doc_id),
sim AS (SELECT early, late FROM (SELECT early, late, p.sig AS a, q.sig AS b FROM cand JOIN sets p ON p.doc_id = early JOIN sets q ON q.doc_id = late) WHERE {like} >= {threshold}),
seq AS (SELECT late, list(early ORDER BY early) AS earlies, row_number() OVER (ORDER BY late) AS i FROM sim GROUP BY late),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone, []::BIGINT[] AS of
  UNION ALL SELECT seq.i, CASE WHEN len(held) > 0 THEN list_append(gone, late) ELSE gone END, CASE WHEN len(held) > 0 THEN list_append(of, held[1]) ELSE of END
  FROM (SELECT walk.i AS was, gone, of, seq.*, list_filter(earlies, lambda e: NOT list_contains(gone, e)) AS held FROM walk JOIN seq ON seq.i = walk.i + 1) seq),
last AS (SELECT gone, of FROM walk ORDER BY i DESC LIMIT 1)"""


def oracle_sql() -> dict[str, str]:
    out = {
        "density": metric("density", "density"),
        "blank_ratio": metric("blank_ratio", "blank"),
        "avg_sentence_len": metric("avg_sentence_len", "a"),
        "lexical_diversity": metric("lexical_diversity", "diversity"),
        "structure": metric("structure", "structure"),
        "flesch": metric("flesch", "flesch"),
        "entropy": metric("entropy", "e"),
        "naturalness": metric("naturalness", "natur"),
        "normalize_native": f"SELECT doc_id, md5(x) AS text_md5, length(x) AS n FROM (SELECT doc_id, {normalized(chr(39) * 2 + ' || coalesce(text, ' + chr(39) * 2 + ')')} AS x FROM documents)",
        "token_count": "SELECT doc_id, greatest(1, length(coalesce(text, '')) // 4) AS est_tokens FROM documents",
        "entropy_filter": f"{BASE} SELECT doc_id FROM m WHERE e >= 3.0",
        "quality_dims": f"{BALANCED} SELECT doc_id, {', '.join(f'q_{k} AS {k}' for k in quality.WEIGHTS)} FROM scored WHERE gate IS NULL",
        "quality_score": f"{BALANCED} SELECT doc_id, score, coalesce(gate, '') AS gate FROM scored",
        "reject_histogram": f"{BALANCED} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM scored GROUP BY 1",
        "classify": f"{TYPED} SELECT doc_id, content_type FROM typed",
        "domain_hist": f"{TYPED} SELECT content_type, count(*) AS n, floor(sum(est_tokens) / count(est_tokens) * 10000 + 0.5::DOUBLE) / 10000 AS avg_tokens FROM typed GROUP BY 1",
        "front_matter": f"""WITH f AS (SELECT doc_id, lower({strip("string_split(coalesce(text, ''), chr(10))[1]")}) AS title, {strip("coalesce(text, '')")} AS body FROM documents)
SELECT doc_id, regexp_matches(title, {quoted(quality.FRONT_MATTER)}) OR (length(body) < 150 AND length(title) > 0 AND regexp_matches(lower(string_split(body, chr(10))[1]), {quoted(quality.FRONT_MATTER)})) AS front_matter FROM f""",
        "pii_detect": f"SELECT * FROM (SELECT doc_id, {', '.join(f'array_to_string({found(k)}, {quoted(chr(124))}) AS {k}' for k in private.PATTERNS)} FROM documents) WHERE {' || '.join(private.PATTERNS)} <> ''",
        "pii_redact": f"SELECT doc_id, md5({masked()}) AS text_md5 FROM documents",
        "pii_totals": " UNION ALL ".join(f"SELECT '{k}' AS kind, sum(len({found(k)}))::BIGINT AS total FROM documents HAVING sum(len({found(k)})) > 0" for k in private.PATTERNS),
        "keep_first": "SELECT min(url) AS url FROM pages GROUP BY lower(string_split(url, '/')[-1])",
        "merge_short": MERGED,
        "chunk_windows": WINDOWS,
        "chunk_semantic": SEMANTIC,
        "exact_dedup": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY coalesce(text, '')",
        "merge_distinct": "SELECT min(doc_id) AS doc_id, lang, source FROM documents GROUP BY lang, source, text, n_chars",
        "shingle_count": f"WITH s AS (SELECT doc_id, {strip('lower(coalesce(text, chr(32)))')} AS t FROM documents), g AS (SELECT doc_id, substr(t, i::INT, 6) AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(length(t) - 4, 1))) AS i FROM s)) SELECT s.doc_id, count(DISTINCT g) AS n_shingles FROM s LEFT JOIN g USING (doc_id) GROUP BY 1",
        "near_dup_keep": f"{near('sigset')} SELECT doc_id FROM documents WHERE NOT list_contains((SELECT gone FROM last), doc_id)",
        "near_dup_pairs": f"{near('slots')} SELECT unnest(gone) AS ord, unnest(of) AS of FROM last",
        "contam_phrase": "SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(coalesce(text, '')), {quoted(p.lower())}) THEN {quoted(p[:40])}" for p in quality.BENCHMARK_PHRASES) + " END AS phrase FROM documents",
        "contam_table": "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) WHERE b.text <> ''",
        "contam_sha": "WITH f AS (SELECT 'bench' AS bench, text FROM benchmark UNION ALL SELECT 'held', text FROM documents WHERE source = 'src3') SELECT doc_id, min(bench) AS bench FROM documents JOIN f USING (text) GROUP BY doc_id",
        "fmt_instruction": f"{TYPED} SELECT {TEMPLATE} AS instruction, {INPUT} AS input, md5(text) AS response_md5, source, 'Chapter ' || doc_id AS chapter, doc_id AS chapter_index, 'general_knowledge' AS domain, content_type, 5.0::DOUBLE AS quality_score, est_tokens FROM typed",
        "fmt_completion": f"{TYPED} SELECT 'Read and learn from the following passage from \"Chapter ' || doc_id || '\" in ' || source || '.' || chr(10) || chr(10) AS prompt, md5(text) AS completion_md5, doc_id AS chapter_index, content_type, est_tokens FROM typed",
        "fmt_chat": f"{TYPED} SELECT md5({CHAT}) AS messages_md5, doc_id AS chapter_index, est_tokens FROM typed",
        "conversation_chat": "SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || text, '|' ORDER BY turn, role, text)) AS messages_md5 FROM conversations GROUP BY conv_id",
        "pack": PACKED,
        "shard": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // ((SELECT count(*) FROM documents) // 7 + 1) AS shard FROM documents",
        "export_pretrain": "SELECT md5(text) AS text_md5, CASE WHEN row_number() OVER (ORDER BY doc_id) > (SELECT count(*) - (count(*) + 19) // 20 FROM documents) THEN 'validation' ELSE 'train' END AS split FROM documents",
        "export_sft": f"{TYPED} SELECT md5('user:' || {TEMPLATE} || chr(10) || {INPUT} || '|assistant:' || text) AS messages_md5 FROM typed",
        "html_strip_regex": f"SELECT page_id, md5({normalized(f'regexp_replace({STRIPPED}, {quoted("(?s)<[^>]*>")}, chr(10), {quoted("g")})')}) AS text_md5 FROM pages",
        "validate_hist": f"{scored(Recipe(min_chars=100, max_chars=99_999))} SELECT least(floor(score), 9)::BIGINT AS bin, count(*) AS n FROM scored GROUP BY 1",
        "source_quality": f"{BALANCED} SELECT source, count(*) AS n, {mean()} AS avg_quality FROM scored WHERE reason IS NULL GROUP BY 1",
        "report": f"{BALANCED} SELECT count(*) AS n, count(*) FILTER (reason IS NULL) AS kept, sum(greatest(1, n // 4)) FILTER (reason IS NULL)::BIGINT AS tokens, {mean(' FILTER (reason IS NULL)')} AS avg_quality, max(score) FILTER (reason IS NULL) AS best, min(score) FILTER (reason IS NULL) AS worst FROM scored",
        "score_by_label": f"{BALANCED} SELECT quality::BIGINT AS quality, count(*) AS n, {mean()} AS avg_score FROM scored JOIN labels USING (doc_id) GROUP BY 1",
        "table_stats": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS docs, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM {t}" for t in ("documents", "benchmark", "conversations")),
    }
    for name, r in RECIPES.items():
        out[f"recipe_{name}"] = f"{scored(r)} SELECT doc_id, score FROM scored WHERE reason IS NULL"
    return out
