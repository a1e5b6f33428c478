"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from quillworks.llm import license_scan
from quillworks.llm.quality_rules import HOST_RATE, PRIOR_DOCUMENTS
from quillworks.llm.revisits import REVISIT_AFTER, TRACKING

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TEXT = "coalesce(text, '')"

LINKS = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate({TEXT}, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(w) - 3) END)) AS i FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT t.b, r.label FROM r JOIN t ON r.node = t.a)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.label AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(label) AS label FROM r GROUP BY 1) c USING (doc_id)"""

REPEATS = f"""WITH d AS (SELECT doc_id, hex(encode({TEXT})) AS h, strlen({TEXT}) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g),
c AS (SELECT DISTINCT doc_id, i FROM w JOIN f USING (g) WHERE m < doc_id),
o AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM c),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM o),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM s),
j AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN j USING (doc_id)"""

_WORDS = rf"regexp_extract_all(translate({TEXT}, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, array_to_string(w[i + 1:i + 10], ' ') AS g, least(10, len(w)) AS n FROM (SELECT item_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(w) - 9) END)) AS i FROM b)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM v))),
h AS (SELECT DISTINCT doc_id, item_id, i, p.n AS n FROM p JOIN v USING (g, n)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""

_TRACKED = ", ".join(f"'{x}'" for x in TRACKING)
REVISITS = rf"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '(?s)#.*$', '') AS bare, md5(coalesce(html, '')) AS etag, strlen(coalesce(html, '')) AS size FROM pages),
v AS (SELECT *, regexp_replace(bare, '(?s)\?.*$', '') AS place, array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '(?s)\?(.*)$', 1), '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN ({_TRACKED}))), '&') AS query FROM u),
k AS (SELECT *, lower(regexp_replace(regexp_extract(place, '^[^/]*'), ':(80|443)$', '')) || regexp_replace(regexp_extract(place, '(?s)^[^/]*(.*)$', 1), '(\.html?|/)$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM v),
a AS (SELECT r.page_id, max(s.page_id) AS of FROM k r JOIN k s ON s.canonical = r.canonical AND s.page_id < r.page_id + {REVISIT_AFTER} GROUP BY 1)
SELECT 2 * k.page_id + 1 AS record_id, k.canonical, CASE WHEN o.page_id IS NULL THEN 'missing' WHEN o.etag = k.etag THEN 'resolved' ELSE 'mismatch' END AS status, CASE WHEN o.etag = k.etag THEN 2 * o.page_id END AS resolved_id,
  CASE WHEN o.etag = k.etag THEN 'age=0;content-length=' || o.size || ';date=' || (k.page_id + {REVISIT_AFTER}) || ';etag=' || o.etag END AS headers
FROM k LEFT JOIN a ON a.page_id = k.page_id LEFT JOIN k o ON o.page_id = a.of"""


_PHRASES = ", ".join(f"('{k}', {len(k.split())}, '{v}')" for k, v in license_scan.PHRASES.items())
_TEMPLATES = ", ".join(f"('{k}', '{license_scan.label_of(k)}', {license_scan.block_words(t)}, '{b" ".join(license_scan.words(t)).decode()}')" for k, t in license_scan.TEMPLATES.items())

LICENSES = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(DISTINCT label) AS own
  FROM p, (VALUES {_PHRASES}) x(phrase, n, label) WHERE i + n <= len(w) AND array_to_string(w[i + 1:i + n], ' ') = phrase GROUP BY 1),
t AS (SELECT name, label, size, list_distinct(string_split(text, ' ')) AS terms FROM (VALUES {_TEMPLATES}) y(name, label, size, text)),
m AS (SELECT name, label, size, len(terms) AS n, unnest(terms) AS term FROM t),
h AS (SELECT doc_id, name, label, size, n, term, i FROM (SELECT doc_id, i, w[i + 1] AS term FROM p) JOIN m USING (term)),
k AS (SELECT doc_id, name FROM h GROUP BY 1, 2, n HAVING 100 * count(DISTINCT term) >= {license_scan.PERCENT} * n),
c AS (SELECT a.doc_id, a.name, a.label, a.i, a.n, count(DISTINCT z.term) AS held FROM h a JOIN k USING (doc_id, name) JOIN h z ON z.doc_id = a.doc_id AND z.name = a.name AND z.i BETWEEN a.i AND a.i + a.size - 1 GROUP BY ALL),
f AS (SELECT doc_id, list(DISTINCT label) AS more, max(held / n) AS best FROM c WHERE 100 * held >= {license_scan.PERCENT} * n GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)"""


def _rates(rule: str) -> str:
    low, high = PRIOR_DOCUMENTS
    strength = f"CASE WHEN v_{rule} > 0 THEN least(greatest(m_{rule} * (1 - m_{rule}) / v_{rule} - 1, {low}), {high}) ELSE {high} END"
    return f"(n_{rule} + m_{rule} * ({strength})) / (n_docs + ({strength}))"


_RULES = {"base": "base_failed", "symbols": "10 * n_symbols > word_chars", "lines": "10 * n_dup_lines > 3 * n_lines"}

QUALITY = rf"""WITH d AS (SELECT doc_id, source, {TEXT} AS t, regexp_extract_all({TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
i AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 0))) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS x FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM i) WHERE times > 1) GROUP BY 1),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM l LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n_docs, {", ".join(f"count(*) FILTER ({c}) AS n_{k}" for k, c in _RULES.items())} FROM b GROUP BY 1),
q AS (SELECT {", ".join(f"avg(n_{k} / n_docs) AS m_{k}, var_pop(n_{k} / n_docs) AS v_{k}" for k in _RULES)} FROM h),
f AS (SELECT source, greatest({", ".join(_rates(k) for k in _RULES)}) > {HOST_RATE} AS host_failed FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept FROM b JOIN f ON b.source IS NOT DISTINCT FROM f.source"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": LINKS, "op3_suffix_dedup": REPEATS, "op4_license_scan": LICENSES, "op6_decontamination": CONTAMINATION, "op7_revisits": REVISITS, "op10_quality_rules": QUALITY}
