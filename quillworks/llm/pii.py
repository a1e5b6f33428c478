"""Personal data by weak supervision, in DataFrame operations alone.

Patterns give candidate spans. On each, labelers vote for, against or not at all: the format's own checks, a gazetteer
(known endings, issuers, dialling codes, reserved ranges), cue words around, and whether the span stands free. The votes'
patterns, of which there are at most kinds x 3**labelers, are counted over the corpus; expectation-maximisation over these
counts estimates each labeler's reliability and each pattern's probability, spans whose format settles them held at their
verdict. With those as soft targets a logistic span
classifier is trained on votes and on the span's shape, again over counts. Its verdict adds spans of the wider kinds and
phone candidates that failed a check; base spans that pass their checks always stay. Card and ip candidates that failed theirs
never count, whatever the classifier says: a wrong check digit or a part above 255 shows that they are other numbers.

Offsets are code points, ends exclusive. Null and empty texts have no spans. doc_id names a document; repeated rows get the
same spans each. Rows without doc_id are documents of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillworks.llm.common import store, with_own_ids

#: The base patterns, in the order in which spans of one start are listed. Each run starts only where a match
#: can (at its own left edge, or where the last match ended) and never gives back, which changes no match but keeps long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider kinds that the method judges.
WIDER = {
    "at": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?i:token|api[_-]?key|secret|password|passwd|pwd) ?[=:] ?[\"']?[A-Za-z0-9_/+-]{12,}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = [*BASE, *WIDER]
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "at": r"[\[(]at[\])]", "iban": "[A-Z]{2}[0-9]{2}", "local": r"[0-9]{3}[ .-][0-9]{4}", "secret": "[=:]", "ssn": "[0-9]{3}-[0-9]{2}-"}

ENDINGS = "com org net edu gov mil int info biz io eu de fr es it nl be at ch uk us ca au jp cn in br".split()
#: Regular expressions of digits: card issuers, dialling codes, reserved addresses.
ISSUERS = "^(4|5[1-5]|2[2-7]|3[47]|6011|65|30|36|38|35)"
DIALLING = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = r"^(0|127|255)\."
CUES = {
    "email": "mail|contact|write|reach",
    "ip": "ip|addr|host|server|client|login",
    "card": "card|visa|master|credit|pay|konto|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|cell|ruf",
    "at": "mail|contact|write|reach",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "local": "phone|call|tel|mobile|fax|cell",
    "secret": "token|key|secret|pass|pwd",
    "ssn": "ssn|social|security",
}
AGAINST = r"isbn|version|release|page|figure|chapter|order no|invoice|sku|doi"
CONTEXT = 32
ROUNDS = 40


def located(text, pattern: str):
    """Matches as an array of (start, end, match): pieces between them and they themselves give the offsets."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def step(acc, x):
        first = acc["at"] + F.length(x["gap"])
        last = first + F.length(x["match"])
        return F.struct(last.alias("at"), F.concat(acc["out"], F.array(F.struct(first.alias("start"), last.alias("end"), x["match"].alias("match")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end, match and the text before and after, of every match of every pattern."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")
    text = F.col("text")

    def named(kind: str, pattern: str):
        return F.transform(located(text, pattern), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match")))

    found = [F.when(text.rlike(NEEDS[kind]), named(kind, pattern)).otherwise(none) for kind, pattern in (BASE | WIDER).items()]
    spans = docs.select("doc_id", "text", F.explode(F.concat(*found)).alias("span")).select("doc_id", "text", "span.*")
    before = F.expr(f"substring(text, greatest(start - {CONTEXT}, 0) + 1, least(start, {CONTEXT}))")
    after = F.expr(f"substring(text, end + 1, {CONTEXT})")
    return spans.select("doc_id", "kind", "start", "end", "match", before.alias("before"), after.alias("after")).distinct()


def _luhn(digits):
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).try_cast("int") * (1 + F.pmod(n - i, F.lit(2))))
    return F.pmod(F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)), F.lit(10)) == F.lit(0)


def passes() -> F.Column:
    """Whether a span of a base kind meets its own checks; null for wider kinds."""
    digits = F.regexp_replace("match", "[^0-9]", "")
    parts = F.transform(F.split("match", r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).try_cast("int") <= 255))
    kind = F.col("kind")
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small)
        .when(kind == "card", F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", F.length(digits).between(10, 15))
    )


def _vote(yes, no):
    return F.when(no, F.lit(-1)).when(yes, F.lit(1)).otherwise(F.lit(0))


LABELERS = ("format", "gazetteer", "context", "free")


def voted(spans: DataFrame) -> DataFrame:
    """``spans`` with base (passes its checks), a vote of each labeler, and two features of shape."""
    kind, match = F.col("kind"), F.col("match")
    digits = F.regexp_replace("match", "[^0-9]", "")
    ok = passes()
    ending = F.lower(F.regexp_extract("match", r"([A-Za-z]+)$", 1))
    listed = (
        F.when(kind.isin("email", "at"), ending.isin(ENDINGS))
        .when(kind == "ip", ~match.rlike(RESERVED))
        .when(kind == "card", digits.rlike(ISSUERS))
        .when(kind == "phone", digits.rlike(DIALLING))
        .when(kind == "ssn", ~match.rlike("^(000|666|9)"))
        .when(kind == "local", digits.rlike("^[2-9]"))
        .when(kind == "secret", match.rlike("[0-9]") & match.rlike("[a-z]"))
        .otherwise(match.rlike("^(DE|FR|ES|IT|NL|BE|AT|CH|GB)"))
    )
    # a leading 0 may be a trunk prefix, and brackets mark an area code: no vote against these
    unsure = (kind == "local") & match.rlike(r"^[0(]")
    near = F.lower(F.concat("before", F.lit(" "), "after"))
    cue = F.lit(False)
    for k, cues in CUES.items():
        cue = F.when(kind == k, near.rlike(cues)).otherwise(cue)
    tight = F.col("before").rlike("[A-Za-z0-9]$") | F.col("after").rlike("^[A-Za-z0-9]")
    return spans.withColumns(
        {
            "base": F.coalesce(ok, F.lit(False)),
            "format": F.when(ok.isNull(), 0).when(ok, 1).otherwise(-1),
            "gazetteer": _vote(listed, ~listed & ~unsure),
            "context": _vote(cue, near.rlike(AGAINST)),
            "free": _vote(~tight, tight),
            "long": (F.length("match") > 15).cast("int"),
            "mixed": (match.rlike("[0-9]") & match.rlike("[A-Za-z]")).cast("int"),
        }
    )


def known(kind: str, votes: tuple[int, ...]) -> float | None:
    """The verdict on spans whose format settles it: 1 where it passes, 0 for card and ip candidates that fail, else None."""
    if votes[0] > 0:
        return 1.0
    return 0.0 if votes[0] < 0 and kind in ("card", "ip") else None


def reliabilities(counts: list[tuple[str, tuple[int, ...], int]], settled=lambda kind, votes: None):
    """(prior of each kind, per labeler {vote: (P if personal, P if not)}, share of personal spans by kind and votes) by
    expectation-maximisation over counted votes.

    It starts from a majority of votes; a count of one half for each vote keeps probabilities from 0 and 1. A labeler that
    abstains says nothing either way: the chances are of the votes it casts, so that kinds on which it always abstains do not
    stand out. Shares that ``settled`` knows are held.
    """
    share = {(k, v): 1 / (1 + math.exp(-sum(v))) if (s := settled(k, v)) is None else s for k, v, _ in counts}
    prior, tables = {}, []
    for _ in range(ROUNDS):
        tables = []
        for j in range(len(LABELERS)):
            yes, no = dict.fromkeys((-1, 1), 0.5), dict.fromkeys((-1, 1), 0.5)
            for k, v, n in counts:
                if v[j]:
                    yes[v[j]] += n * share[k, v]
                    no[v[j]] += n * (1 - share[k, v])
            tables.append({x: (yes[x] / sum(yes.values()), no[x] / sum(no.values())) for x in yes})
        prior = {}
        for kind in {k for k, _, _ in counts}:
            own = [(v, n) for k, v, n in counts if k == kind]
            prior[kind] = (1 + sum(n * share[kind, v] for v, n in own)) / (2 + sum(n for _, n in own))
        for k, v, _ in counts:
            if settled(k, v) is None:
                odds = math.log(prior[k] / (1 - prior[k])) + sum(math.log(tables[j][x][0] / tables[j][x][1]) for j, x in enumerate(v) if x)
                share[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, tables, share


FEATURES = [f"{name}{sign}" for name in LABELERS for sign in "+-"] + ["long", "mixed"] + KINDS


def _features(kind: str, votes: tuple[int, ...], long: int, mixed: int) -> list[int]:
    return [int(v == s) for v in votes for s in (1, -1)] + [long, mixed] + [int(kind == k) for k in KINDS]


def train(rows: list[tuple[list[int], float, int]], steps: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier for (features, soft target, count) rows, by gradient steps from zero."""
    weights, total = [0.0] * len(FEATURES), sum(n for *_, n in rows) or 1
    for _ in range(steps):
        slope = [ridge * w for w in weights]
        for x, target, n in rows:
            wrong = (1 / (1 + math.exp(-sum(w for w, f in zip(weights, x, strict=True) if f))) - target) * n / total
            for i, f in enumerate(x):
                if f:
                    slope[i] += wrong
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def classifier(spans: DataFrame) -> list[float]:
    """Weights by ``FEATURES``, from the counted votes and shapes of all spans: at most 2,916 rows reach the driver."""
    counted = spans.groupBy("kind", *LABELERS, "long", "mixed").count().collect()
    by_votes: dict = {}
    for r in counted:
        key = (r["kind"], tuple(r[x] for x in LABELERS))
        by_votes[key] = by_votes.get(key, 0) + r["count"]
    _, _, share = reliabilities(sorted((k, v, n) for (k, v), n in by_votes.items()), known)
    rows = [(_features(r["kind"], votes := tuple(r[x] for x in LABELERS), r["long"], r["mixed"]), share[r["kind"], votes], r["count"]) for r in counted]
    return train(sorted(rows))


def personal(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end, base, probability of all spans that count: base ones and those the classifier takes,
    unless these overlap a base span."""
    spans = store(voted(candidates(docs.select("doc_id", "text"))).drop("before", "after"), "spans")
    weights = dict(zip(FEATURES, classifier(spans), strict=True))
    score = sum((F.when(F.col(n) == s, F.lit(weights[f"{n}{x}"])).otherwise(0.0) for n in LABELERS for s, x in ((1, "+"), (-1, "-"))), F.lit(0.0))
    score = score + F.col("long") * weights["long"] + F.col("mixed") * weights["mixed"]
    for k in KINDS:
        score = score + F.when(F.col("kind") == k, F.lit(weights[k])).otherwise(0.0)
    judged = spans.withColumn("probability", 1 / (1 + F.exp(-score))).where("base or probability >= 0.5")
    return judged.where("base or kind not in ('card', 'ip')").select("doc_id", "kind", "start", "end", "base", "probability")


def spans_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of start, rank of kind, kind, end, base, in order) of the documents that have any."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    grouped = personal(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind", "base"))).alias("spans"))
    base = F.filter("spans", lambda x: x["base"])
    free = F.filter("spans", lambda x: x["base"] | ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return grouped.withColumn("base", base).withColumn("spans", free)


def _listed(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans, for each row of ``docs``."""
    return with_own_ids(docs, _report)


def _report(docs: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,base:boolean>>")
    found = docs.select("doc_id").join(spans_of_documents(docs), "doc_id", "left").select("doc_id", F.coalesce("spans", none).alias("spans"), F.coalesce("base", none).alias("base"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and n_chars counted again; other columns as they are."""
    return with_own_ids(docs, _redact)


def _redact(docs: DataFrame) -> DataFrame:
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, x):
        fresh = F.concat(acc["out"], F.substring("text", acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    done = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    found = spans_of_documents(docs).select("doc_id", F.col("spans").alias("__spans"))
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(done)
    out = docs.join(found, "doc_id", "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
