"""Order-dependent operators, duplicates, formats, books, sinks, streams."""

import json
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillworks.operators import contamination, duplicates, formats, order
from quillworks.plans import build as plan
from quillworks.plans.recipes import Recipe
from quillworks.sources import epub, epub_writer, html, sinks
from quillworks.streaming import files as streams

PROSE = "The old house stood on a hill above the town. Nobody had lived in it for many years. Children told each other stories about it. On winter nights a light could be seen in its highest window. "


def test_merge_short(spark):
    long = "x" * 500
    data = [("a", 1, "A", "s1"), ("a", 2, "B", "s2"), ("a", 3, "C", long), ("a", 4, "D", "s3"), ("b", 1, "E", "s4"), ("b", 2, "F", None)]
    out = order.merge_short(spark.createDataFrame(data, "source string, chapter_index int, chapter_title string, text string"))
    assert {(r.source, r.chapter_index, r.chapter_title, r.text) for r in out.collect()} == {("a", 1, "A + B", "s1\n\ns2"), ("a", 3, "C + D", long + "\n\ns3"), ("b", 1, "E + F", "s4\n\n")}


def plain_windows(text, size, overlap):
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        piece = text[start : start + size]
        if piece.strip():
            out.append(piece)
        start = start + size - overlap if len(piece) == size else len(text)
    return out


@pytest.mark.parametrize(("n", "size", "overlap"), [(0, 10, 3), (10, 10, 3), (11, 10, 3), (17, 10, 3), (24, 10, 3), (30, 10, 0), (31, 10, 0), (100, 10, 9)])
def test_windows(spark, n, size, overlap):
    text = "".join(chr(97 + i % 26) for i in range(n))
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(order.windows("text", size, overlap)).first()[0] == plain_windows(text, size, overlap)
    if n > size:
        assert order.semantic_pieces(text, size, overlap) == plain_windows(text, size, overlap)


def test_windows_need_progress():
    with pytest.raises(ValueError):
        order.windows("text", 10, 10)
    with pytest.raises(ValueError):
        order.semantic_chunks("text", 10, 12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", min_size=0, max_size=30), max_size=12), st.integers(0, 9))
def test_semantic_pieces(paragraphs, overlap):
    text = "\n\n".join(paragraphs)
    pieces = order.semantic_pieces(text, 20, overlap)
    if len(text) > 20:
        assert all(len(p) <= 22 for p in pieces)  # the last separator is not counted
    else:
        assert pieces == [text]


def test_pack(spark):
    texts = ["a" * 40, "b" * 40, "c" * 400, "d" * 8]
    out = order.pack(spark.createDataFrame([*enumerate(texts)], "i long, response string"), "i", most=30).orderBy("pack_start").collect()
    assert [(r.packed_count, r.packed_tokens) for r in out] == [(2, 26), (1, 103), (1, 5)]
    assert out[0].response == "<|begin|>\n" + "a" * 40 + "\n<|end|>\n<|begin|>\n" + "b" * 40 + "\n<|end|>"
    assert order.pack(spark.createDataFrame([], "i long, response string"), "i").count() == 0


@pytest.mark.parametrize(("n", "k", "made"), [(6, 4, 3), (10, 3, 3), (2, 5, 1), (0, 3, 0)])
def test_contiguous_shards(spark, n, k, made):
    out = order.contiguous_shards(spark.range(n).select((F.col("id") * 3000).alias("i")), "i", k).orderBy("i").collect()
    shards = [r.shard for r in out]
    assert len(set(shards)) == made and shards == sorted(shards)


def test_exact_and_names(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None), (5, "")], "i long, text string")
    assert {r.i for r in duplicates.exact(df, "i").collect()} == {1, 2, 4}
    files = spark.createDataFrame([("/b/A.epub",), ("/a/a.epub",), ("/c/d.epub",)], "path string")
    assert {r.path for r in duplicates.name_dedup(files).collect()} == {"/a/a.epub", "/c/d.epub"}
    merged = duplicates.merge([spark.createDataFrame([(1, "x")], "i long, a string"), spark.createDataFrame([(2, "x", None), (3, "x", "z")], "i long, a string, b string")], "i")
    assert {r.i for r in merged.collect()} == {1, 3}


def leader(sigs, threshold, bands=16):
    """The rule by brute force."""
    rows = 128 // bands
    kept, gone = [], {}
    for i in sorted(sigs):
        for j in kept:
            if any(sigs[i][b * rows : (b + 1) * rows] == sigs[j][b * rows : (b + 1) * rows] for b in range(bands)):
                a, b = set(sigs[i]), set(sigs[j])
                if len(a & b) / len(a | b) >= threshold:
                    gone[i] = j
                    break
        else:
            kept.append(i)
    return gone


def test_near_duplicates(spark, monkeypatch):
    import random

    rng = random.Random(5)
    words = ["w" + str(i) for i in range(60)]
    base = [" ".join(rng.choices(words, k=150)) for _ in range(4)]
    texts = []
    for i in range(60):
        w = base[i % 4].split()
        for _ in range(rng.choice([0, 0, 1, 2, 12])):
            w[rng.randrange(len(w))] = "n" + str(rng.randrange(1000))
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame([*texts, (100, None), (101, "abc")], "i long, text string")
    sigs = {r.i: r.s for r in df.select("i", duplicates.signature("text").alias("s")).collect() if r.s}
    want = set(leader(sigs, 0.6))
    assert want
    for rounds in (1, 3):
        monkeypatch.setattr(duplicates, "LEADER_ROUNDS", rounds)
        assert {r.ord for r in duplicates.near_duplicates(df, "i", threshold=0.6).collect()} == want


def test_contamination(spark):
    docs = spark.createDataFrame([(1, "say The Quick brown fox jumps now"), (2, "quick brown"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "quick Brown fox"), (2, "brown"), (3, ""), (4, None)], "item_id long, text string")
    assert {tuple(r) for r in contamination.contained(docs, items).collect()} == {(1, 1), (1, 2), (2, 2)}
    known = docs.select(F.lit("b").alias("bench"), F.sha2("text", 256).alias("fp")).where("fp is not null").limit(1)
    assert duplicates.without_fingerprints(docs, known).count() == 2


def chunks(spark):
    return spark.createDataFrame([("Book", 1, "One", "text", "narrative", 7.5, 1)], "source string, chapter_index int, chapter_title string, text string, content_type string, quality double, est_tokens long")


def test_formats(spark):
    r = formats.instruction(chunks(spark)).first()
    assert "One" in r.instruction and r.input == "Context: Book — Chapter: One" and r.provenance.chunk_index == 1 and "###" not in r.instruction
    assert formats.completion(chunks(spark)).first().prompt.startswith('Read and learn from the following passage from "One" in Book.')
    assert [m.role for m in formats.chat(chunks(spark)).first().messages] == ["system", "user", "assistant"]
    rows = spark.range(41).select(F.col("id").alias("i"), F.col("id").cast("string").alias("response"))
    assert formats.pretrain(rows, "i").where("split = 'validation'").count() == 3
    assert formats.pretrain(rows, "i", disjoint=False).count() == 44


def test_html():
    page = "<html><head><style>p{}</style></head><body><nav>menu</nav><p>One <b>two</b></p><ul><li>a</li><li>b<ul><li>c</li></ul></li></ul><script>x</script></body></html>"
    lines = [x.strip() for x in html.text_nodes(page).split("\n")]
    assert [x for x in lines if x] == ["One", "two", "* a", "* b", "- c"]
    assert html.text_nodes("<p>unclosed <b>tags &amp; text") .split() == ["unclosed", "tags", "&", "text"]


def books(spark, tmp_path):
    chapters = [("Title Page", "<html><body><p>A title</p></body></html>"), ("Copyright", "<p>(c)</p>"), ("Real Content", f"<html><head><title>t</title></head><body><h1>Real</h1><p>{PROSE * 3}</p></body></html>")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.epub").write_bytes(epub_writer.book("Book", chapters, author="A. Writer", rights="CC0", date="2020-05-06T07:08"))
    (tmp_path / "sub" / "ONE.epub").write_bytes(epub_writer.book("Copy", chapters))
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    return epub.files(spark, str(tmp_path))


def test_epub(spark, tmp_path):
    found = books(spark, tmp_path)
    assert found.count() == 2
    rows = epub.chapters(found).collect()
    assert [(r.chapter_index, r.chapter_title) for r in rows] == [(3, "Real Content")] and len(rows[0].file_hash) == 16
    assert epub.chapters(found, include_front_matter=True).count() == 3
    assert epub.parsed(found).where("error is not null").count() == 1
    meta = {r.source: r for r in epub.metadata(found).collect()}
    assert meta["bad.epub"].author == ""
    assert any((m.author, m.license, m.pub_date) == ("A. Writer", "CC0", "2020-05-06") or m.author == "" for m in meta.values())


def test_build(spark, tmp_path):
    text = "\n\n".join(PROSE + str(i) for i in range(8))
    data = [("b", i, f"C{i}", text if i < 2 else text.replace("house", f"castle{i}")[: 900 + i], "h") for i in range(4)]
    chapters = spark.createDataFrame(data, "source string, chapter_index int, chapter_title string, text string, file_hash string")
    options = plan.Options(Recipe(min_chars=100, quality=1.0, similarity=0.85), redact=True)
    built = plan.build(chapters, options)
    assert built.funnel["chunks"] == 4 and built.funnel["unique"] <= 3
    assert json.loads(plan.report(built, options).first()[0])["funnel"] == built.funnel
    assert plan.build(chapters, plan.Options(Recipe(min_chars=100), lightweight=True, style="chat", pack=500)).examples.count()
    assert plan.quality_table(built.scored).columns[:2] == ["source", "chapter"]


def test_build_of_high_chapter_numbers(spark):
    other = "Rain fell on the harbour all week long. Sailors mended nets beside the cold stone wall. A brown dog slept under an upturned boat. At noon the bells rang over the empty market square. "
    data = [("b", 0, PROSE * 4), ("b", 2_500, other * 4), ("a", 2_048, (other + PROSE) * 60), ("a", 2**31 - 1, PROSE * 4)]
    chapters = spark.createDataFrame([(s, i, f"C{i}", t, "h") for s, i, t in data], "source string, chapter_index int, chapter_title string, text string, file_hash string")
    built = plan.build(chapters.repartition(3), plan.Options(Recipe(min_chars=100, max_chars=4000, quality=0.0)))
    rows = sorted((r.source, r.chapter_index, r.chunk_no, r.ord) for r in built.scored.collect())
    assert len(rows) > 6 and [r[3] for r in rows] == sorted({r[3] for r in rows})
    assert {("a", 2**31 - 1), ("b", 2_500)} <= {(r.source, r.chapter_index) for r in built.examples.collect()}
    assert built.examples.where("source = 'b' and chapter_index = 0").isEmpty()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", 2.5, True, ["x"]), (2, None, 0.5, False, [])], "a long, b string, c double, d boolean, e array<string>").coalesce(1)
    for kind in sinks.FORMATS:
        sinks.write(df, str(tmp_path / kind), kind)
    assert sinks.read_jsonl(spark, str(tmp_path / "jsonl")).count() == 2
    body = "".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*")))
    assert [r["a"] for r in json.loads(body)] == [1, 2]
    import pyarrow as pa

    tables = [pa.ipc.open_file(p).read_all() for p in (tmp_path / "arrow").glob("*.arrow")]
    assert sum(t.num_rows for t in tables) == 2 and "e" not in tables[0].column_names
    data = b"".join(p.read_bytes() for p in (tmp_path / "tfrecord").glob("*.tfrecord"))
    at, n = 0, 0
    while at < len(data):
        size = struct.unpack("<Q", data[at : at + 8])[0]
        assert struct.unpack("<I", data[at + 8 : at + 12])[0] == sinks.masked_crc(data[at : at + 8])
        assert struct.unpack("<I", data[at + 12 + size : at + 16 + size])[0] == sinks.masked_crc(data[at + 12 : at + 12 + size])
        at, n = at + 16 + size, n + 1
    assert n == 2 and sinks.format_of("x.parquet") == "parquet" and sinks.file_name("a b (c).epub") == "a_b_c"


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(i, PROSE * 4 + str(i % 2), f"2024-01-01 00:00:{i:02d}") for i in range(6)], "doc_id long, text string, at string").selectExpr("doc_id", "text", "cast(at as timestamp) at").write.parquet(str(src))
    docs = streams.document_stream(spark, str(src), "doc_id long, text string, at timestamp")
    for name, df, n in (("scored", streams.scored_stream(docs, Recipe(quality=1.0)), 6), ("firsts", streams.first_seen(docs, "at"), 2)):
        q = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == n


def test_near_duplicate_recall(spark):
    """Pairs of exact Jaccard 0.9 and more that some kept row answers for, against all pairs."""
    import random

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(400)]
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=200)
        for edits in (0, 1, 2, 3):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    df = spark.createDataFrame([*enumerate(texts)], "i long, text string")
    grams = [{t[i : i + 6] for i in range(len(t) - 5)} for t in texts]
    pairs = {(a, b) for b in range(len(texts)) for a in range(b) if len(grams[a] & grams[b]) >= 0.9 * len(grams[a] | grams[b])}
    found = {r.ord: r.of for r in duplicates.near_duplicates(df, "i", threshold=0.85, measure="slots").collect()}
    assert len(pairs) > 100 and sum(b in found for _, b in pairs) >= 0.9 * len(pairs)
    assert all(len(grams[a] & grams[b]) >= 0.7 * len(grams[a] | grams[b]) for b, a in found.items())
    assert {r.ord for r in duplicates.near_duplicates(df, "i", threshold=0.85, measure="slots", name=False).collect()} == {*found}


@pytest.mark.parametrize("block", [16, 30, 4096])
def test_pack_does_not_depend_on_blocks(spark, block):
    import random

    rng = random.Random(3)
    texts = ["x" * rng.choice([0, 3, 40, 90, 400]) for _ in range(300)]
    packs, used = [], None
    for i, t in enumerate(texts):
        cost = len(t) // 4 + 3
        if used is None or used + cost > 45:
            packs.append([i, 0])
            used = 0
        packs[-1][1] += 1
        used += cost
    df = spark.createDataFrame([(i * 7 + 5, t) for i, t in enumerate(texts)], "i long, response string").repartition(5)
    out = order.pack(df, "i", most=45, block=block).orderBy("pack_start").collect()
    assert [[r.pack_start, r.packed_count] for r in out] == packs


def test_merge_short_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(order, "BLOCK", 4)
    rows = [(s, i, f"T{i}", "x" * (600 if (i * 7 + len(s)) % 5 == 0 else 3)) for s in ("a", "bb", "ccc") for i in range(1, 40)] + [(None, 3, "N", "y"), (None, 9, "M", None)]
    want = {}
    for s, i, t, x in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        last = want.setdefault(s, [])
        if last and len(x or "") < 500:
            last[-1] = (last[-1][0], f"{last[-1][1]} + {t}", f"{last[-1][2]}\n\n{x or ''}")
        else:
            last.append((i, t, x or ""))
    out = order.merge_short(spark.createDataFrame(rows, "source string, chapter_index int, chapter_title string, text string")).collect()
    assert {(r.source, r.chapter_index, r.chapter_title, r.text) for r in out} == {(s, *v) for s, vs in want.items() for v in vs}


def test_sinks_by_and_mode(spark, tmp_path):
    import pyarrow as pa

    df = spark.createDataFrame([("a b", 1, "x"), ("a b", 2, "y"), (None, 3, "z")], "k string, n long, t string").repartition(3)
    for kind in ("arrow", "tfrecord"):
        out = tmp_path / kind
        sinks.write(df, str(out), kind, by=["k"])
        assert sorted(p.name for p in out.iterdir() if p.is_dir()) == ["k=__HIVE_DEFAULT_PARTITION__", "k=a b"]
        with pytest.raises(FileExistsError):
            sinks.write(df, str(out), kind)
        sinks.write(df, str(out), kind, mode="ignore")
        sinks.write(df.limit(1), str(out), kind, mode="overwrite")
        assert len([*out.rglob(f"*.{kind}")]) == 1
    one = next((tmp_path / "arrow").rglob("*.arrow"))
    assert pa.ipc.open_file(one).schema.names == ["k", "n", "t"]
    with pytest.raises(ValueError):
        sinks.write(df, str(tmp_path / "json"), "json", by=["k"])


def test_checksum():
    assert sinks.masked_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_sql_functions(spark):
    from quillworks.functions.register import register

    assert "quill_chunks" in register(spark)
    row = spark.sql("select quill_nfkc('ﬁ') a, quill_token_estimate('abcdefgh') b, quill_masked_email('to a@b.org now') c, trim(quill_html_text('<p>x</p>')) d").first()
    assert tuple(row) == ("fi", 2, "to [EMAIL_REDACTED] now", "x")
    assert [r.chunk for r in spark.sql("select * from quill_chunks(repeat('ab', 9), 10, 2)").collect()] == [("ab" * 9)[0:10], ("ab" * 9)[8:18], ("ab" * 9)[16:18]]


def test_tokens_need_their_vocabulary(spark):
    from quillworks.functions import tokens

    df = spark.createDataFrame([("hello there, world",)], "text string")
    assert df.select(tokens.precise_tokens("text")).first()[0] > 2
    with pytest.raises(FileNotFoundError):
        tokens.precise_tokens("text", "no_such_vocabulary")
    assert df.select(tokens.precise_tokens("text", "no_such_vocabulary", estimate=True)).first()[0] == 4


def test_fingerprint_maps(spark, tmp_path):
    from quillworks.sources.tables import fingerprint_maps

    (tmp_path / "a.json").write_text(json.dumps({"x": ["1", "2"], "y": ["2"]}))
    (tmp_path / "b.json").write_text(json.dumps({"x": ["2", "3"]}, indent=1))
    assert {tuple(r) for r in fingerprint_maps(spark, str(tmp_path)).collect()} == {("x", "1"), ("x", "2"), ("x", "3"), ("y", "2")}


def test_folder_stats(spark):
    df = spark.createDataFrame([("a", "x" * 2048), ("a", "é"), ("b", "z")], "source string, text string")
    assert {r.source: (r.chapters, r.chars, r.kb, r.examples) for r in plan.folder_stats(df).collect()} == {"a": (2, 2049, 2.0, 2), "b": (1, 1, 0.0, 1), None: (3, 2050, 2.0, 3)}
