"""Cleaning, metrics, scoring, personal data, content types."""

import pytest
from pyspark.sql import functions as F

from quillworks.functions import private, quality
from quillworks.functions import text as tx
from quillworks.plans.recipes import RECIPES, Recipe, recipe, save

PROSE = "The old house stood on a hill above the town. Nobody had lived in it for many years. Children told each other stories about it. On winter nights a light could be seen in its highest window. "


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "clean"),
    [
        ("a   b\t c", "a b c"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("a\r\nb\rc", "a\nb\nc"),
        ("zero​width﻿ soft­hyphen", "zerowidth softhyphen"),
        ("ＡＢＣ", "ABC"),
        ("text\n12\nmore", "text\nmore"),
        ("  lines \n  here  ", "lines\nhere"),
        ("", ""),
        (None, ""),
    ],
)
def test_normalize(spark, given, clean):
    assert one(spark, tx.normalize("text"), given) == clean


@pytest.mark.parametrize(("text", "n"), [("hello world", 2), ("", 1), (None, 1), ("x" * 100, 25), ("é" * 8, 2)])
def test_token_estimate(spark, text, n):
    assert one(spark, tx.token_estimate("text"), text) == n


def metrics(spark, text):
    return tx.measured(spark.createDataFrame([(text,)], "text string")).first()["metrics"]


def test_metrics(spark):
    m = metrics(spark, "# Chapter one\n\n- a point\n1. another")
    assert m["structure"] == pytest.approx(1.0)
    assert m["blank_ratio"] == 0.25
    m = metrics(spark, "One two three four. Five six seven eight nine ten!")
    assert m["avg_sentence_len"] == 5.0 and m["lexical_diversity"] == 1.0 and m["density"] > 0.9
    for empty in ("", None, "   \n "):
        m = metrics(spark, empty)
        assert (m["density"], m["avg_sentence_len"], m["lexical_diversity"], m["flesch"], m["naturalness"]) == (0.0, 0.0, 0.0, 0.5, 0.7)


def test_entropy(spark):
    assert one(spark, tx.entropy("text"), "aaaa") == 0.0
    assert one(spark, tx.entropy("text"), "abcd") == 2.0
    assert one(spark, tx.entropy("text"), "") == 0.0


def scored(spark, text, r=RECIPES["balanced"]):
    df = quality.scored(spark.createDataFrame([(text,)], "text string"), r)
    return df.withColumn("reason", quality.rejected(r)).first()


def test_score(spark):
    good = scored(spark, PROSE * 4)
    assert good["gate"] is None and good["score"] >= 5.0 and len(good["dims"]) == 10
    assert scored(spark, "short")["reason"] == "length"
    assert scored(spark, "x" * 9000)["reason"] == "length"
    assert scored(spark, "%$#@!&*() " * 50)["reason"] == "low_density"
    assert scored(spark, None)["reason"] == "length"
    assert scored(spark, PROSE * 4, Recipe(quality=10.1))["reason"] == "below_threshold"
    assert scored(spark, "aaaa " * 100, Recipe(entropy=3.0))["reason"] == "low_entropy"


def test_private(spark):
    text = "Mail a.b@example.com or call 555-123-4567, 555.987.6543; ssn 123-45-6789, host 10.0.0.1, card 4111-1111-1111-1111."
    found = one(spark, private.detected("text"), text)
    assert found["email"] == ["a.b@example.com"] and len(found["phone_us"]) >= 2 and found["ssn"] == ["123-45-6789"]
    assert found["ip_address"] == ["10.0.0.1"] and found["credit_card"] == ["4111-1111-1111-1111"]
    assert one(spark, private.detected("text"), "nothing here") == {}
    assert "[EMAIL_REDACTED]" in one(spark, private.masked("text"), text) and "example.com" not in one(spark, private.masked("text"), text)
    assert len(one(spark, private.detected("text"), " ".join(f"u{i}@example.com" for i in range(9)))["email"]) == 5


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (PROSE, "narrative"),
        ('"Hello," she said. "How are you?" he asked. "Fine," she replied.', "dialogue"),
        ("The algorithm uses a database and a server protocol framework.", "technical"),
        ("def f(): import os\nclass A: const x => y", "code"),
        ("| a | b |\n| c | d |\n| e | f |\n| g | h |\n| i | j |", "reference"),
        ("", "narrative"),
    ],
)
def test_content_type(spark, text, kind):
    assert one(spark, quality.content_type("text"), text) == kind


@pytest.mark.parametrize(("title", "text", "front"), [("Copyright", "x", True), ("Table of Contents", "x", True), ("About the Author", "x", True), ("Index", "y", True), ("Chapter 1", PROSE * 3, False), ("The Journey", PROSE * 3, False), ("Oddly named", "Dedication\nto all", True)])
def test_front_matter(spark, title, text, front):
    df = spark.createDataFrame([(title, text)], "title string, text string")
    assert df.select(quality.front_matter(F.col("title"), F.col("text"))).first()[0] is front


def test_benchmark_phrase(spark):
    assert one(spark, quality.benchmark_phrase("text"), "well, The Capital of australia is known") == "the capital of Australia is"
    assert one(spark, quality.benchmark_phrase("text"), "a clean text") is None


def test_recipes(tmp_path):
    path = str(tmp_path / "c.json")
    save(Recipe(min_chars=10), path)
    assert recipe("strict", path).min_chars == 10 and recipe("strict", path, min_chars=20).min_chars == 20
    with pytest.raises(FileNotFoundError):
        recipe("strict", str(tmp_path / "none.json"))
