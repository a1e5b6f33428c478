"""EPUB books: chapters and metadata, by the standard library's zip and XML readers."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.functions.quality import front_matter
from quillworks.functions.text import normalize
from quillworks.operators.duplicates import name_dedup
from quillworks.sources.html import text_nodes

CHAPTERS = "source string, chapter_index int, chapter_title string, body string, file_hash string, error string"
METADATA = "source string, author string, publisher string, language string, pub_date string, license string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _decoded(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


class Book:
    """The package document of an EPUB file: metadata, reading order, table of contents."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        container = ElementTree.fromstring(self.zip.read("META-INF/container.xml"))
        self.path = next(x.get("full-path") for x in container.iter() if _local(x.tag) == "rootfile")
        self.folder = posixpath.dirname(self.path)
        self.package = ElementTree.fromstring(self.zip.read(self.path))
        self.items = {x.get("id"): (self._at(x.get("href", "")), x.get("media-type", ""), x.get("properties") or "") for x in self.package.iter() if _local(x.tag) == "item"}
        self.spine = [x.get("idref") for x in self.package.iter() if _local(x.tag) == "itemref"]

    def _at(self, href: str, base: str | None = None) -> str:
        return posixpath.normpath(posixpath.join(self.folder if base is None else base, unquote(href.partition("#")[0])))

    def first(self, name: str) -> str:
        return next(((x.text or "").strip() for x in self.package.iter() if _local(x.tag) == name and (x.text or "").strip()), "")

    def titles(self) -> dict[str, str]:
        """Labels of the table of contents by file: leaves of the NCX or of the navigation document."""
        found: dict[str, str] = {}
        for path, kind, properties in self.items.values():
            base = posixpath.dirname(path)
            if kind == "application/x-dtbncx+xml":
                for point in (x for x in ElementTree.fromstring(self.zip.read(path)).iter() if _local(x.tag) == "navPoint"):
                    if any(_local(x.tag) == "navPoint" for x in point):
                        continue  # a section's own label counts for nothing
                    label = " ".join("".join(x.itertext()) for x in point if _local(x.tag) == "navLabel").strip()
                    src = next((x.get("src", "") for x in point if _local(x.tag) == "content"), "")
                    found.setdefault(self._at(src, base), label)
            elif "nav" in properties.split():
                for m in re.finditer(r"<a\b[^>]*href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>", _decoded(self.zip.read(path)), re.S | re.I):
                    found.setdefault(self._at(m[1], base), " ".join(re.sub("<[^>]*>", " ", m[2]).split()))
        return found

    def chapters(self) -> Iterator[tuple[int, str, str]]:
        """(place from 1 over all documents, title, HTML) in reading order."""
        titles = self.titles()
        by_name = {posixpath.basename(k): v for k, v in titles.items()}
        order = [i for i in self.spine if i in self.items] + [i for i in self.items if i not in self.spine]
        documents = [i for i in order if self.items[i][1] == "application/xhtml+xml"]
        for n, item in enumerate(documents, 1):
            path, _, properties = self.items[item]
            if "nav" in properties.split() or path not in self.zip.namelist():
                continue
            body = _decoded(self.zip.read(path))
            named = re.search(r"<title[^>]*>(.*?)</title>", body, re.S | re.I)
            title = titles.get(path) or by_name.get(posixpath.basename(path)) or titles.get(item) or (named and " ".join(named[1].split())) or f"Chapter {n}"
            yield n, title, re.sub(r"(?is)<head\b.*?</head>", "", body)


def files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, length and content of the EPUB files below ``folder``, one of each name."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(folder)
    return name_dedup(found)


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            name, code = posixpath.basename(unquote(path)), hashlib.sha256(content).hexdigest()[:16]
            try:
                rows = [(name, n, title, text_nodes(body), code, None) for n, title, body in Book(content).chapters()]
            except Exception as e:  # a damaged book is reported in its row and stops no other
                rows = [(name, None, None, None, code, f"{type(e).__name__}: {e}")]
            yield pd.DataFrame(rows, columns=["source", "chapter_index", "chapter_title", "body", "file_hash", "error"]).astype({"chapter_index": "Int32"})


def parsed(books: DataFrame) -> DataFrame:
    """Raw chapters of ``files()`` rows, and a row with error for each unreadable book."""
    return books.select("path", "content").mapInPandas(_parse, CHAPTERS)


def chapters(books: DataFrame, include_front_matter: bool = False, drop_head=None) -> DataFrame:
    """source, chapter_index, chapter_title, text, file_hash of each chapter with text; front and back matter goes unless asked for.

    ``drop_head``: a column function that takes a publisher's own lines off a text.
    """
    found = parsed(books).where("error is null").withColumn("text", normalize("body"))
    if drop_head is not None:
        found = found.withColumn("text", drop_head(F.col("text")))
    found = found.where("length(text) > 0")
    if not include_front_matter:
        found = found.where(~front_matter(F.col("chapter_title"), F.col("text")))
    return found.select("source", "chapter_index", "chapter_title", "text", "file_hash")


def metadata(books: DataFrame) -> DataFrame:
    """author, publisher, language, pub_date, license of each book; empty where missing or unreadable."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    book = Book(content)
                    values = [book.first(x) for x in ("creator", "publisher", "language", "date", "rights")]
                except Exception:  # the chapters' error column says why
                    values = [""] * 5
                rows.append((posixpath.basename(unquote(path)), *values[:3], values[3][:10], values[4]))
            yield pd.DataFrame(rows, columns=["source", "author", "publisher", "language", "pub_date", "license"])

    return books.select("path", "content").mapInPandas(read, METADATA)


def licensed(chapters_: DataFrame, metadata_: DataFrame, wanted: str) -> DataFrame:
    """Chapters of books whose license holds ``wanted``, in any case."""
    return chapters_.join(metadata_.where(F.lower("license").contains(wanted.lower())).select("source"), "source", "left_semi")
