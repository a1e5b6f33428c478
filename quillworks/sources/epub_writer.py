"""Small EPUB files, to round-trip the reader."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def book(title: str, chapters: list[tuple[str, str]], author: str = "", language: str = "en", publisher: str = "", date: str = "", rights: str = "") -> bytes:
    """An EPUB of (title, HTML) chapters, with a navigation document and an NCX."""
    out = io.BytesIO()
    names = [f"c{n}.xhtml" for n in range(1, len(chapters) + 1)]
    fields = {"title": title, "creator": author, "language": language, "publisher": publisher, "date": date, "rights": rights}
    meta = "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in fields.items() if v)
    items = "".join(f'<item id="i{n}" href="{name}" media-type="application/xhtml+xml"/>' for n, name in enumerate(names, 1))
    spine = "".join(f'<itemref idref="i{n}"/>' for n in range(1, len(names) + 1))
    points = "".join(f'<navPoint id="p{n}" playOrder="{n}"><navLabel><text>{escape(t)}</text></navLabel><content src="{name}"/></navPoint>' for n, ((t, _), name) in enumerate(zip(chapters, names, strict=True), 1) if t)
    links = "".join(f'<li><a href="{name}">{escape(t)}</a></li>' for (t, _), name in zip(chapters, names, strict=True))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr(
            "OEBPS/content.opf",
            f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata>'
            f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine>{spine}</spine></package>',
        )
        z.writestr("OEBPS/toc.ncx", f'<?xml version="1.0" encoding="utf-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}</navMap></ncx>')
        z.writestr("OEBPS/nav.xhtml", f"<html><body><nav><ol>{links}</ol></nav></body></html>")
        for name, (_, body) in zip(names, chapters, strict=True):
            z.writestr(f"OEBPS/{name}", body)
    return out.getvalue()


def books_of_pages(pages: DataFrame) -> DataFrame:
    """path and content of one book for each page."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(f"page-{i}.epub", book(f"Page {i}", [(f"Page {i}", page or "")], author="Unknown", rights="public domain", date="2020-01-01T00:00:00Z")) for i, page in zip(frame["page_id"], frame["html"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "content"])

    return pages.select("page_id", "html").mapInPandas(pack, "path string, content binary")
