"""Plain text of HTML: all text nodes on lines of their own, lists as marked lines, without scripts and page furniture."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillworks.functions.text import given, normalize

DROPPED = {"script", "style", "nav", "footer", "header", "aside"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class Node:
    def __init__(self, name: str, parent: "Node | None" = None) -> None:
        self.name, self.parent, self.inside = name, parent, []

    def walk(self, without: "Node | None" = None) -> Iterator["str | Node"]:
        """Text nodes and elements below in page order, but nothing of dropped elements and of ``without``."""
        open_ = [iter(self.inside)]
        while open_:
            for x in open_[-1]:
                if isinstance(x, str):
                    yield x
                elif x.name not in DROPPED and x is not without:
                    yield x
                    open_.append(iter(x.inside))
                    break
            else:
                open_.pop()

    def strings(self, without: "Node | None" = None) -> Iterator[str]:
        return (x for x in self.walk(without) if isinstance(x, str))


class _Tree(HTMLParser):
    """A lenient tree: an end tag closes the nearest open element of its name, or nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag: str, attrs) -> None:
        node = Node(tag, self.at)
        self.at.inside.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.at.inside.append(Node(tag, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.inside.append(data)


LISTS = {"ul", "ol"}


def _items(of: Node) -> Iterator[tuple[int, Node]]:
    return enumerate((x for x in of.inside if isinstance(x, Node) and x.name == "li"), 1)


def list_lines(of: Node) -> list[str]:
    """One line an item: its text outside the first list in it, whose items follow two blanks further in."""
    lines: list[str] = []
    levels = [(_items(of), 2, "*" if of.name == "ul" else None)]
    while levels:
        items, indent, bullet = levels[-1]
        number, item = next(items, (0, None))
        if item is None:
            levels.pop()
            continue
        inner = next((x for x in item.walk() if isinstance(x, Node) and x.name in LISTS), None)
        words = " ".join(filter(None, map(str.strip, item.strings(without=inner))))
        lines.append(f"{' ' * indent}{bullet or f'{number}.'} {words}")
        if inner is not None:
            levels.append((_items(inner), max(indent + 2, 4), "-" if inner.name == "ul" else None))
    return lines


def text_nodes(page: str) -> str:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    lines, listed = [], [tree.root]
    # outermost lists become lines of text, then what is left is read in page order
    while listed:
        node = listed.pop()
        for i, x in enumerate(node.inside):
            if isinstance(x, Node):
                if x.name in LISTS:
                    node.inside[i] = "\n".join(list_lines(x))
                else:
                    listed.append(x)
    lines.extend(tree.root.strings())
    return "\n".join(lines)


@F.pandas_udf(T.StringType())
def _text_nodes(pages: pd.Series) -> pd.Series:
    return pages.map(text_nodes)


def html_to_text(page: Column | str) -> Column:
    return normalize(_text_nodes(given(page)))


def strip_tags(page: Column | str) -> Column:
    """A native approximation: dropped elements go with all they hold, other tags become line breaks; entities stay."""
    t = given(page)
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    for name in sorted(DROPPED):
        t = F.regexp_replace(t, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    return normalize(F.regexp_replace(t, r"(?s)<[^>]*>", "\n"), compose=False)
