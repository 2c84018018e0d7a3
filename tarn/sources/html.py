"""HTML to reading text: a tree of elements, each of which decides for itself whether it is read and how it parts lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Elements that are not read, roles and class words of furniture, and the length up to which furniture told by class words goes.
UNREAD = {"script", "style", "head", "nav", "footer", "button", "svg", "form", "aside", "noscript", "template", "dialog", "iframe", "select"}
ROLES = {"navigation", "banner", "contentinfo", "search", "menu", "menubar", "toolbar", "dialog", "alertdialog"}
NAMES = {
    "cookie", "cookies", "consent", "gdpr", "breadcrumb", "breadcrumbs", "share", "sharing", "social", "sidebar", "widget", "related", "newsletter",
    "popup", "modal", "advert", "advertisement", "skip-link", "pagination", "pager",
}
HIDDEN = {"sr-only", "visually-hidden", "screen-reader-only", "visually-hidden-focusable", "a11y-hidden"}
LINES = {"p", "div", "section", "article", "header", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "blockquote", "dd", "dt", "figcaption", "pre", "time"}
CELLS = {"td", "th"}
HEADLINES = {"h1", "h2", "time"}
NEVER_NAMED = {"body", "main", "article"}
FURNITURE_CHARS = 600
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    parts: list = field(default_factory=list)
    closed: bool = False  # only an element with an end tag has a known extent
    text: str = ""
    headline: bool = False  # holds, or is, a headline


class _Tree(HTMLParser):
    """All elements of a page in document order, parents before children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", {})]
        self._open = [self.elements[0]]

    def handle_starttag(self, tag, attrs):
        made = Element(tag, {k: (v or "").lower() for k, v in attrs})
        self._open[-1].parts.append(made)
        self.elements.append(made)
        if tag not in VOID:
            self._open.append(made)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag == tag:
                self._open[i].closed = True
                del self._open[i:]
                return

    def handle_data(self, data):
        self._open[-1].parts.append(data)


def _carries(names: set[str], value: str) -> bool:
    """Whether one of the names stands among the parts of a class or id."""
    words = "-".join(re.split(r"[^\w-]+", value))
    return any(f"-{name}-" in f"-{words}-" for name in names) if words else False


def _plain(text: str) -> int:
    return len(" ".join(text.replace(" | ", " ").split()))


def is_read(x: Element) -> bool:
    if not x.closed:
        return True
    names = x.attrs.get("class", ""), x.attrs.get("id", "")
    if x.tag in UNREAD or x.attrs.get("role") in ROLES or x.attrs.get("aria-hidden") == "true" or _carries(HIDDEN, names[0]):
        return False
    if x.tag not in NEVER_NAMED and any(_carries(NAMES, n) for n in names) and _plain(x.text) <= FURNITURE_CHARS:
        return False
    return x.tag != "header" or x.headline


def reading_text(page: str | None) -> str:
    """The text of a page: one line for each block, cells of a row parted by bars."""
    tree = _Tree()
    tree.feed(page or "")
    tree.close()
    for x in reversed(tree.elements):
        inner = [p for p in x.parts if isinstance(p, Element)]
        x.headline = x.tag in HEADLINES or any(p.headline for p in inner)
        x.text = "".join(p.text if isinstance(p, Element) else p for p in x.parts)
        if not is_read(x):
            x.text, x.headline = " ", False
        elif x.tag == "br" or x.closed and x.tag in LINES:
            x.text += "\n"
        elif x.closed and x.tag in CELLS:
            x.text += " | "
    return "\n".join(_paragraphs(tree.elements[0].text, _row))


def tidy(text: str) -> str:
    """The text with single spaces, none at either end of a line, and no two empty lines together."""
    return "\n".join(_paragraphs(text, _spaced))


def _spaced(line: str) -> str:
    return re.sub(r"[ \t\xa0]+", " ", line).strip()


def _row(line: str) -> str:
    """A line whose cells, if it has any, are parted by single bars, none at either end."""
    return " | ".join(cell for cell in map(_spaced, line.split("|")) if cell)


def _paragraphs(text: str, shown) -> Iterator[str]:
    """Lines as ``shown``, runs of empty ones as one, none at either end."""
    begun = gap = False
    for line in map(shown, re.split(r"\r\n|\r|\n", text)):
        if not line:
            gap = begun
            continue
        if gap:
            yield ""
        yield line
        begun, gap = True, False


def html_to_text(df: DataFrame, html: str, out: str) -> DataFrame:
    @pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(reading_text)

    return df.withColumn(out, run(F.col(html)))
