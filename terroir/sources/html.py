"""Fields, links and text of HTML pages, by declared selectors; unclosed tags are fine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "source", "wbr"}
#: A new one of these ends an open one.
ENDS_ITSELF = {"p", "li", "tr", "td", "th", "option", "dt", "dd"}
HIDDEN = {"script", "style", "template", "noscript"}


@dataclass(frozen=True)
class Selector:
    """The text (or an attribute) of the elements with this tag and class."""

    name: str
    tag: str
    css_class: str | None = None
    attribute: str | None = None


class _Page(HTMLParser):
    def __init__(self, selectors: Sequence[Selector]) -> None:
        super().__init__(convert_charrefs=True)
        self.selectors, self.open = selectors, []  # (tag, selectors it answers, text so far)
        self.found: dict[str, list[str]] = {s.name: [] for s in selectors}
        self.links: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        hits = [s for s in self.selectors if s.tag == tag and (s.css_class is None or s.css_class in classes)]
        for s in hits:
            if s.attribute and a.get(s.attribute) is not None:
                self.found[s.name].append(a[s.attribute])
        if tag in VOID:
            self.text.append(" ")
            for _, _, parts, _ in self.open:
                parts.append(" ")
            return
        if tag in ENDS_ITSELF and any(t == tag for t, *_ in self.open):
            self.handle_endtag(tag)
        self.text.append("" if tag in ("a", "b", "i", "em", "strong", "span") else " ")
        self.hidden += tag in HIDDEN
        self.open.append((tag, [s for s in hits if not s.attribute], [], a.get("href") if tag == "a" else None))

    def handle_endtag(self, tag):
        if not any(t == tag for t, *_ in self.open):
            return
        while self.open:
            t = self._close()
            if t == tag:
                break

    def _close(self) -> str:
        t, hits, parts, href = self.open.pop()
        self.hidden -= t in HIDDEN
        said = " ".join("".join(parts).split())
        for s in hits:
            self.found[s.name].append(said)
        if href is not None:
            self.links.append((href, said))
        return t

    def handle_data(self, data):
        if self.hidden:
            return
        self.text.append(data)
        for _, _, parts, _ in self.open:
            parts.append(data)


def read_page(html: str, selectors: Sequence[Selector]) -> tuple[dict[str, list[str]], list[tuple[str, str]], str]:
    page = _Page(selectors)
    page.feed(html)
    page.close()
    while page.open:
        page._close()
    return page.found, page.links, " ".join("".join(page.text).split())


def parse_pages(pages: DataFrame, key: str, html: str, selectors: Sequence[Selector]) -> DataFrame:
    """key, fields (map of name to all values), links (array of href, text), text."""
    kind = pages.schema[key].dataType.simpleString()

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for k, h in zip(pdf["k"], pdf["h"]):
                found, links, text = read_page(h, selectors)
                out.append((k, found, [{"href": a, "label": b} for a, b in links], text))
            yield pd.DataFrame(out, columns=["k", "fields", "links", "text"])

    rows = pages.select(F.col(key).alias("k"), F.col(html).alias("h")).where("h is not null")
    return rows.mapInPandas(parse, f"k {kind}, fields map<string,array<string>>, links array<struct<href:string,label:string>>, text string").withColumnRenamed("k", key)


# -- list pages: one page, many records ---------------------------------------------------------


class _Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str | None]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []

    def text(self) -> str:
        out, rest = [], [self]
        while rest:
            x = rest.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in HIDDEN:
                if x is not self and x.tag not in INLINE:
                    out.append(" ")
                    rest.append(" ")
                rest.extend(reversed(x.children))
        return " ".join("".join(out).split())

    def find(self, s: Selector) -> Iterator[_Node]:
        """Nodes below this one that a selector means, in the page's order."""
        rest = [c for c in reversed(self.children) if isinstance(c, _Node)]
        while rest:
            x = rest.pop()
            if x.tag == s.tag and (s.css_class is None or s.css_class in (x.attributes.get("class") or "").split()):
                yield x
            rest.extend(c for c in reversed(x.children) if isinstance(c, _Node))


INLINE = ("a", "b", "i", "em", "strong", "span")


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_ITSELF:
            self._end(tag, within=tag)
        node = _Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        self._end(tag)

    def _end(self, tag: str, within: str | None = None) -> None:
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), None)
        # a new list item doesn't end the item that its own list stands in
        if at and not (within and any(n.tag in ("ul", "ol", "table", "dl", "select") for n in self.open[at + 1 :])):
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].children.append(data)


def read_items(html: str, item: Selector, selectors: Sequence[Selector]) -> list[dict[str, str | None]]:
    """For each item of a list page its fields: the first match of each selector, None if there is none."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    out = []
    for node in tree.root.find(item):
        row: dict[str, str | None] = {}
        for s in selectors:
            hit = next(node.find(s), None)
            row[s.name] = None if hit is None else hit.attributes.get(s.attribute) if s.attribute else hit.text()
        out.append(row)
    return out


def parse_list_pages(pages: DataFrame, key: str, html: str, item: Selector, selectors: Sequence[Selector]) -> DataFrame:
    """key, pos and one text column for each selector: a row for each item of each page, in order.

    A field that an item lacks is null in its row and shifts no other. A null page has no rows.
    """
    kind = pages.schema[key].dataType.simpleString()
    names = [s.name for s in selectors]

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [(k, i, *[row[n] for n in names]) for k, h in zip(pdf["__k"], pdf["__h"]) for i, row in enumerate(read_items(h, item, selectors))]
            yield pd.DataFrame(out, columns=["__k", "__pos", *names])

    rows = pages.select(F.col(key).alias("__k"), F.col(html).alias("__h")).where("__h is not null")
    read = rows.mapInPandas(parse, f"__k {kind}, __pos int, " + ", ".join(f"`{n}` string" for n in names))
    return read.withColumnRenamed("__k", key).withColumnRenamed("__pos", "pos")


def routed(records: DataFrame, full: bool, skip: Sequence[str] = ()) -> DataFrame:
    """What a list page's records lead to: in a full run the addresses of the detail pages (url), else
    the records themselves. Records without an address, or with a name that holds a word of skip, are left out."""
    kept = records.where(F.length(F.trim("url")) > 0)
    for word in skip:
        kept = kept.where(~F.coalesce(F.lower("name").contains(word.lower()), F.lit(False)))
    return kept.select("url").distinct() if full else kept
