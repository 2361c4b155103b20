"""HTML pages: a small tree over the standard library's parser, and what the pipelines take from it.

No Catalyst expression parses real HTML, so this is an Arrow-batched Python function.
"""

from __future__ import annotations

import http.client
import re
import sys
import time
import urllib.request
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Elements that never have an end tag; fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    """An element: name, attributes, and children that are elements or strings."""

    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order; a stack, as pages may nest without end."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        """All text below, nothing between; scripts and styles are no text."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node is self or node.name not in ("script", "style"):
                stack += reversed(node.children)
        return "".join(out)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def by_class(self, name: str) -> list[Node]:
        return [n for n in self.walk() if name in n.attrs.get("class", "").split()]

    def by_id(self, name: str) -> Node | None:
        return next((n for n in self.walk() if n.attrs.get("id") == name), None)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        # An end tag closes the innermost open element of its name, and what stands open in it; others are ignored.
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def article_text(html: str | None) -> str | None:
    """Text of the element with id article, else of the first article element; null without either."""
    if html is None:
        return None
    root = parse(html)
    node = root.by_id("article") or next((n for n in root.walk() if n.name == "article"), None)
    return node.text() if node else None


def statement_text(html: str | None) -> str | None:
    """The largest direct div of the article (first on ties), or all of it with fewer than two that hold text."""
    node = parse(html).by_id("article") if html is not None else None
    if node is None:
        return None
    divs = [d for d in node.elements() if d.name == "div" and d.text().strip()]
    return node.text() if len(divs) < 2 else max((d.text() for d in divs), key=len)


def minutes_text(html: str | None) -> str | None:
    """All text of the article."""
    node = parse(html).by_id("article") if html is not None else None
    return node.text() if node else None


def speech_text(html: str | None) -> str | None:
    """Text of the article's third child element, if that is a div."""
    node = parse(html).by_id("article") if html is not None else None
    children = node.elements() if node else []
    return children[2].text() if len(children) > 2 and children[2].name == "div" else None


def page_text(html: str | None) -> str | None:
    return parse(html).text() if html is not None else None


def listing(html: str | None, recent: bool) -> list[dict]:
    """Entries of a listing page, ``href`` and either ``title, speaker, event`` (old layout) or ``text`` (recent)."""
    if html is None:
        return []
    root = parse(html)
    link = lambda n: next((a.attrs["href"] for a in n.walk() if a.name == "a" and "href" in a.attrs), None)
    if recent:
        rows = [{"href": link(n), "text": n.text()} for n in root.by_class("eventlist__event")]
    else:
        columns = (root.by_class(c) for c in ("title", "speaker", "location"))
        rows = [{"href": link(t), "title": t.text().strip(), "speaker": s.text().strip(), "event": e.text().strip()} for t, s, e in zip(*columns, strict=False)]
    return [r for r in rows if r["href"]]


def _mapped(f: Callable, kind: str = "string") -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda h: f(h) if isinstance(h, str) else f(None))

    return run


def as_column(f: Callable[[str | None], str | None]) -> Callable[[Column], Column]:
    """One of the functions above as a column function."""
    return _mapped(f)


def listings(pages: DataFrame, recent: Callable[[Column], Column] = lambda year: year >= 2006) -> DataFrame:
    """``year, href, title, speaker, event, text`` per entry of listing pages (year, html), layout by year."""
    kind = "array<struct<href:string,title:string,speaker:string,event:string,text:string>>"
    blank = dict.fromkeys(("href", "title", "speaker", "event", "text"))

    @F.pandas_udf(kind)
    def run(html: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([[blank | r for r in listing(h if isinstance(h, str) else None, bool(n))] for h, n in zip(html, new, strict=True)])

    return pages.select("year", F.inline(run(F.col("html"), recent(F.col("year")))))


def http_get(url: str, timeout: float = 30.0, agent: str = "proseflow/1.0") -> str | None:
    """A page's text, in the encoding it declares or else UTF-8; null if it can't be got."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
            body, named = r.read(), r.headers.get_content_charset()
    except (OSError, ValueError, http.client.HTTPException):
        return None
    declared = re.search(rb"charset=[\"']?([\w-]+)", body[:2048])
    for encoding in (named, declared and declared[1].decode("ascii", "replace"), "utf-8"):
        try:
            if encoding:
                return body.decode(encoding)
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("latin-1")


def polite(get: Callable[[str], str | None], seconds: float) -> Callable[[str], str | None]:
    """get with a pause after each call; one site wants one partition, so that pauses hold for all calls."""
    def slow(url: str) -> str | None:
        found = get(url)
        time.sleep(seconds)
        return found

    return slow


def listing_pages(spark, urls: dict[int, str], get: Callable[[str], str | None]) -> DataFrame:
    """``year, html`` of listing pages, a page a year; failed pages have null and no entries."""
    queue = spark.createDataFrame([(y, u) for y, u in urls.items()], "id long, html_url string").coalesce(1)
    return fetched(queue, get).select(F.col("id").cast("int").alias("year"), F.col("raw_html").alias("html"))


def fetched(queue: DataFrame, get: Callable[[str], str | None], url_col: str = "html_url") -> DataFrame:
    """``id, raw_html``: pages got by a function that returns null on failure; one failed page fails nothing else."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "raw_html": [get(u) for u in pdf["url"]]})

    return queue.select("id", F.col(url_col).alias("url")).mapInPandas(run, "id long, raw_html string")
