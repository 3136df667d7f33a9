"""Main text and dates of HTML pages: a parser in Arrow batches, and a subset in plain expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements, roles and parts of id or class that are no content; where pages keep their dates.
DROP_TAGS = "script style noscript iframe svg header footer nav aside form button dialog template input select label".split()
DROP_ROLES = "navigation banner complementary contentinfo search dialog menu menubar tablist alert".split()
DROP_PARTS = """extra-services labstabs bibliograph bibtex endorse citation bookmark sidebar navbar cookie consent newsletter subscribe
breadcrumb social share- -share related recommend skip-link sr-only screen-reader site-header site-footer promo advert popup""".split()
DATE_META = """property=article:published_time property=og:article:published_time property=article:modified_time property=og:updated_time
name=citation_date name=citation_publication_date name=citation_online_date name=datePublished name=parsely-pub-date name=sailthru.date
name=dc.date name=dc.date.issued name=date name=pubdate name=publishdate name=lastmod itemprop=datePublished itemprop=dateModified""".split()
DATE_JSON = "datePublished dateCreated dateModified uploadDate".split()
VOID = set("area base br col embed hr img input link meta source track wbr".split())
_DATE = re.compile(r"([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})")


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs})
        if tag == "p" and self.open[-1].tag == "p":  # a paragraph ends where the next begins
            self.open.pop()
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _dropped(node: _Node) -> bool:
    marks = f"{node.attrs.get('class', '')}\n{node.attrs.get('id', '')}".lower()
    return node.tag in DROP_TAGS or node.attrs.get("role", "").lower() in DROP_ROLES or node.attrs.get("aria-hidden") == "true" or any(p in marks for p in DROP_PARTS)


def _walk(node: _Node) -> Iterator[_Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += [c for c in reversed(n.children) if isinstance(c, _Node)]


def _text(node: _Node, every: bool = False) -> list[str]:
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif every or n is node or not _dropped(n):
            stack += reversed(n.children)
    return out


def _parse(page: str) -> _Node:
    tree = _Tree()
    tree.feed(page or "")
    tree.close()
    return tree.root


def main_text(page: str) -> str:
    """Text of the article, else of main, of what has that role, or of the body, without boilerplate; a line for each run."""
    root = _parse(page)
    live = []
    stack = [root]
    while stack:
        n = stack.pop()
        if n is root or not _dropped(n):
            live.append(n)
            stack += [c for c in reversed(n.children) if isinstance(c, _Node)]
    rules = (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main", lambda n: n.tag == "body")
    best = next((n for rule in rules for n in live if rule(n)), root)
    return "\n".join(x for x in (t.strip() for t in _text(best)) if x)


def _iso(raw: str) -> str:
    m = _DATE.search(raw or "")
    return f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}" if m else ""


def page_date(page: str) -> str:
    """From meta elements in order of trust, then JSON-LD, then <time>; '' where there is none."""
    root = _parse(page)
    nodes = list(_walk(root))
    for rule in DATE_META:
        key, value = rule.split("=", 1)
        tag = next((n for n in nodes if n.tag == "meta" and n.attrs.get(key) == value), None)
        if tag and (d := _iso(tag.attrs.get("content", ""))):
            return d
    for n in nodes:
        if n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            try:
                blob = json.loads("".join(_text(n, every=True)))
            except ValueError:
                continue
            for x in blob if isinstance(blob, list) else [blob]:
                for k in DATE_JSON if isinstance(x, dict) else ():
                    if x.get(k) and (d := _iso(str(x[k]))):
                        return d
    time = next((n for n in nodes if n.tag == "time"), None)
    return _iso(time.attrs.get("datetime") or "".join(_text(time, every=True))) if time else ""


def main_text_of(pages: Column | str) -> Column:
    return F.pandas_udf(lambda x: x.map(main_text, na_action="ignore"), "string", F.PandasUDFType.SCALAR)(pages)


def page_date_of(pages: Column | str) -> Column:
    return F.pandas_udf(lambda x: x.map(page_date, na_action="ignore"), "string", F.PandasUDFType.SCALAR)(pages)


def stripped(page: Column) -> Column:
    """Without the elements that hold no content and without tags, by expressions alone; for pages without nesting of one such element in itself."""
    for tag in ("script", "style", "nav", "header", "footer", "aside"):
        page = F.regexp_replace(page, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    page = F.regexp_replace(F.regexp_replace(page, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    return F.regexp_replace(F.regexp_replace(page, r"\s+", " "), r"^ | $", "")
