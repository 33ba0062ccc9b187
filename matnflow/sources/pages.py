"""Posts from HTML pages, and results as HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import escape_html

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Posts(HTMLParser):
    """Texts and wide pictures of the elements that match a (tag, attribute, value) rule; the innermost counts."""

    def __init__(self, post: tuple[str, str, str], body: tuple[str, str, str], width: int):
        super().__init__(convert_charrefs=True)
        self.post, self.body, self.width = post, body, width
        self.stack: list[tuple[str, bool, bool]] = []
        self.posts: list[dict] = []
        self.open: list[int] = []
        self.bodies = 0

    @staticmethod
    def _matches(rule, tag, attrs) -> bool:
        name, key, value = rule
        return tag == name and (not key or value in (attrs.get(key) or "").split())

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "img" and self.open and str(attrs.get("width") or "").isdigit() and int(attrs["width"]) >= self.width and attrs.get("src"):
            self.posts[self.open[-1]]["images"].append(attrs["src"])
        if tag == "br":
            self.handle_data("\n")
        if tag in VOID:
            return
        is_post, is_body = self._matches(self.post, tag, attrs), self._matches(self.body, tag, attrs)
        if is_post:
            self.open.append(len(self.posts))
            self.posts.append({"text": [], "images": []})
        self.bodies += is_body
        self.stack.append((tag, is_post, is_body))

    def handle_endtag(self, tag):
        while self.stack and any(t == tag for t, _, _ in self.stack):
            top, is_post, is_body = self.stack.pop()
            self.bodies -= is_body
            if is_post:
                self.open.pop()
            if top == tag:
                return

    def handle_data(self, data):
        if self.open and self.bodies:
            self.posts[self.open[-1]]["text"].append(data)


def extract_posts(pages: DataFrame, key: str, html: str, post: tuple[str, str, str], body: tuple[str, str, str], width: int = 200) -> DataFrame:
    """(key, no, text, images): the posts of each page, by rules (tag, attribute, value) for a post and its text.

    Pictures narrower than ``width`` are left out; a page that is null has no posts, and
    markup that is never closed ends with the page.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, page in zip(part[key], part[html]):
                parser = _Posts(post, body, width)
                parser.feed(page or "")
                rows += [(k, i, "".join(p["text"]).strip(), p["images"]) for i, p in enumerate(parser.posts)]
            yield pd.DataFrame(rows, columns=[key, "no", "text", "images"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, no int, text string, images array<string>")


def on_hosts(url: Column | str, hosts: list[str]) -> Column:
    """Whether a URL's host is one of ``hosts`` or below it."""
    host = F.lower(F.parse_url(F.col(url) if isinstance(url, str) else url, F.lit("HOST")))
    return F.coalesce(F.exists(F.array(*map(F.lit, hosts)), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h))), F.lit(False))


def card_html(kind: Column, label: Column, checked: Column, source: Column, rulings: Column | None = None) -> Column:
    """K6: a result as HTML, every value escaped; ``rulings`` is an array of structs (scholar, ruling, book)."""
    parts = [
        F.concat(F.lit('<article class="card" data-kind="'), escape_html(kind), F.lit('"><h3>'), escape_html(label), F.lit("</h3>")),
        F.concat(F.lit("<blockquote>"), escape_html(F.coalesce(checked, F.lit(""))), F.lit("</blockquote>")),
        F.when(source.isNotNull(), F.concat(F.lit('<blockquote class="source">'), escape_html(source), F.lit("</blockquote>"))).otherwise(""),
    ]
    if rulings is not None:
        item = lambda r: F.concat(F.lit("<li><b>"), escape_html(r["ruling"]), F.lit("</b> "), escape_html(F.concat_ws(" · ", r["scholar"], r["book"])), F.lit("</li>"))
        listed = F.concat(F.lit("<ul>"), F.array_join(F.transform(rulings, item), ""), F.lit("</ul>"))
        parts.append(F.when(F.size(rulings) > 0, listed).otherwise(""))
    return F.concat(*parts, F.lit("</article>"))
