"""HTML sources that need a parser: links of a page and search result rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Anchors(HTMLParser):
    """Collects (href, class, text) of anchors and the text of snippet cells, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self._open: list | None = None
        self._sponsored = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "tr":
            self._sponsored = "result-sponsored" in classes
        elif tag == "a" and a.get("href"):
            self._open = ["sponsored" if self._sponsored else "result" if "result-link" in classes else "a", a["href"], ""]
        elif tag == "td" and "result-snippet" in classes:
            self._open = ["snippet", "", ""]

    def handle_endtag(self, tag: str) -> None:
        if self._open and tag == ("td" if self._open[0] == "snippet" else "a"):
            self.found.append(self._open)
            self._open = None

    def handle_data(self, data: str) -> None:
        if self._open:
            self._open[2] += data


def _anchors(html: str | None) -> list[list]:
    parser = _Anchors()
    parser.feed(html or "")
    return parser.found


def links_of(html: str | None, base: str | None, most: int = 50) -> list[dict]:
    """Distinct http links of the page's own host, absolute, without fragment and trailing slash."""
    try:
        host = urlsplit(base or "").hostname
    except ValueError:
        host = None
    if not host:
        return []
    out: dict[str, dict] = {}
    for _, href, text in _anchors(html):
        try:
            parts = urlsplit(urljoin(base, href.strip()))
            if parts.hostname != host or parts.scheme not in ("http", "https"):
                continue
        except ValueError:
            continue
        url = urlunsplit(parts._replace(fragment="")).removesuffix("/")
        if url not in out and url != base.removesuffix("/"):
            out[url] = {"text": text.strip()[:100] or parts.path, "url": url}
            if len(out) == most:
                break
    return list(out.values())


def search_results_of(html: str | None, most: int = 10) -> list[dict]:
    """Title, real address and first snippet of each result row; sponsored rows are left out."""
    out: list[dict] = []
    for kind, href, text in _anchors(html):
        if kind == "result":
            wrapped = parse_qs(urlsplit(href).query).get("uddg")
            url = wrapped[0] if wrapped else href
            if text.strip() and url.startswith("http"):
                out.append({"title": text.strip(), "url": url, "snippet": ""})
        elif kind == "snippet" and out and not out[-1]["snippet"]:
            out[-1]["snippet"] = text.strip()
    return out[:most]


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, position, text and url of each page's links."""

    @F.pandas_udf("array<struct<text:string,url:string>>")
    def links(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, url in batches:
            yield pd.Series([links_of(h, u) for h, u in zip(html, url, strict=True)])

    return pages.select("page_id", F.posexplode(links("html", "url")).alias("position", "link")).select("page_id", "position", "link.text", "link.url")


def search_results(pages: DataFrame) -> DataFrame:
    """Rows of result pages (page_id, html)."""

    @F.pandas_udf("array<struct<title:string,url:string,snippet:string>>")
    def results(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield pd.Series([search_results_of(h) for h in html])

    return pages.select("page_id", F.posexplode(results("html")).alias("position", "r")).select("page_id", "position", "r.title", "r.url", "r.snippet")
