"""Content of web pages: title, description, headings, text."""

from __future__ import annotations

import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "noscript", "svg", "iframe"}
HEADINGS, TEXT_CHARS = 20, 8000
SCHEMA = "title string, meta_description string, headings array<string>, body_text string"


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class Page(HTMLParser):
    """One pass over a document; tolerant of unclosed tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.meta: dict[str, str] = {}
        self.headings: list[str] = []
        self.body: list[str] = []
        self.skip, self.in_title, self.heading, self.in_body = 0, False, None, False
        self.has_body = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "title" and self.title is None and not self.skip:
            self.in_title, self.title = True, ""
        elif tag == "meta":
            name = (a.get("name") or a.get("property") or "").lower()
            self.meta.setdefault(name, a.get("content") or "")
        elif tag in ("h1", "h2"):
            self.heading = []
        elif tag == "body":
            self.in_body = self.has_body = True

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED and self.skip:
            self.skip -= 1
        elif tag == "title":
            self.in_title = False
        elif tag in ("h1", "h2") and self.heading is not None:
            text = squeeze("".join(self.heading))
            if text:
                self.headings.append(text)
            self.heading = None

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.in_title:
            self.title += data
            return
        if self.heading is not None:
            self.heading.append(data)
        if self.in_body:
            self.body.append(data)


def extract(html: str | None) -> dict | None:
    """The content of a page, or null if title, description and text are all empty."""
    page = Page()
    page.feed(html or "")
    page.close()
    title = squeeze(page.title or "")
    about = squeeze(page.meta.get("description") or page.meta.get("og:description") or "")
    body = squeeze("".join(page.body))[:TEXT_CHARS]
    if not (title or about or body):
        return None
    return {"title": title, "meta_description": about, "headings": page.headings[:HEADINGS], "body_text": body}


def http_page(url: str, method: str = "GET", timeout: float = 15.0) -> tuple[int, str]:
    """Status and body of a page."""
    request = urllib.request.Request(url, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, "" if method == "HEAD" else answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


def fetched_pages(urls: DataFrame, url_col: str, fetch: Callable[[str], tuple[int, str]] = http_page) -> DataFrame:
    """(url, html, error) of every distinct address; a page that fails has an error and no html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, error = [], []
            for url in batch.column(0).to_pylist():
                try:
                    status, body = fetch(url)
                    fine = 200 <= status < 300
                    html.append(body if fine else None)
                    error.append(None if fine else f"status {status}")
                except OSError as e:
                    html.append(None)
                    error.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(html, pa.string()), pa.array(error, pa.string())], names=["url", "html", "error"])

    distinct = urls.select(F.col(url_col).alias("url")).filter(F.col("url").isNotNull()).distinct()
    return distinct.mapInArrow(run, "url string, html string, error string")


def reachable(url: str, ask: Callable[[str, str, float], tuple[int, str]] = http_page, timeout: float = 8.0) -> bool:
    """Whether an address answers: asked for its head, and for the page where that is refused or fails."""
    for method in ("HEAD", "GET"):
        try:
            status, _ = ask(url, method, timeout)
        except OSError:
            continue
        if status != 405:
            return status < 400
    return False


def page_content(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """``keep`` columns and the content of each page; pages without any content are left out."""
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", " + SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([pa.field("title", pa.string()), pa.field("meta_description", pa.string()), pa.field("headings", pa.list_(pa.string())), pa.field("body_text", pa.string())])
        for batch in batches:
            found = [extract(h) for h in batch.column(len(keep)).to_pylist()]
            rows = pa.array([i for i, f in enumerate(found) if f], pa.int64())
            content = pa.RecordBatch.from_pylist([f for f in found if f], schema=out)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rows) for i in range(len(keep))], *content.columns], names=[*keep, *out.names])

    return pages.select(*keep, html).mapInArrow(run, schema)
