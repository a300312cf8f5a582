"""Pages to documents: readable blocks under their heading path."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attesta.functions import text as tx
from attesta.functions.arrays import pieces
from attesta.schemas import PAGE_CONTENT

# The least text of a document, and of a block of its own.
MIN_DOC_CHARS = 200
MIN_BLOCK_CHARS = 40

_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_SKIP = {
    "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "iframe", "svg",
    "button", "select", "head", "dialog",
}
_NOISE = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|sidebar|cookie\w*|comments?|breadcrumbs?|share|social|promo|paywall)(?:$|[\s_-])")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BREAKS = {
    "p", "div", "section", "article", "main", "body", "ul", "ol", "li", "table", "thead", "tbody", "tr",
    "td", "th", "blockquote", "pre", "figure", "figcaption", "header", "dl", "dt", "dd", "hr",
} | _HEADINGS
_CAPTURE = {"li": "item", "dd": "item", "tr": "row"}


class _PageReader(HTMLParser):
    """Collects ``(kind, text)`` pieces of a page in document order, where kind is
    a heading tag or ``text``, once for the whole body and once for the part
    inside article or main."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[tuple[str, str, bool]] = []
        self.meta: dict[str, str] = {}
        self.lang = self.time = ""
        self._open: list[str] = []
        self._skip_at: int | None = None
        self._focus = 0
        self._kind = "text"
        self._buffer: list[str] = []
        self._capture: str | None = None
        self._cells: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = named.get("lang", "")
        if tag == "meta":
            key = (named.get("property") or named.get("name") or "").lower()
            self.meta.setdefault(key, named.get("content", ""))
        if tag == "time" and not self.time:
            self.time = named.get("datetime", "")
        if tag == "body":
            # A head that was never closed ends here.
            self._open, self._skip_at = [], None
        if tag in _VOID:
            if self._skip_at is None:
                self._buffer.append(" ")
            return
        if self._skip_at is None and tag in _BREAKS:
            self._on_break(tag)
        self._open.append(tag)
        if self._skip_at is not None:
            return
        marks = f"{named.get('class', '')} {named.get('id', '')}"
        page_header = tag == "header" and not self._focus
        if tag in _SKIP or page_header or (tag in ("div", "section", "ul", "p") and _NOISE.search(marks)):
            self._skip_at = len(self._open)
        elif tag in ("article", "main"):
            self._focus += 1
        elif self._capture is None and tag in _CAPTURE:
            self._capture = tag
            self._cells = [] if tag == "tr" else None
        elif self._capture is None and tag in _HEADINGS:
            self._kind = tag

    def handle_endtag(self, tag: str) -> None:
        if tag not in self._open:
            return
        while self._open:
            closed = self._open.pop()
            depth = len(self._open) + 1
            if self._skip_at is not None:
                if depth == self._skip_at:
                    self._skip_at = None
            else:
                self._on_close(closed)
            if closed == tag:
                break

    def _on_break(self, tag: str) -> None:
        if self._capture is None:
            self._flush()
            if self._open and self._open[-1] == "p":
                self._open.pop()
            return
        if tag == self._capture:
            self._on_close(tag)
            while self._open and self._open.pop() != tag:
                pass
        else:
            self._buffer.append(" ")

    def _on_close(self, tag: str) -> None:
        if tag in ("td", "th") and self._cells is not None:
            self._cells.append(_squeeze(self._buffer))
            self._buffer = []
        elif self._capture is not None and tag == self._capture:
            if self._cells:
                rest = _squeeze(self._buffer)
                self._buffer = [" | ".join(c for c in [*self._cells, rest] if c)]
            self._capture = self._cells = None
            self._flush()
        elif self._capture is None and tag in _BREAKS:
            self._flush()
            if tag in ("article", "main"):
                self._focus = max(0, self._focus - 1)

    def handle_data(self, data: str) -> None:
        if self._skip_at is None:
            self._buffer.append(data)

    def _flush(self) -> None:
        words = _squeeze(self._buffer)
        if words:
            self.pieces.append((self._kind, words, self._focus > 0))
        self._buffer = []
        self._kind = "text"

    def finish(self) -> None:
        self.close()
        if self._capture is not None:
            self._on_close(self._capture)
        self._flush()


def _squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def blocks_of(pieces: list[tuple[str, str]]) -> list[dict[str, Any]]:
    """Put texts under their heading path and fold tiny ones into the block before.

    A heading closes the headings of its level and below. The first-level heading
    is the title of the page and never part of a path.
    """
    path: list[tuple[int, str]] = []
    blocks: list[dict[str, Any]] = []
    for kind, words in pieces:
        if kind != "text":
            level = int(kind[1])
            if level > 1:
                path = [h for h in path if h[0] < level] + [(level, words)]
        elif blocks and len(words) < MIN_BLOCK_CHARS:
            blocks[-1]["text"] += " " + words
        else:
            blocks.append({"heading_path": [name for _, name in path], "text": words})
    return blocks


def read_page(html: str | None) -> dict[str, Any]:
    """Title, language, date and blocks of one page; no blocks where less than
    ``MIN_DOC_CHARS`` of readable text survive."""
    page = _PageReader()
    page.feed(html or "")
    page.finish()
    focused = [(k, w) for k, w, inside in page.pieces if inside]
    pieces = focused or [(k, w) for k, w, _ in page.pieces]
    blocks = blocks_of(pieces)
    if sum(len(b["text"]) for b in blocks) < MIN_DOC_CHARS:
        blocks = []
    tops = [w for k, w, _ in page.pieces if k == "h1"]
    title = page.meta.get("og:title", "").strip() or (tops[0] if len(tops) == 1 else "")
    dates = [page.meta.get(k, "") for k in ("article:published_time", "date", "dc.date", "pubdate")] + [page.time]
    found = next((m.group(0) for m in (re.match(r"\d{4}-\d{2}-\d{2}", d) for d in dates) if m), None)
    return {"title": title, "lang": page.lang or None, "published": found, "blocks": blocks}


def _read_pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = to_arrow_type(PAGE_CONTENT)
    for html in batches:
        for some in pieces(html):
            yield pa.array([read_page(h) for h in some.to_pylist()], kind)


def extract_documents(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(url, html)`` to documents; pages without useful text give no row. Other
    columns are passed through. ``html`` may be text or bytes; an empty title is
    replaced by the title tag."""
    if dict(pages.dtypes)[html] == "binary":
        pages = pages.withColumn(html, tx.decode_utf8(html))
    others = [c for c in pages.columns if c != html]
    read = pages.select(*others, tx.title_from_html(html).alias("_tag"), F.arrow_udf(_read_pages, PAGE_CONTENT)(html).alias("d"))
    return read.filter(F.size("d.blocks") > 0).select(
        *others,
        F.when(F.coalesce("d.title", F.lit("")) == "", F.col("_tag")).otherwise(F.col("d.title")).alias("title"),
        "d.lang",
        "d.published",
        "d.blocks",
    )


def document_text(blocks: str = "blocks"):
    """All blocks joined by blank lines: the text that chunk offsets refer to."""
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")
