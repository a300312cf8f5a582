"""Main text of web pages by tag-path ratios.

Text nodes are grouped by their path of tags from the root. Of each path the text length and the punctuation per node
are taken, smoothed along the page, multiplied, and set against a threshold taken from their spread. Paths
above it hold the content. Navigation, footers and what is hidden never do; names and forms count where the ratios agree.
"""

from __future__ import annotations

import html as html_codes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content, elements whose content is no page text, and elements around the article (fixed values of HTML).
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math canvas object audio video select".split())
_AROUND = frozenset("nav header footer aside form button dialog menu head label fieldset figure".split())
#: Elements that begin and end a block of text (fixed value of HTML).
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element that the start of another ends: the element, and up to which ancestor that holds.
_ENDS = {
    **{t: (frozenset(["p"]), frozenset(["table", "td", "th", "button", "object"])) for t in _BLOCK - {"html", "body", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}},
    "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
}
#: Names of blocks that are no article text, by a class, id or role: alone, as its last word (``site-nav``), or as its first before
#: a word of layout (``share-buttons``, but not ``share-price``).
_DECLARED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice "
    "notices alert alerts popup modal overlay newsletter subscribe subscription signup sidebar nav navbar navigation menu menus breadcrumb "
    "breadcrumbs pagination pager footer header masthead topbar toolbar comment comments reply replies disqus discussion related recommended recommendations "
    "share sharing social widget widgets login search copyright legal disclaimer contentinfo complementary form skip tags".split()
)
_LAYOUT = frozenset(
    "area author avatar bar block body box button buttons column container content group head heading icon icons inner item items label left "
    "link links list main meta outer panel post right row section slot small stories text thread top unit wrap wrapper".split()
)
#: A header of one of these is part of the article.
_OWN = frozenset("article blog content entry page-title post story".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _declared(value: str) -> bool:
    for token in value.split():
        words = [w.lower() for w in _WORDS.findall(token)]
        if not words:
            continue
        if words[-1] in _DECLARED and not (words[-1] in ("header", "tags") and len(words) > 1 and words[0] in _OWN):
            return True
        if words[0] in _DECLARED and all(w in _LAYOUT or w in _DECLARED or w.isdigit() for w in words[1:]):
            return True
    return False


_MAIN = frozenset(["article", "main"])
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/)?(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：؟،।]")
_SPACE = re.compile(r"\s+")


class _Mark:
    """An element that markup declares to be something else than the article."""

    def __init__(self, kind: str) -> None:
        self.kind = kind  # "hidden", "tag" (an element around the article) or "name" (class, id, role; a form)
        self.chars = 0
        self.articles: list[int] = []  # numbers of the <article> and <main> inside


class _Page:
    """One pass over a page: blocks of text with their tag path."""

    def __init__(self, source: str) -> None:
        self.stack: list[tuple[str, _Mark | None, int]] = []  # tag, its mark, number of the <article> or <main> (-1: another element)
        # text, path, marks around it, <article> and <main> around it, link characters
        self.blocks: list[tuple[str, tuple[str, ...], tuple[_Mark, ...], tuple[int, ...], int]] = []
        self.articles: list[int] = []  # characters of each <article> and <main>
        self._parts: list[str] = []
        self._linked = 0
        self._read(source)

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self._parts)).strip()
        if text:
            marks = tuple(m for _, m, _ in self.stack if m is not None)
            articles = tuple(k for _, _, k in self.stack if k >= 0)
            self.blocks.append((text, tuple(t for t, _, _ in self.stack if t in _BLOCK), marks, articles, min(self._linked, len(text))))
            for m in marks:
                m.chars += len(text)
            for k in articles:
                self.articles[k] += len(text)
        self._parts, self._linked = [], 0

    def _text(self, raw: str) -> None:
        text = html_codes.unescape(raw)
        self._parts.append(text)
        if any(t == "a" for t, _, _ in self.stack):
            self._linked += len(text.strip())

    def _close(self, upto: int) -> None:
        if any(t in _BLOCK for t, _, _ in self.stack[upto:]):
            self._flush()
        del self.stack[upto:]

    def _open(self, tag: str, attrs: str) -> None:
        if tag in _ENDS:
            ended, border = _ENDS[tag]
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in border:
                    break
                if self.stack[k][0] in ended:
                    self._close(k)
        if tag in _BLOCK:
            self._flush()
        if tag == "br":
            self._parts.append(" ")
        if tag in _VOID:
            return
        kind = None
        if tag in _AROUND and not (tag in ("header", "figure") and any(t == "article" for t, _, _ in self.stack)):
            kind = "name" if tag in ("form", "fieldset") else "tag"
        for name, value in _ATTRIBUTE.findall(attrs):
            name, value = name.lower(), html_codes.unescape(value.strip("\"'"))
            if name in ("class", "id", "role") and tag not in ("html", "body", *_MAIN):
                kind = kind or ("name" if _declared(value) else None)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                kind = "hidden"
        article = -1
        if tag in _MAIN:
            article = len(self.articles)
            self.articles.append(0)
            for _, m, _ in self.stack:
                if m is not None:
                    m.articles.append(article)
        self.stack.append((tag, _Mark(kind) if kind else None, article))

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        open_ended: set[str] = set()
        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m.group("cdata") is not None:
                self._text(m.group("cdata"))
                continue
            tag = (m.group("tag") or "").lower()
            if not tag:
                continue
            if m.group("end"):
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] == tag:
                        self._close(k)
                        break
                continue
            if tag in _RAW:
                if tag not in open_ended and not (m.group("attrs") or "").rstrip().endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
                    if close:
                        at = close.end()
                    elif tag in ("script", "style"):
                        at = n
                    else:  # never closed: the tag alone is skipped
                        open_ended.add(tag)
                continue
            self._open(tag, m.group("attrs") or "")
        self._flush()


def _smoothed(values: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over two neighbours on each side, weights renewed at the borders."""
    kernel = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    return np.convolve(values, kernel, "full")[2 : 2 + len(values)] / np.convolve(np.ones(len(values)), kernel, "full")[2 : 2 + len(values)]


#: Text of the longest <article> or <main> weighs this much where names are held against the rest of the page.
ARTICLE_WEIGHT = 5
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_Block = tuple[str, tuple, bool, int, int]  # text, path, under a name that may remove it, weight, link characters


def _judged(blocks: list[_Block]) -> tuple[dict[tuple, float], float]:
    """The fused ratio of each path, and the threshold."""
    # Text length and punctuation per node of each path.
    paths: dict[tuple, list[float]] = {}
    for text, path, *_ in blocks:
        sums = paths.setdefault(path, [0.0, 0.0, 0.0])
        sums[0] += 1
        sums[1] += len(text)
        sums[2] += len(_PUNCTUATION.findall(text))
    length = _smoothed(np.array([paths[b[1]][1] / paths[b[1]][0] for b in blocks]))
    marks = _smoothed(np.array([paths[b[1]][2] / paths[b[1]][0] for b in blocks]))
    fused = length * (marks + 0.1)
    # A path is judged by the mean over its nodes; the threshold is a share of the spread, so that pages of any size fit.
    return _means(fused, blocks), float(fused.std()) * 0.1


def _standing(page: _Page) -> list[_Block]:
    """The blocks that may be content. Hidden elements and elements around the article (navigation, footers) go, the latter unless they hold
    the longest <article> or <main>. Names and forms around that one, or around most of the text, say nothing; the others
    are only noted."""
    longest = max(range(len(page.articles)), key=lambda k: (page.articles[k], -k), default=-1)
    holds = lambda m: longest in m.articles
    rest = [b for b in page.blocks if not any(m.kind == "hidden" or m.kind == "tag" and not holds(m) for m in b[2])]
    weight = lambda articles: ARTICLE_WEIGHT if longest in articles else 1
    total = sum(len(b[0]) * weight(b[3]) for b in rest)
    named = lambda m: m.kind == "name" and not holds(m) and 2 * m.chars <= total
    # Paths under such a name are kept apart from those of the same tags without one.
    return [(t, (*path, "") if (n := any(map(named, marks))) else path, n, weight(k), linked) for t, path, marks, k, linked in rest]


def _without_named(blocks: list[_Block]) -> list[_Block]:
    """Without the blocks under a name whose path has a lower ratio than what is content beside them: name and ratio agree."""
    if not any(b[2] for b in blocks):
        return blocks
    fused_of, threshold = _judged(blocks)
    content = [fused_of[path] * weight for _, path, named, weight, _ in blocks if not named and fused_of[path] >= threshold]
    level = sum(content) / len(content) if content else 0.0
    return [b for b in blocks if not b[2] or fused_of[b[1]] * b[3] >= level]


def main_text(source: str | None) -> str:
    """The article of a page, blocks joined by two line ends; empty for null or empty pages and pages without text."""
    if not source:
        return ""
    blocks = _without_named(_standing(_Page(source)))
    if not blocks:
        return ""
    fused_of, threshold = _judged(blocks)
    sums: dict[tuple, list[int]] = {}
    for text, path, _, _, linked in blocks:
        s = sums.setdefault(path, [0, 0])
        s[0] += len(text)
        s[1] += linked
    kept = []
    follows = None  # whether the text after a heading is kept
    for text, path, named, _, _ in reversed(blocks):
        heading = any(t in _HEADINGS for t in path[-2 if named else -1 :])
        own = fused_of[path] >= threshold
        if heading:
            keep = own if follows is None else follows
        else:
            keep = follows = own and sums[path][1] <= 0.5 * sums[path][0]
        if keep:
            kept.append(text)
    return "\n\n".join(reversed(kept))


def _means(fused: np.ndarray, blocks: list) -> dict:
    sums: dict = {}
    for f, b in zip(fused.tolist(), blocks, strict=True):
        s = sums.setdefault(b[1], [0.0, 0])
        s[0] += f
        s[1] += 1
    return {p: s[0] / s[1] for p, s in sums.items()}


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: the key, url, text, n_chars (code points). Pages are independent: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["key", "url", "text", "n_chars"]
                )

    slim = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return slim.mapInArrow(run, "key long, url string, text string, n_chars long").withColumnRenamed("key", key)


def op10_tag_paths(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
