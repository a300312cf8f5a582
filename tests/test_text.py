from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from attesta.functions import audit
from attesta.functions import citations as ct
from attesta.functions import text as tx
from attesta.functions import urls


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col.alias("y")).head()[0]


def spans(text):
    out, start = [], 0
    for m in re.finditer(r"(?<=[.!?])\s+", text):
        out.append((start, m.end()))
        start = m.end()
    return out + [(start, len(text))]


TEXTS = [
    "", " ", "One.", "One. Two!  Three?\n\nFour", "Ends with space. ", "No stop here", "a.b c. d", "Wow!! Really?! Yes.",
    "Nbsp. After", "Thin. x", "Tab.\tx\x0by", "ünï. cödé! 漢字。 x? y",
]


@pytest.mark.parametrize("text", TEXTS)
def test_sentences_are_gap_free(spark, text):
    got = one(spark, tx.sentences("x"), text)
    assert "".join(got) == text
    assert got == [text[a:b] for a, b in spans(text)]


def test_running_total_short_and_blockwise(spark):
    values = list(range(1, 40))
    want = [sum(values[: i + 1]) for i in range(len(values))]
    for block in (4, 13, 39, 512):
        assert one(spark, tx.running_total(F.col("x"), block), values, "array<int>") == want
    assert one(spark, tx.running_total(F.col("x"), 4), [], "array<int>") == []


def test_token_count(spark):
    assert [one(spark, tx.token_count("x"), t) for t in ("", "abc", "abcd", "a" * 11)] == [1, 1, 1, 2]


def test_titles(spark):
    assert one(spark, tx.section_title("x"), "Why???") == "Why"
    long = "word " * 20
    assert one(spark, tx.section_title("x"), long) == (long[:70]).rsplit(" ", 1)[0]
    assert one(spark, tx.section_title("x"), "x" * 80) == "x" * 70
    assert one(spark, tx.title_from_html("x"), "<TITLE a=1>\n A  &amp;\tB </title><title>C</title>") == "A &amp; B"
    assert one(spark, tx.title_from_html("x"), "<p>none</p>") == ""


def test_strip_heading_and_fences(spark):
    assert one(spark, tx.strip_leading_heading("x"), "\n ## T\n\nBody\n## Two") == "Body\n## Two"
    assert one(spark, tx.strip_leading_heading("x"), "### T\nBody") == "### T\nBody"
    assert one(spark, tx.strip_code_fences("x"), ' ```json\n{"a": 1}\n``` ') == '{"a": 1}'
    assert one(spark, tx.strip_code_fences("x"), '{"a": 1}') == '{"a": 1}'
    assert one(spark, tx.heading_level("x"), "h4") == 4
    assert one(spark, tx.heading_level("x"), "big") == 2


def test_decode_utf8(spark):
    bad = bytes([0x54, 0xE9, 0x6E, 0x20, 0xB0, 0xE2, 0x82])
    assert one(spark, tx.decode_utf8("x"), bad, "binary") == bad.decode("utf-8", errors="replace")


def test_redact(spark):
    raw = 'key sk-ant-abcdefgh1234 Authorization: Bearer abc.def password="hunter2" https://x.org/?q=1&k=2'
    got = one(spark, tx.redact("x"), raw)
    for secret in ("abcdefgh1234", "abc.def", "hunter2", "q=1", "k=2"):
        assert secret not in got
    assert "sk-ant-REDACTED" in got and "?q=REDACTED&k=REDACTED" in got


def test_lexical_scores(spark):
    df = spark.createDataFrame([("The cat sat", "a CAT sat down"), ("", "x")], "q string, t string")
    assert [r[0] for r in df.select(F.round(tx.lexical_overlap("q", "t"), 3)).collect()] == [0.667, 0.0]
    df = spark.createDataFrame([("Größe matters, the größe", "große Größe; MATTERS the")], "q string, t string")
    assert df.select(tx.word_hits("q", "t")).head()[0] == 2.0


URLS = {
    "HTTP://ExAmple.COM": "http://example.com/",
    "https://a.com:443/x?Q=1#f": "https://a.com/x?Q=1",
    "http://a.com:8080/": "http://a.com:8080/",
    "https://User:Pw@A.com/P": "https://User:Pw@a.com/P",
    "http://a.com?x=1": "http://a.com/?x=1",
    "https://a.com:80/": "https://a.com:80/",
    "https://[2001:DB8::1]:443/p": "https://[2001:db8::1]/p",
}


@pytest.mark.parametrize("url", URLS)
def test_normalize_url(spark, url):
    assert one(spark, urls.normalize_url("x"), url) == URLS[url]


def test_citation_functions(spark):
    md = "A [1] b [12] c [01] d [99999999999999999999] [x]"
    assert one(spark, ct.markers("x"), md) == [1, 12, 1, -1]
    assert one(spark, ct.drop_unknown_markers("x", 5), md) == "A [1] b  c [01] d  [x]"
    df = spark.createDataFrame([("[1][2]", "[2][1]"), ("[1][1]", "[1]")], "a string, b string")
    assert [r[0] for r in df.select(ct.same_markers("a", "b")).collect()] == [True, False]
    assert one(spark, ct.unresolved_in_report("x"), "a [1] [4] [2]\n## References\n[1] x [2] y") == [4]
    assert one(spark, ct.unresolved_in_report("x"), "no list [1]") is None


def test_scan_lines_and_nested_urls(spark):
    body = "ok\nkey sk-ant-abcdefgh1\nsk-ant-REDACTED\nsk-ant-abcdefgh2 pragma: allowlist secret\n/home/jo/x\nBEGIN RSA PRIVATE KEY"
    rows = audit.scan_lines(spark.createDataFrame([("f", body)], "path string, text string"), "path").collect()
    assert sorted((r.line_no, r.finding) for r in rows) == [(2, "api_key"), (5, "home_path"), (6, "private_key")]
    doc = '{"url": "u1", "a": [{"url": "u\\"2"}, {"b": {"url": "u3"}}], "urls": "no"}'
    got = audit.nested_urls(spark.createDataFrame([("d", doc)], "k string, j string"), "k", "j").collect()
    assert [r.url for r in sorted(got, key=lambda r: r.pos)] == ["u1", 'u"2', "u3"]


def test_redaction_knows_all_letters(spark):
    """As Python's own patterns: accented names, no-break spaces, and what they leave alone."""
    import re

    shapes = [(r"(?i)\b(password|token)\b(['\"]?\s*[:=]\s*['\"]?)([^\s'\",;&]+)", r"\1\2REDACTED"), (r"([?&][\w.%\-]+=)[^&\s\"'<>]+", r"\1REDACTED")]
    texts = ["https://x.example/?clé=hunter2&b=3", "password\u00a0: hunter3", "token\u2003=\u2003abc", "motdépassword: x", "?\u00fcber=1 2"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.redact("t").alias("r")).collect()
    for row in rows:
        want = texts[row.i]
        for pattern, to in shapes:
            want = re.sub(pattern, to, want)
        assert row.r == want


def test_texts_of_a_batch_go_in_pieces():
    import pyarrow as pa

    from attesta.functions.arrays import PIECE_BYTES, PIECE_ROWS, pieces
    from attesta.operators.extract import _read_pages, read_page

    page = "<html lang='en'><body><p>" + "words of a page that are long enough to stay " * 6 + "</p></body></html>"
    pages = [page, None, ""] * 300
    out = list(_read_pages(iter([pa.array(pages)])))
    assert max(map(len, out)) <= PIECE_ROWS
    assert [x for b in out for x in b.to_pylist()] == [read_page(p) for p in pages]
    texts = ["a" * (PIECE_BYTES // 3)] * 7 + ["b" * (2 * PIECE_BYTES), None, "c"]
    cut = list(pieces(pa.array(texts).slice(1)))
    assert [x for p in cut for x in p.to_pylist()] == texts[1:] and [len(p) for p in cut] == [3, 3, 1, 2]
    assert [len(p) for p in pieces(pa.array([], pa.string()))] == [0]
