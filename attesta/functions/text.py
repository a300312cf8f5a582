"""Text columns. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space in Unicode text.
# Java's own \s knows the ASCII ones only.
SPACE_CHARS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SPACE = f"[{SPACE_CHARS}]"

# U+FFFF is a noncharacter, so it cannot occur in text meant for interchange.
_CUT = chr(0xFFFF)

# Secret shapes and what replaces them, applied in this order. (?U) makes \w and \b know all letters; white space is spelled out.
REDACTIONS = [
    (r"sk-ant-[A-Za-z0-9_\-]{8,}", "sk-ant-REDACTED"),
    (rf"(?iU)\bbearer{SPACE}+[A-Za-z0-9._~+/\-]+=*", "Bearer REDACTED"),
    (
        r"(?iU)\b(api[_-]?key|x-api-key|authorization|access[_-]?token|secret[_-]?key|"
        rf"client[_-]?secret|password|token)\b(['\"]?{SPACE}*[:=]{SPACE}*['\"]?)([^{SPACE_CHARS}'\",;&]+)",
        "$1$2REDACTED",
    ),
    (rf"(?U)([?&][\w.%\-]+=)[^&{SPACE_CHARS}\"'<>]+", "$1REDACTED"),
]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``. An expression that is
    mentioned inside a lambda is otherwise computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column | str) -> Column:
    """Remove leading and trailing white space of any kind."""
    # From the last character that is no white space back: the class is not tried at every place.
    return F.regexp_extract(_c(col), rf"(?s)^{SPACE}*+(.*[^{SPACE_CHARS}])?", 1)


def squeeze_space(col: Column | str) -> Column:
    """Runs of white space become one blank; the ends are stripped."""
    return F.trim(F.regexp_replace(_c(col), f"{SPACE}+", " "))


def token_count(col: Column | str) -> Column:
    """About four characters per token, at least one."""
    return F.greatest(F.lit(1), F.shiftright(F.length(_c(col)), 2))


def tokens_of_length(n: Column) -> Column:
    """``token_count`` for a text whose length is already known."""
    return F.greatest(F.lit(1), F.shiftright(n, 2))


def words(col: Column | str) -> Column:
    """Lower-cased words, split at white space."""
    parts = F.split(F.lower(_c(col)), f"{SPACE}+")
    return F.filter(parts, lambda w: w != "")


def sentences(col: Column | str) -> Column:
    """Gap-free sentences: white space stays with the sentence it follows, so
    joining the array gives the text back."""
    marked = F.regexp_replace(_c(col), f"([.!?]{SPACE}+)", f"$1{_CUT}")
    return F.split(marked, _CUT, -1)


def sentence(col: Column | str, number: int) -> Column:
    """The sentence of that number (from 0) without white space around it; the first one if there are fewer, null for a null text."""
    return let(sentences(col), lambda parts: strip(F.coalesce(F.get(parts, F.lit(number)), F.get(parts, F.lit(0)))))


def running_total(values: Column, block: int = 512) -> Column:
    """Inclusive running totals of an integer array.

    Built per block and then shifted by the blocks before it, so that a very
    long array does not cost quadratic copying.
    """

    def scan(items: Column, start: Column) -> Column:
        folded = F.aggregate(
            items,
            F.struct(start.cast("bigint").alias("t"), F.array().cast("array<bigint>").alias("a")),
            lambda acc, x: F.struct(
                (acc["t"] + x).alias("t"), F.array_append(acc["a"], acc["t"] + x).alias("a")
            ),
        )
        return folded["a"]

    def blockwise(vals: Column) -> Column:
        n_blocks = F.ceil(F.size(vals) / block).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(vals, b * block + 1, F.lit(block))
        )

        def shifted(parts: Column) -> Column:
            totals = F.transform(
                parts, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x)
            )
            return F.flatten(
                F.zip_with(
                    parts,
                    scan(totals, F.lit(0)),
                    lambda b, end: scan(b, end - F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x)),
                )
            )

        return let(blocks, shifted)

    return let(
        values,
        lambda vals: F.when(F.size(vals) <= block, scan(vals, F.lit(0))).otherwise(blockwise(vals)),
    )


def title_from_html(col: Column | str) -> Column:
    """Text of the first title tag, white space squeezed, entities left alone."""
    return squeeze_space(F.regexp_extract(_c(col), r"(?is)<title[^>]*>(.*?)</title>", 1))


def decode_utf8(col: Column | str) -> Column:
    """Bytes to text; malformed bytes become the replacement character."""
    return F.make_valid_utf8(_c(col).cast("string"))


def redact(col: Column | str) -> Column:
    """Scrub secrets and URL parameter values."""
    out = _c(col)
    for pattern, replacement in REDACTIONS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(replacement))
    return out


def strip_leading_heading(col: Column | str) -> Column:
    """Drop one opening first- or second-level heading line."""
    body = F.regexp_replace(_c(col), f"^{SPACE}+", "")
    body = F.regexp_replace(body, r"^#{1,2}" + SPACE + r"+[^\n]*\n?", "")
    return F.regexp_replace(body, r"^\n+", "")


def strip_code_fences(col: Column | str) -> Column:
    """Unwrap a reply given inside a code fence."""
    bare = strip(col)
    opened = F.when(F.instr(bare, "\n") > 0, F.regexp_replace(bare, r"^[^\n]*\n", "")).otherwise(bare)
    inner = F.regexp_replace(opened, "```$", "")
    return strip(F.when(bare.startswith("```"), inner).otherwise(bare))


def heading_level(col: Column | str) -> Column:
    """``h3`` is 3; anything else counts as a section heading."""
    level = F.regexp_extract(_c(col), r"^h([0-9])$", 1)
    return F.when(level != "", level.try_cast("int")).otherwise(F.lit(2))


def section_title(col: Column | str, limit: int = 70) -> Column:
    """Question to heading: no question mark, cut at a word boundary."""
    bare = F.regexp_replace(_c(col), r"\?+$", "")
    cut = F.substring(bare, 1, limit)
    return F.when(F.length(bare) > limit, F.regexp_replace(cut, " [^ ]*$", "")).otherwise(bare)


def passage(col: Column | str, limit: int = 6000) -> Column:
    """The part of a chunk that a verdict prompt shows."""
    return F.substring(_c(col), 1, limit)


def lexical_overlap(query: Column | str, text: Column | str) -> Column:
    """Share of the query's distinct words that occur in the text."""

    def share(q: Column) -> Column:
        return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(words(text), q)) / F.size(q))

    return let(F.array_distinct(words(query)), share)


def terms(col: Column | str, min_len: int = 4) -> Column:
    """Lower-cased runs of at least ``min_len`` letters, digits and underscores,
    each once."""
    run = r"(?<![\p{L}\p{M}\p{N}_])([\p{L}\p{M}\p{N}_]{%d,})" % min_len
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(col)), F.lit(run), F.lit(1)))


def term_hits(query_terms: Column | str, text_terms: Column | str) -> Column:
    """How many query terms are among the text's terms."""
    return F.size(F.array_intersect(_c(text_terms), _c(query_terms))).cast("double")


def word_hits(query: Column | str, text: Column | str, min_len: int = 4) -> Column:
    """``term_hits`` of two texts. Where a text meets many queries, compute its
    terms once and use ``term_hits``."""
    return term_hits(terms(query, min_len), terms(text, min_len))


def sha256_hex(col: Column | str) -> Column:
    return F.sha2(_c(col), 256)
