"""Citation markers such as ``[3]`` in markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How markers and section marks are written.
MARKER = r"\[(\d+)\]"
SECTION_MARK = r"<!--Q-SECTION:(.*?)-->"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def raw_markers(md: Column | str) -> Column:
    """The digits of every marker, in order, as written."""
    return F.regexp_extract_all(_c(md), F.lit(MARKER), F.lit(1))


def markers(md: Column | str) -> Column:
    """Every cited number in order, repeats kept. Digits that do not fit a
    bigint cannot name a citation and become -1."""
    return F.transform(raw_markers(md), lambda d: F.coalesce(d.try_cast("bigint"), F.lit(-1)))


def drop_unknown_markers(md: Column | str, n_known: Column | int) -> Column:
    """Delete the markers outside ``1..n_known``, whatever their padding."""
    top = F.lit(n_known) if isinstance(n_known, int) else n_known
    bad = F.filter(
        F.array_distinct(raw_markers(md)),
        lambda d: ~F.coalesce(d.try_cast("bigint"), F.lit(-1)).between(F.lit(1), top),
    )
    return F.aggregate(
        bad, _c(md), lambda text, d: F.replace(text, F.concat(F.lit("["), d, F.lit("]")), F.lit(""))
    )


def same_markers(before: Column | str, after: Column | str) -> Column:
    """True when both texts cite the same numbers equally often."""
    return F.array_sort(markers(before)) == F.array_sort(markers(after))


def section_titles(md: Column | str) -> Column:
    return F.regexp_extract_all(_c(md), F.lit(SECTION_MARK), F.lit(1))


def section_bodies(md: Column | str) -> Column:
    """Text after each section mark; element 0 is what precedes the first."""
    return F.split(_c(md), SECTION_MARK, -1)


def heading_label(heading_path: Column | str, empty: str) -> Column:
    label = F.array_join(_c(heading_path), " > ")
    return F.when(F.size(_c(heading_path)) > 0, label).otherwise(empty)


def corpus_entry(number, url, heading_path, claim, span, text) -> Column:
    """One piece of evidence as it stands in the corpus."""
    n = F.lit(number) if isinstance(number, int) else _c(number)
    return F.concat(
        F.lit("["), n.cast("string"), F.lit("] source: "), _c(url),
        F.lit(" | section: "), heading_label(heading_path, "(top)"),
        F.lit("\nclaim: "), _c(claim),
        F.lit("\nevidence: "), _c(span),
        F.lit("\ntext: "), _c(text),
    )


def reference_line(number, title, url, heading_path, chunk_id, start_char, end_char) -> Column:
    """One line of the references section."""
    anchor = F.concat(
        F.lit("chunk "), _c(chunk_id), F.lit(", chars "),
        _c(start_char).cast("string"), F.lit("-"), _c(end_char).cast("string"),
    )
    heading = heading_label(heading_path, "")
    where = F.when(heading != "", F.concat(heading, F.lit("; "), anchor)).otherwise(anchor)
    name = F.when(F.coalesce(_c(title), F.lit("")) == "", _c(url)).otherwise(_c(title))
    return F.concat(
        F.lit("["), _c(number).cast("string"), F.lit("] "), name, F.lit(" - "), _c(url),
        F.lit(" ("), where, F.lit(")"),
    )


def unresolved_in_report(report: Column | str) -> Column:
    """Markers of the body that the references section does not list; NULL when
    the report has no references section."""
    body = F.substring_index(_c(report), "## References", 1)
    refs = F.substring(_c(report), F.length(body) + 1, F.length(_c(report)))
    missing = F.array_sort(F.array_except(F.array_distinct(markers(body)), markers(refs)))
    return F.when(F.instr(_c(report), "## References") > 0, missing)
