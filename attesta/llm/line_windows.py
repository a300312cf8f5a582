"""Line dedup by overlapping windows of three consecutive lines, with DataFrame operations only.

Every window of three non-blank lines is hashed. Of a window that occurs more than once anywhere, the first
occurrence (smallest id, then position) stays; the lines that later occurrences cover are merged and
removed. A removed line always has its like at an earlier place that stays, so no line is lost from the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import let
from attesta.llm.skew import join_weighted
from attesta.session import cut_lineage

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _filled(lines: Column) -> Column:
    """Non-blank lines as (p: place in the text, t: trimmed line)."""
    with_place = F.transform(lines, lambda x, i: F.struct(i.alias("p"), F.trim(F.regexp_replace(x, r"\s+$", "")).alias("t")))
    return F.filter(with_place, lambda x: x.t != "")


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the columns ``text`` (without lines that are repeated), n_lines and n_removed.

    Lines are ended by a newline and compared without white space at their ends. Blank lines belong to no window and
    stay, unless no other line of the text does: the text is then empty. Texts with fewer than three non-blank lines have
    no window and stay as they are; null texts stay null. Rows with one id are told apart by their text; exact copies of a row (id and text) count as
    one document, and so does each with the others' result. Rows without an id come after all others. Other columns stay as they are, whatever
    their names; only n_lines and n_removed take the place of columns of these names. An empty table gives an empty one; a text of any length is one row.
    """
    own = F.xxhash64(F.col(text).cast("string"))
    rows = docs.select(F.col(key).cast("long").alias("_id"), own.alias("_own"), F.col(text).cast("string").alias("_t"))
    filled = rows.select("_id", "_own", _filled(_lines(F.col("_t"))).alias("f")).filter(F.size("f") >= WINDOW)
    window = F.transform(
        F.sequence(F.lit(0), F.size("f") - WINDOW),
        lambda i: F.struct(
            i.alias("w"),
            *(F.xxhash64(F.lit(seed), *(F.get("f", i + k).t for k in range(WINDOW))).alias(h) for seed, h in ((1, "h1"), (2, "h2"))),
        ),
    )
    windows = filled.select("_id", "_own", F.inline(window))
    place = F.struct(F.col("_id").isNull().alias("late"), F.col("_id").alias("id"), F.col("_own").alias("own"), F.col("w").alias("w"))
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(place).alias("first")).filter("times > 1")
    repeated = cut_lineage(repeated)
    total = repeated.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    found = join_weighted(windows, repeated, ["h1", "h2"], "times", total, F.xxhash64("_own", "w"))
    later = found.filter(F.col("first").isNotNull() & (place != F.col("first"))).select("_id", "_own", "w")
    # As many windows as the document has lines at most; repeats of one row collapse.
    covered = later.groupBy("_id", "_own").agg(F.collect_set("w").alias("_covered"))
    covered = covered.select(F.col("_id").alias("_cid"), F.col("_own").alias("_cown"), "_covered")
    # All other columns travel in one struct, where their names meet no others.
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    marked = docs.select(
        F.col(key).cast("long").alias("_key"), own.alias("_own"), F.col(text).cast("string").alias("_t"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row")
    )
    out = marked.join(covered, F.col("_key").eqNullSafe(F.col("_cid")) & (F.col("_own") == F.col("_cown")), "left")
    # Each array is bound once; inside a lambda it would be computed again for every line.
    def cleaned(lines: Column) -> Column:
        def without(bound: Column) -> Column:
            places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), bound.gone)
            kept = F.when(F.size(bound.gone) < bound.n_filled, F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")).otherwise(F.lit(""))
            return F.struct(kept.alias("text"), F.size(lines).alias("n_lines"), F.size(bound.gone).alias("n_removed"))

        def bound(filled: Column) -> Column:
            gone = F.array_distinct(F.flatten(F.transform("_covered", lambda w: F.transform(F.sequence(w, w + WINDOW - 1), lambda k: F.get(filled, k).p))))
            return F.struct(gone.alias("gone"), F.size(filled).alias("n_filled"))

        return let(let(_filled(lines), bound), without)

    same = F.struct(F.col("_t").alias("text"), F.size(_lines(F.col("_t"))).alias("n_lines"), F.lit(0).alias("n_removed"))
    result = F.when(F.col("_covered").isNull(), same).otherwise(let(_lines(F.col("_t")), cleaned))
    # A generator is a barrier: what filters on the result later does not compute it again.
    out = out.select("_row", F.inline(F.array(result)).alias("_text", "n_lines", "n_removed"))
    named = (F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed"))
    return out.select(*named, "n_lines", "n_removed")


def op4_line_windows(spark, sf_dir: str) -> DataFrame:
    """All documents without repeated lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeated_lines(docs)
    return out.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"))


#: The same in DuckDB. Its hash function differs, so windows are compared by their lines.
LINE_WINDOWS_SQL = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
every_line AS (SELECT doc_id, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM split),
filled AS (SELECT doc_id, p, trim(line) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS f FROM every_line WHERE trim(line) <> ''),
windows AS (
  SELECT doc_id, f, p AS p0, lead(p, 1) OVER w AS p1, lead(p, 2) OVER w AS p2,
         t AS t0, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2
  FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY f)),
whole AS (SELECT * FROM windows WHERE t2 IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY t0, t1, t2 ORDER BY doc_id, f) AS r FROM whole),
gone AS (SELECT DISTINCT doc_id, unnest([p0, p1, p2]) AS p FROM ranked WHERE r > 1),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
full_lines AS (SELECT doc_id, count(*) AS n FROM filled GROUP BY doc_id),
kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.p) AS text
  FROM every_line e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p WHERE g.p IS NULL GROUP BY e.doc_id),
result AS (
  SELECT s.doc_id,
         CASE WHEN c.n IS NULL THEN s.text WHEN c.n >= l.n THEN '' ELSE coalesce(k.text, '') END AS text,
         CAST(len(s.lines) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed
  FROM split s LEFT JOIN counts c USING (doc_id) LEFT JOIN full_lines l USING (doc_id) LEFT JOIN kept k USING (doc_id))
SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars, n_lines, n_removed FROM result
"""
