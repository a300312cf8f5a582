"""Document fingerprints by I-Match with randomised lexicons.

Terms within a band of inverse document frequency form the lexicon. A random subset of the lexicon keeps each
term with probability 2^-level; the sorted distinct terms that a document has in a subset are hashed to one
value. A fingerprint holds these values for ``SUBSETS`` subsets at ``LEVELS`` neighbouring levels, chosen by the number of
the document's terms so that a subset catches about one of them or fewer, whatever the document's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import bytewords as bw

#: A term belongs to the lexicon if its share of the documents lies in this band. At most 1 / RAREST times the
#: mean number of distinct terms of a document can reach the lower bound, however many documents there are.
RAREST, MOST_COMMON = 0.001, 0.1
SUBSETS, LEVELS = 32, 3
#: Mean number of a document's terms in a subset, at the coarsest of its levels, lies between a half of this and this.
TERMS = 1.0
#: Documents per range of ids, and most ranges; a range is sorted in one task, which may spill. Only one id per range reaches the driver.
RANGE_ROWS, MOST_RANGES = 1_500, 10_000
#: Stands for a missing id while rows are put in order.
_NO_ID = -(1 << 63)

_SUBSET = bw.salts(SUBSETS, 11)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Sorted hashes of the lexicon's terms, and the number of documents. Counts cover all documents; terms are
    counted once per document and pre-aggregated in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, count = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
            waiting, size = [], 0

            def merged(term: np.ndarray, count: np.ndarray, waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
                new, times = np.unique(np.concatenate(waiting), return_counts=True)
                both, place = np.unique(np.concatenate([term, new]), return_inverse=True)
                return both, np.bincount(place, weights=np.concatenate([count, times]), minlength=len(both)).astype(np.int64)

            for block in bw.blocks(batch.column(0)):
                w = bw.words(block, bw.ALNUM)
                values, _ = bw.distinct(w.hashes, w.owner, len(block))
                waiting.append(values)
                size += len(values)
                if size > 2_000_000:
                    term, count = merged(term, count, waiting)
                    waiting, size = [], 0
            if waiting:
                term, count = merged(term, count, waiting)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(count)], ["term", "docs"])

    total = docs.count()
    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "term long, docs long")
    counts = counts.groupBy("term").agg(F.sum("docs").alias("docs"))
    band = counts.filter((F.col("docs") >= RAREST * total) & (F.col("docs") <= MOST_COMMON * total)).select("term")
    terms = np.array([r.term for r in band.collect()], dtype=np.int64).view(np.uint64)
    return np.sort(terms), total


def _level(terms: int) -> int:
    """Coarsest level of a document with so many lexicon terms."""
    return max(0, int(np.ceil(np.log2(terms / TERMS)))) if terms else 0


def _subset_values(terms: np.ndarray, level: int) -> np.ndarray:
    """32-bit hash of the terms in each subset of a level, 0 for none."""
    if not len(terms):
        return np.zeros(SUBSETS, dtype=np.uint32)
    draws = bw.mix(terms[None, :] ^ _SUBSET[:, None])
    # Subset k of level l + 1 is part of subset k of level l: the same draw, half the threshold.
    inside = draws <= np.uint64(0xFFFFFFFFFFFFFFFF >> min(level, 63))
    value = np.where(inside, bw.mix(terms)[None, :], np.uint64(0)).sum(axis=1, dtype=np.uint64)
    value = (bw.mix(value + np.uint64(level)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return np.where(inside.any(axis=1), value, np.uint32(0))


def fingerprints(texts: list[str], lexicon: np.ndarray) -> list[tuple[str, dict[int, np.ndarray]]]:
    """For each text its fingerprint and the values behind it by level. Without a lexicon term all distinct terms count
    (marked by a leading ``-``); without any term the fingerprint is ``0``."""
    out: list[tuple[str, dict[int, np.ndarray]]] = []
    for block in bw.blocks(pa.array(texts, pa.large_string())):
        w = bw.words(block, bw.ALNUM)
        values, bounds = bw.distinct(w.hashes, w.owner, len(block))
        if len(lexicon):
            at = np.minimum(np.searchsorted(lexicon, values), len(lexicon) - 1)
            known = lexicon[at] == values
        else:
            known = np.zeros(len(values), dtype=bool)
        for i in range(len(block)):
            part = slice(bounds[i], bounds[i + 1])
            terms, mark = values[part][known[part]], ""
            if not len(terms):
                terms, mark = values[part], "-"
            if not len(terms):
                out.append(("0", {}))
                continue
            level = _level(len(terms))
            levels = {l: _subset_values(terms, l) for l in range(level, level + LEVELS)}
            out.append((f"{mark}{level}:" + ":".join(v.tobytes().hex() for v in levels.values()), levels))
    return out


def likeness(a: tuple[str, dict[int, np.ndarray]], b: tuple[str, dict[int, np.ndarray]]) -> float:
    """Share of subsets with equal hashes among those in which either document has terms, over the levels that both
    fingerprints have. 1 for equal fingerprints, 0 without a common level."""
    if a[0] == b[0]:
        return 1.0
    common = [l for l in a[1] if l in b[1]]
    if not common or a[0].startswith("-") != b[0].startswith("-"):
        return 0.0
    x, y = (np.concatenate([f[1][l] for l in common]) for f in (a, b))
    used = (x != 0) | (y != 0)
    return float((x[used] == y[used]).mean()) if used.any() else 0.0


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text replaces the last floor(n_chars / 4) code points by the first as many (or all) of the next document,
    in ascending id; after the last comes the first, and a single document is its own next. Null texts count as empty.
    Rows without an id come first; rows with one id follow each other by text. Columns: the key, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    lexicon, total = document_frequencies(docs, text)
    shared = spark.sparkContext.broadcast(lexicon)
    slim = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Ranges of ids, each starting at an id that exists. The rows of a range's first id go to the range before it too, where
    # they follow the last row; those of the smallest id follow the last range.
    slim = slim.withColumn("id", F.coalesce("id", F.lit(_NO_ID)))
    ranges = max(1, min(MOST_RANGES, total // RANGE_ROWS))
    cuts = slim.approxQuantile("id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    least = slim.agg(F.min("id")).first()[0]
    if least is None:
        return spark.createDataFrame([], _SCHEMA).withColumnRenamed("id", key)
    heads = np.array(sorted({least, *(int(c) for c in cuts)}), dtype=np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            own = np.searchsorted(heads, ids, side="right") - 1
            again = np.flatnonzero(heads[own] == ids)
            rows = pa.array(np.concatenate([np.arange(len(ids)), again]))
            to = np.concatenate([own, (own[again] - 1) % len(heads)])
            extra = np.repeat([0, 1], [len(ids), len(again)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(to), pa.array(extra), batch.column(0).take(rows), batch.column(1).take(rows)], ["to", "extra", "id", "text"]
            )

    placed = slim.mapInArrow(place, "to long, extra long, id long, text string")
    placed = placed.repartition(len(heads), "to").sortWithinPartitions("to", "extra", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        held = None  # the row that waits for its next one
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            for at in range(0, len(rows), 500):
                part = rows[at : at + 500]
                prints = fingerprints([r[3] for r in part], lexicon)
                pairs = []
                for row, own in zip(part, prints, strict=True):
                    # Of a range's extra rows (one id may have several) only the first follows a row of the range.
                    if held is not None and held[0][0] == row[0] and held[0][1] == 0:
                        pairs.append((held, (row, own)))
                    held = (row, own)
                if pairs:
                    yield _compared(pairs, lexicon)

    return placed.mapInArrow(run, _SCHEMA).withColumnRenamed("id", key)


_SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the next one's beginning."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _compared(pairs: list, lexicon: np.ndarray) -> pa.RecordBatch:
    changed = [edited(a[0][3], b[0][3]) for a, b in pairs]
    prints = fingerprints(changed, lexicon)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None if a[0][2] == _NO_ID else a[0][2] for a, _ in pairs], pa.int64()),
            pa.array([len(a[0][3]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed]),
            pa.array([a[1][0] for a, _ in pairs]),
            pa.array([p[0] for p in prints]),
            pa.array([likeness(a[1], p) for (a, _), p in zip(pairs, prints, strict=True)], pa.float64()),
            pa.array([likeness(a[1], b[1]) for a, b in pairs], pa.float64()),
        ],
        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def op3_imatch(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
