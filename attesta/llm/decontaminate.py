"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND.

Every training passage is a query. The index holds, per term, postings in blocks with the block's largest score;
scores are relative to the score that an item gets for its own text, so that one threshold fits items of any length.
Passages whose block maxima cannot reach the threshold are left out in bulk; the others run through WAND cursors.
Each hit is verified: enough of the item's question and of its answer must stand in the document word for word.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm import bytewords as bw

#: Usual BM25 parameters.
K1, B = 1.2, 0.75
#: A passage is looked at if it reaches this share of the item's own score.
THRESHOLD = 0.6
#: Share of the 5-word shingles of question and answer each that must stand in the document.
OVERLAP = 0.8
SHINGLE = 5
#: Items in a block of postings.
BLOCK_ITEMS = 4
#: Passages have at least twice so many words, and start so many words apart.
STEP_WORDS = 64
#: Words of all items in one broadcast index; a larger benchmark is searched in several parts.
INDEX_WORDS = 2_000_000


def question_answer(text: Column) -> tuple[Column, Column]:
    """The parts of an item: what stands before and after its last answer mark (``Answer:`` or ``A:`` at the beginning of a
    line), else all but the last sentence or line and that one. An item of one sentence is all question."""
    marked = F.regexp_extract(text, r"(?is)^(.*)(?:^|\n)\s*(?:answer|a)\s*:\s*(.+)$", 1)
    answer = F.regexp_extract(text, r"(?is)^(.*)(?:^|\n)\s*(?:answer|a)\s*:\s*(.+)$", 2)
    last = F.regexp_extract(text, r"(?s)^(.*[.?!\n])\s*(\S.*?)\s*$", 2)
    first = F.regexp_extract(text, r"(?s)^(.*[.?!\n])\s*(\S.*?)\s*$", 1)
    return (
        F.when(answer != "", marked).when(F.trim(first) != "", first).otherwise(text),
        F.when(answer != "", answer).when(F.trim(first) != "", last).otherwise(F.lit("")),
    )


@dataclass
class Index:
    """Part of the benchmark. Items are ordered by length, so that a block's items have like scores."""

    ids: np.ndarray
    terms: np.ndarray  # sorted term hashes
    starts: np.ndarray  # postings of term i: starts[i]:starts[i + 1]
    items: np.ndarray  # item places, ascending per term
    scores: np.ndarray  # relative scores
    block_starts: np.ndarray  # blocks of term i
    blocks: np.ndarray  # item block number, ascending per term
    block_max: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]

    def search(self, terms: np.ndarray, threshold: float, reachable: list[int]) -> list[tuple[int, float]]:
        """Places and relative scores of all items that reach ``threshold`` for these distinct terms (places), by block-max
        WAND. reachable: ascending numbers of the blocks whose maxima reach it, as ``reachable_blocks`` finds them."""
        slack = threshold - 1e-9
        # Of a cursor: items, scores, position, blocks, block maxima, list maximum.
        cursors = []
        for t in terms.tolist():
            a, b = int(self.starts[t]), int(self.starts[t + 1])
            c, d = int(self.block_starts[t]), int(self.block_starts[t + 1])
            maxima = self.block_max[c:d].tolist()
            cursors.append([self.items[a:b].tolist(), self.scores[a:b].tolist(), 0, self.blocks[c:d].tolist(), maxima, max(maxima)])
        found = []
        cursors = _advance(cursors, reachable[0] * BLOCK_ITEMS) if reachable else []
        while cursors:
            cursors.sort(key=_current)
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[5]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = _current(cursors[pivot])
            block = item // BLOCK_ITEMS
            at = bisect_left(reachable, block)
            if at == len(reachable):
                break
            if reachable[at] != block:
                cursors = _advance(cursors, reachable[at] * BLOCK_ITEMS)
                continue
            while pivot + 1 < len(cursors) and _current(cursors[pivot + 1]) == item:
                pivot += 1
            bound = 0.0
            for c in cursors[: pivot + 1]:
                k = bisect_left(c[3], block)
                if k < len(c[3]) and c[3][k] == block:
                    bound += c[4][k]
            if bound < slack or _current(cursors[0]) == item:
                score = sum(c[1][c[2]] for c in cursors[: pivot + 1]) if bound >= slack else 0.0
                if score >= slack:
                    found.append((item, score))
                cursors = _advance(cursors, item + 1)
            else:
                cursors = _advance(cursors, item)
        return found

    def reachable_blocks(self, terms: np.ndarray, owner: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Queries, and of each the blocks, whose maxima sum up to the threshold. terms, owner: flat, owner ascending."""
        n_blocks = -(-len(self.ids) // BLOCK_ITEMS)
        sizes = np.diff(self.block_starts)[terms]
        ends = np.cumsum(sizes)
        at, queries, blocks = 0, [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        while at < len(terms):  # so many (term, block) pairs at once, whole queries
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4_000_000)))
            stop = int(np.searchsorted(owner, owner[stop - 1], side="right"))
            t, o, s = terms[at:stop], owner[at:stop] - owner[at], sizes[at:stop]
            place = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + np.repeat(self.block_starts[t], s)
            cell = np.repeat(o, s) * n_blocks + self.blocks[place]
            bound = np.bincount(cell, weights=self.block_max[place])
            good = np.flatnonzero(bound >= threshold - 1e-9)
            queries.append(good // n_blocks + owner[at])
            blocks.append(good % n_blocks)
            at = stop
        return np.concatenate(queries), np.concatenate(blocks)


def _current(cursor: list) -> int:
    return cursor[0][cursor[2]]


def _advance(cursors: list, goal: int) -> list:
    """Cursors moved to their first item from ``goal`` on, without those that have none."""
    live = []
    for c in cursors:
        if c[0][c[2]] < goal:
            c[2] = bisect_left(c[0], goal, c[2])
        if c[2] < len(c[0]):
            live.append(c)
    return live


def build_index(ids: list[int], texts: list[str], questions: list[str], answers: list[str], df: dict[int, int], n_items: int, mean_words: float) -> Index:
    """Index of some items, with document frequencies and mean length over all of them."""
    words = [bw.hash_words(_terms(t)) for t in texts]
    order = sorted(range(len(ids)), key=lambda i: (len(words[i]), ids[i]))
    term, place, score = [], [], []
    for p, i in enumerate(order):
        h, tf = np.unique(words[i], return_counts=True)
        idf = np.log1p([(n_items - df[int(x)] + 0.5) / (df[int(x)] + 0.5) for x in h])
        s = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words[i]) / max(mean_words, 1e-9)))
        if len(h):
            s = s / s.sum()
        term.append(h)
        place.append(np.full(len(h), p))
        score.append(s)
    term, place, score = np.concatenate([*term, np.zeros(0, np.uint64)]), np.concatenate([*place, np.zeros(0, int)]).astype(np.int64), np.concatenate([*score, np.zeros(0)])
    by = np.lexsort((place, term))
    term, place, score = term[by], place[by], score[by]
    terms, starts = np.unique(term, return_index=True)
    number = np.searchsorted(terms, term)
    new = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (place[1:] // BLOCK_ITEMS != place[:-1] // BLOCK_ITEMS)]) if len(term) else np.zeros(0, int)
    block_max = np.maximum.reduceat(score, new) if len(new) else np.zeros(0)
    return Index(
        np.array([ids[i] for i in order], dtype=np.int64), terms, np.r_[starts, len(term)].astype(np.int64), place, score,
        np.searchsorted(number[new], np.arange(len(terms) + 1)).astype(np.int64), place[new] // BLOCK_ITEMS, block_max,
        [_shingles_of(questions[i]) for i in order], [_shingles_of(answers[i]) for i in order],
    )


def _terms(text: str) -> list[str]:
    block = next(bw.blocks(pa.array([text], pa.large_string()), 1 << 62))
    w = bw.words(block, bw.ALNUM)
    return [bytes(bw.LOWER[block.data[a:b]]).decode("utf-8", "replace") for a, b in zip(w.starts, w.ends, strict=True)]


def _shingles_of(text: str) -> np.ndarray:
    """Sorted distinct shingles; fewer words make one of that length."""
    block = next(bw.blocks(pa.array([text], pa.large_string()), 1 << 62))
    values, _ = bw.shingles(bw.words(block, bw.ALNUM), SHINGLE)
    return np.unique(values)


def overlap(part: np.ndarray, own: list[np.ndarray]) -> float:
    """Share of a part's shingles that a document has. ``own``: the document's runs of 1 to 5 words, sorted; a part with
    fewer words than a shingle is looked up among the runs of its length. An empty part is wholly there."""
    if not len(part):
        return 1.0
    return max(float(np.isin(part, own[k]).mean()) for k in range(len(own)))


def _runs(w: bw.Words, text: int) -> list[np.ndarray]:
    """Hashes of all runs of 1 to SHINGLE words of one text, as shingles of as many words have them."""
    a, b = int(w.bounds[text]), int(w.bounds[text + 1])
    out = []
    for length in range(1, SHINGLE + 1):
        n = max(0, b - a - length + 1)
        value = np.full(n, length, dtype=np.uint64)
        for k in range(length):
            value += w.hashes[a + k : a + k + n] * bw._WORD[k]
        out.append(bw.mix(value))
    return out


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Pairs of documents and benchmark items that they contain: the key, item_id, passage (number of the best passage),
    score (relative BM25), question_overlap, answer_overlap.

    Every passage of every document is a query against all items. Null or wordless texts and items find nothing, equal items are
    found each. Rows with one id, or without one, answer as one document: a document and an item make one row, of the passage with the best score, then the
    smallest number. No shuffle of documents, only of what they hold; the index is broadcast in parts of
    at most ``INDEX_WORDS`` words, each part a pass over the documents. Texts are read whole, whatever their length; other columns are not read.
    """
    spark = docs.sparkSession
    q, a = question_answer(F.col("_t"))
    bench = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("_t")).filter("item_id is not null and _t is not null")
    bench = bench.select("item_id", "_t", q.alias("q"), a.alias("a"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, length, item = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = bw.hash_words(_terms(t))
                distinct = np.unique(h)
                term += distinct.view(np.int64).tolist()
                item += [i] * len(distinct)
                length += [len(h)] * len(distinct)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(term, pa.int64()), pa.array(length, pa.int64())], ["item_id", "term", "words"])

    postings = bench.select("item_id", "_t").mapInArrow(count, "item_id long, term long, words long")
    frequencies = postings.groupBy("term").agg(F.count("*").alias("df"))
    sizes = postings.groupBy("item_id").agg(F.max("words").alias("words"))
    stats = sizes.agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.max("words").alias("longest")).first()
    schema = f"`{key}` long, item_id long, passage long, score double, question_overlap double, answer_overlap double"
    if not stats.n:
        return spark.createDataFrame([], schema)
    parts = -(-stats.words // INDEX_WORDS)
    step = max(STEP_WORDS, int(stats.longest))
    out = None
    for part in range(parts):
        own = bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        terms = postings.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).select("term").distinct()
        df = {r.term % (1 << 64): r.df for r in frequencies.join(terms, "term", "left_semi").collect()}
        rows = own.collect()
        index = build_index([r.item_id for r in rows], [r["_t"] for r in rows], [r.q for r in rows], [r.a for r in rows], df, stats.n, stats.words / stats.n)
        found = _scan(docs, spark.sparkContext.broadcast(index), step, key, text, schema)
        out = found if out is None else out.union(found)
    best = F.max_by(F.struct("passage", "score", "question_overlap", "answer_overlap"), F.struct("score", -F.col("passage"), "question_overlap", "answer_overlap"))
    return out.groupBy(key, "item_id").agg(best.alias("_best")).select(key, "item_id", "_best.*")


def _scan(docs: DataFrame, shared, step: int, key: str, text: str, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for block in bw.blocks(batch.column(1)):
                hits = _block_hits(index, block, step)
                if hits:
                    d, i, p, s, x, y = (list(c) for c in zip(*hits, strict=True))
                    keys = batch.column(0).take(pa.array([block.first + k for k in d]))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(i), pa.array(p), pa.array(s), pa.array(x), pa.array(y)], [key, "item_id", "passage", "score", "question_overlap", "answer_overlap"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def _block_hits(index: Index, block: bw.Block, step: int) -> list[tuple]:
    """Verified hits in a block of texts: text, item, passage, score, overlaps."""
    if not len(index.terms):
        return []
    w = bw.words(block, bw.ALNUM)
    at = np.minimum(np.searchsorted(index.terms, w.hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == w.hashes)
    term, owner = at[known], w.owner[known]
    # Passage j of a text has the words from j * step to (j + 2) * step; a text of up to 2 * step words is one passage.
    local = (known - w.bounds[owner]) // step
    words = np.diff(w.bounds)
    count = np.maximum(1, -(-words // step) - 1)
    base = np.concatenate([[0], np.cumsum(count)])
    last = count[owner] - 1
    query = np.concatenate([base[owner] + np.minimum(local, last), base[owner] + np.minimum(np.maximum(local - 1, 0), last)])
    pair = np.unique(query * len(index.terms) + np.concatenate([term, term]))
    query, term = pair // len(index.terms), pair % len(index.terms)
    if not len(pair):
        return []
    queries, blocks = index.reachable_blocks(term, query, THRESHOLD)
    if not len(queries):
        return []
    edges = np.searchsorted(query, np.arange(int(base[-1]) + 1))
    best: dict[tuple[int, int], tuple[float, int]] = {}
    each, first = np.unique(queries, return_index=True)
    for p, own in zip(each.tolist(), np.split(blocks, first[1:]), strict=True):
        text = int(np.searchsorted(base, p, side="right")) - 1
        for item, score in index.search(term[edges[p] : edges[p + 1]], THRESHOLD, own.tolist()):
            if score > best.get((text, item), (0.0, 0))[0]:
                best[text, item] = (score, p - int(base[text]))
    hits, runs = [], {}
    for (text, item), (score, passage) in sorted(best.items()):
        if text not in runs:
            runs = {text: _runs(w, text)}
        x, y = overlap(index.question[item], runs[text]), overlap(index.answer[item], runs[text])
        if x >= OVERLAP and y >= OVERLAP:
            hits.append((text, int(index.ids[item]), passage, score, x, y))
    return hits


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Leaked benchmark items of all documents, one row per document and item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, items)
