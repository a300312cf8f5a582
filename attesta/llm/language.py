"""Language identification that looks at words first and backs off to shorter and shorter character n-grams.

Training counts words and padded n-grams per language in Spark. A known word scores by its log relative
frequency in each language; an unseen word by the mean score of its longest n-grams that are known at all.
A text gets the language with the best mean over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.session import cut_lineage

#: Training uses about this many labelled texts, of each language in equal shares as far as it has them, dealt by hash; whole texts.
TRAIN_TEXTS = 20_000
#: Entries of the model for each language and length (words count as one length).
MODEL_ENTRIES = 20_000
#: Longest n-gram, padding included.
LONGEST = 4
#: Worst score of a word or n-gram, as a negative decimal logarithm, for a language that lacks it.
PENALTY = 7.0

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_BLOCK_CHARS = 1 << 20


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word padded with one space on each side; single characters are not padded."""
    padded = word if n == 1 else f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def even_bound(counts: list[int], total: int) -> float:
    """How many of each count to take at most, so that all together are ``total`` (or all there are)."""
    left, bound = float(total), float(total)
    for k, n in enumerate(sorted(counts)):
        bound = left / (len(counts) - k)
        if n > bound:
            break
        left -= n
    return bound


def train(labelled: DataFrame, text: str, lang: str, key: str) -> Model:
    """A model from labelled texts.

    Texts or languages that are null teach nothing. Counting runs in Spark, pre-aggregated in each task;
    ``MODEL_ENTRIES`` for each language and length come to the driver.
    """
    rows = labelled.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    # One row per language.
    texts_of = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    if sum(texts_of.values()) > TRAIN_TEXTS:
        bound = even_bound(list(texts_of.values()), TRAIN_TEXTS)
        share = F.element_at(F.create_map(*(F.lit(x) for g, n in sorted(texts_of.items()) for x in (g, min(1.0, bound / n)))), F.col("lang"))
    part = rows.filter(F.pmod(F.xxhash64(F.coalesce("key", F.lit("")), F.lit(7)), F.lit(1_000_000)) < share * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, dict[str, int]] = {}
            for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = by_lang.setdefault(g, {})
                for w in words_of(t):
                    counts[w] = counts.get(w, 0) + 1
            for g, counts in by_lang.items():
                for n in range(LONGEST + 1):
                    out: dict[str, int] = counts if not n else {}
                    if n:
                        for w, c in counts.items():
                            for x in grams(w, n):
                                out[x] = out.get(x, 0) + c
                    size = len(out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g] * size, pa.string()), pa.array([n] * size, pa.int32()), pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())],
                        ["lang", "n", "entry", "c"],
                    )

    counts = part.select("text", "lang").mapInArrow(run, "lang string, n int, entry string, c long")
    counts = cut_lineage(counts.groupBy("lang", "n", "entry").agg(F.sum("c").alias("c")))
    # The most frequent entries by a threshold on counts, so that no group has to be sorted as a whole.
    floors = counts.groupBy("lang", "n", "c").agg(F.count("*").alias("entries")).groupBy("lang", "n").agg(
        F.sort_array(F.collect_list(F.struct("c", "entries")), asc=False).alias("steps")
    ).collect()
    langs = sorted({r.lang for r in floors})
    entries: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    scores: list[list[np.ndarray]] = [[] for _ in range(LONGEST + 1)]
    for r in floors:
        # Counts from ``least`` on fit whole; of those with the next count as many as still fit, by a hash order.
        least, kept, step_c = 0, 0, 0
        for step in r.steps:
            if kept + step.entries > MODEL_ENTRIES:
                step_c = step.c
                break
            kept += step.entries
            least = step.c
        these = counts.filter((F.col("lang") == r.lang) & (F.col("n") == r.n)).select("entry", "c")
        own = these.filter(F.col("c") >= least).collect() if least else []
        if step_c:
            own += these.filter(F.col("c") == step_c).orderBy(F.xxhash64("entry"), "entry").limit(MODEL_ENTRIES - kept).collect()
        total = sum(x.c for x in own) or 1
        at, place, rows_of = langs.index(r.lang), entries[r.n], scores[r.n]
        for x in own:
            k = place.setdefault(x.entry, len(rows_of))
            if k == len(rows_of):
                rows_of.append(np.full(len(langs), PENALTY, dtype=np.float32))
            rows_of[k][at] = min(PENALTY, -np.log10(x.c / total))
    return Model(langs, entries, [np.stack(s) if s else np.zeros((0, len(langs)), np.float32) for s in scores])


@dataclass
class Model:
    """Languages, and for each length (0: words) the place of each entry and one row of scores per entry."""

    langs: list[str]
    entries: list[dict[str, int]]
    scores: list[np.ndarray]


class Scorer:
    """Word scores from a model, remembered within a task."""

    def __init__(self, model: Model, remembered: int = 100_000) -> None:
        self.langs, self.model, self.remembered = model.langs, model, remembered
        self.seen: dict[str, int] = {}
        self.rows = np.empty((1024, len(self.langs)), dtype=np.float32)
        self.flat = np.full(len(self.langs), PENALTY, dtype=np.float32)

    def word(self, w: str) -> np.ndarray:
        """Scores of a word in each language."""
        k = self.model.entries[0].get(w)
        if k is not None:
            return self.model.scores[0][k]
        for n in range(LONGEST, 0, -1):
            table = self.model.entries[n]
            known = [table[x] for x in grams(w, n) if x in table]
            if known:
                return self.model.scores[n][known].mean(axis=0)
        return self.flat

    def texts(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language (``und`` without a letter) and a score from 0 to 1 for each text."""
        if len(self.seen) > self.remembered:
            self.seen = {}
        seen = self.seen
        split = [words_of(t) for t in texts]
        for w in {w for s in split for w in s if w not in seen}:
            if len(seen) == len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[len(seen)] = self.word(w)
            seen[w] = len(seen)
        langs, scores = [], []
        for s in split:
            if not s or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            mean = self.rows[[seen[w] for w in s]].mean(axis=0, dtype=np.float64)
            best = int(mean.argmin())
            # Evidence counts with the square root of the words: words of a text are not independent.
            odds = np.exp(-np.log(10) * np.sqrt(len(s)) * (mean - mean[best]))
            langs.append(self.langs[best])
            scores.append(float(1.0 / odds.sum()))
        return langs, scores


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: the key, lang_pred, score (then the columns ``keep``). Equal texts get equal answers.
    Null texts and texts without a letter get ``und`` and 0. Of equally good languages the first in
    the alphabet wins. No shuffle; the model is broadcast, its size bounded by ``MODEL_ENTRIES``. Columns with names that the result uses
    are kept inside a struct of the caller's; others are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:  # some texts at a time, at least one
                before = sizes[first - 1] if first else 0
                stop = max(first + 1, int(np.searchsorted(sizes, before + _BLOCK_CHARS, side="right")))
                part = batch.slice(first, stop - first)
                langs, scores = scorer.texts([t or "" for t in part.column("_text").to_pylist()])
                columns = [part.column(c) for c in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [columns[0], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *columns[1:]],
                    [part.schema.names[0], "lang_pred", "score", *part.schema.names[1:-1]],
                )
                first = stop

    slim = docs.select(F.col(key).alias("_key"), *(F.col(c) for c in keep), F.col(text).cast("string").alias("_text"))
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([slim.schema.fields[0], *made, *slim.schema.fields[1:-1]])
    return slim.mapInArrow(run, schema).withColumnRenamed("_key", key)


def is_held_out(key: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; false without an id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of all documents that are not held out. Those without an id are not learned from."""
    return train(docs.filter(F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2), text, lang, key)


def op7_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, learned(docs))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
