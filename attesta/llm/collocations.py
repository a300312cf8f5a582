"""Frequent phrases of two or more words and how much their words belong together.

Every word sequence of a text gets a fingerprint from prefix polynomials (Rabin-Karp): one over the bytes gives the words'
fingerprints, one over these gives the phrases'. Fingerprints are counted, sizes ascending: a phrase can only be
frequent if the phrase without its first and that without its last word are, which a bit table of fixed size tells, so other phrases are not
shuffled. With the count goes a pointer to a document that holds the phrase, and a second, independent fingerprint. Where two phrases
share a fingerprint, the second one gives it away, and their occurrences are counted again by text. Only frequent phrases become text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import bytewords as bw
from attesta.llm.keyfilter import bit_table, possible
from attesta.llm.skew import join_weighted
from attesta.llm.workspace import Workspace
from attesta.operators.topk import top_k

#: Occurrences that make a phrase a candidate; words of the longest one; share in percent of a phrase's occurrences that a
#: longer one must have to stand for it; phrases reported per language.
LEAST, LONGEST, INSIDE, TOP = 10, 3, 50, 2_000
#: Distinct phrases that a task holds before it hands them on.
HELD = 1 << 18
#: Rows of a batch that a task hands on.
BATCH = 1 << 16

_BREAKS = np.frombuffer(b".,;:!?\n\x0b\x0c\r", dtype=np.uint8)
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, 0x09, *_BREAKS]] = False
_BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_VALUES = [bw.salts(256, 21), bw.salts(256, 22)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def span_prints(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Fingerprint of each span of a sequence of values, the same wherever it stands."""
    power, inverse = _power(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=prefix[1:])
    return bw.mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Grams:
    """Words of a block; ``prints(n)`` has the fingerprints of the n words from each word on, where they lie in one piece."""

    block: bw.Block
    words: bw.Words
    data: np.ndarray
    room: np.ndarray  # how many words there are from this one to the end of its piece
    salt: np.ndarray  # a value per word that tells languages apart
    own: list[np.ndarray]
    bits: int

    def starts(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.room >= n)

    def prints(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        first, second = (bw.mix(span_prints(own, at, at + n, base) ^ self.salt[at]) for own, base in zip(self.own, _BASES, strict=True))
        return first >> np.uint64(64 - self.bits), second

    def text(self, at: int, n: int) -> str:
        w = self.words
        return b" ".join(self.data[w.starts[k] : w.ends[k]].tobytes() for k in range(at, at + n)).decode("utf-8", "replace")


def grams(block: bw.Block, langs: np.ndarray, bits: int = 64) -> Grams:
    """``langs``: a 64-bit value per text of the block."""
    data = bw.LOWER[block.data]
    w = bw.words(block, _IN_WORD)
    breaks = np.concatenate([[0], np.cumsum(np.isin(data, _BREAKS))])
    n = len(w.starts)
    last = np.ones(n, dtype=bool)
    last[:-1] = (breaks[w.starts[1:]] != breaks[w.starts[:-1]]) | (w.owner[1:] != w.owner[:-1])
    ends = np.flatnonzero(last)
    room = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1 if n else np.zeros(0, dtype=np.int64)
    own = [span_prints(values[data], w.starts, w.ends, base) for values, base in zip(_VALUES, _BASES, strict=True)]
    return Grams(block, w, data, room, langs[w.owner], own, bits)


def _lang_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's language among the distinct ones, and a value of each row's language."""
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), bw.hash_words(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]


class _Counts:
    """Counts per (language, fingerprint, second fingerprint), each with the smallest pointer seen."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(self._merged(list(columns)))
        self.size += len(self.parts[-1][0])
        if self.size > HELD:
            self.fold()

    def fold(self) -> None:
        if len(self.parts) > 1:
            self.parts = [self._merged([np.concatenate(c) for c in zip(*self.parts, strict=True)])]
            self.size = len(self.parts[0][0])

    @staticmethod
    def _merged(columns: list[np.ndarray]) -> list[np.ndarray]:
        first, second, lang, n, doc = columns
        order = np.argsort(first, kind="stable")
        first, second, lang, n, doc = (c[order] for c in (first, second, lang, n, doc))
        new = np.ones(len(first), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (lang[1:] != lang[:-1])
        at = np.flatnonzero(new)
        if not len(at):
            return [first, second, lang, n, doc]
        return [first[at], second[at], lang[at], np.add.reduceat(n, at), np.minimum.reduceat(doc, at)]

    def taken(self) -> list[np.ndarray] | None:
        self.fold()
        out = self.parts[0] if self.parts else None
        self.parts, self.size = [], 0
        return out


def _partial_counts(docs: DataFrame, size: int, filters, bits: int) -> DataFrame:
    """lang, fp, check, n, doc: the phrases of ``size`` words whose two shorter parts may be frequent, pre-aggregated in each task.
    Of single words there is a row without fp too, for the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names, words = _Counts(), [], []

        def out() -> Iterator[pa.RecordBatch]:
            found = counts.taken()
            if found is not None and len(found[0]):
                for at in range(0, len(found[0]), BATCH):
                    first, second, lang, n, doc = (c[at : at + BATCH] for c in found)
                    strings = pa.array(names, pa.string()).take(pa.array(lang))
                    yield pa.RecordBatch.from_arrays(
                        [strings, pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(n), pa.array(doc)], ["lang", "fp", "check", "n", "doc"]
                    )

        for batch in batches:
            doc = batch.column(0).to_numpy()
            index, values = _lang_values(batch.column(1))
            here = batch.column(1).dictionary_encode().dictionary.to_pylist()
            for name in here:
                if name not in names:
                    names.append(name)
                    words.append(0)
            index = np.array([names.index(name) for name in here], dtype=np.int64)[index]
            for block in bw.blocks(batch.column(2)):
                texts = slice(block.first, block.first + len(block))
                g = grams(block, values[texts], bits)
                at = g.starts(size)
                if size > 1:
                    shorter = g.starts(size - 1)
                    known = np.zeros(len(g.room) + 1, dtype=bool)
                    known[shorter] = possible(filters.value, g.prints(shorter, size - 1)[0])
                    at = at[known[at] & known[at + 1]]
                else:
                    for k, c in enumerate(np.bincount(index[texts][g.words.owner], minlength=len(names))):
                        words[k] += int(c)
                owner = g.words.owner[at]
                first, second = g.prints(at, size)
                counts.add(first, second, index[texts][owner], np.ones(len(at), dtype=np.int64), doc[texts][owner])
                if counts.size > HELD:
                    yield from out()
        yield from out()
        if size == 1 and names:
            none = pa.nulls(len(names), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names), none, none, pa.array(words, pa.int64()), none], ["lang", "fp", "check", "n", "doc"])

    return docs.mapInArrow(run, "lang string, fp long, check long, n long, doc long")


def _counted(space: Workspace, docs: DataFrame, size: int, filters, least: int, bits: int) -> DataFrame:
    """size, lang, fp, check, n, doc of the phrases with ``least`` occurrences, and the rows without fp."""
    # Each task has counted what it can; counting its rows once more before the shuffle would only take memory.
    partial = _partial_counts(docs, size, filters, bits).repartition("lang", "fp")
    sums = partial.groupBy("lang", "fp").agg(F.sum("n").alias("n"), F.min("check").alias("check"), F.max("check").alias("other"), F.min("doc").alias("doc"))
    sums = space.write(sums.filter((F.col("n") >= least) | F.col("fp").isNull()))
    columns = ["lang", "fp", "check", "n", "doc"]
    out = sums.filter("fp is null or check = other").select(*columns)
    mixed = sums.filter("check < other").select("lang", "fp")
    if not mixed.isEmpty():
        out = out.union(space.write(_counted_by_text(docs, mixed, size, bits).filter(F.col("n") >= least).select(*columns)))
    return out.withColumn("size", F.lit(size))


def _counted_by_text(docs: DataFrame, mixed: DataFrame, size: int, bits: int) -> DataFrame:
    """The phrases behind fingerprints that several share, each with its own count."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(mixed, "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, values = _lang_values(batch.column(1))
            for block in bw.blocks(batch.column(2)):
                g = grams(block, values[block.first : block.first + len(block)], bits)
                at = g.starts(size)
                first, second = g.prints(at, size)
                some = possible(table.value, first)
                at, first, second = at[some], first[some], second[some]
                rows = pa.array(g.words.owner[at] + block.first)
                phrases = pa.array([g.text(k, size) for k in at], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(rows), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), batch.column(0).take(rows), phrases],
                    ["lang", "fp", "check", "doc", "phrase"],
                )

    found = docs.mapInArrow(run, "lang string, fp long, check long, doc long, phrase string")
    found = found.groupBy("lang", "fp", "check", "phrase").agg(F.count("*").alias("n"), F.min("doc").alias("doc"))
    return found.join(mixed, ["lang", "fp"], "left_semi")


_PART = "struct<size:int,fp:bigint,check:bigint>"


def _texts(space: Workspace, docs: DataFrame, candidates: DataFrame, bits: int) -> DataFrame:
    """lang, size, fp, check, a, phrase, parts of each candidate. Its parts are the two sides of every cut, in the order of the cuts."""
    # As many as a document has phrases.
    wanted = candidates.groupBy("doc").agg(F.collect_list(F.struct("size", "fp", "check", F.col("n").alias("a"))).alias("wanted"))
    wanted = space.write(wanted)
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted, "doc"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(possible(table.value, batch.column(0).to_numpy().view(np.uint64))))

    # Copies of a text have one pointer; one of them is read.
    read = docs.mapInArrow(some, docs.schema).dropDuplicates(["doc"]).join(wanted, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, values = _lang_values(batch.column(1))
            wanted_ = batch.column(3)
            for block in bw.blocks(batch.column(2), 1):
                g = grams(block, values[block.first : block.first + 1], bits)
                asked = wanted_[block.first].as_py()
                prints = {n: (at := g.starts(n), *g.prints(at, n)) for n in range(1, max((x["size"] for x in asked), default=0) + 1)}
                place = {}
                for n in {x["size"] for x in asked}:
                    at, first, second = prints[n]
                    keep = np.isin(first.view(np.int64), [x["fp"] for x in asked if x["size"] == n])
                    for k, f, s in zip(at[keep].tolist(), first[keep].view(np.int64).tolist(), second[keep].view(np.int64).tolist(), strict=True):
                        place.setdefault((n, f, s), k)
                out = []
                for x in asked:
                    k = place.get((x["size"], x["fp"], x["check"]))
                    if k is None:
                        continue  # another text with the pointer's value
                    parts = []
                    for cut in range(1, x["size"]):
                        for at, n in ((k, cut), (k + cut, x["size"] - cut)):
                            where, first, second = prints[n]
                            p = np.searchsorted(where, at)
                            parts.append({"size": n, "fp": int(first[p].view(np.int64)), "check": int(second[p].view(np.int64))})
                    out.append((x["size"], x["fp"], x["check"], x["a"], g.text(k, x["size"]), parts))
                if out:
                    columns = list(zip(*out, strict=True))
                    part = pa.list_(pa.struct([("size", pa.int32()), ("fp", pa.int64()), ("check", pa.int64())]))
                    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), part]
                    lang = batch.column(1).take(pa.array([block.first] * len(out)))
                    yield pa.RecordBatch.from_arrays(
                        [lang, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["lang", "size", "fp", "check", "a", "phrase", "parts"]
                    )

    return read.select("doc", "lang", "text", "wanted").mapInArrow(
        run, f"lang string, size int, fp long, check long, a long, phrase string, parts array<{_PART}>"
    )


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int = TOP, bits: int = 64
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts (A-Z lower-cased) end in pieces at ``.,;:!?`` and line ends, pieces in words at blanks and tabs. n is the number of words of the
    language, a that of a phrase's occurrences, overlapping ones included. A phrase of 2 to ``longest`` words with at least ``least`` occurrences is a candidate; each cut
    gives l and r, the occurrences of its two parts, and floor(1000000 a a / (l r)); the lowest counts, the earliest cut of equal ones. A
    candidate goes if a longer one that holds it has at least ``inside`` percent of its occurrences. Order: score and a descending, phrase ascending by bytes.

    Null and empty texts have no words; a null language is ``und``; a table without words gives no rows. Repeated rows count as often as they occur;
    ids and other columns are not looked at. A text of any length is a block of its own. ``bits`` of the fingerprints are used (fewer only to test
    that shared ones are told apart).
    """
    space = Workspace(docs.sparkSession)
    try:
        slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        slim = slim.select(F.xxhash64("lang", "text").alias("doc"), "lang", "text")
        counts, filters = None, None
        for size in range(1, longest + 1):
            found = _counted(space, slim, size, filters, least, bits)
            counts = found if counts is None else counts.union(found)
            if size < longest:
                filters = docs.sparkSession.sparkContext.broadcast(bit_table(found, "fp"))
        candidates = space.write(_texts(space, slim, counts.filter("size > 1"), bits))
        return _ranked(space, candidates, counts, inside, top)
    finally:
        space.remove()


def _ranked(space: Workspace, candidates: DataFrame, counts: DataFrame, inside: int, top: int) -> DataFrame:
    key = ["lang", "size", "fp", "check"]
    part = [F.col("part.size").alias("size"), F.col("part.fp").alias("fp"), F.col("part.check").alias("check")]
    # A phrase inside a longer candidate is inside one with a single word more, which has no fewer occurrences.
    longer = candidates.select("lang", F.col("size").alias("whole"), "a", F.explode("parts").alias("part")).filter("part.size = whole - 1 and part.size > 1")
    longer = longer.select("lang", *part, "a").groupBy(*key).agg(F.max("a").alias("longer"))
    left = candidates.join(longer, key, "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    left = space.write(left.select("lang", "phrase", "a", "parts"))
    cuts = left.select("lang", "phrase", "a", F.posexplode("parts").alias("place", "part")).select("lang", "phrase", "a", "place", *part)
    # One word may be part of a third of all phrases.
    uses = cuts.groupBy(*key).agg(F.count("*").alias("uses"))
    few = space.write(uses.join(counts.select(*key, F.col("n").alias("f")), key))
    total = few.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    known = join_weighted(cuts, few, key, "uses", total, F.xxhash64("phrase", "place"))
    sides = known.groupBy("lang", "phrase", "a", F.floor(F.col("place") / 2).alias("k")).agg(
        F.max(F.when(F.col("place") % 2 == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("place") % 2 == 1, F.col("f"))).alias("r")
    )
    wide = "cast(cast({0} as decimal(19,0)) * cast({1} as decimal(19,0)) as decimal(38,0))"
    sides = sides.withColumn("score", F.expr(f"(cast(1000000 * {wide.format('a', 'a')} as decimal(38,0))) div {wide.format('l', 'r')}"))
    best = sides.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    ranked = top_k(best, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top, "rank", salt_on=["phrase"])
    words = counts.filter("fp is null").select("lang", "n")
    out = ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    # ``top`` rows a language; all else that was written goes.
    return Workspace(candidates.sparkSession).write(out)


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in DuckDB.
COLLOCATIONS_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
lists AS (SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces) WHERE len(w) > 0),
grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM lists
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lists),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
words AS (SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
sides AS (SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM cuts),
scored AS (
  SELECT s.lang, s.size, s.phrase, s.a, s.k, x.f AS l, y.f AS r,
         (1000000 * s.a::HUGEINT * s.a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM sides s JOIN counts x ON x.lang = s.lang AND x.phrase = s.lp AND x.size = s.k
  JOIN counts y ON y.lang = s.lang AND y.phrase = s.rp AND y.size = s.size - s.k),
least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored),
longer AS (SELECT lang, p, max(a) AS f FROM (
  SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS p FROM cand WHERE size = 3) GROUP BY lang, p),
kept AS (
  SELECT l.* FROM least l LEFT JOIN longer g ON l.size = 2 AND g.lang = l.lang AND g.p = l.phrase
  WHERE l.o = 1 AND (g.f IS NULL OR 100 * g.f < 50 * l.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN words USING (lang) WHERE rank <= 2000
"""
