"""Spelling variants: words one inserted, deleted or replaced code point apart, and the frequent form behind each.

Words are compared in blocks by their letter counts. The squared distance of two count vectors follows from one matrix product
(Gram matrix) for all pairs of a block; words one edit apart have a distance of at most two, and their lengths are equal or
adjacent. Such pairs are verified on the words themselves.

A block holds words of two adjacent lengths that agree outside of a free range of code points: an edit lies in one range of a word cut in two, and the rest
is then the same in both words. A block with too many words is cut again at the middle of its range, down to ranges of one code point.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm import bytewords as bw
from attesta.llm.skew import join_weighted
from attesta.llm.workspace import Workspace

#: Least code points and occurrences of a word; how much more frequent its form has to be; of so many checksums one asks for a deletion.
SHORTEST, LEAST, TIMES, DELETED = 7, 2, 10, 31
#: Words of a block beyond which it is cut again.
CROWDED = 1_024
#: Words compared by one matrix product, if no block alone has more.
TOGETHER = 512
#: Runs up to so many bytes are summed side by side; longer ones one by one.
_SIDE_BY_SIDE = 64

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


#: The change of the checksum by each byte; it is linear, so the checksums of single bytes give it.
_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)


def _checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> np.ndarray:
    """zlib's crc32 of each span, going on from the given checksums."""
    out = state.astype(np.uint32)
    order = np.argsort(lengths, kind="stable")[::-1]
    longest = min(int(lengths.max(initial=0)), _SIDE_BY_SIDE)
    register = out[order] ^ np.uint32(0xFFFFFFFF)
    first = starts[order]
    left = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
    for k in range(longest):
        m = left[k]
        part = register[:m]
        register[:m] = _STEP[(part ^ data[first[:m] + k]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    out[order] = register ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(lengths > _SIDE_BY_SIDE):
        rest = data[starts[k] + _SIDE_BY_SIDE : starts[k] + lengths[k]].tobytes()
        out[k] = zlib.crc32(rest, int(out[k]))
    return out


def _runs(block: bw.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends and code points of the runs of letters of a block, and their texts."""
    data = bw.LOWER[block.data]
    n = len(data)
    # In UTF-8 the letters U+00C0 to U+00FF, and no others, begin with 0xC3.
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(n + 1, dtype=bool)
    edge[block.offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    owner = np.searchsorted(block.offsets, starts, side="right") - 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return data, starts, ends, (ends - starts) - (leads[ends] - leads[starts]), owner


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    flat = data[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])


def word_counts(docs: DataFrame, key: str, text: str, shortest: int = SHORTEST) -> DataFrame:
    """word, n: every result of at least ``shortest`` code points with its occurrences, pre-aggregated in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in bw.blocks(batch.column(1)):
                data, starts, ends, points, owner = _runs(block)
                long = points >= shortest
                starts, ends, points, owner = starts[long], ends[long], points[long], owner[long]
                own = ids.slice(block.first, len(block)).to_pylist()
                state = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in own], dtype=np.uint32)
                h = _checksums(data, starts, ends - starts, state[owner])
                cut = h % DELETED == 0
                found = pc.value_counts(_strings(data, starts[~cut], ends[~cut]))
                words, n = found.field(0).cast(pa.string()), found.field(1)
                changed = []
                for k in np.flatnonzero(cut & (points > shortest)):
                    word = data[starts[k] : ends[k]].tobytes().decode()
                    at = int(h[k]) % len(word)
                    changed.append(word[:at] + word[at + 1 :])
                if changed:
                    more = pc.value_counts(pa.array(changed))
                    words, n = pa.concat_arrays([words, more.field(0)]), pa.concat_arrays([n, more.field(1)])
                yield pa.RecordBatch.from_arrays([words, n], ["word", "n"])

    slim = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _range_key(base: Column, lo: Column, hi: Column) -> Column:
    """What words of a block have in common, hashed: the code points before and behind the free range."""
    return F.xxhash64(base, lo, hi, F.expr("substring(word, 1, lo)"), F.expr("right(word, base - hi)"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", _range_key(F.col("base"), F.col("lo"), F.col("hi")))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row (base, lo, hi, word, n) for both halves of its free range."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
    return _keyed(rows.select("base", F.inline(both), "word", "n"))


_KEY = ["base", "lo", "hi", "key"]


def blocked(space: Workspace, words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """base, lo, hi, words (array of word, n): blocks of at least two words in which every near pair occurs. ``base`` is the shorter
    length, lo and hi bound the free range. No block has more than ``crowded`` words unless its range is one code point, of which
    there are so few that these blocks are small as well."""
    n = F.char_length("word")
    whole = words.select(F.explode(F.array(n, n - 1)).alias("base"), "word", "n").select(
        F.col("base").cast("int").alias("base"), F.lit(0).alias("lo"), F.col("base").cast("int").alias("hi"), "word", "n"
    )
    rows = space.write(_halves(whole))
    done = None
    while True:
        sizes = rows.groupBy(*_KEY).agg(F.count("*").alias("members"))
        hot = space.write(sizes.filter((F.col("members") > crowded) & (F.col("hi") - F.col("lo") > 1)).withColumn("hot", F.lit(1)))
        total = hot.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
        if not total:
            part = rows
        else:
            rows = join_weighted(rows, hot, _KEY, "members", total, F.xxhash64("word"))
            part = rows.filter("hot is null")
        part = part.groupBy(*_KEY).agg(F.collect_list(F.struct("word", "n")).alias("words")).filter(F.size("words") > 1).drop("key")
        done = part if done is None else done.union(part)
        if not total:
            return done
        rows = space.write(_halves(rows.filter("hot = 1")))


def _letters(points: np.ndarray) -> tuple[np.ndarray, int]:
    """Code points of the alphabet as numbers from 1, and how many there are."""
    seen = np.unique(points[points > 0])
    return np.where(points > 0, np.searchsorted(seen, points) + 1, 0), len(seen)


def near_pairs(base: int, lo: np.ndarray, hi: np.ndarray, block: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of words of one block that are one edit apart, each where its edit is. ``block``, ``lo`` and ``hi`` are given per word.

    All words have ``base`` or ``base`` + 1 code points; pairs of two longer ones belong to other blocks.
    """
    m = len(words)
    lengths = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(m), lengths)
    column = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
    left = np.zeros((m, base + 1), dtype=np.int64)
    left[row, column] = flat
    left, n_letters = _letters(left)
    right = np.zeros_like(left)
    right[row, column + np.repeat(base + 1 - lengths, lengths)] = left[row, column]
    # Single precision is exact up to 2^24.
    counts = np.zeros((m, n_letters + 1), dtype=np.float32 if base < 2_000 else np.float64)
    np.add.at(counts, (row, left[row, column]), 1)
    square = (counts * counts).sum(axis=1)
    short = np.flatnonzero(lengths == base)
    gap = square[short][:, None] + square[None, :] - 2 * (counts[short] @ counts.T)
    fits = (gap <= 2) & (gap > 0) & (block[short][:, None] == block[None, :])
    fits &= (lengths[None, :] > base) | (short[:, None] < np.arange(m)[None, :])
    a, b = np.nonzero(fits)
    a = short[a]
    if not len(a):
        return a, b
    same = left[a] == left[b]
    prefix = np.where(same.all(axis=1), base + 1, np.argmin(same, axis=1))
    same = right[a, ::-1] == right[b, ::-1]
    suffix = np.where(same.all(axis=1), base + 1, np.argmin(same, axis=1))
    prefix, suffix = np.minimum(prefix, base), np.minimum(suffix, base)
    replaced = lengths[b] == base
    near = np.where(replaced, prefix + suffix == base - 1, prefix + suffix >= base)
    # The leftmost place of the edit decides in which block the pair counts.
    place = np.where(replaced, prefix, base - suffix)
    near &= (lo[a] <= place) & ((place < hi[a]) | ((place == base) & (hi[a] == base)))
    return a[near], b[near]


def _compared(blocks: DataFrame) -> DataFrame:
    """word, near, best (struct of -n and word): per block, how many near words a word has, and the most frequent of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            rows = batch.take(pa.array(order))
            base, lo, hi = (rows.column(i).to_numpy() for i in range(3))
            sizes = pc.list_value_length(rows.column(3)).to_numpy()
            at = 0
            while at < len(base):
                end, size = at + 1, sizes[at]
                while end < len(base) and base[end] == base[at] and size + sizes[end] <= TOGETHER:
                    size += sizes[end]
                    end += 1
                part = rows.column(3).slice(at, end - at).flatten()
                words, n = part.field(0).to_pylist(), part.field(1).to_numpy()
                repeat = sizes[at:end]
                a, b = near_pairs(int(base[at]), np.repeat(lo[at:end], repeat), np.repeat(hi[at:end], repeat), np.repeat(np.arange(end - at), repeat), words)
                at = end
                if not len(a):
                    continue
                one, other = np.concatenate([a, b]), np.concatenate([b, a])
                rank = np.empty(len(words), dtype=np.int64)
                rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
                order = np.lexsort((rank[other], -n[other], one))
                one, other = one[order], other[order]
                first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
                count = np.diff(np.append(first, len(one)))
                column = pa.array(words, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [column.take(pa.array(one[first])), pa.array(count), pa.array(-n[other[first]]), column.take(pa.array(other[first]))],
                    ["word", "near", "less", "form"],
                )

    found = blocks.mapInArrow(run, "word string, near long, less long, form string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))


def _roots(space: Workspace, links: DataFrame) -> DataFrame:
    """word, root for each word with a form: the pointers are doubled until none moves. A form has at least ``TIMES`` times the
    occurrences, so that a chain has no more members than a count has digits."""
    state = space.write(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = space.write(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        state = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return state


def variant_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES, crowded: int = CROWDED
) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of the texts with its near words.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; from a run whose checksum crc32(``<id>:<run>``) is a multiple of 31
    the code point at checksum modulo length goes. Words of fewer than ``shortest`` code points or ``least`` occurrences (n) are left out. Near
    words differ by one code point inserted, deleted or replaced; n_near counts them. form is the near word of largest n, the smallest of equal
    ones, if its n is at least ``times`` times the word's, else null; root is what forms lead to in the end, the word itself without one.

    Null and empty texts have no words; a null id counts as an empty one; repeated rows count as often as they occur; an empty table gives no rows; other
    columns are not looked at. A text of any length is a block of its own.
    """
    space = Workspace(docs.sparkSession)
    try:
        words = space.write(word_counts(docs, key, text, shortest).filter(F.col("n") >= least))
        near = _compared(blocked(space, words, crowded))
        form = F.when(-F.col("best.less") >= times * F.col("n"), F.col("best"))
        found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"))
        found = space.write(found.select("word", "n", "n_near", F.col("form.form").alias("form"), (-F.col("form.less")).alias("form_n")))
        roots = _roots(space, found.filter("form is not null"))
        out = found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
        return Workspace(docs.sparkSession).write(out.select("word", "form", "root", "n", "n_near", "form_n"))
    finally:
        space.remove()


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """The words of all documents with their spelling variants."""
    return variant_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
