"""Removal of repeated passages: each byte of a fixed number of bytes in a row that also start earlier in the corpus.

Strings of ``LENGTH`` bytes (windows) meet by an anchor: the ``GRAM`` bytes in a window with the smallest hash, the leftmost of equal ones. Equal
windows have equal anchors, and neighbouring windows mostly share one, so a text has few anchors. A stretch is a run of windows with one anchor.
Stretches whose anchor occurs once hold nothing repeated. Of equal stretches all but the first are repeated as a whole. Different
stretches with one anchor are compared by a suffix array of them, built by grouping (``suffix_groups``): suffixes that share
their first ``LENGTH`` bytes lie side by side in it, and all but the earliest are repeated.

An anchor with too many different stretches is split: windows that reach far to its left and windows that reach far to its right are put together by more of
what they have in common, down to single windows, of which only equal ones meet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.arrays import pieces
from attesta.llm import bytewords as bw
from attesta.llm.keyfilter import bit_table, possible
from attesta.llm.skew import join_weighted
from attesta.llm.suffix_groups import suffix_orders
from attesta.llm.workspace import Workspace

LENGTH, GRAM = 100, 32
#: Different stretches of an anchor beyond which it is split; bytes sorted side by side.
CROWDED, SORTED_BYTES = 16, 1 << 20
#: Windows handled at once, and those of them whose anchors are looked for at once.
_PIECE, _CACHED = 1 << 20, 1 << 14


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbouring values."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _anchors(prefix: np.ndarray, at: int, end: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows that begin at ``at``, ``at`` + 1, ... before ``end``: hash and place (from ``at``) of the anchor as one number, and
    the hashes of all grams from ``at`` on."""
    bits, width = np.uint64(21), length - gram + 1
    best, hashes = np.empty(end - at, dtype=np.uint64), np.empty(end - at + width - 1, dtype=np.uint64)
    # Some at a time, so that what is in between stays in the processor's cache.
    for lo in range(at, end, _CACHED):
        hi = min(end, lo + _CACHED)
        h = bw.window_hashes(prefix, lo, hi + width - 1, gram)
        hashes[lo - at : hi - at + width - 1] = h
        # The place in the low bits makes the leftmost of equal hashes the smallest.
        h >>= bits
        h <<= bits
        h |= np.arange(lo - at, hi - at + width - 1, dtype=np.uint64)
        best[lo - at : hi - at] = _smallest(h, width)
    return best, hashes


def stretches(
    block: bw.Block, length: int = LENGTH, gram: int = GRAM, prefix: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, place and hash of the anchor of every stretch of a block. ``prefix``: the running sums of its bytes, if they are at hand."""
    prefix = bw.running_sums(block.data) if prefix is None else prefix
    found: list[list[np.ndarray]] = [[], [], [], []]
    # Windows from here to the end of the document are not whole.
    cut = np.maximum(block.offsets[:-1], block.offsets[1:] - length + 1)
    borders = np.concatenate([block.offsets[:-1], cut])
    windows = max(0, len(block.data) - length + 1)
    for at in range(0, windows, _PIECE):
        end = min(windows, at + _PIECE)
        best, hashes = _anchors(prefix, at, end, length, gram)
        new = np.ones(len(best), dtype=bool)
        new[1:] = best[1:] != best[:-1]
        new[borders[(borders >= at) & (borders < end)] - at] = True
        edges = np.flatnonzero(new)
        owner = np.searchsorted(block.offsets, edges + at, side="right") - 1
        whole = edges + at < cut[owner]
        first, count = edges[whole], np.diff(np.append(edges, len(best)))[whole]
        place = (best[first] & np.uint64((1 << 21) - 1)).astype(np.int64)
        for column, values in zip(found, (first + at, count, place + at, hashes[place]), strict=True):
            column.append(values)
    if not found[0]:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in found)  # type: ignore[return-value]


def _content(block: bw.Block, first: np.ndarray, count: np.ndarray, place: np.ndarray, length: int, prefix: np.ndarray) -> np.ndarray:
    """A hash of each stretch and of where its anchor lies in it."""
    return bw.mix(bw.span_hashes(block.data, first, first + count + length - 1, prefix) + (place - first).astype(np.uint64))


def _repeated_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, several: the anchors that occur more than once, and whether with different stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch.column(0)):
                prefix = bw.running_sums(block.data)
                first, count, place, anchor = stretches(block, length, gram, prefix)
                content = _content(block, first, count, place, length, prefix)
                order = np.lexsort((content, anchor))
                a, c = anchor[order], content[order]
                at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])[: len(a)])
                n = np.diff(np.append(at, len(a)))
                yield pa.RecordBatch.from_arrays([pa.array(a[at].view(np.int64)), pa.array(c[at].view(np.int64)), pa.array(n)], ["anchor", "content", "n"])

    found = docs.select("text").mapInArrow(run, "anchor long, content long, n long").groupBy("anchor")
    found = found.agg(F.sum("n").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    return found.filter("n > 1").select("anchor", (F.col("lo") < F.col("hi")).alias("several"))


def _merged(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each owner with those that touch or overlap made one. They are given in ascending order of owner and start, and
    ends ascend with the starts."""
    if not len(starts):
        return starts, ends, owner
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] > ends[:-1])])
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:], len(starts)) - 1], owner[at]


def _ranks(late: np.ndarray, ids: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Place of each document in the order of documents; equal ones share it."""
    by = np.lexsort((own, ids, late))
    changes = (own[by][1:] != own[by][:-1]) | (ids[by][1:] != ids[by][:-1]) | (late[by][1:] != late[by][:-1])
    out = np.empty(len(by), dtype=np.int64)
    out[by] = np.concatenate([[0], np.cumsum(changes)])
    return out


#: Where a document stands: those without an id last, then by id, then by a hash of the text.
_DOC = ["late", "id", "own"]
_RANGES = "array<struct<start:bigint,end:bigint>>"
_ITEM = "key long, late boolean, id long, own long, at long, low int, high int, content long, bytes binary"


def _range_lists(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Ranges as a list per owner, and the owners."""
    some, first = np.unique(owner, return_index=True)
    pairs = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)).astype(np.int32)), pairs), some


def _items(docs: DataFrame, table, several, length: int, gram: int) -> DataFrame:
    """Rows of two kinds. With a key: a stretch whose anchor may be repeated; ``low`` and ``high`` say how far before the anchor its
    last and its first window begin; it has its bytes if its anchor may have different ones. Without: ranges of a document that are repeated for certain, because an equal stretch stands earlier in
    the same block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch.column(3)):
                prefix = bw.running_sums(block.data)
                first, count, place, anchor = stretches(block, length, gram, prefix)
                some = possible(table.value, anchor)
                first, count, place, anchor = first[some], count[some], place[some], anchor[some]
                if not len(first):
                    continue
                own = batch.slice(block.first, len(block))
                late, ids, hashes = (own.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                rank = _ranks(late, ids, hashes)
                owner = np.searchsorted(block.offsets, first, side="right") - 1
                content = _content(block, first, count, place, length, prefix)
                order = np.lexsort((first - block.offsets[owner], rank[owner], place - first, content, anchor))
                a, c, d = anchor[order], content[order], (place - first)[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
                # Rows that are equal stand at one place; such a stretch does not repeat the first one.
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                r, f = rank[owner[order]], (first - block.offsets[owner])[order]
                kept, again = order[new], np.sort(order[(r != r[lead]) | (f != f[lead])])
                raw, compared = block.data.tobytes(), possible(several.value, anchor[kept])
                doc = owner[kept]
                columns = [own.column(i).take(pa.array(doc)) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[kept].view(np.int64)), *columns, pa.array(first[kept] - block.offsets[doc]),
                        pa.array((place - first - count + 1)[kept].astype(np.int32)), pa.array((place - first)[kept].astype(np.int32)),
                        pa.array(content[kept].view(np.int64)),
                        pa.array([raw[x : x + k + length - 1] if c else None for x, k, c in zip(first[kept].tolist(), count[kept].tolist(), compared, strict=True)], pa.binary()),
                        pa.nulls(len(kept), _LIST),
                    ],
                    names,
                )
                if len(again):
                    doc = owner[again]
                    at = first[again] - block.offsets[doc]
                    lists, docs_ = _range_lists(*_merged(at, at + count[again] + length - 1, doc))
                    columns = [own.column(i).take(pa.array(docs_)) for i in range(3)]
                    none = [pa.nulls(len(docs_), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(docs_), pa.int64()), *columns, *none, lists], names)

    names = ["key", *_DOC, "at", "low", "high", "content", "bytes", "ranges"]
    return docs.select(*_DOC, "text").mapInArrow(run, f"{_ITEM}, ranges {_RANGES}")


_LIST = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _halves(items: DataFrame, length: int) -> DataFrame:
    """Stretches of crowded keys, each as its windows that begin far before the anchor and as the others. ``from`` and ``to`` bound the key's
    windows; a half's key holds what all its windows have in common."""
    middle = F.floor((F.col("from") + F.col("to")) / 2).cast("int")
    both = F.array(F.struct("from", middle.alias("to")), F.struct((middle + 1).alias("from"), "to"))
    part = items.select("key", *_DOC, "at", "low", "high", "bytes", F.inline(both))
    part = part.withColumn("l", F.greatest("low", "from")).withColumn("h", F.least("high", "to")).filter("l <= h")
    # The anchor lies ``high`` bytes after the first window's begin, ``h`` after that of the first one in this half.
    part = part.withColumn("bytes", F.expr(f"substring(bytes, high - h + 1, h - l + {length})")).withColumn("at", F.expr("at + high - h"))
    common = F.expr(f"substring(bytes, h - `from` + 1, {length} - `to` + `from`)")
    return part.select(
        F.xxhash64("key", "from", "to", common).alias("key"),
        *_DOC, "at", F.col("l").alias("low"), F.col("h").alias("high"), F.xxhash64("bytes").alias("content"), "bytes", "from", "to",
    )


def _sorted(sets: DataFrame, length: int) -> DataFrame:
    """late, id, own, ranges: what the suffix array of each set of stretches shows to be repeated."""

    def some(sets_: pa.Array) -> pa.RecordBatch | None:
        offsets = sets_.offsets.to_numpy() - sets_.offsets[0].as_py()
        rows = sets_.flatten()
        late, ids, own, at = (rows.field(k).to_numpy(zero_copy_only=False) for k in (*_DOC, "at"))
        content = rows.field("bytes").cast(pa.large_binary())
        borders = np.frombuffer(content.buffers()[1], dtype=np.int64)[content.offset : content.offset + len(content) + 1]
        data = np.frombuffer(content.buffers()[2], dtype=np.uint8)[borders[0] : borders[-1]]
        borders = borders - borders[0]
        order = suffix_orders(data, borders, borders[offsets])
        string = np.searchsorted(borders, order, side="right") - 1
        # Only whole windows matter; they are in order, equal ones side by side.
        whole = order + length <= borders[string + 1]
        order, string = order[whole], string[whole]
        set_of = np.searchsorted(offsets, string, side="right") - 1
        same = np.flatnonzero(set_of[1:] == set_of[:-1])
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        eight = np.zeros(len(data), dtype=np.uint64)
        for k in range(8):
            eight |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(8 * k)
        for k in [*range(0, length - 7, 8), length - 8]:
            same = same[eight[order[same] + k] == eight[order[same + 1] + k]]
        new = np.ones(len(order), dtype=bool)
        new[same + 1] = False
        start = np.flatnonzero(new)
        # Documents in their order, then places in them.
        doc = _ranks(late, ids, own)
        inside = order - borders[string]
        position = (doc[string] << 40) + at[string] + inside
        earliest = np.minimum.reduceat(position, start) if len(start) else position
        again = position > np.repeat(earliest, np.diff(np.append(start, len(order))))
        string, inside = string[again], inside[again]
        if not len(string):
            return None
        by = np.lexsort((inside, string))
        string, inside = string[by], inside[by]
        starts = at[string] + inside
        lists, found = _range_lists(*_merged(starts, starts + length, string))
        which = pa.array(found)
        return pa.RecordBatch.from_arrays([*(rows.field(k).take(which) for k in _DOC), lists], [*_DOC, "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Sets of like size go together, since each step goes through all of them.
            size = batch.column(1).to_numpy()
            order = np.argsort(size, kind="stable")
            column = batch.column(0).take(pa.array(order))
            total = np.cumsum(size[order])
            at = 0
            while at < len(order):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SORTED_BYTES, side="right")))
                out = some(column.slice(at, end - at))
                at = end
                if out is not None:
                    yield out

    return sets.mapInArrow(run, f"late boolean, id long, own long, ranges {_RANGES}")


def _repeated_ranges(space: Workspace, docs: DataFrame, length: int, gram: int, crowded: int) -> DataFrame:
    """late, id, own, ranges: repeated ranges of documents, which may overlap; a document may have several rows."""
    anchors = space.write(_repeated_anchors(docs, length, gram))
    sc = docs.sparkSession.sparkContext
    table, several = sc.broadcast(bit_table(anchors, "anchor")), sc.broadcast(bit_table(anchors.filter("several"), "anchor"))
    rows = space.write(_items(docs, table, several, length, gram))
    columns = [*_DOC, "ranges"]
    found = rows.filter("key is null").select(*columns)
    items = rows.filter("key is not null").drop("ranges").withColumn("from", F.lit(0)).withColumn("to", F.lit(length - gram))
    kind = ["key", "content", "high"]
    while True:
        place = F.struct(*_DOC, "at")
        classes = items.groupBy(*kind).agg(
            F.min(place).alias("first"), F.count("*").alias("members"), F.min("low").alias("low"), F.min("bytes").alias("bytes"),
            F.min("from").alias("from"), F.min("to").alias("to"),
        )
        classes = space.write(classes)
        repeated = classes.filter("members > 1").select(*kind, "first", "members")
        total = repeated.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
        slim = items.select(*kind, *_DOC, "at", "low")
        later = join_weighted(slim, repeated, kind, "members", total, F.xxhash64(*_DOC, "at")).filter(F.col("first").isNotNull() & (place != F.col("first")))
        end = F.col("at") + F.col("high") - F.col("low") + length
        found = found.union(space.write(later.select(*_DOC, F.array(F.struct(F.col("at").alias("start"), end.cast("long").alias("end"))).alias("ranges"))))
        sizes = space.write(classes.groupBy("key").agg(F.count("*").alias("different")).filter("different > 1"))
        fits = classes.join(sizes.filter(F.col("different") <= crowded), "key")
        # At most ``crowded`` stretches a set.
        sets = fits.groupBy("key").agg(F.collect_list(F.struct(*(F.col(f"first.{c}").alias(c) for c in (*_DOC, "at")), "bytes")).alias("items"), F.sum(F.length("bytes")).alias("size"))
        found = found.union(space.write(_sorted(sets.select("items", "size"), length)))
        # Written down, so that its size is known before the join: a few keys need no shuffle of all classes.
        hot = space.write(sizes.filter(F.col("different") > crowded))
        total = hot.agg(F.coalesce(F.sum("different"), F.lit(0))).first()[0]
        if not total:
            return found
        many = join_weighted(classes, hot.withColumn("hot", F.lit(1)), ["key"], "different", total, F.col("content")).filter("hot = 1")
        items = space.write(_halves(many.select("key", "first.*", "low", "high", "bytes", "from", "to"), length))


def remove_repeated_passages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED
) -> DataFrame:
    """The key, n_bytes, spans (array of start, end), kept (binary) of every row: the bytes of its text in UTF-8 without those of
    strings of ``length`` bytes that also start earlier, in a document with a smaller id or before in the same one. Overlaps count, and
    what is earlier is judged on the whole input. Spans are the maximal removed runs.

    Null and empty texts have no bytes; texts of fewer than ``length`` bytes lose none. Rows without an id come after all others. Rows with
    one id are ordered by a hash of their texts; rows with one id and one text count as one document, and each has its result. An empty table gives no rows;
    other columns are not looked at. A text of any length is read as a whole, in pieces that overlap.
    """
    space = Workspace(docs.sparkSession)
    try:
        body = F.coalesce(F.col(text).cast("string"), F.lit(""))
        number = F.col(key).cast("long")
        slim = docs.select(number.isNull().alias("late"), F.coalesce(number, F.lit(0)).alias("id"), F.xxhash64(body).alias("own"), body.alias("text"))
        # Rows that are equal stand at one place, so one does not make the other a repeat.
        found = _repeated_ranges(space, slim, length, gram, crowded)
        # As many ranges as a document has stretches.
        lists = found.groupBy(*_DOC).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
        lists = Workspace(docs.sparkSession).write(lists)
    finally:
        space.remove()
    # Documents without such ranges need not move. They are read and written in one go, so that a task keeps one Python worker busy, not two.
    table = docs.sparkSession.sparkContext.broadcast(bit_table(lists, "own"))

    def part(batch: pa.RecordBatch, repeated: bool) -> pa.RecordBatch:
        return batch.filter(pa.array(possible(table.value, batch.column(2).to_numpy().view(np.uint64)) == repeated))

    def with_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield part(batch, True)

    def as_they_are(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = part(batch, False)
            late, number, _, texts = some.columns
            yield from _without([pa.RecordBatch.from_arrays([late, number, texts, pa.nulls(len(some), _LIST)], columns)])

    columns = ["late", "id", "text", "ranges"]
    result = f"late boolean, id long, n_bytes long, spans {_RANGES}, kept binary"
    moved = slim.mapInArrow(with_ranges, slim.schema).join(lists, _DOC, "left").select(*columns).mapInArrow(_without, result)
    out = moved.union(slim.mapInArrow(as_they_are, result))
    return out.select(F.when(~F.col("late"), F.col("id")).alias(key), "n_bytes", "spans", "kept")


def _without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for texts in pieces(batch.column(2)):
            n_bytes, spans, kept = [], [], []
            for text, ranges in zip(texts, batch.column(3).slice(at, len(texts)), strict=True):
                raw = text.as_buffer().to_pybytes()
                gone: list[list[int]] = []
                if ranges.is_valid:
                    pairs = ranges.values
                    starts, ends = pairs.field(0).to_numpy(), pairs.field(1).to_numpy()
                    order = np.argsort(starts, kind="stable")
                    starts, ends = starts[order], np.maximum.accumulate(ends[order])
                    starts, ends, _ = _merged(starts, ends, np.zeros(len(starts), dtype=np.int64))
                    gone = np.stack([starts, ends], axis=1).tolist()
                rest, end = [], 0
                for a, b in gone:
                    rest.append(raw[end:a])
                    end = b
                rest.append(raw[end:])
                n_bytes.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in gone])
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(at, len(texts)) for i in (0, 1)), pa.array(n_bytes, pa.int64()), pa.array(spans, _LIST), pa.array(kept, pa.binary())],
                ["late", "id", "n_bytes", "spans", "kept"],
            )
            at += len(texts)


def op13_passages(spark, sf_dir: str) -> DataFrame:
    """What is left of all documents without repeated passages, in numbers."""
    out = remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
