"""Pairs of near duplicates, found exactly and without comparing everything.

Hamming pairs come from blocking: a 64-bit value is cut into blocks, and two
values that differ in at most ``d`` bits agree on all blocks but ``d``. Every way
of leaving out ``d`` blocks is one table of masked values, and equal masked values
are candidates. A bucket that is still crowded is blocked again on the bits its
mask leaves free, so no bucket is ever compared in full while it is hot.

Cosine pairs come from cells around pivots: a vector belongs to its nearest pivot
and is copied to every cell whose border it is close enough to for a match to lie
beyond. A crowded cell is cut again around pivots of its own, as often as that saves
comparisons; of a large one a bounded sample is cut first, so that copies are made only
where they pay. Vectors tightly around one pivot all match each other; they become a group
key instead of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.simhash import hamming
from attesta.operators.topk import top_k
from attesta.session import cut_lineage

BUCKET_ROWS = 1000
MAX_TABLES = 400
MAX_PIVOTS = 256
BLOCK_ROWS = 2048
# Pivots that cut a crowded cell, and rows of it that one task places.
SPLIT_PIVOTS = 16
PLACE_ROWS = 8192
# A cut stands if it leaves less than this share of the comparisons. Rows of a large cell that tell it beforehand.
WORTH = 0.7
TRIED_ROWS = 4096
# Blocks of a cell as long as none has more than so many numbers, and rows and columns of scores held at once.
BLOCKS = 16
BLOCK_VALUES = 1 << 22
TILE = (1024, 4096)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _masks(bits: list[int], d: int, n_values: float) -> list[int]:
    """Masks over ``bits`` so that two values at most ``d`` bits apart agree on
    at least one. More blocks mean longer keys and more copies; the number is
    chosen for the lower expected cost at ``n_values``."""
    best: tuple[float, int] | None = None
    for blocks in range(d + 1, min(len(bits), d + 4) + 1):
        tables = math.comb(blocks, d)
        if tables > MAX_TABLES:
            break
        key_bits = len(bits) * (blocks - d) / blocks
        cost = tables * (1 + n_values / 2**key_bits)
        if best is None or cost < best[0]:
            best = (cost, blocks)
    if best is None:
        return [0]
    cuts = [round(i * len(bits) / best[1]) for i in range(best[1] + 1)]
    parts = [bits[lo:hi] for lo, hi in zip(cuts, cuts[1:])]
    masks = []
    for left_out in combinations(range(best[1]), d):
        masks.append(sum(1 << b for i, p in enumerate(parts) if i not in left_out for b in p))
    return masks


def _literal(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)).cast("bigint") for m in masks])


def hamming_pairs(values: DataFrame, col: str, max_distance: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All ``(a, b)`` with ``a < b`` among the distinct non-zero values of ``col``
    that differ in at most ``max_distance`` bits.

    The values must be distinct already: copies share a value and are no pairs.
    """
    # Every step below reads the values again, and a filter that Spark moves down to a Python column computes it twice;
    # so they are made once, and before the filter.
    values = cut_lineage(values.select(F.col(col).alias("h"))).filter("h != 0")
    n = values.count()
    masks = _masks(list(range(64)), max_distance, n)
    rows = values.select(
        "h", F.posexplode(F.transform(_literal(masks), lambda m: F.col("h").bitwiseAND(m))).alias("t", "k")
    )
    found: list[DataFrame] = []
    while True:
        sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        sizes = cut_lineage(sizes)
        hot = sizes.filter(F.col("n") > bucket_rows).select("t", "k")
        cold = sizes.filter(F.col("n") <= bucket_rows).select("t", "k")
        # Only values that share a bucket go into the pair join.
        found.append(_pairs_in_buckets(rows.join(cold, ["t", "k"], "left_semi"), max_distance))
        if hot.isEmpty():
            break
        crowded = rows.join(hot, ["t", "k"], "left_semi")
        finer = [
            _masks([b for b in range(64) if not m >> b & 1], max_distance, n) for m in masks
        ]
        if all(f == [0] for f in finer) or sum(map(len, finer)) > 20 * MAX_TABLES:
            # Too few free bits to block again: a bucket holds at most as many
            # distinct values as its free bits can spell.
            found.append(_pairs_in_buckets(crowded, max_distance))
            break
        starts = np.cumsum([0] + [len(f) for f in finer]).tolist()
        nested = F.array(*[_literal([m | x for x in f]) for m, f in zip(masks, finer)])
        offsets = F.array(*[F.lit(s) for s in starts])
        rows = crowded.select(
            "h",
            F.get(offsets, F.col("t")).alias("o"),
            F.posexplode(F.transform(F.get(nested, F.col("t")), lambda m: F.col("h").bitwiseAND(m))).alias("p", "k"),
        ).select("h", (F.col("o") + F.col("p")).alias("t"), "k")
        masks = [m | x for m, f in zip(masks, finer) for x in f]
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.distinct()


def _pairs_in_buckets(rows: DataFrame, max_distance: int) -> DataFrame:
    a = rows.select("t", "k", F.col("h").alias("a"))
    b = rows.select("t", "k", F.col("h").alias("b"))
    near = (F.col("a") < F.col("b")) & (hamming("a", "b") <= max_distance)
    return a.join(b, ["t", "k"]).filter(near).select("a", "b")


def _matrix(column: pa.Array) -> np.ndarray:
    return flat_matrix(column).astype(np.float64)


def flat_matrix(column: pa.Array) -> np.ndarray:
    """A row per vector, in the type of the column."""
    lengths = pc.list_value_length(column)
    if pc.min(lengths) != pc.max(lengths):
        raise ValueError("vectors of different lengths cannot be compared")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _thinned(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Unit vectors in the given order, without those inside the tight ball of one before."""
    inside = math.cos(math.acos(threshold) / 2)
    kept: list[np.ndarray] = []
    for v in vectors.astype(np.float64):
        v = v / (np.linalg.norm(v) or 1.0)
        if all(float(v @ p) < inside for p in kept):
            kept.append(v)
    return np.stack(kept)


def _pivots(vectors: DataFrame, threshold: float) -> np.ndarray:
    """A bounded sample of vectors, thinned."""
    want = max(1, min(MAX_PIVOTS, vectors.count() // BLOCK_ROWS))
    sample = vectors.orderBy(F.xxhash64("id")).limit(want).collect()
    return _thinned(np.array([row["v"] for row in sample]), threshold)


def block_limit(dim: int) -> int:
    """Vectors of ``dim`` numbers in one block at most."""
    return max(1, BLOCK_VALUES // max(1, dim))


def tiles(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Dots of all rows of both in double precision, in pieces of a bounded size with their first row and column."""
    for j in range(0, len(right), TILE[1]):
        columns = right[j : j + TILE[1]].astype(np.float64).T
        for i in range(0, len(left), TILE[0]):
            yield i, j, left[i : i + TILE[0]].astype(np.float64) @ columns


PLACED = "up string, cell string, foreign bigint, core boolean, near_core boolean, id bigint, v array<float>"
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32())}
_NONE_PLACED = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in PLACED.split(", ")]).empty_table()


def _place(up: str, depth: int, ids: pa.Array, vectors: pa.Array, foreign: np.ndarray, pivots: np.ndarray, threshold: float) -> pa.Table:
    """The rows of one cell, ``up``, in the cells around ``pivots``. ``foreign`` has a bit per depth, set for a copy."""
    angle, slack = math.acos(threshold), 1e-6
    tight = math.cos(angle / 2) + slack
    reach = math.cos(min(math.pi, 1.5 * angle)) - slack
    gap = math.sqrt(max(0.0, 2 - 2 * threshold)) + slack
    apart = np.linalg.norm(pivots[:, None, :] - pivots[None, :, :], axis=2)
    np.fill_diagonal(apart, 1.0)
    dots = _matrix(vectors) @ pivots.T
    home = dots.argmax(axis=1)
    best = dots[np.arange(len(home)), home]
    # Distance to the border with each other cell; the lower cell of two receives the copy.
    row, cell = np.nonzero((best[:, None] - dots) / apart[home] <= gap)
    keep = cell <= home[row]
    row, cell = row[keep], cell[keep]
    foreign = foreign[row] | np.where(cell == home[row], 0, 1 << depth)
    names = pa.array([f"{up}.{c}" for c in range(len(pivots))])
    columns = [
        pa.array(np.full(len(row), up, dtype=object), pa.string()),
        names.take(pa.array(cell)),
        pa.array(foreign),
        pa.array((foreign == 0) & (best[row] >= tight)),
        pa.array(dots[row, cell] >= reach),
        ids.take(pa.array(row)),
        vectors.take(pa.array(row)),
    ]
    return pa.table(columns, names=["up", "cell", "foreign", "core", "near_core", "id", "v"])


def _cut(rows: DataFrame, sizes: DataFrame, depth: int, threshold: float) -> DataFrame:
    """The rim rows of crowded cells in cells of their own; ``sizes`` has these cells with their ``rim``."""
    rows = rows.filter("NOT core").join(sizes.select("cell", F.ceil(F.col("rim") / PLACE_ROWS).alias("tasks")), "cell")
    chosen = top_k(rows, ["cell"], [F.xxhash64("id"), F.col("id")], SPLIT_PIVOTS, salt_on=["id"])
    chosen = chosen.select("cell", "tasks", "rn", F.col("v").alias("pivot"))
    chosen = chosen.withColumn("task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)))
    rows = rows.select("cell", F.pmod(F.xxhash64("id"), F.col("tasks")).alias("task"), "foreign", "id", "v")

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return _NONE_PLACED
        left, right = left.combine_chunks(), right.sort_by("rn").combine_chunks()
        pivots = _thinned(_matrix(right["pivot"].combine_chunks()), threshold)
        foreign = left["foreign"].to_numpy()
        return _place(left["cell"][0].as_py(), depth, left["id"].combine_chunks(), left["v"].combine_chunks(), foreign, pivots, threshold)

    # New names: both sides come from the same rows.
    chosen = chosen.select(F.col("cell").alias("c"), F.col("task").alias("t"), "rn", "pivot")
    return cut_lineage(rows.groupBy("cell", "task").cogroup(chosen.groupBy("c", "t")).applyInArrow(place, PLACED))


def _sizes(placed: DataFrame) -> DataFrame:
    counts = [F.count_if(~F.col("core")).alias("rim"), F.count_if("core").alias("cores")]
    return cut_lineage(placed.groupBy("up", "cell").agg(*counts))


def _promising(placed: DataFrame, crowded: DataFrame, depth: int, threshold: float) -> DataFrame:
    """The crowded cells without those large ones of which a sample says that a cut saves too little."""
    large = cut_lineage(crowded.filter(F.col("rim") > 4 * TRIED_ROWS))
    if large.isEmpty():
        return crowded
    every = F.floor(F.col("rim") / TRIED_ROWS)
    sample = placed.filter("NOT core").join(large.select("cell", every.alias("every")), "cell")
    sample = cut_lineage(sample.filter(F.pmod(F.xxhash64("id", F.lit(depth)), F.col("every")) == 0).drop("every"))
    sizes = cut_lineage(sample.groupBy("cell").agg(F.count("*").alias("rim")))
    left = _left_over(_sizes(_cut(sample, sizes, depth, threshold)))
    poor = sizes.join(left, "cell").filter(F.col("left") > WORTH * F.col("rim") * F.col("rim")).select("cell")
    return cut_lineage(crowded.join(poor, "cell", "left_anti"))


def _left_over(child_sizes: DataFrame) -> DataFrame:
    """Comparisons that a cut leaves of each cell."""
    return child_sizes.groupBy(F.col("up").alias("cell")).agg(F.sum(F.col("rim").cast("double") * F.col("rim")).alias("left"))


def _fitting_cells(placed: DataFrame, block_rows: int, threshold: float, most_rows: int | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Cut crowded cells until they fit or a cut saves too little. Returns the rows of all depths with ``nr`` and ``nc``, the
    blocks of rim and core rows in their cell, and ``deep``, true where the rim rows meet each other in cells further down;
    and ``(id, ball)`` of all depths. A cell has up to ``BLOCKS`` blocks of more than ``block_rows`` rows, so that copies for
    comparing do not grow with its size; with ``most_rows`` in each it has more."""
    parts, balls, depth = [], [], 0
    most_rows = max(block_rows, most_rows or block_rows)
    sizes = _sizes(placed)
    while True:
        balls.append(placed.filter("core").select("id", F.col("cell").alias("ball")))
        crowded = sizes.filter(F.col("rim") > 2 * block_rows)
        if depth < 61:
            crowded = _promising(placed, crowded, depth + 1, threshold)
        if depth == 61 or crowded.isEmpty():
            below, split = None, sizes.select("cell").limit(0)
        else:
            below = _cut(placed, crowded, depth + 1, threshold)
            child_sizes = _sizes(below)
            split = crowded.join(_left_over(child_sizes), "cell").filter(F.col("left") <= WORTH * F.col("rim") * F.col("rim")).select("cell")
            split = cut_lineage(split)
        blocks = [
            F.least(F.ceil(F.col(c) / block_rows), F.greatest(F.lit(BLOCKS), F.ceil(F.col(c) / most_rows))).cast("int").alias(n)
            for c, n in (("rim", "nr"), ("cores", "nc"))
        ]
        known = sizes.join(split.withColumn("deep", F.lit(True)), "cell", "left").select(
            "cell", *blocks, F.coalesce("deep", F.lit(False)).alias("deep")
        )
        # Where rim rows meet further down, only those near the core are left to do.
        busy = known.filter("nr > 0 AND (nc > 0 OR NOT deep)")
        parts.append(placed.drop("up").join(busy, "cell").filter("NOT deep OR core OR near_core"))
        if below is None or split.isEmpty():
            return parts, balls
        placed = below.join(split.withColumnRenamed("cell", "up"), "up", "left_semi")
        sizes = child_sizes.join(split.withColumnRenamed("cell", "up"), "up", "left_semi")
        depth += 1


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def _placed(vectors: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                none = np.zeros(batch.num_rows, dtype=np.int64)
                yield from _place("", 0, batch.column(0), batch.column(1), none, pivots, threshold).to_batches()

    return vectors.select("id", "v").mapInArrow(place, PLACED)


def _cells_save(vectors: DataFrame, pivots: np.ndarray, threshold: float) -> bool:
    """Whether cells around the pivots save comparisons; of many vectors a sample of bounded size tells."""
    n = vectors.count()
    if len(pivots) < 2 or n <= 4 * TRIED_ROWS:
        return True
    sample = cut_lineage(vectors.filter(F.pmod(F.xxhash64("id", F.lit(0)), F.lit(n // TRIED_ROWS)) == 0))
    left = _left_over(_placed(sample, pivots, threshold).groupBy("up", "cell").agg(F.count_if(~F.col("core")).alias("rim"))).first()
    return left is None or left["left"] <= WORTH * sample.count() ** 2


def cells_save(vectors: DataFrame, threshold: float) -> bool:
    """Whether near pairs of ``(id, v)`` are found without comparing most of the vectors with each other."""
    return _cells_save(vectors, _pivots(vectors, threshold), threshold)


def cosine_pairs(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Near pairs among distinct unit vectors ``(id bigint, v array<float>)``.

    Returns ``balls (id, ball)`` and ``pairs (a, b)`` with ``a < b``. Any two ids of
    one ball match; every other matching pair is in ``pairs``. Dots are compared
    unrounded in double precision.

    Cells form a tree: one that is crowded is cut around pivots drawn from it, until
    it fits or the borders overlap so much that a cut saves nothing. Comparing happens
    per cell in pieces of two blocks of about ``block_rows`` rows, of more in a large cell (``BLOCK_VALUES``
    numbers at most), so the largest group is bounded whatever the cell holds. Core rows of a cell are never compared with
    each other.
    """
    vectors = cut_lineage(vectors)
    if vectors.isEmpty():
        spark = vectors.sparkSession
        return spark.createDataFrame([], "id bigint, ball string"), spark.createDataFrame([], "a bigint, b bigint")
    pivots = _pivots(vectors, threshold)
    if not _cells_save(vectors, pivots, threshold):
        pivots = pivots[:1]
    placed = cut_lineage(_placed(vectors, pivots, threshold))
    parts, balls = _fitting_cells(placed, block_rows, threshold, block_limit(pivots.shape[1]))
    blocked = _union(parts).withColumn(
        "i",
        F.when(F.col("core"), F.col("nr") + F.pmod(F.xxhash64("id"), F.col("nc")).cast("int")).otherwise(
            F.pmod(F.xxhash64("id"), F.col("nr")).cast("int")
        ),
    )
    # A core block meets the rim blocks only; a rim block meets every block, or the core alone where the rest is done further down.
    first = F.when(F.col("deep"), F.col("nr")).otherwise(F.lit(0))
    partners = F.when(F.col("core"), F.sequence(F.lit(0), F.col("nr") - 1)).otherwise(
        F.sequence(first, F.col("nr") + F.col("nc") - 1)
    )
    work = blocked.select("cell", "foreign", "core", "near_core", "id", "v", "i", F.explode(partners).alias("j")).select(
        "cell", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "foreign", "core", "near_core", "id", "v", "i"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        mine = pc.equal(rows["i"], rows["lo"])
        left, right = rows.filter(mine), rows.filter(pc.equal(rows["i"], rows["hi"]))
        if not left.num_rows or not right.num_rows:
            return
        (lid, lf, lnear), (rid, rf, rcore) = (
            [t[c].to_numpy() for c in names] for t, names in ((left, ("id", "foreign", "near_core")), (right, ("id", "foreign", "core")))
        )
        for i, j, dots in tiles(*(flat_matrix(t["v"].combine_chunks()) for t in (left, right))):
            x, y = np.nonzero(dots >= threshold)
            x, y = x + i, y + j
            # At every depth one of the two must be at home, or the pair belongs to another cell.
            real = ((lf[x] & rf[y]) == 0) & (~rcore[y] | lnear[x]) & (lid[x] != rid[y])
            a, b = lid[x[real]], rid[y[real]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    pairs = work.groupBy("cell", "lo", "hi").applyInArrow(compare, "a bigint, b bigint").distinct()
    return _union(balls), pairs
