"""Greedy first-wins removal of near duplicates.

In the given order an item is dropped if it matches an item that was kept before
it; a match with a dropped item does not count. Items of different components of the
graph of matches do not touch each other, so each component that is small enough is
gone through item by item in one task. A larger one is decided in rounds: every item
that no undecided earlier item matches is kept, whatever matches it is dropped, and
what is left falls into components again. Pairs of items are never listed: items that
share a hash, a vector or a ball meet through that key, and only distinct values that
are near each other are joined by an edge.

Vectors that lie in all directions have no cells that would save comparisons, and their
near pairs grow with the square of their number. Such items are decided in slices of the
order, each as large as all before: first against what was kept so far, of which only the
first match is noted, then what no kept item matches among itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.config import DedupSettings
from attesta.functions.simhash import simhash64
from attesta.functions.vectors import dot
from attesta.operators.components import components
from attesta.operators.neardup import block_limit, cells_save, cosine_pairs, flat_matrix, hamming_pairs, tiles
from attesta.session import cut_lineage

# Items and edges that one task goes through. Larger components go on in rounds.
WALK_ROWS = 100_000
# Vectors of the first slice, and the least number of groups in which a slice is compared with the kept items.
SLICE_ROWS = 8192
GROUPS = 32


@dataclass(frozen=True)
class Matching:
    """Items with the same ``key`` match, and so do items whose keys an edge
    ``(a, b)`` joins. A NULL key matches nothing. ``edges`` is None where equal
    keys are the only matches."""

    key: str
    edges: DataFrame | None = None


def _first_near(items: DataFrame, m: Matching) -> DataFrame:
    """Per key value: the smallest rank among the items it matches."""
    own = items.filter(F.col(m.key).isNotNull()).groupBy(m.key).agg(F.min("rank").alias("r"))
    if m.edges is None:
        return own
    ends = m.edges.select(F.col("a").alias(m.key), F.col("b").alias("to")).union(
        m.edges.select(F.col("b").alias(m.key), F.col("a").alias("to"))
    )
    across = own.join(ends, m.key).select(F.col("to").alias(m.key), "r")
    return own.union(across).groupBy(m.key).agg(F.min("r").alias("r"))


def _with_first(items: DataFrame, source: DataFrame, matchings: list[Matching], out: str) -> DataFrame:
    for i, m in enumerate(matchings):
        near = _first_near(source, m).withColumnRenamed("r", f"{out}{i}")
        items = items.join(near, m.key, "left")
    firsts = [F.col(f"{out}{i}") for i in range(len(matchings))]
    best = F.least(*firsts) if len(firsts) > 1 else firsts[0]
    return items.withColumn(out, best).drop(*[f"{out}{i}" for i in range(len(matchings))])


def _graph(items: DataFrame, matchings: list[Matching]) -> DataFrame:
    """Items as ``(rank, keys)`` and the edges between their keys as ``(m, a, b)`` in one table. A key is named by the
    smallest rank that has it, so ranks are the only nodes."""
    rows, edges = items, None
    for i, m in enumerate(matchings):
        least = items.filter(F.col(m.key).isNotNull()).groupBy(m.key).agg(F.min("rank").alias(f"_k{i}"))
        rows = rows.join(least, m.key, "left")
        if m.edges is not None:
            ends = m.edges.join(least.toDF("a", "ra"), "a").join(least.toDF("b", "rb"), "b")
            ends = ends.select(F.lit(i).alias("m"), F.col("ra").alias("a"), F.col("rb").alias("b"))
            edges = ends if edges is None else edges.union(ends)
    rows = rows.select("rank", F.array(*[f"_k{i}" for i in range(len(matchings))]).alias("keys"))
    return rows if edges is None else rows.unionByName(edges, allowMissingColumns=True)


def _in_parts(graph: DataFrame, n_rows: int) -> DataFrame:
    """The rows with ``part``, the number of the task that goes through their component, NULL where it is too large."""
    across = graph.filter("a IS NOT NULL").select("a", "b")
    own = graph.filter("rank IS NOT NULL").select(F.col("rank").alias("a"), F.explode("keys").alias("b"))
    found = components(own.filter("b IS NOT NULL").union(across)).withColumnRenamed("id", "_node")
    node = F.coalesce("rank", "a")
    rows = graph.withColumn("_node", node).join(found, "_node", "left")
    rows = cut_lineage(rows.withColumn("component", F.coalesce("component", "_node")).drop("_node"))
    sizes = rows.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") <= WALK_ROWS)
    parts = F.pmod(F.xxhash64("component"), F.lit(-(-n_rows // WALK_ROWS)))
    return rows.join(sizes.select("component", parts.alias("part")), "component", "left").drop("component")


def _walk(rows: pa.Table) -> pa.Table:
    """Whole components, item by item: ``(rank, dup_of)`` with NULL for the kept ones."""
    items, near = [], defaultdict(list)
    for row in rows.to_pylist():
        if row["rank"] is not None:
            items.append((row["rank"], row["keys"]))
        else:
            near[row["m"], row["a"]].append(row["b"])
            near[row["m"], row["b"]].append(row["a"])
    first, out = {}, []
    for rank, keys in sorted(items, key=lambda item: item[0]):
        own = [(m, k) for m, k in enumerate(keys) if k is not None]
        hits = [first[key] for key in own if key in first]
        out.append((rank, min(hits, default=None)))
        if not hits:
            for m, k in own:
                for other in (k, *near.get((m, k), ())):
                    first.setdefault((m, other), rank)
    ranks, dup_of = zip(*out) if out else ((), ())
    return pa.table({"rank": pa.array(ranks, pa.int64()), "dup_of": pa.array(dup_of, pa.int64())})


def first_wins(items: DataFrame, matchings: list[Matching]) -> DataFrame:
    """``items`` has a unique ``rank`` and the key columns. Returns
    ``(rank, dup_of)`` for the dropped items: the rank of the earliest kept match.

    What has at most ``WALK_ROWS`` items and edges is one walk; of more, each
    component within that bound is. A round decides at least the first undecided
    item of every larger component, and in practice most of it, because all items
    without an undecided earlier match are decided at once.
    """
    keys = [m.key for m in matchings]
    items = open_items = cut_lineage(items.select("rank", *keys))
    walked, winners = [], []
    while not open_items.isEmpty():
        graph = cut_lineage(_graph(open_items, matchings))
        if "m" not in graph.columns:
            graph = graph.selectExpr("*", "CAST(NULL AS int) m", "CAST(NULL AS bigint) a", "CAST(NULL AS bigint) b")
        n_rows = graph.count()
        fits = n_rows <= WALK_ROWS
        graph = graph.withColumn("part", F.lit(0).cast("bigint")) if fits else cut_lineage(_in_parts(graph, n_rows))
        small = graph.filter("part IS NOT NULL")
        walked.append(cut_lineage(small.groupBy("part").applyInArrow(_walk, "rank bigint, dup_of bigint")))
        if fits:
            break
        open_items = open_items.join(graph.filter("part IS NULL AND rank IS NOT NULL").select("rank"), "rank", "left_semi")
        seen = _with_first(open_items, open_items, matchings, "first")
        won = cut_lineage(seen.filter(F.col("first").isNull() | (F.col("first") >= F.col("rank"))).select("rank", *keys))
        winners.append(won)
        rest = _with_first(open_items.join(won.select("rank"), "rank", "left_anti"), won, matchings, "hit")
        open_items = cut_lineage(
            rest.filter(F.col("hit").isNull() | (F.col("hit") > F.col("rank"))).select("rank", *keys)
        )
    if not walked:
        return items.select("rank", F.col("rank").alias("dup_of"))
    by_walk = reduce(DataFrame.union, walked)
    found = by_walk.filter("dup_of IS NOT NULL")
    if not winners:
        return found
    # What a round dropped may match an item that was kept later and comes before the winner.
    by_round = reduce(DataFrame.union, winners)
    kept = by_round.union(items.join(by_walk.filter("dup_of IS NULL").select("rank"), "rank", "left_semi"))
    dropped = items.join(by_walk.select("rank").union(by_round.select("rank")), "rank", "left_anti")
    return found.union(_with_first(dropped, kept, matchings, "dup_of").select("rank", "dup_of"))


def _shared(items: DataFrame, m: Matching) -> DataFrame:
    """Key values through which some item can match another one."""
    many = (
        items.filter(F.col(m.key).isNotNull()).groupBy(m.key).agg(F.count("*").alias("n")).filter("n > 1").select(m.key)
    )
    if m.edges is None:
        return many
    ends = m.edges.select(F.col("a").alias(m.key)).union(m.edges.select(F.col("b").alias(m.key)))
    return many.union(ends).distinct()


def _first_alike(later: DataFrame, kept: DataFrame, threshold: float) -> DataFrame:
    """``(vid, r)``: of each vector of ``later (vid, v)`` the smallest rank of the vectors of ``kept (rank, v)`` that reach the
    threshold with it. Every block of the one meets every block of the other."""
    some = kept.first()
    if some is None:
        return later.select("vid", F.lit(None).cast("bigint").alias("r")).limit(0)
    most = block_limit(len(some["v"]))
    n_kept = -(-kept.count() // most)
    n_later = max(-(-later.count() // most), GROUPS // n_kept)

    def dealt(rows: DataFrame, by: str, own: str, n: int, other: str, m: int) -> DataFrame:
        number = F.pmod(F.xxhash64(by), F.lit(n)).alias(own)
        return rows.select(by, "v", number, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint"))).alias(other))

    left = dealt(later, "vid", "i", n_later, "j", n_kept).groupBy("i", "j")
    right = dealt(kept, "rank", "j", n_kept, "i", n_later).groupBy("i", "j")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        first = np.full(left.num_rows, np.iinfo(np.int64).max)
        if left.num_rows and right.num_rows:
            right = right.sort_by("rank")
            ranks = right["rank"].to_numpy()
            for i, j, dots in tiles(*(flat_matrix(t["v"].combine_chunks()) for t in (left, right))):
                hit = dots >= threshold
                some = np.flatnonzero(hit.any(axis=1))
                first[some + i] = np.minimum(first[some + i], ranks[j + hit[some].argmax(axis=1)])
        found = first < np.iinfo(np.int64).max
        return pa.table({"vid": left["vid"].to_numpy()[found], "r": first[found]}, schema=pa.schema([("vid", pa.int64()), ("r", pa.int64())]))

    return left.cogroup(right).applyInArrow(compare, "vid bigint, r bigint").groupBy("vid").agg(F.min("r").alias("r"))


def _slice_by_slice(
    classes: DataFrame, vectors: DataFrame, n_vectors: int, matchings: list[Matching], threshold: float, decide: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``(rank, dup_of)`` of the dropped classes. ``matchings`` are those by key, ``decide`` gives the dropped of some classes by themselves."""
    shares, rows = [], SLICE_ROWS
    while rows < n_vectors:
        shares.append(rows / n_vectors)
        rows *= 2
    ends = sorted({int(x) for x in classes.filter("vid IS NOT NULL").approxQuantile("rank", shares, 0.25 * shares[0])})
    dropped, kept, start = [], None, None
    for end in [*ends, None]:
        part = classes
        if start is not None:
            part = part.filter(F.col("rank") > start)
        if end is not None:
            part = part.filter(F.col("rank") <= end)
        start = end
        if kept is not None:
            later = vectors.join(part.select("vid").distinct(), "vid", "left_semi").select("vid", "v")
            near = kept.filter("v IS NOT NULL").groupBy("vid").agg(F.min("rank").alias("rank"), F.first("v").alias("v"))
            alike = _first_alike(later, cut_lineage(near.select("rank", "v")), threshold)
            seen = _with_first(part, kept, matchings, "hit").join(alike, "vid", "left").withColumn("dup_of", F.least("hit", "r"))
            seen = cut_lineage(seen.select(*classes.columns, "dup_of"))
            dropped.append(seen.filter("dup_of IS NOT NULL").select("rank", "dup_of"))
            part = seen.filter("dup_of IS NULL").drop("dup_of")
        lost = cut_lineage(decide(part))
        dropped.append(lost)
        new = part.join(lost, "rank", "left_anti").join(vectors.select("vid", "v"), "vid", "left")
        kept = cut_lineage(new if kept is None else kept.unionByName(new))
    return reduce(DataFrame.union, dropped)


def dedup(
    chunks: DataFrame,
    rank: str,
    text: str | None,
    vector: str | None = None,
    settings: DedupSettings | None = None,
    hash_name: str = "blake2b",
) -> DataFrame:
    """``(rank, dup_of)`` for every row of ``chunks``; NULL ``dup_of`` means kept.

    ``rank`` is a unique bigint that gives the order. Two rows match when their
    SimHash values are both non-zero and at most ``simhash_hamming_max`` bits apart
    or when the dot product of their unit vectors reaches ``cosine_threshold``. A
    missing vector, or one whose own square is below the threshold, matches none.
    Leave out ``vector`` for SimHash alone, ``text`` for vectors alone.
    """
    settings = settings or DedupSettings()
    cols: list[Column] = [F.col(rank).alias("rank")]
    if text:
        cols.append(F.nullif(simhash64(text, hash_name=hash_name), F.lit(0)).alias("h"))
    if vector:
        v = F.col(vector).cast("array<float>")
        cols.append(v.alias("v"))
        # 128 bits of hash stand for the vector wherever only equality counts. A vector that does not even reach the
        # threshold with itself (missing or zero, say) matches nothing by its direction.
        own = F.struct(F.xxhash64(vector), F.xxhash64(F.lit(7), F.col(vector)))
        cols.append(F.when(dot(v, v) >= settings.cosine_threshold, own).alias("vk"))
    base = cut_lineage(chunks.select(*cols))

    # Copies first: of rows alike in hash and vector only the first can be kept.
    alike = [c for c in ("h", "vk") if c in base.columns]
    known = F.coalesce(*(F.when(F.col(c).isNotNull(), True) for c in alike), F.lit(False))
    classes = base.filter(known).groupBy(*alike).agg(F.min("rank").alias("rank"))
    by_key: list[Matching] = []
    if text:
        hashes = cut_lineage(classes.filter(F.col("h").isNotNull()).select("h").distinct())
        edges = cut_lineage(hamming_pairs(hashes, "h", settings.simhash_hamming_max))
        by_key.append(Matching("h", edges))
    if vector:
        firsts = base.filter(F.col("vk").isNotNull()).groupBy("vk").agg(F.min("rank").alias("vid"), F.min_by("v", "rank").alias("v"))
        firsts = cut_lineage(firsts)
        classes = classes.join(firsts.select("vk", "vid"), "vk", "left")
    classes = cut_lineage(classes)

    def decide(part: DataFrame) -> DataFrame:
        """The dropped of some classes, as far as they match each other."""
        matchings = list(by_key)
        if vector:
            own = firsts.join(part.select("vid").distinct(), "vid", "left_semi")
            balls, pairs = cosine_pairs(own.select(F.col("vid").alias("id"), "v"), settings.cosine_threshold)
            matchings += [Matching("vid", cut_lineage(pairs)), Matching("ball")]
            part = cut_lineage(part.join(balls.select(F.col("id").alias("vid"), "ball"), "vid", "left"))
        # Most rows match nothing; only the others take part in the rounds.
        involved = None
        for m in matchings:
            some = part.join(_shared(part, m), m.key, "left_semi").select("rank", *[x.key for x in matchings])
            involved = some if involved is None else involved.union(some)
        return first_wins(involved.dropDuplicates(["rank"]), matchings)

    n_vectors = firsts.count() if vector else 0
    if n_vectors > 2 * SLICE_ROWS and not cells_save(firsts.select(F.col("vid").alias("id"), "v"), settings.cosine_threshold):
        dropped = _slice_by_slice(classes, firsts, n_vectors, [*by_key, Matching("vid")], settings.cosine_threshold, decide)
    else:
        dropped = decide(classes)

    decided = classes.join(dropped, "rank", "left").select(
        *[F.col(c).alias(f"_{c}") for c in alike], F.col("rank").alias("first_rank"), "dup_of"
    )
    on = None
    for c in alike:
        same = F.col(c).eqNullSafe(F.col(f"_{c}")) if len(alike) > 1 else F.col(c) == F.col(f"_{c}")
        on = same if on is None else on & same
    # A NULL first_rank is a row without any hash: it matches nothing.
    is_first = F.col("rank") == F.coalesce("first_rank", "rank")
    return base.join(decided, on, "left").select(
        "rank", F.coalesce("dup_of", F.when(~is_first, F.col("first_rank"))).alias("dup_of")
    )


def drop_rate(decided: DataFrame) -> DataFrame:
    """One row: ``n_input``, ``n_kept``, ``drop_rate`` (0 for no input)."""
    n, kept = F.count("*"), F.count_if(F.col("dup_of").isNull())
    rate = F.when(n == 0, F.lit(0.0)).otherwise(1 - kept / n)
    return decided.agg(n.alias("n_input"), kept.alias("n_kept"), rate.alias("drop_rate"))
