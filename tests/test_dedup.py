from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.config import DedupSettings
from attesta.functions import simhash as sh
from attesta.operators import dedup, neardup
from attesta.operators.components import components


def votes(text, size=5):
    words = text.lower().split()
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    sums = [0] * 64
    for s in shingles:
        h = int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big")
        for b in range(64):
            sums[b] += 1 if h >> b & 1 else -1
    value = sum(1 << b for b in range(64) if sums[b] > 0)
    return value - (1 << 64) if value >> 63 else value


def bits(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def greedy(n, match):
    kept, dropped = [], {}
    for i in range(n):
        first = next((j for j in kept if match(i, j)), None)
        if first is None:
            kept.append(i)
        else:
            dropped[i] = first
    return dropped


def dropped_of(df):
    return {r[0]: r.dup_of for r in df.collect() if r.dup_of is not None}


def test_simhash_values(spark):
    texts = ["", "  \n", "one", "Alpha beta", "a b c d e f g", "x y " * 50, "Größe ändert sich nie mehr wieder heute"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(sh.simhash64("t")).collect()
    assert [r[0] for r in got] == [votes(t) for t in texts]


@pytest.mark.parametrize("distance,bucket", [(3, 1000), (3, 4), (1, 3), (10, 1000)])
def test_hamming_pairs_are_all_pairs(spark, distance, bucket):
    rng = random.Random(distance)
    base, values = rng.getrandbits(64), set()
    while len(values) < 300:
        v = base
        for _ in range(rng.randint(0, 8)):
            v ^= 1 << rng.randint(0, 30)
        values.add(v - (1 << 64) if v >> 63 else v)
    values = sorted(values - {0})
    got = neardup.hamming_pairs(spark.createDataFrame([(v,) for v in values], "h bigint"), "h", distance, bucket)
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bits(a, b) <= distance}
    assert {tuple(r) for r in got.collect()} == want


def test_hamming_pairs_makes_its_values_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def made(v):
        calls.add(1)
        return v

    values = spark.createDataFrame([(v,) for v in (0, 1, 3, 1 << 40)], "v bigint").select(made("v").alias("h")).distinct()
    assert {tuple(r) for r in neardup.hamming_pairs(values, "h", 1).collect()} == {(1, 3)}
    assert calls.value == 4


def test_chain_keeps_its_ends(spark):
    # a~b and b~c but not a~c: b falls to a, and c stays although b matched it.
    values = [0b1, 0b111, 0b11111]
    edges = spark.createDataFrame([(1, 7), (7, 31)], "a bigint, b bigint")
    items = spark.createDataFrame(list(enumerate(values)), "rank bigint, h bigint")
    assert dropped_of(dedup.first_wins(items, [dedup.Matching("h", edges)])) == {1: 0}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 3000) if i % 500] + [(9000, k) for k in range(8000, 8600)] + [(5, 5), (2**62, 2**62 + 1)]
    pairs += [rng.choice(pairs) for _ in range(50)]
    rng.shuffle(pairs)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    # A batch of few rows leaves the contraction to the joins.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {x: find(x) for pair in pairs if pair[0] != pair[1] for x in pair}
    assert {r.id: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).isEmpty()


@pytest.mark.parametrize("walk_rows", [100_000, 3000])
def test_long_chains_take_one_pass(spark, monkeypatch, walk_rows):
    """A chain of 10,000 in one walk, and ten of 1,000 that are found as components."""
    step = 10_000 if walk_rows > 10_000 else 1000
    passes = []
    graph = dedup._graph
    monkeypatch.setattr(dedup, "WALK_ROWS", walk_rows)
    monkeypatch.setattr(dedup, "_graph", lambda *args: passes.append(1) or graph(*args))
    items = spark.range(10_000).selectExpr("id AS rank", "id * 3 AS h")
    edges = spark.range(9999).filter(F.col("id") % step != step - 1).selectExpr("id * 3 AS a", "id * 3 + 3 AS b")
    got = dropped_of(dedup.first_wins(items, [dedup.Matching("h", edges)]))
    assert got == {i: i - 1 for i in range(10_000) if i % step % 2}
    assert len(passes) == 1


@pytest.mark.parametrize("walk_rows", [100_000, 60, 8, 0])
def test_two_matchings_equal_the_loop(spark, monkeypatch, walk_rows):
    """In one walk, by components, in rounds and walks by turns, in rounds alone."""
    monkeypatch.setattr(dedup, "WALK_ROWS", walk_rows or 1)
    rng = random.Random(5)
    n = 120
    keys = [(rng.randint(0, 25), rng.choice([None, *range(15)])) for _ in range(n)]
    edges = {(a, b) for a in range(26) for b in range(a + 1, 26) if rng.random() < 0.05}

    def match(i, j):
        (h, v), (g, w) = keys[i], keys[j]
        return h == g or (min(h, g), max(h, g)) in edges or (v is not None and v == w)

    items = spark.createDataFrame([(i, h, v) for i, (h, v) in enumerate(keys)], "rank bigint, h bigint, v bigint")
    pairs = spark.createDataFrame(sorted(edges), "a bigint, b bigint")
    got = dedup.first_wins(items, [dedup.Matching("h", pairs), dedup.Matching("v")])
    assert dropped_of(got) == greedy(n, match)


def test_empty_texts_and_copies(spark):
    para = "The panel expected the pilot to cut losses by a third within two winters of steady use in the hills"
    texts = ["", "   ", para, "other words entirely here today", para, para + " ", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "n bigint, text string")
    got = dedup.dedup(df, "n", "text")
    assert dropped_of(got) == {4: 2, 5: 2}
    rate = dedup.drop_rate(got).head()
    assert (rate.n_input, rate.n_kept, round(rate.drop_rate, 9)) == (7, 5, round(2 / 7, 9))
    assert dedup.drop_rate(got.limit(0)).head().drop_rate == 0.0


def _cluster_vectors(n):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    rows = []
    for i in range(n):
        c = centers[0] if i % 3 == 0 else centers[rng.integers(6)]
        v = c + rng.normal(size=8) * rng.choice([0, 0.05, 0.3])
        rows.append(v / np.linalg.norm(v))
    return np.array(rows, dtype=np.float32)


def test_cosine_dedup_equals_the_loop(spark, monkeypatch):
    # Many small cells and blocks, a third of the rows around one center.
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    n = 400
    vectors = _cluster_vectors(n)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, v array<float>")
    got = dedup.dedup(df, "id", None, "v")
    exact = vectors.astype(np.float64)
    assert dropped_of(got) == greedy(n, lambda i, j: float(exact[i] @ exact[j]) >= 0.92)


def test_balls_and_pairs_cover_every_match(spark):
    n = 300
    vectors = _cluster_vectors(n)
    df = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, v array<float>"
    ).dropDuplicates(["v"])
    neardup_pivots, neardup.BLOCK_ROWS = neardup.BLOCK_ROWS, 20
    try:
        balls, pairs = neardup.cosine_pairs(df, 0.92, block_rows=7)
    finally:
        neardup.BLOCK_ROWS = neardup_pivots
    ball = {r.id: r.ball for r in balls.collect()}
    ids = sorted(r.id for r in df.select("id").collect())
    exact = vectors.astype(np.float64)
    want = {(i, j) for x, i in enumerate(ids) for j in ids[x + 1 :] if exact[i] @ exact[j] >= 0.92}
    got = {tuple(r) for r in pairs.collect()}
    same = {(i, j) for x, i in enumerate(ids) for j in ids[x + 1 :] if i in ball and ball[i] == ball.get(j)}
    assert same <= want and got <= want and same | got == want


@pytest.mark.parametrize("worth", [0.7, 10.0])
def test_crowded_cells_are_cut_without_losing_a_match(spark, monkeypatch, worth):
    """One cell of everything at first, cut to the bottom; with ``worth`` 10 also where a cut saves nothing."""
    for name, value in (("BLOCK_ROWS", 10_000), ("SPLIT_PIVOTS", 4), ("PLACE_ROWS", 50), ("WORTH", worth)):
        monkeypatch.setattr(neardup, name, value)
    # Where every cut stands, the depth has to end by itself.
    cuts, cut = [], neardup._cut
    monkeypatch.setattr(neardup, "_cut", lambda rows, sizes, depth, t: cuts.append(depth) or cut(rows, sizes.filter(F.lit(depth < 4)), depth, t))
    vectors = _cluster_vectors(360)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, v array<float>").dropDuplicates(["v"])
    balls, pairs = neardup.cosine_pairs(df, 0.92, block_rows=7)
    ball = {r.id: r.ball for r in balls.collect()}
    assert len(ball) == balls.count() and len(cuts) > 1
    ids = sorted(r.id for r in df.select("id").collect())
    exact = vectors.astype(np.float64)
    want = {(i, j) for x, i in enumerate(ids) for j in ids[x + 1 :] if exact[i] @ exact[j] >= 0.92}
    got = {tuple(r) for r in pairs.collect()}
    same = {(i, j) for x, i in enumerate(ids) for j in ids[x + 1 :] if i in ball and ball[i] == ball.get(j)}
    assert same <= want and got <= want and same | got == want


def test_unlike_vectors_meet_few_others(spark):
    """Rows that go into the comparison grow about linearly: random directions in six dimensions, alike at 0.995."""
    def placed(n):
        rng = np.random.default_rng(n)
        v = rng.normal(size=(n, 6))
        v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
        df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id bigint, v array<float>")

        def everything(batches):
            for batch in batches:
                none = np.zeros(batch.num_rows, dtype=np.int64)
                yield from neardup._place("", 0, batch.column(0), batch.column(1), none, _matrix_of(v[:1]), 0.995).to_batches()

        parts, _ = neardup._fitting_cells(df.mapInArrow(everything, neardup.PLACED), 50, 0.995)
        return neardup._union(parts).filter("NOT deep").select(F.sum("nr")).head()[0]

    def _matrix_of(rows):
        return rows.astype(np.float64)

    small, large = placed(1500), placed(6000)
    assert large < 8 * small, (small, large)


def test_either_signal_drops(spark):
    words = "completely different wording that shares no shingle with anything else at all here"
    rows = [(0, words, [1.0, 0.0]), (1, "paraphrase in other terms", [0.95, float(np.sqrt(1 - 0.95**2))]), (2, words, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "n bigint, text string, v array<float>")
    assert dropped_of(dedup.dedup(df, "n", "text", "v", DedupSettings())) == {1: 0, 2: 0}
    assert dropped_of(dedup.dedup(df, "n", "text")) == {2: 0}


def test_hamming_column(spark):
    df = spark.createDataFrame([(0, -1), (5, 5), (0b1010, 0b0101)], "a bigint, b bigint")
    assert [r[0] for r in df.select(sh.hamming("a", "b")).collect()] == [64, 0, 4]
    assert df.select(F.max(sh.hamming("b", "a"))).head()[0] == 64


def test_vectors_that_match_nothing(spark):
    """Zero, missing and short vectors neither end the job nor make rows of unlike text duplicates."""
    unit, zero = [1.0, 0.0], [0.0, 0.0]
    rows = [(0, "one text about rivers and hills", zero), (1, "another text about trains and ships", zero), (2, "a third text on bread", None),
            (3, "number four speaks of clouds", unit), (4, "number five speaks of metal", unit), (5, "a third text on bread", None)]
    df = spark.createDataFrame(rows, "id bigint, text string, v array<float>")
    both = {r["rank"]: r.dup_of for r in dedup.dedup(df, "id", "text", "v", DedupSettings()).collect()}
    assert both == {0: None, 1: None, 2: None, 3: None, 4: 3, 5: 2}
    alone = {r["rank"]: r.dup_of for r in dedup.dedup(df, "id", None, "v", DedupSettings()).collect()}
    assert alone == {0: None, 1: None, 2: None, 3: None, 4: 3, 5: None}


def _directions(n, seed=3):
    """Vectors in all directions of 64 dimensions, a few of them copies or close to an earlier one."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 64))
    v[n // 2 :: 9] = v[: len(v[n // 2 :: 9])] + 0.05 * rng.normal(size=v[n // 2 :: 9].shape)
    v[n // 2 + 4 :: 11] = v[: len(v[n // 2 + 4 :: 11])]
    return (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)


@pytest.mark.parametrize("tile", [(1024, 4096), (7, 5)])
def test_directions_without_cells_go_in_slices(spark, monkeypatch, tile):
    """What is kept already decides most of the later vectors, so few of them are paired with each other; the result is that of the loop."""
    for name, value in (("BLOCK_ROWS", 64), ("TRIED_ROWS", 100), ("BLOCK_VALUES", 64 * 90), ("TILE", tile)):
        monkeypatch.setattr(neardup, name, value)
    monkeypatch.setattr(dedup, "SLICE_ROWS", 100)
    paired, find = [], dedup.cosine_pairs
    monkeypatch.setattr(dedup, "cosine_pairs", lambda v, t: paired.append(v.count()) or find(v, t))
    n, vectors = 1000, _directions(1000)
    texts = [f"a text {i % 150 if i > 300 else i} of some words that only it has {i % 150 if i > 300 else i}" for i in range(n)]
    rows = [(i, texts[i], [float(x) for x in vectors[i]] if i % 5 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, t string, v array<float>")
    got = dropped_of(dedup.dedup(df, "id", "t", "v", DedupSettings(cosine_threshold=0.40)))
    exact, h = vectors.astype(np.float64), [votes(t) for t in texts]
    assert got == greedy(n, lambda i, j: bits(h[i], h[j]) <= 3 or bool(i % 5 and j % 5 and float(exact[i] @ exact[j]) >= 0.40))
    assert len(paired) > 2 and max(paired) < 300


def test_large_cells_are_not_copied_where_it_saves_nothing(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 64), ("TRIED_ROWS", 100)):
        monkeypatch.setattr(neardup, name, value)
    placed, sizes = [], neardup._sizes
    monkeypatch.setattr(neardup, "_sizes", lambda df: placed.append(df.count()) or sizes(df))
    n, vectors = 1200, _directions(1200, 4)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, v array<float>").dropDuplicates(["v"])
    balls, pairs = neardup.cosine_pairs(df, 0.40, block_rows=20)
    ball = {r.id: r.ball for r in balls.collect()}
    got, exact = {tuple(r) for r in pairs.collect()}, vectors.astype(np.float64)
    ids = sorted(r.id for r in df.select("id").collect())
    want = {(i, j) for x, i in enumerate(ids) for j in ids[x + 1 :] if exact[i] @ exact[j] >= 0.40}
    assert got <= want and want - got <= {(i, j) for i, j in want if i in ball and ball[i] == ball.get(j)}
    assert max(placed) <= n
