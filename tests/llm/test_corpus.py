"""Operators that look at the whole corpus, and the pipeline, against brute force."""

from __future__ import annotations

import random
import re

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import components, decontaminate, hyperminhash, line_windows, skew
from attesta.llm.queries import ORACLES, QUERIES
from attesta.llm.workspace import Workspace
from compare import compare, connect

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(rows, percent=85):
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in rows}


@pytest.mark.parametrize("small", [12, 2])
def test_near_duplicates(spark, monkeypatch, small):
    """Copies, edits of one text with and without a link to it, chains, short and empty texts; also with crowded bands."""
    monkeypatch.setattr(hyperminhash, "SMALL", small)
    rng = random.Random(small)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(120)]
    texts = [" ".join(base)] * 4
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(60)]
    for k in range(12):
        texts.append(" ".join(chain[k * 2 : k * 2 + 36]))
    texts += [" ".join(word() for _ in range(rng.randint(1, 50))) for _ in range(30)] + [None, "", "  ", "one", "ONE", "a b c d e", "a b c d e"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, id int")
    got = {r.id: r for r in hyperminhash.near_duplicates(df).collect()}
    want = brute_groups(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) and r.n_shingles == len(shingles(dict(rows)[i])) for i, r in got.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_band_loses_no_pair(spark, seed):
    """All documents in one band: every pair alike from different components is proposed, and few of the others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(120)]
    spots, marks = [rng.randrange(120) for _ in range(8)], [word() for _ in range(4)]
    texts = []
    for k in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            # Some edits share their place, some their word too.
            copy[rng.choice(spots) if rng.random() < 0.6 else rng.randrange(120)] = rng.choice(marks) if rng.random() < 0.5 else word()
        cut = rng.choice([0, 0, 0, 5, 12])
        texts.append(" ".join(copy[cut:] + [word() for _ in range(rng.choice([0, 0, 6]))]))
    far = [word() for _ in range(110)]
    texts += [" ".join(far[:k] + base[k:]) for k in (10, 40, 41, 42, 108, 109, 110)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = hyperminhash.sketches(df, "doc_id", "text").groupBy("n_shingles", "k1", "k2").agg(F.min("id").alias("id"))
    component = {r.id: 0 if r.id < 60 else r.id for r in classes.collect()}
    crowded = spark.createDataFrame([(7, i, c) for i, c in component.items()], "band long, id long, component long")
    found = {(r.a, r.b) for r in hyperminhash._across(crowded, classes, df.toDF("id", "text"), 0.85, 5).collect()}
    sets = {i: shingles(texts[i]) for i in component}
    apart = [(i, j) for i in sets for j in sets if i < j and component[i] != component[j]]
    alike = {(i, j) for i, j in apart if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert alike and alike <= found and len(found) < len(apart)


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert hyperminhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, "w " * 60_000)]
    got = sorted((r.id or 0, r.component_id or 0, r.kept) for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_weighted_join(spark):
    big = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 50 + ["a", "b", None])], "k string, i int")
    few = spark.createDataFrame([("hot", 50, "x"), ("a", 1, "y")], "k string, n long, v string")
    for total in (51, 10_000_000):
        out = skew.join_weighted(big, few, ["k"], "n", total, F.col("i")).collect()
        assert len(out) == 53 and {(r.k, r.v) for r in out} == {("hot", "x"), ("a", "y"), ("b", None), (None, None)}


def test_lines(spark):
    rows = [(1, "a\nb\nc\nd", 5), (2, "x\na\n\nb \nc\ny", 5), (3, "a\nb\nc", 5), (4, "q\nq\nq\nq\nq", 5), (5, None, 5), (6, "", 5), (7, "a\nb", 5), (8, "\n".join(f"l{i}" for i in range(30_000)), 5),
            (3, "a\nb\nc", 5), (None, "b\nc\nd", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    got = {}
    for r in line_windows.remove_repeated_lines(docs).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert {i: got[i][0] for i in (1, 2, 3, 4, 5, 6, 7, None)} == {1: "a\nb\nc\nd", 2: "x\n\ny", 3: "", 4: "q", 5: None, 6: "", 7: "a\nb", None: ""}
    assert len(got[3]) == 2 and got[8][0].count("\n") == 29_999
    assert line_windows.remove_repeated_lines(docs.limit(0)).count() == 0


def test_leaks(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 40))) + ". " + " ".join(word() for _ in range(rng.randint(1, 8))) + ".") for i in range(40)]
    items += [(90, None), (91, ""), (92, items[0][1])]
    docs = []
    for d in range(120):
        body = [word() for _ in range(rng.randint(0, 600))]
        if d % 3 == 0:
            leak = items[d % 40][1].split()
            at = rng.randint(0, len(body))
            body[at:at] = leak if d % 2 else leak[: len(leak) // 2]
        docs.append((d, " ".join(body)))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    term = lambda t: re.findall("[a-z]+", t)
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = set()
    for d, t in docs:
        w = term(t or "")
        for i, x in items:
            if not x:
                continue
            parts = [term(p) for p in re.match(r"(?s)(.*[.?!\n])\s*(\S.*?)\s*$", x).groups()]
            if all(sum(s in runs(w, min(5, len(p))) for s in runs(p, min(5, len(p)))) >= 0.8 * len(runs(p, min(5, len(p)))) for p in parts):
                want.add((d, i))
    assert got == want and want
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(spark.createDataFrame(docs[:3], "doc_id long, text string"), none).count() == 0


def test_wand_finds_what_full_scoring_finds(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 12))) for _ in range(150)]
    from collections import Counter

    from attesta.llm import bytewords as bw

    df = Counter(int(h) for t in texts for h in set(bw.hash_words(decontaminate._terms(t)).tolist()))
    index = decontaminate.build_index(list(range(150)), texts, texts, [""] * 150, df, 150, 7.0)
    import numpy as np

    for _ in range(60):
        terms = np.array(sorted(rng.sample(range(len(index.terms)), 12)))
        full = np.zeros(150)
        for t in terms:
            full[index.items[index.starts[t] : index.starts[t + 1]]] += index.scores[index.starts[t] : index.starts[t + 1]]
        _, blocks = index.reachable_blocks(terms, np.zeros(len(terms), dtype=np.int64), 0.5)
        assert [i for i, _ in index.search(terms, 0.5, blocks.tolist())] == np.flatnonzero(full >= 0.5 - 1e-9).tolist()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    line = compare(spark, connect(SMALL), SMALL, name, QUERIES[name], ORACLES[name])
    assert line.startswith("SAME"), line


def test_pipeline(spark):
    """Each stage against the plain meaning of its operator, on its own input."""
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "decontaminate", "tokens"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    start = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SMALL)
        assert out.columns == start
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        kept = {r.doc_id: r.text for r in out.collect()}
        if name == "language":
            assert set(kept) == {i for i, _ in rows}
        if name == "line_dedup":
            lines = {x.strip() for _, t in rows for x in t.split("\n")}
            assert {x.strip() for t in kept.values() for x in t.split("\n")} | {""} == lines | {""}
        if name == "near_dedup":
            assert set(kept) == set(brute_groups(rows).values())
        if name == "decontaminate":
            bench = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert set(kept) == {i for i, t in rows if not any(b in t for b in bench)}
        docs = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in last.collect()} == set(kept)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SMALL).count() <= 2 and stage(spark, odd.limit(0), SMALL).count() == 0


def test_stages_leave_columns_of_any_name_alone(spark):
    """Columns with the names that the operators use inside, and with those of their results, come out as they went in."""
    names = ["score", "lang_pred", "_text", "_key", "_own", "_whole", "_doc", "_row", "_t", "_covered", "_cid", "_cown", "_r", "col1", "size", "id", "key",
             "n_lines", "n_removed", "n_shingles", "component_id", "kept", "band", "item_id", "passage", "a.b"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = docs.select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:4]:
        want = sorted(map(tuple, stage(spark, docs, SMALL).collect()), key=lambda r: r[0])
        out = stage(spark, more, SMALL)
        assert out.columns == more.columns, name
        rows = sorted(map(tuple, out.collect()), key=lambda r: r[0])
        at = docs.columns.index("doc_id")
        assert [r[: len(docs.columns)] for r in rows] == want, name
        assert all(r[len(docs.columns) :] == tuple(f"{n} {r[at]}" for n in names) for r in rows), name


def test_near_dedup_stage_at_four_fifths(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SMALL, percent=80).collect()}
    assert kept == set(brute_groups([(r.doc_id, r.text) for r in docs.collect()], 80).values())


def test_repeated_rows_leak_once(spark):
    """One row per document and item, also for rows that are there twice and for several texts with one id."""
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    once = {tuple(r) for r in decontaminate.find_leaks(docs, items).collect()}
    both = decontaminate.find_leaks(docs.union(docs), items).collect()
    assert once and len(both) == len(once) and {tuple(r) for r in both} == once
    one_id = decontaminate.find_leaks(docs.withColumn("doc_id", F.lit(None).cast("long")), items).collect()
    assert sorted(r.item_id for r in one_id) == sorted({r[1] for r in once})


def test_bands_reach_similarity_of_four_fifths(spark):
    """Pairs of exactly 0.8 share a band when 80 percent are asked for; with all 8 registers to a band two of these do not."""
    rng = random.Random(12)
    texts = []
    for _ in range(1000):
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(49)]
        texts += [" ".join(words), " ".join(words[:-5] + [f"{w}x" for w in words[-5:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in hyperminhash.near_duplicates(docs, percent=80).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_crowded_band_in_a_workspace_loses_no_pair(spark):
    """All documents in one band, steps written as tables: every pair alike from different components is proposed."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base, spots = [word() for _ in range(120)], [rng.randrange(120) for _ in range(8)]
    texts = []
    for _ in range(80):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.choice(spots) if rng.random() < 0.6 else rng.randrange(120)] = word()
        texts.append(" ".join(copy[rng.choice([0, 0, 5, 12]) :]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = hyperminhash.sketches(df, "doc_id", "text").groupBy("n_shingles", "k1", "k2").agg(F.min("id").alias("id"))
    component = {r.id: 0 if r.id < 30 else r.id for r in classes.collect()}
    crowded = spark.createDataFrame([(7, i, c) for i, c in component.items()], "band long, id long, component long")
    space = Workspace(spark)
    found = {(r.a, r.b) for r in hyperminhash._across(crowded, classes, df.toDF("id", "text"), 0.85, 5, space=space).collect()}
    space.remove()
    sets = {i: shingles(texts[i]) for i in component}
    apart = [(i, j) for i in sets for j in sets if i < j and component[i] != component[j]]
    alike = {(i, j) for i, j in apart if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert alike and alike <= found and len(found) < len(apart)


def test_near_dedup_keeps_unlike_texts_of_one_id(spark):
    """Rows with one id but unlike texts: the longest text stays, then the first in order, in whatever order rows come."""
    rows = [(1, "a b c d e f"), (1, "q w e r t y u i o p"), (2, "x y z u v w"), (2, "x y z u v a")]
    rows = [(i, t, "en", "s", len(t)) for i, t in rows]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
        assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()) == [(1, "q w e r t y u i o p"), (2, "x y z u v a")]
