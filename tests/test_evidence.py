from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from attesta import schemas
from attesta.functions import text as tx
from attesta.functions.tokens import WORDS
from attesta.operators import evidence, gap, quantile, retrieve, scan, sections, topk, triage, verify
from attesta.operators.cells import VectorCells


def rows_of(n, seed=1, questions=4, hot=0.4):
    """Evidence in which one sub-question holds a large share of the rows."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sq = "sq01" if rng.random() < hot else f"sq{rng.randint(1, questions):02d}"
        text = "t" * rng.choice([10, 40, 41, 400, 4000])
        out.append((i, sq, f"c{rng.randint(0, 10**9):09d}{i}", f"http://h/{i}", "T", ["A", "B"] if i % 2 else [], text,
                    0, len(text), f"claim {i}", "span", 0.9, float(rng.randint(-2, 3))))
    return out


def cost(r):
    path = " > ".join(r[5]) or "(top)"
    return max(1, len(f"[0] source: {r[3]} | section: {path}\nclaim: {r[9]}\nevidence: {r[10]}\ntext: {r[6]}") // 4)


def walk(rows, budget):
    queues = {}
    for r in sorted(rows, key=lambda r: (r[1], -r[12], r[2])):
        queues.setdefault(r[1], []).append(r)
    order = sorted((i, sq) for sq, q in queues.items() for i in range(len(q)))
    kept, spent = [], 0
    for i, sq in order:
        c = cost(queues[sq][i])
        if spent + c <= budget:
            spent += c
            kept.append((sq, queues[sq][i][2]))
    return kept


@pytest.mark.parametrize("budget", [20, 300, 3000, 10**6])
def test_selection_equals_the_walk(spark, budget):
    rows = rows_of(300, seed=budget)
    got = evidence.select_evidence(spark.createDataFrame(rows, schemas.EVIDENCE), budget).orderBy("visit_no").collect()
    assert [(r.sub_question_id, r.chunk_id) for r in got] == walk(rows, budget)


def test_selection_by_words(spark, monkeypatch):
    """Another counter prices the entries."""
    rows = rows_of(200, seed=9)
    words = lambda r: len(f"[0] source: {r[3]} | section: {' > '.join(r[5]) or '(top)'}\nclaim: {r[9]}\nevidence: {r[10]}\ntext: {r[6]}".split())
    monkeypatch.setitem(globals(), "cost", words)
    got = evidence.select_evidence(spark.createDataFrame(rows, schemas.EVIDENCE), 500, counter=WORDS).orderBy("visit_no").collect()
    assert [(r.sub_question_id, r.chunk_id) for r in got] == walk(rows, 500)


def test_budget_per_group(spark):
    rows = rows_of(200, seed=4, hot=0.3)
    df = spark.createDataFrame(rows, schemas.EVIDENCE).withColumn("part", F.when(F.col("sub_question_id") < "sq03", 0).otherwise(1))
    got = evidence.select_evidence(df, 900, by="part").orderBy("part", "visit_no").collect()
    for part in (0, 1):
        own = [r for r in rows if (r[1] >= "sq03") == bool(part)]
        assert [(r.sub_question_id, r.chunk_id) for r in got if r.part == part] == walk(own, 900)


def test_section_corpora(spark):
    df = spark.createDataFrame(rows_of(60, seed=9), schemas.EVIDENCE)
    chosen = evidence.select_evidence(df, 4000)
    parts = spark.createDataFrame([(1, ["sq01"]), (2, ["sq02", "sq03"])], "section_ord bigint, sub_question_ids array<string>")
    got = {r.section_ord: r.corpus for r in evidence.section_corpora(chosen, parts, 10**6).collect()}
    whole = evidence.corpus_text(chosen).head().corpus
    assert whole.startswith(got[1]) and got[2].count("### Sub-question") == 2
    assert got[2].removeprefix("EVIDENCE CORPUS\n\n") in whole


def test_selection_of_nothing(spark):
    empty = spark.createDataFrame([], schemas.EVIDENCE)
    assert evidence.select_evidence(empty, 100).collect() == []
    assert evidence.corpus_text(empty).head().corpus == "EVIDENCE CORPUS\n"


def test_entry_frame_is_a_lower_bound(spark):
    empty = [(0, "s", "c", "", "", [], "", 0, 0, "", "", 1.0, 0.0)]
    df = spark.createDataFrame(empty, schemas.EVIDENCE)
    assert df.select(tx.token_count(evidence._entry(0))).head()[0] >= evidence.MIN_ENTRY_TOKENS


@pytest.mark.parametrize("part", [[], ["g"]])
def test_running_sums(spark, part):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", None]), i, rng.randint(0, 9)) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, v bigint")
    got = {r.k: r.s for r in scan.running_sum(df, F.col("v"), [-F.col("k")], "s", part).collect()}
    for g, k, _ in rows:
        assert got[k] == sum(v for h, j, v in rows if j >= k and (not part or h == g))


def test_top_k_with_salt(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("g"), "id")
    got = topk.top_k(df, ["g"], [F.col("id").desc()], 5, salt_on=["id"]).collect()
    for g in range(7):
        ids = sorted((i for i in range(5000) if (0 if i % 3 == 0 else i % 7) == g), reverse=True)[:5]
        assert sorted((r.rn, r.id) for r in got if r.g == g) == list(enumerate(ids, 1))


def test_numbering_and_corpus(spark):
    rows = [
        (0, "sq02", "cB", "u1", "T1", ["H"], "text b", 0, 6, "claim b", "sb", 1.0, 5.0),
        (1, "sq01", "cA", "u2", "", [], "text a", 3, 9, "claim a", "sa", 1.0, 1.0),
        (2, "sq01", "cB", "u1", "T1", ["H"], "text b", 0, 6, "claim b1", "sb", 1.0, 2.0),
    ]
    df = spark.createDataFrame(rows, schemas.EVIDENCE)
    assert {r.chunk_id: r.number for r in evidence.number_citations(df).collect()} == {"cB": 1, "cA": 2}
    assert evidence.corpus_text(df).head().corpus == (
        "EVIDENCE CORPUS\n\n### Sub-question sq01\n\n"
        "[1] source: u1 | section: H\nclaim: claim b1\nevidence: sb\ntext: text b\n\n"
        "[2] source: u2 | section: (top)\nclaim: claim a\nevidence: sa\ntext: text a\n\n"
        "### Sub-question sq02\n\n[1] source: u1 | section: H\nclaim: claim b\nevidence: sb\ntext: text b\n"
    )
    assert evidence.references_text(evidence.citation_table(df)).head().references == (
        "## References\n\n[1] T1 - u1 (H; chunk cB, chars 0-6)\n[2] u2 - u2 (chunk cA, chars 3-9)"
    )


def plan_of(spark, n):
    rows = [(i, f"sq{i + 1:02d}", f"Question {i + 1}?", ["a", "b"], f"criterion {i + 1}") for i in range(n)]
    return spark.createDataFrame(rows, schemas.PLAN)


def test_digest_ladder(spark):
    rows = [(i, "sq01", f"c{i}", "u", "", [], "t", 0, 1, f"claim {i} " + "x" * 200, "", 1.0, 0.0) for i in range(45)]
    plan, ev = plan_of(spark, 2), spark.createDataFrame(rows, schemas.EVIDENCE)
    full = evidence.coverage_digest(plan, ev).head().digest
    assert full.count("  claim: ") == 40 and full.endswith("  success criterion: criterion 2\n  (no evidence collected)\n")
    for budget, step, n in [(10**6, 0, 40), (len(full) // 4 - 1, 1, 20), (150, 5, 1), (1, 6, 1)]:
        got = evidence.budgeted_digest(plan, ev, budget).head()
        assert (got.step, got.digest.count("  claim: ")) == (step, n)
    assert "  claim: " + rows[0][9][:160] + "\n" in evidence.budgeted_digest(plan, ev, 1).head().digest


@pytest.mark.parametrize("n,limit,body", [(8, 12, 8), (12, 12, 6), (15, 7, 5), (9, 2, 1)])
def test_sections(spark, n, limit, body):
    got = sections.plan_sections(plan_of(spark, n), limit).orderBy("section_ord").collect()
    assert [got[0].title, got[-1].title] == ["Overview", "Conclusions"] and len(got) == body + 2
    ids = [i for s in got[1:-1] for i in s.sub_question_ids]
    assert ids == got[0].sub_question_ids == [f"sq{i + 1:02d}" for i in range(n)]
    assert got[1].title == "Question 1"


def test_plan_rules(spark):
    assert sections.check_plan(plan_of(spark, 8)).collect() == []
    assert sections.check_plan(plan_of(spark, 7)).count() == 1
    twice = plan_of(spark, 8).withColumn("sub_question_id", F.lit("same")).withColumn("queries", F.array(F.lit("q")))
    assert sections.check_plan(twice).count() == 2


def test_triage(spark):
    replies = ['{"relevant": true, "confidence": 0.3, "claim": "c"}', '```json\n{"relevant": true, "confidence": 0.29}\n```',
               '{"relevant": false, "confidence": 1.0}', '{"relevant": true, "confidence": 1.1}', "no json", '{"confidence": 0.5}']
    df = spark.createDataFrame(list(enumerate(replies)), "n int, r string").select("n", triage.parse_verdict("r").alias("verdict"))
    assert tuple(triage.triage_counts(df).head()) == (6, 1, 2, 3)
    assert [(r.n, r.claim) for r in triage.keep_relevant(df).collect()] == [(0, "c")]


def test_accumulate(spark):
    df = spark.createDataFrame([(1, "a", "x", 1.0), (2, "b", "x", 2.0), (9, "a", "x", 3.0)], "ord bigint, sq string, c string, s double")
    got = triage.accumulate(df, ["sq", "c"], "ord").orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(1, "a", "x", 3.0), (2, "b", "x", 2.0)]


def test_nearest_in_blocks_with_ties(spark):
    rng = random.Random(2)
    rows = [(f"c{i:03d}", [float(rng.randint(0, 3)) for _ in range(4)]) for i in range(200)]
    asked = [(f"q{j}", [float(rng.randint(0, 3)) for _ in range(4)]) for j in range(5)]
    chunks = spark.createDataFrame(rows, "chunk_id string, vector array<float>").repartition(5)
    queries = spark.createDataFrame(asked, "sub_question_id string, vector array<float>")
    got = retrieve.nearest_chunks(chunks, queries, 7, block=2).collect()
    for q, v in asked:
        want = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), c) for c, w in rows)[:7]
        mine = sorted((r.ann_rank, r.distance, r.chunk_id) for r in got if r.sub_question_id == q)
        assert [(d, c) for _, d, c in mine] == want
    assert retrieve.nearest_chunks(chunks, queries.limit(0), 7).collect() == []


def clustered(n, seed=5, clusters=25):
    """Vectors around far apart centres, every fourth one a copy of one vector."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-50, 50) for _ in range(6)] for _ in range(clusters)]
    return [(f"c{i:05d}", centres[0] if i % 4 == 0 else [x + rng.gauss(0, 1) for x in rng.choice(centres)]) for i in range(n)]


def ranking(found):
    return sorted((r.sub_question_id, r.ann_rank, r.chunk_id, round(r.distance, 6)) for r in found.collect())


def test_nearest_from_cells_is_exact_and_skips(spark, tmp_path):
    rows = clustered(3000)
    chunks = spark.createDataFrame(rows, "chunk_id string, vector array<float>")
    queries = spark.createDataFrame([(f"q{j}", v) for j, (_, v) in enumerate(clustered(9, seed=6)[1:] + rows[1:20:3])] + [("far", [900.0] * 6)],
                                    "sub_question_id string, vector array<float>")
    extra = chunks.unionByName(spark.createDataFrame([("none", None)], chunks.schema))
    cells = VectorCells.build(extra, str(tmp_path / "cells"))
    for k, block in ((7, 1024), (7, 4), (900, 1024)):
        assert ranking(cells.nearest(queries, k, block=block)) == ranking(retrieve.nearest_chunks(chunks, queries, k))
    near = queries.filter("sub_question_id like 'q%'")
    cells.nearest(near, 7)
    assert 0 < cells.share < 0.5
    again = VectorCells(spark, cells.path)
    assert ranking(again.nearest(near.limit(2), 4000)) == ranking(retrieve.nearest_chunks(chunks, near.limit(2), 4000)) and again.share == 1.0
    assert again.nearest(queries.limit(0), 7).collect() == []
    empty = VectorCells.build(chunks.limit(0), str(tmp_path / "empty"))
    assert empty.nearest(queries, 7).collect() == [] and empty.nearest(queries, 7).columns == ["sub_question_id", "chunk_id", "distance", "ann_rank"]


def test_rerank_keeps_order_of_ties(spark):
    rows = [("q", "the cat", f"c{i}", i, t) for i, t in enumerate(["dog", "the", "cat", "the cat", "the x"])]
    df = spark.createDataFrame(rows, "sub_question_id string, question string, chunk_id string, ann_rank int, text string")
    got = retrieve.rerank(df, 4).orderBy("rerank_rank").collect()
    assert [r.chunk_id for r in got] == ["c3", "c1", "c2", "c4"]


def test_ndcg_and_quantiles(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 0.0), ("a", 3, 2.0), ("b", 1, 0.0)], "k string, p int, g double")
    got = {r.k: round(r.ndcg, 6) for r in retrieve.ndcg(df, "k", "p", "g", 3).collect()}
    assert got == {"a": round((3 + 2 / 2) / (3 + 2 / 1.5849625007211562), 6), "b": 0.0}
    values = [5.0, 1.0, 1.0, 9.0, 4.0, None]
    q = quantile.index_quantiles(spark.createDataFrame([(v,) for v in values], "x double"), "x", [0.0, 0.5, 0.6, 1.0])
    assert {r.fraction: r.value for r in q.collect()} == {0.0: 1.0, 0.5: 4.0, 0.6: 5.0, 1.0: 9.0}


MD = """## Head [1]

First claim [1]. Plain sentence. Both [2][1]!

- item one [1]
- item two [9]

> quote [1]

| a [1] |"""


def test_verify(spark):
    draft = spark.createDataFrame([(0, "S", MD), (1, "Empty", "")], "section_ord int, title string, markdown string")
    cited = spark.createDataFrame([(1, "c1"), (2, "c2")], "number bigint, chunk_id string")
    chunks = spark.createDataFrame([("c1", "x" * 2000), ("c2", "two")], "chunk_id string, text string")
    key = ["section_ord", "title"]
    proven = verify.attach_evidence(verify.split_pieces(draft, key), key, cited, chunks)
    claims = {r.piece: r.evidence for r in proven.collect() if r.evidence}
    assert claims == {"First claim [1].": "x" * 1500, "Both [2][1]!": "two\n\n" + "x" * 1500, "- item one [1]": "x" * 1500}

    def score(text, proof):
        return F.when(text.contains("First"), -9.0).when(text.contains("item"), -8.5).when(text.contains("better"), 2.0).otherwise(1.0)

    def rewrites(text, proof):
        return F.when(text.contains("First"), F.array(F.lit("better [2]"), F.lit("better [1].")))\
            .otherwise(F.array(F.lit("item [1]"), F.lit(""), F.lit("better [1]")))

    judged = verify.judge(proven, score, rewrites)
    s = verify.summarize(judged).head()
    assert (s.total_claims, s.kept, s.rewritten, s.dropped, s.mean_entailment_score) == (3, 1, 1, 1, 1.5)
    out = {r.section_ord: r.markdown for r in verify.rebuild(judged, key).collect()}
    assert out[0] == "## Head [1]\n\nbetter [1]. Plain sentence. Both [2][1]!\n\n- item two [9]\n\n> quote [1]\n\n| a [1] |"
    assert out[1] == ""
    attempts = {r.piece: r.rewrite_attempts for r in judged.collect() if r.action}
    assert attempts == {"First claim [1].": 2, "Both [2][1]!": 0, "- item one [1]": 2}
    assert [tuple(r) for r in verify.dangling(draft, ["title"], "markdown", cited).collect()] == [("S", 9)]
    assert verify.verification_bar(verify.summarize(judged.limit(0))).collect() == []


def test_polish_guard(spark):
    before = "<!--Q-SECTION:A-->\n\nx [1]\n\n<!--Q-SECTION:B-->\n\ny [2]"
    tries = {
        "ok": before.replace("x", "better"), "marker": before.replace("[2]", "[1]"), "prefix": "Hi " + before,
        "order": before.replace("SECTION:A", "SECTION:Z"),
    }
    b = spark.createDataFrame([(k, before) for k in tries], "key string, text string")
    a = spark.createDataFrame(list(tries.items()), "key string, text string")
    assert {r.key: r.accepted for r in sections.guard_polish(b, a).collect()} == {"ok": True, "marker": False, "prefix": False, "order": False}
    parts = sections.polished_sections(a.filter("key = 'ok'")).orderBy("section_ord").collect()
    assert [(r.title, r.markdown) for r in parts] == [("A", "better [1]"), ("B", "y [2]")]


def test_lenient_replies(spark):
    """Booleans and numbers as models write them, and gap analyses with null texts or missing parts."""
    cases = {
        '{"relevant": "true", "confidence": "0.9"}': (True, 0.9), '{"relevant": 1, "confidence": true}': (True, 1.0), '{"relevant": "Off", "confidence": " 1 "}': (False, 1.0),
        '{"relevant": "maybe", "confidence": 0.5}': None, '{"relevant": 2, "confidence": 0.5}': None, '{"relevant": true, "confidence": "NaN"}': None,
        '{"relevant": true, "confidence": "x"}': None, '{"relevant": {"a": 1}, "confidence": 1}': None, '{"relevant": null, "confidence": 1}': None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "r string")
    got = {r.r: r.v and (r.v.relevant, r.v.confidence) for r in df.select("r", triage.parse_verdict("r").alias("v")).collect()}
    assert got == cases
    gaps = {
        '{"saturated": false, "assessments": [{"sub_question_id": "a", "covered": true, "missing": null}, {"sub_question_id": "b", "covered": "no", "missing": "x"}], "new_queries": ["q"]}': (False, 1, 1),
        '```json\n{"saturated": "yes"}\n```': (True, 0, 0),
        '{"assessments": []}': None, '{"saturated": true, "assessments": [{"sub_question_id": "a"}]}': None, "no json": None,
    }
    df = spark.createDataFrame([(c,) for c in gaps], "r string").withColumn("gap", gap.parse_gap("r"))
    assert {r.r: tuple(r)[1:] for r in gap.gap_summary(df, "r").collect()} == {k: v for k, v in gaps.items() if v}
    assert [tuple(r)[1:] for r in gap.open_questions(df, "r").collect()] == [("b", "x")]


def test_lexical_top_k_equals_scoring_every_text(spark):
    """Ties, texts and queries without words, repeated texts, blocks of queries, batches smaller than k."""
    rng = random.Random(8)
    word = lambda: rng.choice(["Alpha", "beta", "GAMMA", "delta", "é", "Σίγμας", "zeta", "eta", "theta"])
    texts = [" ".join(word() for _ in range(rng.randint(0, 6))) for _ in range(150)] + [None, "", " \u2003 ", "beta\u00a0eta"]
    asked = [" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(12)] + [None, "", "unheard of"]
    docs = spark.createDataFrame([(i, t, -i) for i, t in enumerate(texts)], "doc_id bigint, text string, score int")
    docs = docs.withColumnRenamed("score", "extra")
    queries = spark.createDataFrame(list(enumerate(asked)), "item_id bigint, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = retrieve.lexical_top_k(docs, queries, 20, "doc_id", "text", "item_id", "text", block=4, carry=["extra"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for q, question in enumerate(asked):
        own = set((question or "").lower().split())
        score = [round(len(own & set((t or "").lower().split())) / max(1, len(own)), 9) for t in texts]
        best = sorted(range(len(texts)), key=lambda d: (-score[d], d))[:20]
        want += [(q, d, score[d], n + 1, -d) for n, d in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    none = retrieve.lexical_top_k(docs.limit(0), queries, 20, "doc_id", "text", "item_id", "text")
    assert none.collect() == [] and retrieve.lexical_top_k(docs, queries.limit(0), 3, "doc_id", "text", "item_id", "text").isEmpty()


def test_strip_takes_white_space_of_any_kind(spark):
    from attesta.functions import text as tx

    texts = [None, "", " ", "One", "One. Two", " a.  b!\n\nc? d", "a.b. ￿c", "x ￿ y. z", "!! ?", ". . .", "e. f.　"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace("t", f"^{tx.SPACE}+|{tx.SPACE}+$", "")
    assert all(r[0] == r[1] for r in df.select(tx.strip("t"), plain).collect())


def test_evidence_is_put_together_once_per_list_of_numbers(spark):
    from attesta.operators import verify

    pieces = spark.createDataFrame(
        [(i, 0, 0, False, False, "Said [1] and [2]." if i % 2 else "Said [2] and [9].") for i in range(200)]
        + [(500, 0, 0, True, False, "# Head [1]"), (501, 0, 0, False, False, "Nothing."), (502, 0, 0, False, False, "Only [9].")],
        "k int, block_no int, piece_no int, passthrough boolean, is_list boolean, piece string",
    )
    cited = spark.createDataFrame([(1, "a"), (2, "b")], "number bigint, chunk_id string")
    chunks = spark.createDataFrame([("a", "text a"), ("b", "text b")], "chunk_id string, text string")
    out = verify.attach_evidence(pieces, ["k"], cited, chunks)
    got = {r.k: r.evidence for r in out.collect()}
    assert len(got) == 203 and {got[k] for k in (500, 501, 502)} == {""}
    assert {got[k] for k in range(0, 200, 2)} == {"text b"} and {got[k] for k in range(1, 200, 2)} == {"text a\n\ntext b"}
    # Texts are collected by their list of numbers, never by piece.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("piece_no" not in line.split("],")[0] for line in plan.splitlines() if "collect_list" in line)
