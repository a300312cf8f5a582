"""A whole run with stand-ins for search, network and models."""

from __future__ import annotations

import dataclasses
import datetime as dt
import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attesta import schemas
from attesta.config import ReportSettings, RunSettings, Settings
from attesta.functions import text as tx
from attesta.plans.research import Components, CostCapExceeded, Gap, Research
from attesta.sources.index import ChunkIndex
from attesta.streaming.ingest import ingest_pages, page_stream

TOPICS = ["solar panels", "wind turbines", "heat pumps", "grid storage", "tidal power", "carbon taxes", "rail freight", "city cycling"]


def article(topic, n):
    body = " ".join(
        f"Study {n}{i} of {topic} measured a change of {i * 7 + n} percent across {i + 3} regions over the winter." for i in range(30)
    )
    return f"<html lang='en'><head><title>{topic} {n}</title></head><body><article><h1>{topic}</h1><h2>Results</h2><p>{body}</p></article></body></html>"


def _unit(col):
    def vector(t):
        v = np.zeros(64)
        for w in t.lower().split():
            v[int.from_bytes(hashlib.sha256(w.encode()).digest()[:2], "big") % 64] += 1
        return (v / (np.linalg.norm(v) or 1)).astype(np.float32).tolist()

    def column(texts: pd.Series) -> pd.Series:
        return texts.map(vector)

    return F.pandas_udf(column, "array<float>")(col)


class Stand:
    def __init__(self, spark, gaps=(), price=0, fail_at=None, polish=None):
        self.spark, self.gaps, self.price, self.fail_at, self.calls = spark, list(gaps), price, fail_at, []
        self.polish = polish

    def plan(self, topic, meter):
        self.calls.append("plan")
        meter.record("claude-opus-5", "plan", input_tokens=self.price, on=dt.date(2026, 1, 1))
        rows = [(i, f"sq{i + 1:02d}", f"What is known about {t}?", [t, f"{t} study"], f"a measured change for {t}") for i, t in enumerate(TOPICS)]
        return self.spark.createDataFrame(rows, schemas.PLAN)

    def search(self, queries):
        self.calls.append("search")
        hits = F.array(*[
            F.struct(F.lit(n).alias("rank"), F.concat(F.lit(f"http://site{n}.org/"), F.translate("query", " ", "-")).alias("url")) for n in range(3)
        ])
        return queries.select("query_idx", "query", F.explode(hits).alias("h")).select(
            "query_idx", "query", "h.rank", "h.url", F.lit(None).cast("string").alias("title"), F.lit("").alias("snippet"),
            F.lit("x").alias("engine"), F.lit(1.0).alias("score"),
        )

    def fetch(self, urls):
        self.calls.append("fetch")

        @F.pandas_udf("string")
        def page(u: pd.Series) -> pd.Series:
            return u.map(lambda x: article(x.rsplit("/", 1)[1].replace("-study", "").replace("-", " "), int(x[11])))

        body = page("url")
        return urls.select(
            "url", F.col("url").alias("final_url"), F.when(F.col("url").contains("site2"), 404).otherwise(200).alias("http_status"),
            F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("content_length"),
            F.encode(body, "utf-8").alias("body"), F.lit(None).cast("string").alias("failure"),
        )

    def robots(self, spark, urls):
        return spark.createDataFrame([("site1.org", "User-agent: *\nDisallow: /rail\n")], "host string, body string")

    def gap(self, digest, iteration, meter):
        self.calls.append("gap")
        assert "sq08: What is known about city cycling?" in digest
        return self.gaps.pop(0) if self.gaps else Gap(True)

    def write(self, asked, meter):
        self.calls.append("write")
        if self.fail_at == "write":
            raise RuntimeError("model went away")
        first = F.regexp_extract("corpus", r"\[(\d+)\]", 1)
        md = F.concat(F.lit("# "), F.col("title"), F.lit("\n\nStudy of a change measured ["), first, F.lit("]. Invented [999]. Closing words."))
        return asked.select("section_ord", md.alias("markdown"))

    def components(self):
        def verdict(question, passage):
            good = tx.word_hits(question, passage) >= 2
            return F.to_json(F.struct(good.alias("relevant"), F.substring(passage, 1, 60).alias("claim"), F.lit(0.8).alias("confidence")))

        return Components(
            plan=self.plan, search=self.search, fetch=self.fetch, embed=_unit, score=tx.word_hits, verdict=verdict, gap=self.gap,
            write=self.write, robots=self.robots, polish=self.polish,
        )


def settings(**over):
    return Settings(run=RunSettings(max_iterations=over.pop("max_iterations", 1), **over), report=ReportSettings(corpus_budget_tokens=6000))


def test_run_and_resume(spark, tmp_path):
    stand = Stand(spark, price=1000, fail_at="write")
    run = Research(spark, str(tmp_path), stand.components(), settings())
    with pytest.raises(RuntimeError):
        run.research("energy")
    failed = run.runs().head()
    assert failed.status == "failed"
    stage = run.store.get_stage(failed.run_id, "synthesize")
    assert stage["status"] == "failed" and "model went away" in stage["error"]

    stand.fail_at, stand.calls = None, []
    done = run.resume(failed.run_id)
    # Everything before the failure is replayed, not computed again.
    assert stand.calls == ["write"] and done["run_id"] == failed.run_id
    assert done["iterations"] == 1 and done["n_chunks_evidence"] > 0 and round(done["total_cost_usd"], 6) == 0.005
    report = (tmp_path / "reports" / f"report-{failed.run_id}.md").read_text()
    assert "[999]" not in report and "## References" in report and "## What is known about solar panels" in report
    assert "$0.0050" in report and '"n_urls_fetched": 48' in report
    statuses = {r.status: r.n for r in spark.read.parquet(run._table(failed.run_id, "fetch", 0)).groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert statuses == {"ok": 30, "http_error": 16, "robots_disallowed": 2}
    # Both queries of a topic lead to the same article: one copy is indexed.
    assert done["n_chunks_indexed"] < spark.read.parquet(run._table(failed.run_id, "chunk", 0)).count()

    info, stages, payloads = run.inspect(failed.run_id)
    assert info["status"] == "completed" and [r.stage for r in stages.collect()][:3] == ["plan", "search", "fetch"]
    assert payloads.filter("key = 'n_rows'").count() == stages.count()


def test_loop_and_polish(spark, tmp_path):
    seen = {}

    def polish(draft, meter):
        seen["draft"] = draft
        return draft.replace("Closing", "Polished")

    stand = Stand(spark, gaps=[Gap(False, ["hydrogen trucks"]), Gap(False, [])], polish=polish)
    done = Research(spark, str(tmp_path), stand.components(), settings(max_iterations=3)).research("energy")
    assert done["iterations"] == 2 and stand.calls.count("gap") == 2 and stand.calls.count("search") == 2
    text = open(done["report_path"]).read()
    assert "Polished words." in text and "<!--Q-SECTION" not in text and seen["draft"].startswith("<!--Q-SECTION:Overview-->")


def test_cost_cap(spark, tmp_path):
    stand = Stand(spark, price=2_000_000)
    run = Research(spark, str(tmp_path), stand.components(), settings(cost_cap_usd=5.0))
    with pytest.raises(CostCapExceeded):
        run.research("energy")
    failed = run.runs().head()
    # The call that crossed the cap is on record.
    assert json.loads(run.store.ledger(failed.run_id).head().entry)["input_tokens"] == 2_000_000


def test_stream_adds_each_chunk_once(spark, tmp_path):
    pages, index = tmp_path / "pages", ChunkIndex(spark, str(tmp_path / "index")).open()

    def drop(first, n):
        rows = [(i, f"http://x.org/{i}", article(f"topic {i}", i)) for i in range(first, first + n)]
        spark.createDataFrame(rows, "page_id bigint, url string, html string").write.mode("append").parquet(str(pages))

    def run(mark):
        ingest_pages(page_stream(spark, str(pages), 2), index, _unit, str(tmp_path / mark)).awaitTermination()
        return index.count()

    drop(0, 3)
    first = run("a")
    assert first >= 3 and run("a") == first
    drop(2, 2)
    second = run("a")
    assert second > first
    # Reading everything again, as after a lost checkpoint, adds nothing.
    assert run("b") == second
    assert index.table().select("chunk_id").distinct().count() == second


def test_pages_and_vectors_are_asked_for_once(spark, tmp_path):
    """Requests and embeddings are counted in the workers."""
    requests, embeddings = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def once(u):
        requests.add(1)
        return article("bridges", int(u[-2:]))

    def fetch(urls):
        return urls.select(
            "url", F.col("url").alias("final_url"), F.lit(200).alias("http_status"), F.lit("text/html").alias("content_type"),
            F.lit(None).cast("string").alias("content_length"), F.encode(once.asNondeterministic()("url"), "utf-8").alias("body"), F.lit(None).cast("string").alias("failure"),
        )

    parts = dataclasses.replace(Stand(spark).components(), fetch=fetch)
    run = Research(spark, str(tmp_path), parts, settings())
    urls = spark.createDataFrame([(f"https://site9.org/{i:02d}", i) for i in range(50)], "url string, url_ord bigint")
    assert run._fetched(urls).filter("status = 'ok'").count() == 50 and requests.value == 50
    assert run.cache.missing(urls).count() == 0

    @F.udf("array<float>")
    def embed(t):
        embeddings.add(1)
        return [1.0, 0.0]

    index = ChunkIndex(spark, str(tmp_path / "once")).open()
    chunks = spark.range(40).select(
        F.col("id").cast("string").alias("chunk_id"), F.lit("u").alias("url"), F.lit("t").alias("doc_title"), F.array(F.lit("h")).alias("heading_path"), F.lit("x").alias("text"),
        F.lit(1).alias("token_count"), F.col("id").cast("int").alias("position"), F.lit(0).alias("start_char"), F.lit(1).alias("end_char"),
    ).withColumn("vector", embed.asNondeterministic()("text"))
    assert index.add(chunks) == 40 and embeddings.value == 40
