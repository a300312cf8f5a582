"""A research run: a topic in, a cited and verified report out.

Every stage writes a table; the run log says which stages are complete, and a
completed stage is read back instead of computed again. So a run that was
interrupted continues where it stopped. Models, search and the network are
functions given by the caller; all work on rows is done by the operators.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta import schemas
from attesta.config import Settings
from attesta.functions import text as tx
from attesta.functions.tokens import BY_LENGTH, TokenCounter
from attesta.operators import chunking, dedup, evidence, extract, ledger, retrieve, sections, triage, verify
from attesta.operators.scan import row_rank
from attesta.session import cut_lineage, ship_package
from attesta.sources import fetch, search
from attesta.sources.files import Folder
from attesta.sources.index import ChunkIndex
from attesta.sources.runs import RunStore, list_runs, payload_summary

# How much of a local model's context a gap check leaves for its
# digest, in heuristic tokens.
GAP_REPLY_TOKENS = 1200
GAP_OVERHEAD_TOKENS = 600
TOKEN_RATIO = 1.35


class CitationError(Exception):
    """A marker of the report has no citation."""


class CostCapExceeded(Exception):
    """The run has cost more than allowed."""


class Meter:
    """Model calls of a run, in order, with their token counts."""

    def __init__(self) -> None:
        self.rows: list[dict[str, Any]] = []

    def record(self, model: str, stage: str, iteration: int = 0, batch: bool = False, input_tokens: int = 0,
               output_tokens: int = 0, cache_creation_input_tokens: int = 0, cache_read_input_tokens: int = 0,
               on: dt.date | None = None, context: str = "") -> None:
        self.rows.append(
            dict(
                seq=len(self.rows), on_date=(on or dt.datetime.now(dt.UTC).date()).isoformat(), model=model, stage=stage,
                iteration=iteration, batch=batch, input_tokens=input_tokens, output_tokens=output_tokens,
                cache_creation_input_tokens=cache_creation_input_tokens,
                cache_read_input_tokens=cache_read_input_tokens, context=context,
            )
        )

    def calls(self, spark: SparkSession) -> DataFrame:
        rows = [tuple({**r, "on_date": dt.date.fromisoformat(r["on_date"])}[f] for f in schemas.LEDGER.names) for r in self.rows]
        return spark.createDataFrame(rows, schemas.LEDGER)


@dataclass
class Gap:
    saturated: bool
    new_queries: list[str] = field(default_factory=list)


def _no_robots(spark: SparkSession, urls: DataFrame) -> DataFrame:
    return spark.createDataFrame([], "host string, body string")


@dataclass
class Components:
    """What a run needs from outside. Columns may be pandas UDFs over a model."""

    # (topic, meter) to a plan in PLAN form
    plan: Callable[[str, Meter], DataFrame]
    # (query_idx, query) to raw hits in HIT form
    search: Callable[[DataFrame], DataFrame]
    # (url) to (url, final_url, http_status, content_type, content_length, body, failure)
    fetch: Callable[[DataFrame], DataFrame]
    # text to a unit vector
    embed: Callable[[Column], Column]
    # (text, proof) to a score, higher is better
    score: Callable[[Column, Column], Column]
    # (question, passage) to a JSON verdict
    verdict: Callable[[Column, Column], Column]
    # (digest, iteration, meter) to a gap analysis
    gap: Callable[[str, int, Meter], Gap]
    # sections (section_ord, title, instructions, sub_question_ids, corpus) to (section_ord, markdown)
    write: Callable[[DataFrame, Meter], DataFrame]
    # (section text, proof) to an array of rewrites; None drops failing claims
    rewrites: Callable[[Column, Column], Column] | None = None
    # entailment score of (claim, proof); the rerank score where None
    entailment: Callable[[Column, Column], Column] | None = None
    robots: Callable[[SparkSession, DataFrame], DataFrame] = _no_robots
    # assembled draft to a polished one; None keeps the draft
    polish: Callable[[str, Meter], str] | None = None
    # tokens of chunks and of corpus entries
    counter: TokenCounter = BY_LENGTH


class Research:
    def __init__(self, spark: SparkSession, data_dir: str, components: Components, settings: Settings | None = None,
                 prices: list[tuple] = ledger.PRICES) -> None:
        ship_package(spark)
        self.spark, self.dir, self.parts = spark, data_dir.rstrip("/"), components
        self.settings = settings or Settings()
        self.prices = ledger.price_table(spark, prices)
        self.store = RunStore(spark, f"{self.dir}/log")
        self.cache = fetch.BodyCache(spark, f"{self.dir}/cache")

    # ---- public

    def research(self, topic: str) -> dict[str, Any]:
        return self._drive(self.store.create_run(topic, self.settings.snapshot()), topic, Meter())

    def resume(self, run_id: str) -> dict[str, Any]:
        """Go on with a run; its complete stages are replayed. The cap is looked
        at again with the next call that is recorded."""
        run = self.store.get_run(run_id)
        meter = Meter()
        meter.rows = [json.loads(r.entry) for r in self.store.ledger(run_id).collect()]
        return self._drive(run_id, run["topic"], meter)

    def runs(self, limit: int = 50) -> DataFrame:
        return list_runs(self.store.runs(), limit)

    def inspect(self, run_id: str) -> tuple[dict[str, Any], DataFrame, DataFrame]:
        """The run, its stages in the order they were started, and what their
        payloads hold."""
        stages = self.store.stages(run_id).orderBy("first_seq")
        return self.store.get_run(run_id), stages, payload_summary(stages)

    # ---- stages

    def _table(self, run_id: str, stage: str, it: int) -> str:
        return f"{self.dir}/runs/{run_id}/{stage}-{it}"

    def _stage(self, run_id: str, stage: str, it: int, meter: Meter, compute: Callable[[], DataFrame]) -> DataFrame:
        path = self._table(run_id, stage, it)
        done = self.store.get_stage(run_id, stage, it)
        if done is None or done["status"] != "completed":
            self.store.start_stage(run_id, stage, it)
            logged = len(meter.rows)
            try:
                compute().write.mode("overwrite").parquet(path)
                self._charge(run_id, meter, logged)
            except Exception as exc:
                self.store.fail_stage(run_id, stage, f"{type(exc).__name__}: {exc}", it)
                raise
            self.store.complete_stage(run_id, stage, {"path": path, "n_rows": self.spark.read.parquet(path).count()}, it)
        return self.spark.read.parquet(path)

    def _charge(self, run_id: str, meter: Meter, logged: int) -> None:
        """Log new calls, then enforce the cap: the call that crosses it counts."""
        if len(meter.rows) == logged:
            return
        for row in meter.rows[logged:]:
            self.store.append_ledger(run_id, row)
        costs = ledger.ledger_costs(meter.calls(self.spark), self.prices)
        cap = self.settings.run.cost_cap_usd
        spent = costs.agg(F.sum("cost_usd")).head()[0] or 0.0
        if spent > cap:
            raise CostCapExceeded(f"spent ${spent:.4f}, more than the allowed ${cap:.2f}")

    def _fetched(self, urls: DataFrame) -> DataFrame:
        """Statuses of all URLs; new bodies go to the cache."""
        wanted = urls.select("url", "url_ord")
        cached = wanted.join(self.cache.missing(wanted.select("url")), "url", "left_anti").withColumn("status", F.lit("ok"))
        new = self.cache.missing(wanted)
        rules = fetch.parse_robots(self.parts.robots(self.spark, new), self.settings.fetch.user_agent)
        # Robots files and pages are asked for once: what reads them more than once reads what is written down here.
        gated = cut_lineage(fetch.robots_allowed(new, rules))
        refused = gated.filter(~F.col("allowed")).select("url", "url_ord", F.lit("robots_disallowed").alias("status"))
        allowed = gated.filter("allowed").select("url", "url_ord")
        replies = self.parts.fetch(allowed.select("url")).withColumn(
            "status",
            fetch.fetch_status(
                F.col("http_status"), F.col("content_type"), F.col("content_length"), F.octet_length("body"), F.col("failure"),
                self.settings.fetch.max_bytes,
            ),
        )
        replies = cut_lineage(replies)
        ok = replies.filter("status = 'ok'").select(
            "url", "final_url", "http_status", "content_type", F.current_timestamp().alias("fetched_at"), "body"
        )
        outcome = refused.unionByName(cached).unionByName(
            allowed.join(replies.select("url", "status"), "url").select("url", "url_ord", "status")
        )
        # Statuses are fixed before the cache changes, since they depend on it.
        outcome = cut_lineage(outcome)
        self.cache.add(ok)
        return outcome

    def _drive(self, run_id: str, topic: str, meter: Meter) -> dict[str, Any]:
        started = dt.datetime.now(dt.UTC)
        self.store.set_run(run_id, status="running")
        try:
            result = self._stages(run_id, topic, meter, started)
        except Exception:
            self.store.set_run(run_id, status="failed")
            raise
        self.store.set_run(run_id, status="completed")
        return result

    def _stages(self, run_id: str, topic: str, meter: Meter, started: dt.datetime) -> dict[str, Any]:
        cfg, parts, spark = self.settings, self.parts, self.spark

        def stage(name: str, it: int, compute: Callable[[], DataFrame]) -> DataFrame:
            return self._stage(run_id, name, it, meter, compute)

        plan = stage("plan", 0, lambda: self._checked_plan(parts.plan(topic, meter)))
        index = ChunkIndex(spark, f"{self.dir}/runs/{run_id}/index").open()
        queries = search.all_queries(plan)
        queries = row_rank(queries, [F.col("sq_ord"), F.col("pos")], out="n").select(
            (F.col("n") - 1).cast("int").alias("query_idx"), "query"
        )
        totals = dict(n_queries=0, n_urls_fetched=0, n_sources=0, n_docs_extracted=0, n_chunks=0, n_chunks_after_dedup=0)
        collected: DataFrame | None = None
        it = 0
        while True:
            hits = stage("search", it, lambda q=queries: search.merge_hits(parts.search(q), cfg.search.results_per_query))
            ordered = row_rank(hits.select("url", "query_idx", "rank"), [F.col("query_idx"), F.col("rank")], out="url_ord")
            fetched = stage("fetch", it, lambda o=ordered: self._fetched(o))
            ok = fetched.filter("status = 'ok'")
            docs = stage("extract", it, lambda o=ok: self._extracted(o))
            chunks = stage("chunk", it, lambda d=docs: self._ordered_chunks(d))
            vectors = stage("embed", it, lambda c=chunks: c.withColumn("vector", parts.embed(F.col("text"))))
            decided = stage("dedup", it, lambda v=vectors: dedup.dedup(v, "ord", "text", "vector", cfg.dedup))
            kept = vectors.join(decided.filter("dup_of is null"), vectors["ord"] == decided["rank"], "left_semi")

            def indexed(k: DataFrame = kept) -> DataFrame:
                n = index.add(k)
                return spark.createDataFrame([(n, index.count())], "n_inserted bigint, n_total bigint")

            stage("index", it, indexed)
            questions = plan.select("sub_question_id", "question")
            asked = questions.withColumn("vector", parts.embed(F.col("question")))
            found = stage("retrieve", it, lambda a=asked: index.nearest(a, cfg.retrieve.ann_top_k))
            ranked = stage("rerank", it, lambda f=found, q=questions: self._reranked(index, f, q))
            judged = stage("triage", it, lambda r=ranked, i=it: self._judged(r, i))
            good = triage.keep_relevant(judged, cfg.triage.confidence_floor)
            collected = good if collected is None else collected.unionByName(good)

            totals["n_queries"] += queries.count()
            totals["n_urls_fetched"] += hits.count()
            totals["n_sources"] += ok.count()
            totals["n_docs_extracted"] += docs.count()
            totals["n_chunks"] += chunks.count()
            totals["n_chunks_after_dedup"] += decided.filter("dup_of is null").count()
            self.store.set_run(run_id, iteration=it)
            if it + 1 >= cfg.run.max_iterations:
                break
            so_far = triage.accumulate(collected, ["sub_question_id", "chunk_id"], "ord")
            gap = stage("gap", it, lambda e=so_far, i=it: self._gap(plan, e, i, meter)).head()
            if gap.saturated or not gap.new_queries:
                break
            queries = spark.createDataFrame(list(enumerate(gap.new_queries)), "query_idx int, query string")
            it += 1

        # At most rerank_top_k rows per sub-question and pass.
        everything = cut_lineage(triage.accumulate(collected, ["sub_question_id", "chunk_id"], "ord"))
        chosen = evidence.select_evidence(everything, cfg.report.corpus_budget_tokens, counter=self.parts.counter)
        # The numbering comes from the selected evidence, in every run and resume.
        cited = cut_lineage(evidence.citation_table(chosen))
        n_cited = cited.count()
        draft = stage("synthesize", 0, lambda: self._written(plan, chosen, n_cited, meter))
        summary: dict[str, Any] = {}
        final = draft
        if cfg.verify.enabled:
            pieces = stage("verify", 0, lambda: self._verified(draft, cited, everything))
            summary = verify.summarize(pieces).head().asDict()
            final = verify.rebuild(pieces, ["section_ord", "title"])
        n_evidence = everything.agg(F.count_distinct("chunk_id")).head()[0]

        def rendered() -> DataFrame:
            path = self._render(run_id, topic, final, cited, meter, started, it + 1, {**totals, "n_chunks_evidence": n_evidence, **summary})
            return spark.createDataFrame([(path,)], "report_path string")

        path = stage("render", 0, rendered).head().report_path
        costs = ledger.ledger_costs(meter.calls(spark), self.prices).agg(F.sum("cost_usd")).head()[0]
        return {
            "run_id": run_id, "report_path": path, "total_cost_usd": costs or 0.0, "iterations": it + 1,
            "n_sources": totals["n_sources"], "n_chunks_indexed": index.count(), "n_chunks_evidence": n_evidence,
        }

    # ---- what stages compute

    def _checked_plan(self, plan: DataFrame) -> DataFrame:
        problems = [r.problem for r in sections.check_plan(plan).collect()]
        if problems:
            raise ValueError("; ".join(problems))
        return plan

    def _extracted(self, ok: DataFrame) -> DataFrame:
        bodies = self.cache.lookup(ok).select("url", F.col("body").alias("html"))
        return extract.extract_documents(ok.select("url", "url_ord").join(bodies, "url"))

    def _ordered_chunks(self, docs: DataFrame) -> DataFrame:
        chunks = chunking.chunk_documents(docs.select("url_ord", "url", "title", "blocks"), self.settings.chunk, self.parts.counter)
        return row_rank(chunks, [F.col("url_ord"), F.col("position")], out="ord").drop("url_ord")

    def _reranked(self, index: ChunkIndex, found: DataFrame, questions: DataFrame) -> DataFrame:
        chunks = index.get_many(found.select("chunk_id").distinct())
        candidates = found.join(chunks, "chunk_id").join(questions, "sub_question_id")
        return retrieve.rerank(candidates, self.settings.retrieve.rerank_top_k, self.parts.score)

    def _judged(self, ranked: DataFrame, it: int) -> DataFrame:
        passage = tx.passage("text", self.settings.triage.passage_chars)
        reply = self.parts.verdict(F.col("question"), passage)
        judged = ranked.withColumn("verdict", triage.parse_verdict(reply)).withColumnRenamed("score", "rerank_score")
        # Order of collection: pass, sub-question, rerank position.
        placed = row_rank(judged, [F.col("sub_question_id"), F.col("rerank_rank")], out="ord")
        placed = placed.withColumn("ord", F.col("ord") + F.lit(it) * F.lit(1 << 40))
        return placed.select(
            "ord", "sub_question_id", "chunk_id", "url", "doc_title", "heading_path", "text", "start_char", "end_char",
            "rerank_score", "verdict",
        )

    def _gap(self, plan: DataFrame, so_far: DataFrame, it: int, meter: Meter) -> DataFrame:
        room = self.settings.triage.context_tokens - GAP_REPLY_TOKENS - GAP_OVERHEAD_TOKENS
        digest = evidence.budgeted_digest(plan, so_far, max(1000, int(room / TOKEN_RATIO))).head().digest
        gap = self.parts.gap(digest, it, meter)
        return self.spark.createDataFrame([(gap.saturated, gap.new_queries)], "saturated boolean, new_queries array<string>")

    def _written(self, plan: DataFrame, chosen: DataFrame, n_cited: int, meter: Meter) -> DataFrame:
        planned = sections.plan_sections(plan, self.settings.report.max_sections)
        n_questions = plan.count()
        spanning = F.size("sub_question_ids") == n_questions
        own = evidence.section_corpora(chosen, planned.filter(~spanning), self.settings.report.section_budget_tokens)
        # The digest of the whole plan, for the sections that span it: three claims
        # for each of at most 15 sub-questions.
        digest = F.lit(evidence.section_digest(plan, chosen).head().digest)
        asked = planned.join(own, "section_ord", "left").select(
            "section_ord", "title", "instructions", "sub_question_ids",
            F.when(spanning, digest).otherwise(F.coalesce("corpus", F.lit(evidence.EMPTY_CORPUS))).alias("corpus"),
        )
        asked = cut_lineage(asked)
        drafted = asked.select("section_ord", "title").join(self.parts.write(asked, meter), "section_ord")
        clean = sections.clean_sections(drafted, n_cited).select("section_ord", "title", "markdown")
        return clean if self.parts.polish is None else self._polished(clean, meter)

    def _polished(self, clean: DataFrame, meter: Meter) -> DataFrame:
        """One pass over the whole draft, thrown away if it touched a marker."""
        rows = clean.orderBy("section_ord").collect()
        whole = "\n\n".join(x for r in rows for x in (f"<!--Q-SECTION:{r.title}-->", r.markdown))
        try:
            reply = self.parts.polish(whole, meter)
        except CostCapExceeded:
            raise
        except Exception:
            return clean
        before = self.spark.createDataFrame([("draft", whole)], "key string, text string")
        after = self.spark.createDataFrame([("draft", reply.strip())], "key string, text string")
        if not sections.guard_polish(before, after).head().accepted:
            return clean
        pieces = sections.polished_sections(after)
        first = rows[0].section_ord
        return pieces.select((F.col("section_ord") + first).cast("bigint").alias("section_ord"), "title", "markdown")

    def _verified(self, draft: DataFrame, cited: DataFrame, everything: DataFrame) -> DataFrame:
        key = ["section_ord", "title"]
        pieces = verify.split_pieces(draft, key)
        chunks = everything.select("chunk_id", "text").dropDuplicates(["chunk_id"])
        proven = verify.attach_evidence(pieces, key, cited, chunks, self.settings.verify)
        return verify.judge(proven, self.parts.entailment or self.parts.score, self.parts.rewrites, self.settings.verify)

    def _render(self, run_id: str, topic: str, final: DataFrame, cited: DataFrame, meter: Meter, started: dt.datetime,
                iterations: int, counts: dict[str, Any]) -> str:
        if not verify.dangling(final, ["section_ord"], "markdown", cited).isEmpty():
            raise CitationError("a citation marker of the report does not resolve")
        body = [f"# {topic}", ""]
        for s in final.orderBy("section_ord").collect():
            body += [f"## {s.title}", "", s.markdown, ""]
        costs = ledger.ledger_costs(meter.calls(self.spark), self.prices)
        manifest = {
            "run_id": run_id, "topic": topic, "started_at": started.isoformat(),
            "finished_at": dt.datetime.now(dt.UTC).isoformat(), "iterations": iterations, **counts,
        }
        parts = [
            "\n".join(body), evidence.references_text(cited).head().references, "",
            ledger.ledger_markdown(costs, self.settings.run.cost_cap_usd), "", "## Run manifest", "", "```json",
            json.dumps(manifest, indent=2, sort_keys=True), "```", "",
        ]
        return write_report(self.spark, "\n".join(parts), f"{self.dir}/reports", run_id)


def write_report(spark: SparkSession, markdown: str, folder: str, run_id: str) -> str:
    """Write ``report-<run_id>.md`` as UTF-8 with line feeds, on any file system that Spark reads; returns the path."""
    name = f"report-{run_id}.md"
    Folder(spark, folder).write(name, markdown)
    return f"{folder}/{name}"
