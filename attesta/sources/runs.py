"""The run log: append-only events, read back as the latest state per key."""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.sources.files import Folder

#: A file of events is merged with smaller ones once these have more than one in so many of its events.
GROWTH = 4
# The stages of a run in order.
STAGES = [
    "plan", "search", "fetch", "extract", "chunk", "embed", "dedup", "index", "retrieve", "rerank", "triage",
    "gap", "synthesize", "verify", "render",
]
_RUNS = "seq bigint, run_id string, topic string, status string, created_at string, updated_at string, iteration int, config_snapshot string"
_STAGES = "seq bigint, run_id string, stage string, iteration int, status string, started_at string, finished_at string, payload string, error string"
_LEDGER = "seq bigint, run_id string, entry string"


def latest_stages(events: DataFrame, keys: tuple[str, ...] = ("run_id", "stage", "iteration")) -> DataFrame:
    """The last event per key, with ``first_seq``, the place of the first one.

    A key with very many events is reduced before the shuffle."""
    others = [c for c in events.columns if c not in keys]
    last = F.max_by(F.struct(*others), "seq").alias("_e")
    rows = events.groupBy(*keys).agg(last, F.min("seq").alias("first_seq"))
    return rows.select(*keys, *[F.col(f"_e.{c}").alias(c) for c in others], "first_seq")


def list_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs, ties by id."""
    return runs.orderBy(F.col("created_at").desc(), F.col("run_id")).limit(limit)


def latest_completed(stages: DataFrame) -> DataFrame:
    """Per run the completed stage that was started last."""
    done = stages.filter(F.col("status") == "completed")
    others = [c for c in stages.columns if c != "run_id"]
    best = done.groupBy("run_id").agg(F.max_by(F.struct(*others), "first_seq").alias("s"))
    return best.select("run_id", *[F.col(f"s.{c}").alias(c) for c in others])


def payload_summary(stages: DataFrame) -> DataFrame:
    """Keys of a stage's JSON payload in order, lists as their length, nested
    objects left out: ``(run_id, stage, iteration, key, summary)``."""
    parsed = stages.select(
        "run_id", "stage", "iteration", "payload", F.explode(F.array_sort(F.json_object_keys("payload"))).alias("key")
    )
    value = F.variant_get(F.parse_json("payload"), F.concat(F.lit('$["'), F.col("key"), F.lit('"]')), "variant")
    kind = F.schema_of_variant(value)
    items = F.size(F.variant_get(value, "$", "array<variant>"))
    return parsed.select("run_id", "stage", "iteration", "key", value.alias("v"), kind.alias("kind")).select(
        "run_id", "stage", "iteration", "key",
        F.when(F.col("kind").startswith("ARRAY"),
               F.concat(F.lit("["), F.size(F.try_variant_get("v", "$", "array<variant>")).cast("string"), F.lit(" items]")))
        .when(~F.col("kind").startswith("OBJECT"), F.to_json("v"))
        .alias("summary"),
    )


def _now() -> str:
    return dt.datetime.now(dt.UTC).isoformat()


class EventLog:
    """Events in a folder as lines of JSON, in few files: about the logarithm of their number.

    An event appears as a file of its own, renamed into place. Files are then merged, small ones first, into one that appears before they go, so
    each event is in some file at any time; one that is in two counts once. Files that a merge replaced stay until the next merge, for readers that
    have listed them. Several writers may append; what a lost one left behind is merged by the next.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._folder = Folder(spark, path)
        self._replaced: list[str] = []

    def append(self, event: dict[str, Any]) -> None:
        self._put(1, json.dumps(event) + "\n")
        self._merge()

    def _put(self, n: int, lines: str) -> None:
        self._folder.create(f"events-{n}-{uuid.uuid4().hex}.json", lines, f".{uuid.uuid4().hex}")

    def _merge(self) -> None:
        present = [n for n in self._folder.names() if n.startswith("events-") and n not in self._replaced]
        small, total = [], 0
        for size, name in sorted((int(n.split("-")[1]), n) for n in present):
            if total and size >= GROWTH * total:
                break
            small.append(name)
            total += size
        if len(small) < 2:
            return
        lines: dict[str, None] = {}
        for name in small:
            try:
                lines.update(dict.fromkeys(self._folder.read(name).splitlines()))
            except Exception:
                if self._folder.exists(name):
                    raise
                # Another writer has merged it.
                return
        self._put(len(lines), "".join(f"{line}\n" for line in lines))
        for name in self._replaced:
            self._folder.delete(name)
        self._replaced = small


class RunStore:
    """Runs, stage transitions and ledger entries as event logs, the last two apart for each run.

    Nothing is updated in place: each change appends an event, and the views pick
    the latest one, so a lost writer never damages earlier state. What is asked about one run reads the files of that run.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._logs: dict[str, EventLog] = {}

    def _append(self, table: str, schema: str, row: tuple) -> None:
        names = [column.split()[0] for column in schema.split(", ")]
        folder = f"{self.path}/{table}" if table == "runs" else f"{self.path}/{table}/run={row[0]}"
        if folder not in self._logs:
            self._logs[folder] = EventLog(self.spark, folder)
        self._logs[folder].append(dict(zip(names, (time.time_ns(), *row), strict=True)))

    def _events(self, table: str, schema: str, run_id: str | None = None) -> DataFrame:
        """Events of a table, or of one run in it; some may come twice."""
        folder = f"{self.path}/{table}" if run_id is None else f"{self.path}/{table}/run={run_id}"
        if not Folder(self.spark, folder).exists():
            return self.spark.createDataFrame([], schema)
        lines = self.spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "events-*.json")
        return lines.json(folder)

    def runs(self) -> DataFrame:
        return latest_stages(self._events("runs", _RUNS), ("run_id",))

    def stages(self, run_id: str | None = None) -> DataFrame:
        return latest_stages(self._events("stages", _STAGES, run_id))

    def create_run(self, topic: str, config: dict[str, Any]) -> str:
        run_id = uuid.uuid4().hex[:12]
        now = _now()
        self._append("runs", _RUNS, (run_id, topic, "created", now, now, 0, json.dumps(config)))
        return run_id

    def get_run(self, run_id: str) -> dict[str, Any]:
        row = self.runs().filter(F.col("run_id") == run_id).head()
        if row is None:
            raise KeyError(f"there is no run {run_id}")
        return row.asDict()

    def set_run(self, run_id: str, status: str | None = None, iteration: int | None = None) -> None:
        r = self.get_run(run_id)
        self._append(
            "runs", _RUNS,
            (run_id, r["topic"], status or r["status"], r["created_at"], _now(),
             r["iteration"] if iteration is None else iteration, r["config_snapshot"]),
        )

    def start_stage(self, run_id: str, stage: str, iteration: int = 0) -> None:
        """Start a stage, or start it again after a failure: the earlier payload,
        error and end are gone."""
        self.get_run(run_id)
        self._append("stages", _STAGES, (run_id, stage, iteration, "running", _now(), None, "{}", None))

    def get_stage(self, run_id: str, stage: str, iteration: int = 0) -> dict[str, Any] | None:
        row = self.stages(run_id).filter((F.col("stage") == stage) & (F.col("iteration") == iteration)).head()
        return None if row is None else row.asDict()

    def _finish(self, run_id: str, stage: str, iteration: int, status: str, payload: str | None, error: str | None) -> None:
        s = self.get_stage(run_id, stage, iteration)
        if s is None:
            raise KeyError(f"run {run_id} has not begun stage {stage} of pass {iteration}")
        self._append(
            "stages", _STAGES,
            (run_id, stage, iteration, status, s["started_at"], _now(), payload or s["payload"], error or s["error"]),
        )

    def complete_stage(self, run_id: str, stage: str, payload: dict[str, Any], iteration: int = 0) -> None:
        self._finish(run_id, stage, iteration, "completed", json.dumps(payload), None)

    def fail_stage(self, run_id: str, stage: str, error: str, iteration: int = 0) -> None:
        self._finish(run_id, stage, iteration, "failed", None, error)

    def append_ledger(self, run_id: str, entry: dict[str, Any]) -> None:
        self._append("ledger", _LEDGER, (run_id, json.dumps(entry)))

    def ledger(self, run_id: str) -> DataFrame:
        return self._events("ledger", _LEDGER, run_id).dropDuplicates(["seq", "entry"]).orderBy("seq")
