"""The chunk index: hash-bucketed Parquet tables with vectors and insert-once semantics.

An insert adds a commit: a folder of Parquet files partitioned by the hash bucket of the id, and a Bloom filter per bucket. A manifest, one small
file per version, lists the commits with their rows per bucket; it is renamed into place, so readers see whole commits only and of
two writers with one version in mind the second one looks again at what the first has added. The ids of a batch are looked up in the filters, and only buckets that
may hold one of them are read.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from attesta import schemas
from attesta.operators import retrieve
from attesta.operators.cells import VectorCells
from attesta.operators.topk import top_k
from attesta.sources.files import Folder

#: Buckets of a new index, hash functions of a filter, bits per id in it.
BUCKETS, HASHES, BITS_PER_ID = 64, 4, 16
#: Bits of one row of a filter, as the functions bitmap_* have them.
_PART = 32_768
_STORED = T.StructType([*schemas.INDEX.fields, T.StructField("commit", T.StringType()), T.StructField("bucket", T.IntegerType())])


def first_rows(batch: DataFrame, key: str = "chunk_id", order: str = "ord") -> DataFrame:
    """The first row per key."""
    others = [c for c in batch.columns if c not in (key, order)]
    row = F.min_by(F.struct(*others), order)
    first = batch.groupBy(key).agg(F.min(order).alias(order), row.alias("_row"))
    return first.select(*[F.col(f"_row.{c}").alias(c) if c in others else F.col(c) for c in batch.columns])


def not_yet_indexed(batch: DataFrame, index: DataFrame, key: str = "chunk_id", order: str = "ord") -> DataFrame:
    """Rows of ``batch`` that an insert adds: the first one per key, unless the
    index has that key. Existing rows are never changed."""
    return first_rows(batch, key, order).join(index.select(key), key, "left_anti")


class ChunkIndex:
    """Chunks and vectors of one run."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self._buckets = spark, path, buckets
        self._manifests = Folder(spark, f"{path}/manifest")
        self._files = Folder(spark, path)

    def open(self) -> "ChunkIndex":
        """Create the index, or check the schema of the existing one. A plain table of the right schema is taken over."""
        if self._manifests.names():
            self.manifest()
            return self
        old = None
        try:
            old = schemas.assert_schema(self.spark.read.parquet(self.path), schemas.INDEX, self.path)
        except AnalysisException:
            pass
        self._commit({"version": 0, "schema_version": schemas.INDEX_VERSION, "buckets": self._buckets, "commits": []})
        if old is not None:
            self.add(old.drop("schema_version"))
        return self

    def manifest(self) -> dict:
        """The newest version: ``version``, ``buckets``, ``commits`` (id, filter bits per bucket, rows per bucket)."""
        versions = [int(m.group(1)) for n in self._manifests.names() if (m := re.fullmatch(r"v(\d+)\.json", n))]
        found = json.loads(self._manifests.read(f"v{max(versions):09d}.json"))
        if found["schema_version"] != schemas.INDEX_VERSION:
            raise schemas.SchemaMismatchError(found["schema_version"], schemas.INDEX_VERSION, self.path)
        return found

    def _commit(self, manifest: dict) -> bool:
        return self._manifests.create(f"v{manifest['version']:09d}.json", json.dumps(manifest), f".{uuid.uuid4().hex}")

    def _bucket(self, chunk_id: Column, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(chunk_id), F.lit(manifest["buckets"])).cast("int")

    def _read(self, commits: list[dict], buckets: dict[str, list[int]] | None = None) -> DataFrame:
        """Rows of some commits with their bucket; ``buckets`` names those to read of each commit."""
        folders = [f"{self.path}/data/commit={c['id']}" for c in commits if c["rows"]]
        if buckets is not None:
            folders = [f"{self.path}/data/commit={c}/bucket={b}" for c, some in buckets.items() for b in some]
        if not folders:
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).option("basePath", f"{self.path}/data").parquet(*folders)

    def table(self) -> DataFrame:
        return self._read(self.manifest()["commits"]).drop("commit", "bucket")

    def add(self, chunks: DataFrame) -> int:
        """Insert chunks with a ``vector``; returns how many were new.

        An ``ord`` column says which of two rows with one id comes first; without
        it the smaller position wins. The batch is evaluated once. Of two writers that insert one id at once, one adds it.
        """
        batch = chunks.withColumn("schema_version", F.lit(schemas.INDEX_VERSION))
        if "ord" not in batch.columns:
            batch = batch.withColumn("ord", F.col("position").cast("bigint"))
        names = [f.name for f in schemas.INDEX.fields]
        # Checked inside the write: vectors may be dear to compute.
        missing = F.raise_error(F.lit("a chunk without a vector cannot be indexed")).cast("array<float>")
        batch = batch.withColumn("vector", F.coalesce("vector", missing))
        typed = [F.col(f.name).cast(f.dataType) for f in schemas.INDEX.fields]
        manifest = self.manifest()
        own = self._stored(first_rows(batch.select(*names, "ord")).select(*typed), manifest)
        seen: set[str] = set()
        while True:
            unseen = [c for c in manifest["commits"] if c["id"] not in seen]
            own = self._without_known(own, unseen, manifest)
            if not own["rows"]:
                return 0
            seen |= {c["id"] for c in unseen}
            if self._commit({**manifest, "version": manifest["version"] + 1, "commits": [*manifest["commits"], own]}):
                return sum(own["rows"].values())
            manifest = self.manifest()

    def _stored(self, rows: DataFrame, manifest: dict) -> dict:
        """Write rows and their filters; nobody sees them before a manifest names them."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/data/commit={name}"
        placed = rows.withColumn("bucket", self._bucket(F.col("chunk_id"), manifest)).repartition("bucket").sortWithinPartitions("bucket", "chunk_id")
        placed.write.partitionBy("bucket").parquet(folder)
        stored = self._read([{"id": name, "rows": True}]) if self._files.exists(f"data/commit={name}") else None
        counts = {} if stored is None else {str(r.bucket): r.n for r in stored.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        most = max(counts.values(), default=0)
        bits = max(_PART, 1 << (most * BITS_PER_ID - 1).bit_length()) if most else _PART
        if counts:
            spots = stored.select("bucket", F.explode(_spots(F.col("chunk_id"), F.lit(bits))).alias("spot"))
            parts = spots.groupBy("bucket", F.floor(F.col("spot") / _PART).cast("int").alias("part"))
            parts.agg(F.bitmap_construct_agg(F.col("spot") % _PART).alias("bits")).write.parquet(f"{self.path}/filters/commit={name}")
        return {"id": name, "bits": bits, "rows": counts}

    def _without_known(self, own: dict, commits: list[dict], manifest: dict) -> dict:
        """The commit ``own`` without ids that other commits hold: itself, or a new one."""
        commits = [c for c in commits if c["rows"]]
        if not commits or not own["rows"]:
            return own
        mine = self._read([own])
        hits = self.possible(mine.select("chunk_id", "bucket"), commits)
        known = self._read(commits, hits).select("chunk_id").join(mine.select("chunk_id"), "chunk_id", "left_semi")
        if not hits or known.isEmpty():
            return own
        fresh = self._stored(mine.drop("commit", "bucket").join(known, "chunk_id", "left_anti").select(*schemas.INDEX.fieldNames()), manifest)
        for kind in ("data", "filters"):
            self._files.delete(f"{kind}/commit={own['id']}")
        return fresh

    def possible(self, ids: DataFrame, commits: list[dict] | None = None) -> dict[str, list[int]]:
        """Buckets by commit that may hold one of ``ids`` (chunk_id, and bucket if it is known), from the filters alone."""
        manifest = self.manifest()
        commits = [c for c in (manifest["commits"] if commits is None else commits) if c["rows"]]
        if not commits:
            return {}
        if "bucket" not in ids.columns:
            ids = ids.withColumn("bucket", self._bucket(F.col("chunk_id"), manifest))
        filters = self.spark.read.schema("commit string, bucket int, part int, bits binary").option("basePath", f"{self.path}/filters")
        filters = filters.parquet(*[f"{self.path}/filters/commit={c['id']}" for c in commits])
        which = F.array(*[F.struct(F.lit(c["id"]).alias("commit"), F.lit(c["bits"]).alias("size")) for c in commits])
        asked = ids.select("chunk_id", "bucket", F.inline(which))
        asked = asked.select("chunk_id", "bucket", "commit", F.explode(_spots(F.col("chunk_id"), F.col("size"))).alias("spot"))
        asked = asked.withColumn("part", F.floor(F.col("spot") / _PART).cast("int")).withColumn("place", (F.col("spot") % _PART).cast("int"))
        byte = "cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as int)"
        on = asked.join(filters, ["commit", "bucket", "part"]).filter(F.expr(f"(shiftright({byte}, place % 8) & 1) = 1"))
        whole = on.groupBy("commit", "bucket", "chunk_id").agg(F.count_distinct("spot").alias("n"))
        wanted = asked.groupBy("commit", "bucket", "chunk_id").agg(F.count_distinct("spot").alias("n"))
        found: dict[str, list[int]] = {}
        # At most commits x buckets rows.
        for r in whole.join(wanted, ["commit", "bucket", "chunk_id", "n"]).select("commit", "bucket").distinct().collect():
            found.setdefault(r.commit, []).append(r.bucket)
        return found

    def compact(self) -> None:
        """Replace all commits by one. Readers of an older version keep their files."""
        while True:
            manifest = self.manifest()
            if len(manifest["commits"]) < 2:
                return
            one = self._stored(self._read(manifest["commits"]).drop("commit", "bucket"), manifest)
            # Cells cover commits by name; they are arranged anew when asked for.
            if self._commit({**manifest, "version": manifest["version"] + 1, "commits": [one], "cells": None}):
                return

    def arrange(self) -> VectorCells:
        """Lay the vectors of all present commits out in cells, for ``nearest``. Later commits are searched besides, until the next call."""
        while True:
            manifest = self.manifest()
            covered = [c["id"] for c in manifest["commits"]]
            folder = f"{self.path}/cells/{uuid.uuid4().hex}"
            cells = VectorCells.build(self._read(manifest["commits"]), folder)
            while set(covered) <= {c["id"] for c in manifest["commits"]}:
                if self._commit({**manifest, "version": manifest["version"] + 1, "cells": {"folder": folder, "commits": covered}}):
                    return cells
                manifest = self.manifest()

    def nearest(self, queries: DataFrame, k: int, query_id: str = "sub_question_id", query_vector: str = "vector") -> DataFrame:
        """The ``k`` nearest chunks of each question, as ``retrieve.nearest_chunks`` has them. Of arranged commits only cells that can hold one are read."""
        manifest = self.manifest()
        cells = manifest.get("cells") or {"commits": []}
        rest = [c for c in manifest["commits"] if c["id"] not in cells["commits"]]
        found = retrieve.nearest_chunks(self._read(rest), queries, k, query_id=query_id, query_vector=query_vector)
        if not cells["commits"]:
            return found
        near = VectorCells(self.spark, cells["folder"]).nearest(queries, k, query_id=query_id, query_vector=query_vector)
        if not any(c["rows"] for c in rest):
            return near
        return top_k(near.unionByName(found).drop("ann_rank"), [query_id], [F.col("distance"), F.col("chunk_id")], k, out="ann_rank")

    def count(self) -> int:
        """Rows by the manifest; no data is read."""
        return sum(sum(c["rows"].values()) for c in self.manifest()["commits"])

    def has(self, chunk_id: str) -> bool:
        one = self.spark.createDataFrame([(chunk_id,)], "chunk_id string")
        return not self.get_many(one).isEmpty()

    def get_many(self, ids: DataFrame) -> DataFrame:
        """Chunks whose id occurs in ``ids.chunk_id``, without their vectors. Only buckets that may hold one are read."""
        wanted = ids.select("chunk_id")
        rows = self._read([], self.possible(wanted))
        return rows.join(wanted, "chunk_id", "left_semi").drop("vector", "schema_version", "commit", "bucket")


def _spots(chunk_id: Column, size: Column) -> Column:
    """Places of an id in a filter of ``size`` bits."""
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(chunk_id, F.lit(k)), size.cast("long")) for k in range(HASHES)]))


