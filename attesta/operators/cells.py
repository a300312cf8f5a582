"""Vectors laid out in cells around pivots, for exact nearest neighbours that leave most of them unread.

A vector belongs to the cell of its nearest pivot and, by its distance to that pivot, to one of a few rings of the cell. A ring knows its
number of vectors and the least and largest distance in it, so the triangle inequality bounds from both sides how far its vectors are from
a question. Rings that surely hold ``k`` vectors are read first; of all others only those that can hold a nearer one than the k-th so far.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.operators.retrieve import QUERY_BLOCK, query_blocks, with_keys
from attesta.operators.topk import scored_top_k, top_k
from attesta.session import cut_lineage
from attesta.sources.files import Folder

#: Cells at most, rings of each, vectors in one file of a ring.
MAX_CELLS, RINGS, FILE_ROWS = 256, 4, 250_000
#: Relative error allowed for when a bound is set against a distance.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


class VectorCells:
    """Cells in a folder. ``share`` is the part of all pairs of a question and a vector that the last search scored."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        found = json.loads(Folder(spark, path).read("cells.json"))
        self.key, self.schema = found["key"], T.StructType.fromJson(found["schema"])
        self.pivots = np.array(found["pivots"], dtype=np.float64)
        rings = np.array(found["rings"], dtype=np.float64).reshape(-1, 4)
        self.rings, self.sizes, self.low, self.high = rings[:, 0].astype(int), rings[:, 1].astype(np.int64), rings[:, 2], rings[:, 3]
        self.share = 0.0

    @classmethod
    def build(cls, chunks: DataFrame, path: str, chunk_id: str = "chunk_id", vector: str = "vector") -> "VectorCells":
        """Lay ``chunks`` out below ``path``. Rows without a vector are left out: they are near nothing.

        About the square root of their number of vectors become pivots, ``MAX_CELLS`` at most, drawn by a hash order. Vectors move once; a
        ring of many vectors (copies of one, say) is dealt out by id.
        """
        spark, files = chunks.sparkSession, Folder(chunks.sparkSession, path)
        rows = chunks.filter(F.col(vector).isNotNull()).select(F.col(chunk_id).alias("id"), F.col(vector).alias("vector"))
        cells = min(MAX_CELLS, math.isqrt(rows.count()) // 2 + 1)
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(cells).collect()
        pivots = np.unique(np.array([r.vector for r in drawn], dtype=np.float64), axis=0) if drawn else np.zeros((0, 0))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = _matrix(batch.column(1))
                cell = _squared(m, pivots).argmin(axis=1) if len(m) else np.zeros(0, dtype=int)
                radius = np.sqrt(((m - pivots[cell]) ** 2).sum(axis=1)) if len(m) else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(radius)], ["id", "vector", "cell", "radius"]
                )

        meta = {"key": chunk_id, "schema": rows.schema.jsonValue(), "pivots": pivots.tolist(), "rings": []}
        if drawn:
            placed = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())])
            rows.mapInArrow(place, placed).write.parquet(f"{path}/placed")
            staged = spark.read.schema(placed).parquet(f"{path}/placed")
            steps = F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)])
            cuts = staged.groupBy("cell").agg(F.percentile_approx("radius", steps).alias("cuts"))
            ring = (F.col("cell") * RINGS + F.size(F.filter("cuts", lambda c: c < F.col("radius")))).cast("int")
            # At most MAX_CELLS rows.
            ringed = staged.join(F.broadcast(cuts), "cell").select("id", "vector", "radius", ring.alias("ring"))
            stats = ringed.groupBy("ring").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))
            # At most MAX_CELLS x RINGS rows.
            found = stats.orderBy("ring").collect()
            meta["rings"] = [[r.ring, r.n, r.low, r.high] for r in found]
            pieces = F.create_map(*[F.lit(x) for r in found for x in (r.ring, -(-r.n // FILE_ROWS))])
            piece = F.pmod(F.xxhash64("id"), F.element_at(pieces, F.col("ring")))
            dealt = ringed.select("id", "vector", "ring").repartition("ring", piece).sortWithinPartitions("ring", "id")
            dealt.write.partitionBy("ring").parquet(f"{path}/rings")
            files.delete("placed")
        files.write("cells.json", json.dumps(meta))
        return cls(spark, path)

    def _read(self, numbers: np.ndarray) -> DataFrame:
        folders = [f"{self.path}/rings/ring={n}" for n in numbers]
        schema = T.StructType([*self.schema.fields, T.StructField("ring", T.IntegerType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/rings").parquet(*folders)

    def _best(self, q: np.ndarray, asked: np.ndarray, k: int) -> DataFrame | None:
        """The best ``k`` rows of each question within the rings it asks for: a matrix of questions and rings."""
        some = asked.any(axis=0)
        if not some.any():
            return None
        place = np.full(int(self.rings.max()) + 1, -1)
        place[self.rings] = np.arange(len(self.rings))

        def closeness(column, q=q, asked=asked, place=place) -> np.ndarray:
            ring, vectors = column.flatten()
            ring, m = place[ring.to_numpy()], _matrix(vectors)
            out = np.full((len(m), len(q)), -np.inf)
            for r in np.unique(ring):
                rows, questions = np.flatnonzero(ring == r), np.flatnonzero(asked[:, r])
                out[np.ix_(rows, questions)] = -_squared(m[rows], q[questions])
            return out

        rows = self._read(self.rings[some]).select("id", F.struct("ring", "vector").alias("value"))
        return scored_top_k(rows, "id", "value", closeness, len(q), k)

    def nearest(
        self, queries: DataFrame, k: int, query_id: str = "sub_question_id", query_vector: str = "vector", block: int = QUERY_BLOCK
    ) -> DataFrame:
        """What ``retrieve.nearest_chunks`` returns, ties to the smaller id included, from the rings that can hold it.

        Up to ``block`` questions travel to the tasks at a time. Per block there are two passes: the rings that surely hold ``k`` vectors, then those
        whose nearest possible vector is not farther than the k-th found.
        """
        key_type = queries.schema[query_id].dataType
        schema = T.StructType([
            T.StructField(query_id, key_type), T.StructField(self.key, self.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()), T.StructField("ann_rank", T.IntegerType()),
        ])
        out: DataFrame | None = None
        scored = pairs = 0
        for rows in query_blocks(queries, query_id, query_vector, block) if len(self.rings) else ():
            q = np.asarray([r[query_vector] for r in rows], dtype=np.float64)
            cell = self.rings // RINGS
            away = np.sqrt(np.maximum(_squared(q, self.pivots), 0))[:, cell]
            least = np.maximum(0, np.maximum(away - self.high, self.low - away))
            size = 1 + (q * q).sum(axis=1)[:, None] + (np.sqrt((self.pivots**2).sum(axis=1))[cell] + self.high)[None, :] ** 2
            order = np.argsort(away + self.high, axis=1, kind="stable")
            before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
            first = np.zeros(away.shape, dtype=bool)
            np.put_along_axis(first, order, before < k, axis=1)
            part = cut_lineage(self._best(q, first, k))
            # One row per question of the block.
            limit = np.full(len(q), np.inf)
            for r in part.groupBy("query_no").agg(F.count("*").alias("n"), F.min("score").alias("last")).collect():
                if r.n == k:
                    limit[r.query_no] = -r.last
            second = ~first & (least**2 <= limit[:, None] + SLACK * size)
            more = self._best(q, second, k)
            if more is not None:
                both = part.unionByName(more).drop("rn")
                part = top_k(both, ["query_no"], [F.col("score").desc(), F.col("id")], k)
            scored += int(((first | second) * self.sizes).sum())
            pairs += int(self.sizes.sum()) * len(q)
            part = with_keys(part, query_id, rows, key_type.simpleString()).select(
                query_id, F.col("id").alias(self.key), (-F.col("score")).alias("distance"), F.col("rn").alias("ann_rank")
            )
            out = part if out is None else out.unionByName(part)
        self.share = scored / pairs if pairs else 0.0
        return self.spark.createDataFrame([], schema) if out is None else out
