"""Near-duplicate groups by HyperMinHash.

Every document gets ``TABLES`` small HyperMinHash sketches. A sketch has ``BUCKETS`` buckets; a bucket
keeps the minimum of the hashes dealt to it, compressed to its number of leading zeros and the next
``MANTISSA`` bits. The registers of one sketch, or some of them if documents less alike are wanted, form one band: documents that agree on a whole band are
candidates. Candidates pass a Jaccard estimate from all registers, corrected for registers that agree by
accident, and then an exact comparison of their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import bytewords as bw
from attesta.llm.components import connected_components
from attesta.llm.skew import join_weighted
from attesta.llm.workspace import Workspace
from attesta.session import cut_lineage

#: Two documents with similarity 0.85 agree on all 8 registers of a sketch with probability 0.27 or more, so that 40
#: sketches miss such a pair 3 times in a million.
TABLES, BUCKETS, MANTISSA = 40, 8, 10
#: A band takes as many registers of a sketch as miss a pair of the wanted similarity no more often than this.
MISSES = 1e-5
#: A candidate band with more members is compared with leaders instead of pair by pair.
SMALL = 12
#: Estimated similarity may fall short of the wanted one by this much: over five standard deviations of 320 registers.
SLACK = 0.12

_TABLE = bw.salts(TABLES, 3) | np.uint64(1)
_EMPTY = np.uint16(0xFFFF)


def registers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Compressed registers, one row of TABLES * BUCKETS for each set of hashes. An empty bucket is 0xFFFF."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(bounds))
    out = np.empty((n, TABLES, BUCKETS), dtype=np.uint16)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for t in range(TABLES):
        h = bw.mix(values * _TABLE[t])
        least = np.full(n * BUCKETS, top, dtype=np.uint64)
        np.minimum.at(least, owner + (h >> np.uint64(61)).astype(np.int64), h & np.uint64((1 << 61) - 1))
        out[:, t] = _compress(least).reshape(n, BUCKETS)
    return out.reshape(n, TABLES * BUCKETS)


def _compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros of 61-bit minima (at most 48 are told apart) and the MANTISSA bits after the first one."""
    # The exponent of the nearest float may round up to the next power of two; frexp of the upper bits cannot.
    high = (least >> np.uint64(13)).astype(np.float64)  # 48 bits: exact
    exponent = np.frexp(high)[1]
    zeros = 48 - exponent
    shift = np.maximum(61 - 1 - zeros - MANTISSA, 0).astype(np.uint64)
    mantissa = (least >> shift) & np.uint64((1 << MANTISSA) - 1)
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    return np.where(least == np.uint64(0xFFFFFFFFFFFFFFFF), _EMPTY, out)


def by_accident(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Chance that registers of two sets without a common element agree, for buckets with n1 and n2 elements on average."""
    a, b = np.maximum(n1, 1e-9)[:, None], np.maximum(n2, 1e-9)[:, None]
    octave = np.arange(48)[None, :]
    low, high = 2.0 ** -(octave + 1), 2.0**-octave
    width = low / (1 << MANTISSA)
    s = a + b
    return (width * a * b / s * (np.exp(-s * low) - np.exp(-s * high))).sum(axis=1)


def estimate(r1: np.ndarray, r2: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Jaccard estimates from rows of registers and set sizes, corrected for accidental agreement."""
    used = (r1 != _EMPTY) | (r2 != _EMPTY)
    same = ((r1 == r2) & used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)
    c = by_accident(n1 / BUCKETS, n2 / BUCKETS)
    return np.clip((same - c) / (1 - c), 0.0, 1.0)


def sketches(docs: DataFrame, key: str, text: str, size: int = 5) -> DataFrame:
    """id, n_shingles, two hashes of the whole set, registers (little-endian 16-bit values) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, values, bounds in bw.shingle_sets(batch.column(1), size):
                n = len(block)
                sums = []
                for seed in (5, 6):
                    prefix = np.concatenate([[0], np.cumsum(bw.mix(values ^ bw.salts(1, seed)[0]))]).astype(np.uint64)
                    sums.append((prefix[bounds[1:]] - prefix[bounds[:-1]]).view(np.int64))
                raw = registers(values, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, n),
                        pa.array(np.diff(bounds)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.array([r.tobytes() for r in raw], pa.binary()),
                    ],
                    ["id", "n_shingles", "k1", "k2", "registers"],
                )

    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, n_shingles long, k1 long, k2 long, registers binary")


_CLASS = ["n_shingles", "k1", "k2"]


def _plausible(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose registers let the wanted similarity seem possible."""
    side = reps.select("id", "n_shingles", "registers")
    both = pairs.join(side.toDF("a", "n1", "r1"), "a").join(side.toDF("b", "n2", "r2"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r1, r2 = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1)
                for c in ("r1", "r2")
            )
            n1, n2 = (batch.column(c).to_numpy().astype(float) for c in ("n1", "n2"))
            near = estimate(r1, r2, n1, n2) >= similarity - SLACK
            yield batch.select(["a", "b"]).filter(pa.array(near))

    # Sizes that differ too much rule a pair out exactly.
    both = both.filter(F.least("n1", "n2") >= F.lit(similarity) * F.greatest("n1", "n2"))
    return both.select("a", "b", "n1", "n2", "r1", "r2").mapInArrow(run, "a long, b long")


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The shingle hashes of each text."""
    found = []
    for block, values, bounds in bw.shingle_sets(texts, size):
        found += [values[bounds[i] : bounds[i + 1]] for i in range(len(block))]
    return found


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are alike: 100 * common >= percent * union."""
    both = pairs.join(texts.toDF("a", "t1"), "a").join(texts.toDF("b", "t2"), "b").select("a", "b", "t1", "t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [_sets(part.column(c), size) for c in ("t1", "t2")]
                good = []
                for x, y in zip(*sets, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _mixed(crowded: DataFrame) -> DataFrame:
    """Members of the bands that hold more than one component."""
    mixed = crowded.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    return crowded.join(mixed.select("band"), "band")


def _against_main(rows: DataFrame, texts: DataFrame, size: int, room: float) -> DataFrame:
    """For each (id, main): how many shingles of main the document lacks (``less``), how many it has beyond main (``more``), and
    the missing ones themselves (``gone``) if they are at most ``room`` times its own number."""
    both = rows.join(texts.toDF("id", "t1"), "id").join(texts.toDF("main", "t2"), "main").select("id", "main", "t1", "t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own, main = _sets(part.column("t1"), size), _sets(part.column("t2"), size)
                gone = [np.setdiff1d(y, x, assume_unique=True) for x, y in zip(own, main, strict=True)]
                less = np.array([len(g) for g in gone], dtype=np.int64)
                n = np.array([len(x) for x in own], dtype=np.int64)
                more = n - np.array([len(y) for y in main], dtype=np.int64) + less
                gone = [g.view(np.int64) if len(g) <= room * k else None for g, k in zip(gone, n, strict=True)]
                columns = [part.column("id"), part.column("main"), pa.array(less), pa.array(more), pa.array(gone, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "main", "less", "more", "gone"])

    return both.mapInArrow(run, "id long, main long, less long, more long, gone array<long>")


def _across(
    crowded: DataFrame, classes: DataFrame, texts: DataFrame, similarity: float, size: int, space: Workspace | None = None
) -> DataFrame:
    """Pairs of one band but of different components that can be alike. Nothing alike is left out, by two exact bounds.

    Of the n shingles of a document, those that no other member of any of these bands has are missing in every partner.
    The others, m, bound the common part of a pair, and so the sizes that a partner can have.

    Members of the component of a band that is largest in all wait for the others to find them. Its first document, ``main``, is the
    measure for the band: two documents near it have in common at most what neither lacks of main, and what both have
    beyond it. Either that is enough by the numbers alone, or both must lack some of the same shingles: they meet by those,
    so that the members of a large group are not all compared with each document beside it.

    Steps are written to ``space``. Without one they get their own, which goes once the pairs are written down.
    """
    if space is None:
        own = Workspace(crowded.sparkSession)
        try:
            return cut_lineage(_across(crowded, classes, texts, similarity, size, own))
        finally:
            own.remove()
    ids = crowded.select("id").union(crowded.select("component")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, values, bounds in bw.shingle_sets(batch.column(1), size):
                owner = np.repeat(np.arange(len(block)), np.diff(bounds))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner + block.first)), pa.array(values.view(np.int64))], ["id", "shingle"]
                )

    seen = texts.join(ids, "id", "left_semi").mapInArrow(run, "id long, shingle long")
    single = seen.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("most")).filter("id = most")
    # An id with several texts has several sizes; of such ids nothing counts as theirs alone.
    several = classes.groupBy("id").agg(F.count("*").alias("texts")).filter("texts > 1")
    single = space.write(single.select("id", "shingle").join(several, "id", "left_anti"))
    alone = single.groupBy("id").agg(F.count("*").alias("alone"))
    sized = classes.join(ids, "id", "left_semi").join(alone, "id", "left").select(
        "id", F.col("n_shingles").alias("n"), F.coalesce("alone", F.lit(0)).alias("alone")
    )
    ratio, dust = (1 + similarity) / similarity, 1e-6
    rows = crowded.join(sized, "id").withColumn("m", F.col("n") - F.col("alone")).filter(F.col("m") >= F.col("n") * F.lit(similarity) - dust)
    # The same main for as many bands as can be, so that a document is measured against few.
    sizes = rows.select("id", "component").distinct().groupBy("component").agg(F.count("*").alias("size"))
    mains = rows.select("band", "component").distinct().join(sizes, "component").groupBy("band")
    mains = mains.agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts"))
    rows = space.write(rows.join(mains.filter("parts > 1").select("band", "main"), "band"))
    measured = rows.select("id", "main", "component", "n", "m", "alone").distinct()
    against = _against_main(measured.select("id", "main"), texts, size, (1 - similarity) / similarity)
    whole = sized.select(F.col("id").alias("main"), (F.col("n") - F.col("alone")).alias("whole"), F.col("alone").alias("own"))
    measured = measured.join(against, ["id", "main"]).join(whole, "main")
    # What main has alone everybody lacks: it says nothing about a pair.
    other = F.col("id") != F.col("main")
    measured = measured.withColumn("less", F.col("less") - F.when(other, F.col("own")).otherwise(0))
    measured = measured.withColumn("more", F.col("more") - F.when(other, F.col("alone")).otherwise(0)).drop("own", "alone")
    # -1: too far from main for its measure; such documents are compared by size alone.
    measured = space.write(measured.withColumn("step", F.when(F.col("gone").isNull(), -1).otherwise(F.col("less"))))
    rows = rows.select("band", "id", "main", "n").join(measured.drop("gone", "less"), ["id", "main", "n"])

    # At most as many values as documents have sizes and distances from main, however crowded the band.
    kinds = rows.groupBy("band").agg(F.collect_set(F.struct("n", "step")).alias("kinds"))
    most = F.col("m") * F.lit(ratio) - F.col("n") + dust

    def surely_short(n, step, more):
        """Whether the numbers alone leave too little in common, unless both lack the same."""
        enough = (F.col("na") + n) / F.lit(ratio) - dust
        return (F.col("sa") >= 0) & (step >= 0) & (F.col("whole") - F.col("sa") - step + F.least(F.col("ea"), more) < enough)

    seekers = rows.filter("component != main").select(
        "band", "main", F.col("id").alias("a"), F.col("component").alias("c"), F.col("m").alias("ma"), F.col("n").alias("na"),
        F.col("step").alias("sa"), F.col("more").alias("ea"), "whole", most.alias("most"),
    )
    possible = F.filter(
        "kinds",
        lambda k: (k["n"] >= F.col("na") * F.lit(similarity) - dust) & (k["n"] <= F.col("most")) & ~surely_short(k["n"], k["step"], F.col("ea")),
    )
    by_size = seekers.join(kinds, "band").select("band", "a", "c", "ma", "na", "sa", "ea", F.col("whole"), F.inline(possible))
    by_size = by_size.join(rows.select("band", "n", "step", "id", "component", "m", "more"), ["band", "n", "step"])
    fits = F.least("m", "ma") * F.lit(ratio) + dust >= F.col("n") + F.col("na")
    differ = F.col("component") != F.col("c")
    by_size = by_size.filter(fits & differ & ~surely_short(F.col("n"), F.col("step"), F.col("more"))).select("a", F.col("id").alias("b"))

    found = measured.select("main", "id", "component", "m", "n", "step", "more", "whole", F.explode("gone").alias("shingle"))
    found = found.join(single.select(F.col("id").alias("main"), "shingle"), ["main", "shingle"], "left_anti")
    left = found.filter("component != main").select(
        "main", "shingle", F.col("id").alias("a"), F.col("component").alias("c"), F.col("m").alias("ma"), F.col("n").alias("na"),
        F.col("step").alias("sa"), F.col("more").alias("ea"), "whole",
    )
    right = found.drop("whole")
    met = left.join(right, ["main", "shingle"]).filter(fits & differ)
    met = met.groupBy("main", "a", "id", "ma", "na", "sa", "ea", "whole", "m", "n", "step", "more").agg(F.count("*").alias("both"))
    common = F.col("whole") - F.col("sa") - F.col("step") + F.col("both") + F.least("ea", "more")
    met = met.filter(common * F.lit(ratio) + dust >= F.col("n") + F.col("na")).select("a", F.col("id").alias("b"))
    return _ordered(by_size.union(met)).distinct()


def band_registers(similarity: float) -> int:
    """How many registers of a sketch form its band: 8 for a similarity of 0.85, 6 for 0.8."""
    few_enough = [n for n in range(1, BUCKETS + 1) if (1 - similarity**n) ** TABLES <= MISSES]
    return max(few_enough, default=1)


def _ordered(df: DataFrame) -> DataFrame:
    return df.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, size: int = 5) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Documents are linked when 100 * common >= ``percent`` * union over their sets of ``size``-word shingles (A-Z lower-cased,
    words ended by ASCII white space). Fewer words make one shingle; no word or a null text makes an empty set, linked with nothing. component_id
    is the smallest id reachable. Rows that share an id but not their text are not linked by it: each row gets
    the component of the smallest id that has its set. Rows without an id have a null component and are kept.
    """
    similarity = percent / 100
    space = Workspace(docs.sparkSession)
    sketched = space.write(sketches(docs, key, text, size))
    # Equal sets are one class; only its smallest id goes on.
    classes = space.write(
        sketched.filter("n_shingles > 0 and id is not null")
        .groupBy(*_CLASS)
        .agg(F.min("id").alias("id"), F.count("*").alias("members"), F.min("registers").alias("registers"))
    )
    width, used = 2 * BUCKETS, 2 * band_registers(similarity)
    bands = classes.select(
        "id",
        F.explode(F.array(*(F.xxhash64(F.lit(t), F.substring("registers", t * width + 1, used)) for t in range(TABLES)))).alias("band"),
    )
    # Most bands have one member, so what is summed up for all of them is kept narrow.
    chosen = bands.groupBy("band").agg(F.count("*").alias("size"), F.min("id").alias("first"), F.max("id").alias("last"))
    chosen = space.write(chosen.filter("size > 1"))
    two = chosen.filter("size = 2").select(F.col("first").alias("a"), F.col("last").alias("b"))
    members = space.write(bands.join(chosen.filter("size > 2"), "band").select("band", "id", "size", "first", "last"))
    crowd = members.filter(F.col("size") > SMALL)
    leaders = crowd.join(classes.select("id", "members"), "id").groupBy("band").agg(
        F.max_by("id", F.struct("members", -F.col("id"))).alias("copied"), F.min_by("id", F.xxhash64("id")).alias("any")
    )
    # All whole texts move once; what is compared later reads those of documents that share a band with another.
    wanted = two.select(F.col("a").alias("id")).union(two.select("b")).union(members.select("id")).distinct()
    whole = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    texts = space.write(whole.join(wanted, "id", "left_semi"))
    tried = _ordered(two.union(_all_pairs(members)).union(_star_pairs(crowd.join(leaders, "band")))).distinct()
    links = space.write(_confirmed(space.write(_plausible(tried, classes, similarity)), texts, percent, size))
    components = connected_components(links, "a", "b")
    # A crowded band that is one component is settled. In others, what can link two components is compared too.
    crowded = crowd.select("band", "id").join(components, "id", "left")
    crowded = space.write(_mixed(crowded.withColumn("component", F.coalesce("component", "id"))))
    if not crowded.isEmpty():
        tried = _across(crowded, classes, texts, similarity, size, space)
        found = _confirmed(space.write(_plausible(tried, classes, similarity)), texts, percent, size)
        components = connected_components(links.union(found), "a", "b")
    total = sketched.count()
    groups = classes.join(components, "id", "left").select(
        *_CLASS, "members", F.coalesce("component", "id").alias("component_id")
    )
    out = join_weighted(sketched.select("id", *_CLASS), groups, _CLASS, "members", total, F.col("id"))
    # Rows that share an id but not their text may get different components.
    out = out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    )
    # Narrow rows; all else that was written goes before the caller moves its texts.
    out = cut_lineage(out)
    space.remove()
    return out


def _all_pairs(members: DataFrame) -> DataFrame:
    """All pairs of bands with at most SMALL members."""
    lists = members.filter(F.col("size") <= SMALL).groupBy("band").agg(F.collect_set("id").alias("ids"))
    pairs = F.flatten(F.transform("ids", lambda x: F.transform(F.filter("ids", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return lists.select(F.inline(pairs))


def _star_pairs(members: DataFrame) -> DataFrame:
    """Each member of a crowded band with the leaders of its band."""
    leaders = F.array_distinct(F.array("first", "last", "copied", "any"))
    return members.select(F.explode(leaders).alias("a"), F.col("id").alias("b"))


def op2_hyperminhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")
