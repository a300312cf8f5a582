"""Dictionary-compressed WARC archives, written and read by Spark tasks.

Every archive starts with a skippable frame that holds a Zstandard dictionary, trained on records of the same archive;
each record is a Zstandard frame of its own. Records with equal payloads are written once, the others as revisits.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.skew import join_weighted
from attesta.session import cut_lineage, ensure_checkpoint_dir

#: Magic number of the dictionary's skippable frame, and of a plain dictionary (fixed values).
FRAME_MAGIC, DICTIONARY_MAGIC = 0x184D2A5D, 0xEC30A437
#: Profile of a revisit record (fixed value).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Uncompressed bytes of an archive before the next one is begun.
ROLL_BYTES = 32 << 20
#: Size of a dictionary, bytes of records it is trained on, and bytes taken of each of these.
DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLE_EACH = 32 << 10, 2 << 20, 16 << 10
#: Smallest payload that is stored once for all its records.
DEDUP_BYTES = 1000
LEVEL = 3


@dataclass
class Record:
    """What an archive says about one page."""

    page_id: int | None
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None
    url: str | None
    payload: bytes | None


def _clean(value: str) -> str:
    """A header value: control characters and line ends in percent form."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def _uri(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def format_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP header only, with the payload's length and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = _clean(url) if url else f"urn:page:{'' if page_id is None else page_id}"
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Has-URL: {0 if url is None else 1}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> Record:
    """The record back; raises ValueError if lengths or digests do not fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.decode().rsplit("Content-Length: ", 1)[1].split("\r\n")[0])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload does not fit its digest")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return Record(
        number("X-Page-ID"), length, digest, kind, number("X-Refers-To-Page-ID"),
        fields["WARC-Target-URI"] if fields["X-Has-URL"] == "1" else None, payload if kind == "response" else None,
    )


def train(records: list[bytes]) -> bytes:
    """A Zstandard dictionary from the first ``SAMPLE_BYTES`` of records; the plain beginning of them where
    there is too little to train on."""
    samples, size = [], 0
    for r in records:
        samples.append(r[:SAMPLE_EACH])
        size += len(samples[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 10)), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b"\n")


def _loaded(dictionary: bytes) -> zstandard.ZstdCompressionDict:
    trained = dictionary[:4] == struct.pack("<I", DICTIONARY_MAGIC)
    return zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(stream, records: list[bytes]) -> None:
    """An archive: dictionary frame, then a frame for each record."""
    dictionary = train(records)
    stream.write(struct.pack("<II", FRAME_MAGIC, len(dictionary)) + dictionary)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_loaded(dictionary), write_checksum=True)
    for r in records:
        stream.write(compressor.compress(r))


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != FRAME_MAGIC:
        raise ValueError("no dictionary frame")
    decompressor = zstandard.ZstdDecompressor(dict_data=_loaded(stream.read(size)))
    left = b""
    while True:
        if not left:
            left = stream.read(1 << 20)
            if not left:
                return
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(left))
            left = frame.unused_data
            if frame.eof:
                break
            left = stream.read(1 << 20)
            if not left:
                raise ValueError("archive ends inside a record")
        yield b"".join(parts)


def archive_folder(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/warc-{uuid.uuid4().hex}"


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive every row of ``pages`` below ``folder``; one row per archive: path, records, bytes.

    Of rows with equal payloads of at least DEDUP_BYTES the one with the largest id is the response (all of them if that
    row is repeated), the others revisit it; rows without an id come before all others. A null page is an empty payload.
    Each attempt of a task writes to names of its own, and the result lists those of the attempt that succeeded: a task that runs again, or late,
    touches none of them. What an attempt without success left in the folder is listed nowhere.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    large = rows.filter(F.col("size") >= DEDUP_BYTES).select("digest", "size", "page_id")
    shared = large.groupBy("digest", "size").agg(F.count("*").alias("times"), F.max("page_id").alias("keeper")).filter("times > 1 and keeper is not null")
    shared = cut_lineage(shared)
    total = shared.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    rows = join_weighted(rows, shared, ["digest", "size"], "times", total, F.xxhash64("page_id", "url"))
    revisit = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id"))
    rows = rows.select("page_id", "url", "payload", "digest", "keeper", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        waiting: list[bytes] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            name = f"{base}/part-{task.partitionId():06d}-{number:06d}-{task.taskAttemptId()}.warc.zst"
            with fs.open_output_stream(name, compression=None) as out:
                write_archive(out, waiting)
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([len(waiting)], pa.int64()), pa.array([fs.get_file_info(name).size], pa.int64())], ["path", "records", "bytes"]
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for p, u, payload, digest, keeper, again in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    waiting.append(format_record(p, u, payload, digest, keeper, again))
                    size += len(waiting[-1])
                    if size >= ROLL_BYTES:
                        yield flush()
                        waiting, size, number = [], 0, number + 1
        if waiting:
            yield flush()

    # Written once: the manifest is what the write returned, not a second run of it.
    return cut_lineage(rows.mapInArrow(run, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives that ``write_archives`` listed: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url and, if asked for, payload. Payloads are checked against their digests. An archive that
    yields another number of records than listed is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * with_payload
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen, rows = 0, []
                with fs.open_input_stream(path, compression=None) as stream:
                    for raw in read_archive(stream):
                        r = parse_record(raw)
                        rows.append([getattr(r, n) for n in names])
                        seen += 1
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types)], names)
                            rows = []
                if seen != records:
                    raise ValueError(f"{path} has {seen} records, not {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    listed = archives.select("path", "records")
    return listed.repartition(max(1, archives.count()), "path").mapInArrow(run, schema + ", payload binary" * with_payload)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Archive all pages and read the archives back."""
    folder = archive_folder(spark)
    written = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(written, folder)


WARC_SQL = """
WITH p AS (SELECT page_id, url, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS keeper FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id <> keeper THEN keeper END AS refers_to, url
FROM k
"""
