"""Incremental ingest: new pages become chunks of the index, each exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from attesta.config import ChunkSettings
from attesta.operators.chunking import chunk_documents
from attesta.operators.extract import extract_documents
from attesta.session import ship_package
from attesta.sources.index import ChunkIndex

PAGE_SCHEMA = "page_id bigint, url string, html string"


def page_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Parquet files of pages as they arrive in a folder."""
    return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def ingest_pages(
    pages: DataFrame,
    index: ChunkIndex,
    embed,
    checkpoint: str,
    settings: ChunkSettings | None = None,
) -> StreamingQuery:
    """Start a query that adds the chunks of every micro-batch to ``index``.

    ``embed`` makes a vector column of a text column. The insert skips ids that
    the index has, so a micro-batch that is run again after a failure adds nothing
    twice.
    """
    ship_package(pages.sparkSession)

    def add(batch: DataFrame, _: int) -> None:
        docs = extract_documents(batch.select("url", "html")).select("url", "title", "blocks")
        chunks = chunk_documents(docs, settings)
        index.add(chunks.withColumn("vector", _vector(embed, chunks["text"])))

    return (
        pages.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _vector(embed, text: Column) -> Column:
    return embed(text).cast("array<float>")
