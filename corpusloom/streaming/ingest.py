"""Incremental ingest: newly landed papers are chunked once and appended.

An extension beside the batch engine; the batch counterpart is ``resume_union``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_papers
from ..schemas import schema as schema_of
from ..sources.envelopes import path_exists

KEY = "arxiv_id"


def landing_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Parsed papers as JSON lines, as they land."""
    reader = spark.readStream.schema(schema_of("parsed")).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder).withColumn("landed_at", F.current_timestamp())


def first_arrivals(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each paper once within the watermark; state older than that is dropped."""
    return stream.withWatermark("landed_at", lateness).dropDuplicatesWithinWatermark([KEY])


def append_new_chunks(spark: SparkSession, out: str):
    """A batch writer that leaves out papers stored before, so a repeated batch adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if path_exists(spark, out):
            batch = batch.join(spark.read.parquet(out).select(KEY).distinct(), KEY, "left_anti")
        chunk_papers(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    return write


def start(spark: SparkSession, landing: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = first_arrivals(landing_stream(spark, landing)).writeStream.foreachBatch(append_new_chunks(spark, out)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
