"""Streaming intake: new files of an inbox, each once, through the pipeline into a record table and an outbox.

Files are told apart by (partner_id, sha256) against the table of jobs inside each micro-batch, so the state is that
table and not the stream's memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import jobs

FILES = "path string, modificationTime timestamp, length long, content binary"


def inbox(spark: SparkSession, path: str, archive: str | None = None, per_batch: int = 1000) -> DataFrame:
    """A stream of (file_id, file_name, partner_id, received_at, content)."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    raw = reader.load(path)
    root = path.removeprefix("file://")
    return raw.select(F.col("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), jobs.partner_of(F.col("path"), root).alias("partner_id"), F.col("modificationTime").alias("received_at"), "content")


def run(files: DataFrame, jobs_path: str, process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start the stream: every batch's new files are handed to ``process`` and entered in the table of jobs.

    The table is keyed by batch, so a batch that is tried again replaces its own rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "partner_id string, sha256 string, job_id string, batch long"
        try:
            known = spark.read.schema(schema).parquet(jobs_path).where(F.col("batch") != number)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], schema)
        fresh = jobs.receive(batch, known).persist()
        try:
            process(fresh, number)
            entry = fresh.select("partner_id", "sha256", F.concat_ws("-", "partner_id", F.substring("sha256", 1, 16)).alias("job_id"))
            entry.write.mode("overwrite").parquet(f"{jobs_path}/batch={number}")
        finally:
            fresh.unpersist()

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """A running count of events by kind, for a stream or a table."""
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
