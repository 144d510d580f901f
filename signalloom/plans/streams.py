"""Queries that run as streams over what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalloom.plans import telemetry
from signalloom.plans.telemetry import marks_of
from signalloom.sources.tables import table
from signalloom.streaming.ingest import Breaker, WatermarkIngest


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of files; a single file is its own folder's only match."""
    schema = table(spark, folder, name).schema
    glob = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    # A table is a folder of files, or one file beside those of other tables.
    files = spark.read.parquet(glob).inputFiles()
    single = len(files) == 1 and files[0].rstrip("/").endswith(f"/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(glob)


def stream_watermark_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Events taken in micro-batches behind per-user marks, which an earlier run left."""
    ingest = WatermarkIngest(spark, "user_id", "ts", start=marks_of(spark, folder))
    return ingest.run(_stream(spark, folder, "events")).select("event_id", "user_id", "event_type")


def stream_circuit_breaker(spark: SparkSession, folder: str) -> DataFrame:
    """Failures in a row per user, with state across micro-batches."""
    return Breaker(spark, "user_id", "ts", "event_id", "event_type = 'error'").run(_stream(spark, folder, "events"))


QUERIES = {f.__name__: f for f in (stream_watermark_ingest, stream_circuit_breaker)}
# What the streams leave where the table is one file, so that one batch holds all events.
SQL = {
    "stream_watermark_ingest": telemetry.SQL["watermark_incremental"].replace("SELECT event_id, e.user_id", "SELECT event_id, e.user_id, event_type", 1),
    "stream_circuit_breaker": f"SELECT user_id, consecutive_failures, broken FROM ({telemetry.SQL['circuit_breaker_state']})",
}
