"""Structured Streaming: incremental ingest behind watermarks, circuit breaker state, windowed counts.

The sinks here are ``foreachBatch`` sinks over a named folder.  What a batch leaves
depends on that batch and on batches with a smaller number only, and goes to
files of its own number; so a batch that is run again, in the same
session or after a restart on the same folder, leaves the same once more.
State is a log of changes per batch; every ``COMPACT`` batches its sum is
written, and readers start from the last sum below their number.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators.state import broken, past_watermark
from signalloom.sources.storage import shared_folder

COMPACT = 20


def drain(stream: DataFrame, sink: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over what is available, exactly once per folder, and read all it wrote there so far."""
    spark = stream.sparkSession
    at = folder or f"{shared_folder(spark)}/{sink}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


class BatchLog:
    """Numbered parquet folders under one name; ``summed`` ones stand for all up to their number."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at

    def put(self, df: DataFrame, number: int, summed: bool = False) -> None:
        df.write.mode("overwrite").parquet(f"{self.at}/{'sum' if summed else 'each'}/batch={number}")

    def read(self, schema: str, before: int | None = None, summed: bool = False) -> DataFrame:
        """Rows with their batch, of the batches below ``before``."""
        try:
            df = self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.at}/{'sum' if summed else 'each'}")
        except AnalysisException:
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return df if before is None else df.where(F.col("batch") < before)

    def since_sum(self, schema: str, before: int) -> DataFrame:
        """The last sum below ``before`` and the changes after it."""
        last = (before - 1) // COMPACT * COMPACT
        each = self.read(schema, before)
        if last <= 0:
            return each
        return self.read(schema, summed=True).where(F.col("batch") == last).unionByName(each.where(F.col("batch") > last))

    def up_to(self, schema: str, number: int) -> DataFrame:
        """The same with the changes of batch ``number``, whose own sum is not used."""
        return self.since_sum(schema, number).unionByName(self.read(schema).where(F.col("batch") == number))


class WatermarkIngest:
    """Sink that drops items at or before their key's mark, appends the rest and moves the marks forward.

    A batch sees the marks of earlier batches only.  Items without time always pass, as do keys without a mark.
    """

    def __init__(self, spark: SparkSession, key: str, ts: str, folder: str | None = None, start: DataFrame | None = None):
        """``start`` (key, mark) are the marks of a new folder; one that is there already goes on with its own."""
        self.spark, self.key, self.ts, self.start = spark, key, ts, start
        self.at = folder or f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
        self.marks_log, self.rows_log = BatchLog(spark, f"{self.at}/marks"), BatchLog(spark, f"{self.at}/rows")

    def _schema(self, batch: DataFrame) -> str:
        kinds = dict(batch.dtypes)
        return f"{self.key} {kinds[self.key]}, mark {kinds[self.ts]}"

    def _latest(self, log: DataFrame) -> DataFrame:
        """Marks only move forward, so the largest counts."""
        return log.groupBy(self.key).agg(F.max("mark").alias("mark"))

    def marks(self, batch: DataFrame, before: int) -> DataFrame:
        """key, mark as the batches below ``before`` left them."""
        return self._latest(self.marks_log.since_sum(self._schema(batch), before))

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number == 0 and self.start is not None:
            self.marks_log.put(self.start.select(self.key, "mark"), -1)
        self.rows_log.put(past_watermark(batch, self.marks(batch, number), self.key, self.ts, "mark"), number)
        taken = self.rows_log.read(batch.schema.toDDL()).where(F.col("batch") == number)
        # Only the keys of this batch: the log grows with what changes, not with all keys.
        self.marks_log.put(taken.where(F.col(self.ts).isNotNull()).groupBy(self.key).agg(F.max(self.ts).alias("mark")), number)
        if number and number % COMPACT == 0:
            self.marks_log.put(self._latest(self.marks_log.up_to(self._schema(batch), number)), number, summed=True)

    def run(self, stream: DataFrame) -> DataFrame:
        """Take in what is available and return all rows taken in so far."""
        q = stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return self.rows_log.read(stream.schema.toDDL()).drop("batch")


class Breaker:
    """Sink that keeps the failures in a row of every key.

    A batch is summed up per key (failures after its last success, or all) before anything is
    kept, so a key with very many events is no hot task.  Batches arrive in the order of
    time; inside a batch the order is free.
    """

    def __init__(self, spark: SparkSession, key: str, ts: str, tie: str, failed: str, folder: str | None = None):
        self.spark, self.key, self.ts, self.tie, self.failed = spark, key, ts, tie, failed
        self.at = folder or f"{shared_folder(spark)}/breaker-{uuid.uuid4().hex}"
        self.log = BatchLog(spark, f"{self.at}/runs")

    def _schema(self, kinds: dict[str, str]) -> str:
        return f"{self.key} {kinds[self.key]}, failures long, reset boolean"

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = batch.select(self.key, F.struct(self.ts, self.tie).alias("at"), F.expr(self.failed).alias("failed"))
        ok = rows.where("not failed").groupBy(self.key).agg(F.max("at").alias("ok"))
        # The right side has one row per key; the failures are counted before the shuffle.
        after = rows.join(ok, self.key, "left").groupBy(self.key).agg(F.count_if(F.col("failed") & (F.col("ok").isNull() | (F.col("at") > F.col("ok")))).alias("failures"), F.bool_or(F.col("ok").isNotNull()).alias("reset"))
        self.log.put(after, number)
        if number and number % COMPACT == 0:
            self.log.put(self._fold(self.log.up_to(self._schema(dict(batch.dtypes)), number)), number, summed=True)

    def _fold(self, log: DataFrame) -> DataFrame:
        """The failures since the last batch with a success."""
        last = log.where("reset").groupBy(self.key).agg(F.max("batch").alias("last"))
        kept = log.join(last, self.key, "left").where("last is null or batch >= last")
        return kept.groupBy(self.key).agg(F.sum("failures").alias("failures"), F.bool_or("reset").alias("reset"))

    def run(self, stream: DataFrame) -> DataFrame:
        """key, consecutive_failures, broken after all that is available."""
        q = stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        schema = self._schema(dict(stream.dtypes))
        last = self.log.read(schema).agg(F.max("batch")).first()[0]
        state = self._fold(self.log.up_to(schema, last or 0))
        return state.select(self.key, F.col("failures").alias("consecutive_failures"), broken(F.col("failures"), F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp")).alias("broken"))


def windowed_counts(events: DataFrame, ts: str, lateness: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events per type and window, late ones beyond ``lateness`` left out."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")
