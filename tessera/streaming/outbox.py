"""Change events as a stream: propagation by micro-batch, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import propagation

SCHEMA = "event_id long, ts timestamp, context_id long, account_id string, change_type string, new_version int, is_breaking boolean"


def append(changes: DataFrame, path: str) -> None:
    """A10: the outbox sink."""
    changes.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(path)


def read_outbox(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The outbox source."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", str(files_per_batch)).parquet(path)


def propagate(stream: DataFrame, edges: DataFrame, subscriptions: DataFrame, sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Actions of each micro-batch, written below sink/batch=<id>. A batch that runs again replaces its own folder, so every action
    is there once. The rules are those of the batch operator."""

    def write(batch: DataFrame, batch_id: int) -> None:
        propagation.actions(batch, edges, subscriptions).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    trigger = {"availableNow": True} if available_now else {"processingTime": "30 seconds"}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def unique(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def tumbling_counts(changes: DataFrame, width: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """Events of each kind in each window; the same for a stream (append mode; late: None where it has a watermark already) and a table. An extension."""
    source = changes.withWatermark("ts", late) if changes.isStreaming and late else changes
    return source.groupBy(F.window("ts", width).alias("w"), "change_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "change_type", "n")


def sessions(changes: DataFrame, gap: str = "6 hours", late: str | None = "1 hour") -> DataFrame:
    """Bursts of events on a context, cut where nothing happens for so long. An extension."""
    source = changes.withWatermark("ts", late) if changes.isStreaming and late else changes
    return source.groupBy(F.session_window("ts", gap).alias("w"), "context_id").agg(F.count("*").alias("n")).select("context_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
