"""Incremental ingestion: micro-batches that recompute what they touch, so that repeated and late rows change nothing twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.operators.merge import Snapshots, upsert


def stream_of(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def activity_totals(events: DataFrame) -> DataFrame:
    """Running n, first and last activity of each session, batch or stream: no watermark, so nothing late is dropped."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("started_at"), F.max("ts").alias("last_activity_at"))


def into_snapshots(events: DataFrame, snapshots: Snapshots, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]):
    """Runs the stream to its present end; each micro-batch becomes one snapshot. `merge` must be idempotent."""

    def step(batch: DataFrame, _: int) -> None:
        head = snapshots.read() if snapshots.version() else None
        snapshots.commit(merge(head, batch))

    query = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return snapshots.read()


def merge_activity(head: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Last row of each event id (of equal times, the one whose columns sort last), kept as the table of events by id: a row that comes again changes nothing."""
    others = [c for c in batch.columns if c != "event_id"]
    rows = batch if head is None else head.unionByName(batch)
    return rows.groupBy("event_id").agg(F.max_by(F.struct(*others), F.struct("ts", F.to_json(F.struct(*others)))).alias("e")).select("event_id", *[f"e.{c}" for c in others])


def merge_messages(generation: int) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    return lambda head, batch: batch if head is None else upsert(head, batch.select("conversation_id", "native_id", "part", "text"), generation)


def windowed_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Addition: counts by event-time window and type."""
    return events.groupBy(F.window("ts", width).start.alias("day"), "event_type").agg(F.count("*").alias("n"))
