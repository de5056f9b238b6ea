"""Operational facts kept live: metrics, failure ratios, file states, leases, ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from granary.operators import chunk, operations
from granary.streaming.sinks import write_batch

# Failure window and the limits at which a breaker would open.
WINDOW_SECONDS, MIN_REQUESTS, FAILURE_RATIO = 60, 4, 0.5


def metric_rollup(points: DataFrame, delay: str = "10 minutes", width: str = "1 minute", scale: int = 2) -> DataFrame:
    """Counts, totals and maxima per name, labels and minute; input: ts, name, labels, value."""
    value = F.col("value")
    return (
        points.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "name", "labels")
        .agg(F.count("*").alias("n"), F.sum(value.cast(f"decimal(18,{scale})")).cast("double").alias("total"), F.max(value).alias("max"))
        .select(F.col("window.start").alias("bucket"), "name", "labels", "n", "total", "max")
    )


def failure_ratio(
    requests: DataFrame,
    delay: str = "5 minutes",
    width: str = f"{WINDOW_SECONDS} seconds",
    step: str = "10 seconds",
) -> DataFrame:
    """Failures over requests per sliding window and whether they would open the breaker; input: ts, provider, ok."""
    counted = (
        requests.withWatermark("ts", delay)
        .groupBy(F.window("ts", width, step), "provider")
        .agg(F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("failures"))
    )
    ratio = F.col("failures") / F.col("requests")
    return counted.select(
        F.col("window.start").alias("bucket"),
        "provider",
        "requests",
        "failures",
        ((F.col("requests") >= MIN_REQUESTS) & (ratio >= FAILURE_RATIO)).alias("open"),
    )


def job_dedup(jobs: DataFrame, key: str = "idempotency_key", delay: str = "1 hour") -> DataFrame:
    """Each idempotency key once within the watermark; input: ts and the key."""
    return jobs.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def file_status(events: DataFrame) -> DataFrame:
    """Latest stage per file; once deleted a file stays deleted, however late other news arrive.

    Both parts are plain aggregates, so they combine before the shuffle and need no order.
    """
    gone = F.bool_or(F.col("status").isin(*operations.DELETED_STATUSES))
    newest = F.max_by("status", F.struct("ts", "seq"))
    return events.groupBy("file_id").agg(
        F.when(gone, "deleted").otherwise(newest).alias("status"), F.count("*").alias("updates")
    )


def lease_sessions(beats: DataFrame, lease: str, delay: str) -> DataFrame:
    """Runs of heartbeats; a run ends when no beat came within the lease, and the job is queued again."""
    return (
        beats.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", lease).alias("s"), "worker")
        .agg(F.count("*").alias("beats"))
        .select("worker", F.col("s.start").alias("started"), F.col("s.end").alias("expired_at"), "beats", F.lit("queued").alias("status"))
    )


def ingest(documents: DataFrame, size: int, overlap: int) -> DataFrame:
    """Arriving documents as chunks."""
    return chunk.window_segments(documents, "doc_id", "text", size, overlap)


def ingest_writer(chunks_path: str, catalog_path: str) -> Callable[[DataFrame, int], None]:
    """Write the chunks of a micro-batch and a catalog row for each of its documents."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            write_batch(batch, number, chunks_path)
            rows = batch.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))
            write_batch(rows, number, catalog_path)
        finally:
            batch.unpersist()

    return write


def quality_writer(good_path: str, bad_path: str) -> Callable[[DataFrame, int], None]:
    """Route lifecycle events that miss required fields aside; input: event_id, event, fields."""

    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("missing", operations.missing_fields(F.col("event"), F.col("fields"))).persist()
        try:
            bad = F.size("missing") > 0
            write_batch(marked.filter(bad).select("event_id", "event", "missing"), number, bad_path)
            write_batch(marked.filter(~bad).select("event_id", "event"), number, good_path)
        finally:
            marked.unpersist()

    return write


def coverage_gauge(points: DataFrame) -> DataFrame:
    """Last coverage per mode and how often each bucket occurred; input: ts, seq, mode, ratio."""
    ratio = F.col("ratio")
    bucket = operations.coverage_bucket(ratio)
    names = ("lt_50", "ge_50_lt_80", "ge_80_lt_95", "ge_95")
    return points.groupBy("mode").agg(
        F.max_by("ratio", F.struct("ts", "seq")).alias("last_ratio"), *[F.count_if(bucket == n).alias(n) for n in names]
    )




def seconds(time: Column) -> Column:
    return operations.micros(time) / 1e6
