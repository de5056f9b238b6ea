"""Manifests, chart points and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from granary.functions import cells

PREVIEW_CHARS = 360
RETENTION_HOURS = 168
RETENTION_RUNS = 2_000


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(trimmed) <= chars, trimmed).otherwise(F.concat(F.substring(trimmed, 1, chars), F.lit("...")))


def manifest(chunks: DataFrame, chunk_types: list[str]) -> DataFrame:
    """Per file: artifacts in all and per chunk type, and characters of extracted text."""
    counts = [F.count_if(F.col("chunk_type") == c).alias(f"{c}_count") for c in chunk_types]
    return chunks.groupBy("file_id").agg(
        F.count("*").alias("total_artifacts"),
        *counts,
        F.sum(F.length(F.trim("content"))).alias("extracted_chars"),
    )


def artifact_index(chunks: DataFrame) -> DataFrame:
    """One row per artifact; a file's list stays in rows because it grows with the file."""
    return chunks.select(
        "file_id", F.col("chunk_index").alias("artifact_index"), "chunk_type", preview(F.col("content")).alias("content_preview")
    )


def write_manifest(chunks: DataFrame, chunk_types: list[str], path: str) -> None:
    manifest(chunks, chunk_types).write.json(f"{path}/manifest")
    artifact_index(chunks).write.json(f"{path}/artifacts")


def chart_points(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label, value) points: blank labels go, text that is no number counts as zero."""
    number = F.coalesce(F.replace(F.trim(F.col(value).cast("string")), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))
    text = cells.cell_text(df, label)
    return df.filter(text != "").select(text.alias("label"), number.alias("value"))


def retained(runs: DataFrame, run: str, time: str, as_of: Column, hours: int = RETENTION_HOURS, cap: int = RETENTION_RUNS):
    """Runs to keep: young enough, and the newest ``cap`` of those."""
    young = runs.filter(F.col(time) >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return young.orderBy(F.col(time).desc(), F.col(run).desc()).limit(cap)


def expired(runs: DataFrame, run: str, time: str, as_of: Column, hours: int = RETENTION_HOURS, cap: int = RETENTION_RUNS):
    return runs.join(retained(runs, run, time, as_of, hours, cap).select(run), run, "left_anti")
