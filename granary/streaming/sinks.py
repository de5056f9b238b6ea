"""Starting streams and keeping their results as plain Parquet tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

BATCH = "_batch"


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def write_batch(batch: DataFrame, number: int, path: str) -> None:
    """One directory per micro-batch; a batch run again replaces its own directory."""
    batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")


def start(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "append",
    write: Callable[[DataFrame, int], None] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Run a stream into a folder; with ``available_now`` it stops when its input is used up."""
    sink = write or (lambda batch, number: write_batch(batch, number, path))
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def finish(query: StreamingQuery) -> None:
    """Wait for an available-now query, however long its input takes, and raise its error if it failed."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def latest(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The last update of every key of a stream in update mode."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(path)
    fields = [f.name for f in schema.fields if f.name not in keys]
    newest = F.max_by(F.struct(*fields), F.col(BATCH))
    return rows.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark dropped so far."""
    total = 0
    for progress in query.recentProgress:
        for operator in progress.get("stateOperators", []) if isinstance(progress, dict) else progress.stateOperators:
            dropped = operator.get("numRowsDroppedByWatermark", 0) if isinstance(operator, dict) else operator.numRowsDroppedByWatermark
            total += int(dropped)
    return total


def event_time(column: str) -> Column:
    """Watermarks need a timestamp; a time without zone is read in the session's zone."""
    return F.col(column).cast("timestamp")
