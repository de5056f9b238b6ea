"""Streams over several micro-batches against the same rows in one batch."""

import pytest
from pyspark.sql import functions as F

from granary.operators import operations
from granary.plans import load_all
from granary.plans.registry import REGISTRY, Tables
from granary.session import shared_folder
from granary.streaming import live, sinks

load_all()
EVENTS = "/root/testdata/sf0.001/events.parquet"


def in_files(spark, df, slices=4):
    """Write the rows as files in time order, so that a stream meets them one file after the other."""
    path = shared_folder(spark, "source")
    bounds = df.approxQuantile("event_id", [i / slices for i in range(1, slices)], 0.0)
    edges = [float("-inf"), *bounds, float("inf")]
    for low, high in zip(edges, edges[1:]):
        df.filter((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(1).write.mode("append").parquet(path)
    return path


def test_metric_rollup_over_batches(spark):
    events = spark.read.parquet(EVENTS)
    path = in_files(spark, events)
    stream = sinks.file_stream(spark, path, events.schema, files_per_trigger=1).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), F.lit("").alias("labels"), "value"
    )
    out = shared_folder(spark, "out")
    rolled = live.metric_rollup(stream)
    query = sinks.start(rolled, f"{out}/rows", f"{out}/state", "update")
    sinks.finish(query)
    assert query.lastProgress["batchId"] >= 3
    rows = sinks.latest(spark, f"{out}/rows", rolled.schema, ["bucket", "name", "labels"])
    assert rows.agg(F.sum("n")).first()[0] == events.count()


def test_deletion_wins_over_later_news(spark):
    source = shared_folder(spark, "source")
    schema = "event_id long, file_id long, ts timestamp, seq long, status string"
    rows = [(1, 7, "2024-01-01", 1, "uploaded"), (2, 7, "2024-01-02", 2, "deleted"), (3, 7, "2024-01-03", 3, "ready"), (4, 8, "2024-01-03", 4, "ready")]
    for row in rows:
        spark.createDataFrame([row], "event_id long, file_id long, ts string, seq long, status string").withColumn(
            "ts", F.col("ts").cast("timestamp")
        ).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    status = live.file_status(stream)
    out = shared_folder(spark, "out")
    sinks.finish(sinks.start(status, f"{out}/rows", f"{out}/state", "update"))
    got = {r["file_id"]: r["status"] for r in sinks.latest(spark, f"{out}/rows", status.schema, ["file_id"]).collect()}
    assert got == {7: "deleted", 8: "ready"}


def test_a_batch_run_again_replaces_itself(spark):
    path = shared_folder(spark, "again")
    for _ in range(2):
        sinks.write_batch(spark.range(5), 0, path)
    assert spark.read.parquet(path).count() == 5


def test_missing_fields(spark):
    rows = [("file_uploaded", {"user_id": "1", "file_id": " ", "status": "ok"}), ("other", {})]
    df = spark.createDataFrame(rows, "event string, fields map<string,string>")
    got = operations.lifecycle_violations(df).collect()
    assert [r["missing"] for r in got] == [["file_id", "upload_id", "storage_key"]]


@pytest.mark.parametrize("parts", [None, 3])
def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path, parts):
    rows = spark.createDataFrame([(i, "word " * (i * 100 + 1), "en", "a", 1) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    target = f"{tmp_path}/documents.parquet"
    if parts:
        rows.repartition(parts).write.parquet(target)
    else:
        rows.toPandas().to_parquet(target)
    rows.toPandas().to_parquet(f"{tmp_path}/labels.parquet")
    got = REGISTRY["L07_stream_ingest"].plan(Tables(spark, str(tmp_path))).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(9))
    assert all(r["chars"] >= len("word " * (r["doc_id"] * 100 + 1)) for r in got)
