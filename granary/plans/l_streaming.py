"""Streams over the given tables, run until their input is used up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from granary.operators import operations
from granary.plans.f_chunks import CHUNKS_SQL, OVERLAP, SIZE
from granary.plans.i_operations import lifecycle_of
from granary.plans.registry import Tables, query
from granary.session import shared_folder
from granary.streaming import live, sinks


#: Bounds what one micro-batch of a backlog holds.
FILES_PER_TRIGGER = 256


def stream_of(t: Tables, table: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files: a pattern may stand for either, a plain path for a folder only."""
    return sinks.file_stream(t.spark, f"{t.folder}/{{{table}.parquet}}", getattr(t, table).schema, "*", FILES_PER_TRIGGER)


def events_stream(t: Tables) -> DataFrame:
    return stream_of(t, "events").withColumn("ts", sinks.event_time("ts"))


def run_latest(t: Tables, stream: DataFrame, keys: list[str]) -> DataFrame:
    path = shared_folder(t.spark, "stream")
    sinks.finish(sinks.start(stream, f"{path}/rows", f"{path}/state", "update"))
    return sinks.latest(t.spark, f"{path}/rows", stream.schema, keys)


def run_appended(t: Tables, stream: DataFrame) -> DataFrame:
    path = shared_folder(t.spark, "stream")
    sinks.finish(sinks.start(stream, f"{path}/rows", f"{path}/state", "append"))
    return sinks.appended(t.spark, f"{path}/rows", stream.schema)


def text(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query(
    "L01_stream_metric_rollup",
    """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS bucket, event_type AS name, 'k=' || (props->>'$.k') AS labels, count(*) AS n,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(value) AS max FROM events GROUP BY 1, 2, 3""",
)
def _(t):
    points = events_stream(t).select(
        "ts", F.col("event_type").alias("name"), F.concat(F.lit("k="), F.get_json_object("props", "$.k")).alias("labels"), "value"
    )
    rolled = run_latest(t, live.metric_rollup(points), ["bucket", "name", "labels"])
    return rolled.withColumn("bucket", text("bucket"))


@query(
    "L02_stream_failure_ratio",
    """WITH w AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - CAST(i * 10 AS INTEGER) * INTERVAL 1 MINUTE AS s, event_type FROM events, range(6) AS r(i))
       SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS bucket, 'all' AS provider, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failures,
         count(*) >= 4 AND count(*) FILTER (WHERE event_type = 'error') / count(*) >= 0.5 AS open FROM w GROUP BY s""",
)
def _(t):
    requests = events_stream(t).select("ts", F.lit("all").alias("provider"), (F.col("event_type") != "error").alias("ok"))
    stream = live.failure_ratio(requests, "2 hours", "60 minutes", "10 minutes")
    return run_latest(t, stream, ["bucket", "provider"]).withColumn("bucket", text("bucket"))


@query(
    "L04_stream_job_dedup",
    "SELECT 'ingestion:' || event_id || ':' || substr(sha256(event_id || '|' || event_type), 1, 24) AS idempotency_key FROM events",
)
def _(t):
    once = events_stream(t)
    again = events_stream(t).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE"))
    key = operations.idempotency_key(F.col("event_id"), F.col("event_type"))
    jobs = once.unionByName(again).select("ts", key.alias("idempotency_key"))
    return run_appended(t, live.job_dedup(jobs)).select("idempotency_key")


@query(
    "L05_stream_file_status",
    """WITH s AS (SELECT user_id AS file_id, ts, event_id, CASE WHEN event_type = 'error' AND value > 40 THEN 'deleted' ELSE event_type END AS status FROM events)
       SELECT file_id, CASE WHEN bool_or(status = 'deleted') THEN 'deleted' ELSE arg_max(status, (ts, event_id)) END AS status, count(*) AS updates FROM s GROUP BY 1""",
)
def _(t):
    gone = (F.col("event_type") == "error") & (F.col("value") > 40)
    news = events_stream(t).select(
        F.col("user_id").alias("file_id"), "ts", F.col("event_id").alias("seq"), F.when(gone, "deleted").otherwise(F.col("event_type")).alias("status")
    )
    return run_latest(t, live.file_status(news), ["file_id"])


@query(
    "L06_stream_lease_expiry",
    """WITH b AS (SELECT user_id AS worker, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(new) OVER (PARTITION BY worker ORDER BY ts) AS run FROM b),
       g AS (SELECT worker, run, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS expired_at, count(*) AS beats FROM s GROUP BY 1, 2)
       SELECT worker, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, strftime(expired_at, '%Y-%m-%d %H:%M:%S') AS expired_at, beats, 'queued' AS status
       FROM g WHERE expired_at <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""",
)
def _(t):
    beats = events_stream(t).select("ts", F.col("user_id").alias("worker"))
    sessions = run_appended(t, live.lease_sessions(beats, "6 hours", "1 hour"))
    return sessions.withColumns({"started": text("started"), "expired_at": text("expired_at")})


@query(
    "L07_stream_ingest",
    f"WITH {CHUNKS_SQL} SELECT file_id AS doc_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM chunks GROUP BY 1",
)
def _(t):
    path = shared_folder(t.spark, "ingest")
    arriving = live.ingest(stream_of(t, "documents"), SIZE, OVERLAP)
    writer = live.ingest_writer(f"{path}/chunks", f"{path}/catalog")
    sinks.finish(sinks.start(arriving, path, f"{path}/state", write=writer))
    return t.spark.read.option("recursiveFileLookup", True).parquet(f"{path}/catalog")


@query(
    "L08_stream_lifecycle_quality",
    """SELECT CASE WHEN event_type = 'click' OR (event_type = 'purchase') OR (event_type IN ('view', 'error') AND value >= 20) THEN 'violation' ELSE 'good' END AS verdict,
         count(*) AS events FROM events GROUP BY 1""",
)
def _(t):
    path = shared_folder(t.spark, "quality")
    stream = lifecycle_of(_StreamTables(t)).drop("ts")
    sinks.finish(sinks.start(stream, path, f"{path}/state", write=live.quality_writer(f"{path}/good", f"{path}/bad")))
    parts = []
    for verdict, name in (("good", "good"), ("violation", "bad")):
        rows = t.spark.read.option("recursiveFileLookup", True).parquet(f"{path}/{name}")
        parts.append(rows.agg(F.count("*").alias("events")).withColumn("verdict", F.lit(verdict)))
    return parts[0].unionByName(parts[1])


class _StreamTables:
    """The given tables as streams."""

    def __init__(self, tables: Tables):
        self._tables = tables

    @property
    def events(self) -> DataFrame:
        return stream_of(self._tables, "events")


@query(
    "L09_stream_coverage_gauge",
    """SELECT event_type AS mode, arg_max(value / 100, (ts, event_id)) AS last_ratio, count(*) FILTER (WHERE value / 100 < 0.5) AS lt_50,
         count(*) FILTER (WHERE value / 100 >= 0.5 AND value / 100 < 0.8) AS ge_50_lt_80, count(*) FILTER (WHERE value / 100 >= 0.8 AND value / 100 < 0.95) AS ge_80_lt_95,
         count(*) FILTER (WHERE value / 100 >= 0.95) AS ge_95 FROM events GROUP BY 1""",
)
def _(t):
    points = events_stream(t).select("ts", F.col("event_id").alias("seq"), F.col("event_type").alias("mode"), (F.col("value") / 100).alias("ratio"))
    return run_latest(t, live.coverage_gauge(points), ["mode"])
