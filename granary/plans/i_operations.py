"""Operational reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from granary.operators import operations
from granary.operators.ordering import with_position
from granary.plans.registry import Tables, query


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def time_text(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


def runs_of(t: Tables) -> DataFrame:
    """Orders as processing runs of a customer's file."""
    return t.orders.select(
        F.col("o_custkey").alias("file_id"),
        F.col("o_orderkey").alias("run_id"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "queued")
        .otherwise("partial_failed")
        .alias("status"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_active"),
        F.col("o_orderdate").alias("created_at"),
    )


RUNS_SQL = """runs AS (SELECT o_custkey AS file_id, o_orderkey AS run_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'partial_failed' END AS status,
  o_orderpriority = '1-URGENT' AS is_active, o_orderdate AS created_at FROM orders)"""
ACTIVE_SQL = """active AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id
  ORDER BY is_active DESC, created_at DESC, run_id DESC) AS r FROM runs) WHERE r = 1)"""


def files_of(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("file_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Uploaded")
        .when(F.col("c_mktsegment") == "MACHINERY", "processing")
        .when(F.col("c_mktsegment") == "FURNITURE", "deleted")
        .otherwise("ready")
        .alias("status"),
    )


FILES_SQL = """files AS (SELECT c_custkey AS file_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Uploaded'
  WHEN 'MACHINERY' THEN 'processing' WHEN 'FURNITURE' THEN 'deleted' ELSE 'ready' END AS status FROM customer)"""


def messages_of(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("position"), "role", "text")


@query(
    "I01_user_stats",
    """WITH m AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '2001-06-01' - INTERVAL 7 DAY)
         AS recent FROM lineitem GROUP BY 1)
       SELECT c_custkey AS user_id, count(o_orderkey) AS total_conversations, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_messages,
         count(o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS total_files, CAST(coalesce(sum(recent), 0) AS BIGINT) AS recent_messages
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN m ON o_orderkey = l_orderkey GROUP BY 1""",
)
def _(t):
    users = t.customer.select(F.col("c_custkey").alias("user_id"))
    conversations = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("conversation_id"))
    messages = t.lineitem.select(F.col("l_orderkey").alias("conversation_id"), F.col("l_shipdate").alias("timestamp"))
    files = t.orders.select(
        F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "P", "deleted").otherwise("ready").alias("status")
    )
    return operations.user_stats(users, conversations, messages, files, at("2001-06-01"))


@query(
    "I02_system_stats",
    """SELECT (SELECT count(DISTINCT user_id) FROM events) AS total_users,
         (SELECT count(DISTINCT user_id) FROM events WHERE ts >= TIMESTAMP '2024-02-20' - INTERVAL 30 DAY) AS active_users,
         (SELECT count(DISTINCT conv_id) FROM conversations) AS total_conversations,
         (SELECT count(*) FROM conversations) AS total_messages""",
)
def _(t):
    activity = t.events.select("user_id", F.col("ts").alias("timestamp"))
    return operations.system_stats(activity, messages_of(t), at("2024-02-20"))


@query(
    "I03_storage_quota",
    """SELECT source, CAST(sum(n_chars) AS BIGINT) AS used_bytes, CAST(greatest(0, 60000 - sum(n_chars)) AS BIGINT)
       AS remaining_bytes, sum(n_chars) + 5000 > 60000 AS would_exceed FROM documents GROUP BY 1""",
)
def _(t):
    return operations.storage_quota(t.documents, "source", "n_chars", 60_000, 5_000)


@query(
    "I04_recent_first_listing",
    """SELECT o_orderkey, status, strftime(t, '%Y-%m-%d %H:%M:%S') AS created_at FROM (
         SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS t
         FROM orders WHERE o_orderstatus IN ('F', 'O')) ORDER BY t DESC NULLS LAST, o_orderkey DESC LIMIT 50 OFFSET 100""",
)
def _(t):
    files = t.orders.select(
        "o_orderkey",
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("created_at"),
    )
    page = operations.recent_first(files, "created_at", "o_orderkey", ["F", "O"], 100, 50)
    return page.withColumn("created_at", time_text("created_at"))


@query("I05_active_run_per_file", f"WITH {RUNS_SQL}, {ACTIVE_SQL} SELECT file_id, run_id, status, is_active FROM active")
def _(t):
    return operations.active_run_per_file(runs_of(t)).drop("created_at")


@query(
    "I06_activate_run",
    f"""WITH {RUNS_SQL}, chosen AS (SELECT file_id, max(run_id) AS run FROM runs GROUP BY 1),
        gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')
        SELECT file_id, run_id, status, CASE WHEN file_id IN (SELECT c_custkey FROM gone) THEN is_active
          ELSE run_id = run END AS is_active FROM runs JOIN chosen USING (file_id)""",
)
def _(t):
    runs = runs_of(t)
    chosen = runs.groupBy("file_id").agg(F.max("run_id").alias("chosen_run"))
    deleted = files_of(t).filter(F.col("status").isin(*operations.DELETED_STATUSES)).select("file_id")
    return operations.activate_runs(runs, chosen, deleted).drop("created_at")


@query(
    "I07_last_n_messages",
    """SELECT conv_id AS conversation_id, turn AS position, role, text FROM (
         SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3""",
)
def _(t):
    return operations.last_messages(messages_of(t), 3)


@query(
    "I08_message_history",
    """SELECT conv_id AS conversation_id, turn AS position, role, text FROM (
         SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r BETWEEN 2 AND 4""",
)
def _(t):
    return operations.message_history(messages_of(t), 1, 3)


@query(
    "I09_message_count",
    "SELECT conv_id AS conversation_id, count(*) AS message_count, max(turn) AS last_position FROM conversations GROUP BY 1",
)
def _(t):
    return operations.message_counts(messages_of(t))


@query(
    "I10_conversation_list",
    """SELECT o_custkey AS user_id, o_orderkey AS conversation_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
         ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus <> 'P') WHERE r <= 2""",
)
def _(t):
    conversations = t.orders.select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("conversation_id"),
        F.col("o_orderdate").alias("updated_at"),
        (F.col("o_orderstatus") == "P").alias("is_archived"),
    )
    return operations.conversation_list(conversations, 2).select("user_id", "conversation_id")


READY_SQL = "status IN ('ready', 'completed', 'partial_success', 'partial_failed')"
LINKED_SQL = """linked AS (SELECT f.file_id, lower(f.status) AS file_status, a.status AS status
  FROM files f LEFT JOIN active a ON f.file_id = a.file_id)"""


@query(
    "I11_readiness_summary",
    f"""WITH {RUNS_SQL}, {ACTIVE_SQL}, {FILES_SQL}, {LINKED_SQL}
        SELECT count(*) AS linked_files_total, count(*) FILTER (WHERE {READY_SQL}) AS ready_files,
          count(*) FILTER (WHERE NOT {READY_SQL}) AS pending_files, count(*) FILTER (WHERE status IS NULL) AS missing_files,
          'no_retrievable_files' AS no_context_reason FROM linked""",
)
def _(t):
    return operations.readiness_summary(files_of(t), operations.active_run_per_file(runs_of(t)))


@query(
    "I11_readiness_counts",
    f"""WITH {RUNS_SQL}, {ACTIVE_SQL}, {FILES_SQL}, {LINKED_SQL}
        SELECT file_status, coalesce(status, 'missing') AS run_status, count(*) AS files FROM linked GROUP BY 1, 2""",
)
def _(t):
    return operations.readiness_counts(files_of(t), operations.active_run_per_file(runs_of(t)))


@query(
    "I12_status_normalisation",
    """SELECT raw, CASE raw WHEN 'click' THEN 'processing' WHEN 'Partial_Failed ' THEN 'ready' WHEN 'FAILED' THEN 'failed'
         WHEN 'uploaded' THEN 'uploaded' WHEN '' THEN 'processing' END AS file_status,
         CASE raw WHEN 'click' THEN 'click' WHEN 'Partial_Failed ' THEN 'partial_failed' WHEN 'FAILED' THEN 'failed'
         WHEN 'uploaded' THEN 'uploaded' WHEN '' THEN 'queued' END AS run_status, count(*) AS n FROM (
         SELECT CASE event_type WHEN 'purchase' THEN 'Partial_Failed ' WHEN 'error' THEN 'FAILED'
           WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN '' ELSE event_type END AS raw FROM events) GROUP BY 1, 2, 3""",
)
def _(t):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "purchase", "Partial_Failed ")
        .when(kind == "error", "FAILED")
        .when(kind == "signup", "uploaded")
        .when(kind == "view", "")
        .otherwise(kind)
    )
    log = t.events.groupBy(raw.alias("raw")).agg(F.count("*").alias("n"))
    return log.select(
        "raw", operations.file_status(F.col("raw")).alias("file_status"), operations.run_status(F.col("raw")).alias("run_status"), "n"
    )


@query(
    "I13_finalize_run",
    """WITH c AS (SELECT l_orderkey AS run_id, count(*) AS expected, count(*) FILTER (WHERE l_linestatus = 'O') AS indexed,
         count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R') AS failed0,
         count(*) FILTER (WHERE l_linestatus = 'O' OR l_returnflag IN ('R', 'A')) AS processed0,
         bool_or(l_quantity > 49 AND l_discount > 0.09) AS fatal FROM lineitem GROUP BY 1),
       r AS (SELECT *, failed0 + expected - processed0 AS failed FROM c)
       SELECT run_id, expected, indexed, failed, round(failed / expected, 6) AS bad_ratio,
         CASE WHEN failed <= 0 AND expected = indexed + failed AND indexed > 0 AND NOT fatal THEN 'completed'
           WHEN indexed <= 0 OR fatal THEN 'failed' WHEN failed > 0 AND failed / expected > 0.35 THEN 'failed'
           WHEN failed > 0 OR expected <> indexed + failed OR indexed < expected THEN 'partial_failed' ELSE 'failed' END
         AS final_status FROM r""",
)
def _(t):
    status, flag = F.col("l_linestatus"), F.col("l_returnflag")
    runs = t.lineitem.groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.count("*").alias("expected"),
        F.count_if(status == "O").alias("indexed"),
        F.count_if((status == "F") & (flag == "R")).alias("failed"),
        F.count_if((status == "O") | flag.isin("R", "A")).alias("processed"),
        F.bool_or((F.col("l_quantity") > 49) & (F.col("l_discount") > 0.09)).alias("fatal_error"),
    )
    runs = runs.withColumns({"upserts": F.col("indexed"), "parsing_ok": F.lit(True), "chunking_ok": F.lit(True)})
    return operations.finalize_runs(runs).select("run_id", "expected", "indexed", "failed", "bad_ratio", "final_status")


@query(
    "I14_failure_classes",
    """WITH e AS (SELECT CASE user_id % 8 WHEN 0 THEN 401 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 503 END AS code0,
         user_id % 8 AS m FROM events WHERE event_type = 'error')
       SELECT CASE WHEN code0 IS NOT NULL THEN 'http_' || code0 WHEN m = 4 THEN 'auth_error' WHEN m = 5 THEN 'transient_error'
         ELSE 'unknown_error' END AS code, m IN (2, 3, 5) AS retryable, m IN (0, 1, 4) AS fatal, count(*) AS n FROM e GROUP BY 1, 2, 3""",
)
def _(t):
    m = F.col("user_id") % 8
    log = t.events.filter("event_type = 'error'").select(
        F.when(m == 0, 401).when(m == 1, 404).when(m == 2, 429).when(m == 3, 503).alias("status_code"),
        F.when(m == 4, "Invalid API key given").when(m == 5, "Connection reset").otherwise("boom").alias("message"),
    )
    return operations.failure_class(log, "status_code", "message").groupBy("code", "retryable", "fatal").agg(F.count("*").alias("n"))


@query(
    "I15_job_dedup",
    """WITH j AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('purchase', 'error') THEN 'finish' ELSE 'enqueue' END AS kind,
         lag(CASE WHEN event_type IN ('purchase', 'error') THEN 'finish' ELSE 'enqueue' END) OVER w AS before
         FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       f AS (SELECT user_id, count(*) FILTER (WHERE kind = 'enqueue') AS enq,
         count(*) FILTER (WHERE kind = 'enqueue' AND (before IS NULL OR before = 'finish')) AS run_count,
         arg_max(kind, (ts, event_id)) AS last FROM j GROUP BY 1)
       SELECT user_id, run_count, enq - run_count AS dedup_hits, CASE last WHEN 'finish' THEN 'completed' ELSE 'queued' END AS status
       FROM f WHERE enq > 0""",
)
def _(t):
    kind = F.when(F.col("event_type").isin("purchase", "error"), "finish").otherwise("enqueue")
    return operations.job_dedup(t.events.select("user_id", "ts", "event_id", kind.alias("kind")), "user_id", ["ts", "event_id"])


@query(
    "I15_idempotency_key",
    """SELECT event_id, 'ingestion:' || user_id || ':' || substr(sha256(user_id || '|' || event_type || '|' || props), 1, 24)
       AS idempotency_key FROM events""",
)
def _(t):
    key = operations.idempotency_key(F.col("user_id"), F.col("event_type"), F.col("props"))
    return t.events.select("event_id", key.alias("idempotency_key"))


def jobs_of(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", "queued").when(kind == "click", "processing").when(kind == "error", "dead_letter").otherwise("completed")
    )
    return t.events.select(
        F.col("event_id").alias("job_id"),
        status.alias("status"),
        (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("next_run_at"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.expr("INTERVAL 120 SECONDS")).alias("lease_until"),
        F.when(F.col("ts") <= at("2024-01-20"), F.col("ts")).alias("heartbeat_at"),
    )


JOBS_SQL = """jobs AS (SELECT event_id AS job_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing'
  WHEN 'error' THEN 'dead_letter' ELSE 'completed' END AS status, ts + INTERVAL 2 HOUR AS next_run_at, ts AS created_at,
  ts + INTERVAL 120 SECOND AS lease_until, CASE WHEN ts <= TIMESTAMP '2024-01-20' THEN ts END AS heartbeat_at FROM events)"""


@query(
    "I16_next_jobs",
    f"""WITH {JOBS_SQL} SELECT job_id, strftime(next_run_at, '%Y-%m-%d %H:%M:%S') AS next_run_at FROM jobs
        WHERE status = 'queued' AND next_run_at <= TIMESTAMP '2024-01-20' ORDER BY jobs.next_run_at, created_at, job_id LIMIT 10""",
)
def _(t):
    return operations.next_jobs(jobs_of(t), at("2024-01-20"), 10).select("job_id", time_text("next_run_at").alias("next_run_at"))


@query(
    "I17_expired_leases",
    f"""WITH {JOBS_SQL} SELECT job_id, 'queued' AS status FROM jobs WHERE status = 'processing'
        AND lease_until < TIMESTAMP '2024-01-20'""",
)
def _(t):
    return operations.expired_leases(jobs_of(t), at("2024-01-20")).select("job_id", "status")


@query(
    "I18_queue_stats",
    f"""WITH {JOBS_SQL} SELECT count(*) FILTER (WHERE status = 'queued') AS queued,
        count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'completed') AS completed,
        count(*) FILTER (WHERE status = 'dead_letter') AS dead_letter,
        greatest(0.0, round((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(min(next_run_at) FILTER (WHERE status = 'queued'))) / 1e6, 3))
          AS lag_seconds,
        greatest(0.0, round((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(max(heartbeat_at))) / 1e6, 3)) AS heartbeat_age_seconds
        FROM jobs""",
)
def _(t):
    return operations.queue_stats(jobs_of(t), at("2024-01-20"))


@query(
    "I19_retry_schedule",
    """SELECT event_id, attempt, CASE WHEN attempt < 3 AND value <= 50 THEN 'retry' ELSE 'dead_letter' END AS action,
         CASE WHEN attempt < 3 AND value <= 50 THEN least(60.0, 2.0 * pow(2.0, attempt - 1)) END AS delay_seconds
       FROM (SELECT event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt
             FROM events WHERE event_type = 'error')""",
)
def _(t):
    failures = with_position(t.events.filter("event_type = 'error'"), ["user_id"], ["ts", "event_id"], "attempt")
    scheduled = operations.retry_schedule(failures.withColumn("retryable", F.col("value") <= 50), "attempt", "retryable")
    return scheduled.select("event_id", "attempt", "action", "delay_seconds")


@query(
    "I20_stuck_files",
    f"""WITH {RUNS_SQL}, {ACTIVE_SQL}, {FILES_SQL},
        waiting AS (SELECT file_id, lower(status) AS status FROM files WHERE lower(status) IN ('uploaded', 'processing')
                    ORDER BY file_id LIMIT 200)
        SELECT w.file_id, w.status, a.run_id FROM waiting w LEFT JOIN active a ON w.file_id = a.file_id""",
)
def _(t):
    files = files_of(t).select("file_id", F.lower("status").alias("status"), F.col("file_id").alias("created_at"))
    return operations.stuck_files(files, runs_of(t)).drop("created_at")


def points_of(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view"), "counter").when(F.col("event_type") == "error", "gauge").otherwise("timer")
    return t.events.select(
        kind.alias("kind"), F.col("event_type").alias("name"), F.concat(F.lit("k="), F.get_json_object("props", "$.k")).alias("labels"),
        "ts", F.col("event_id").alias("seq"), "value",
    )


@query(
    "I21_metrics_snapshot",
    """WITH p AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'counter' WHEN event_type = 'error' THEN 'gauge' ELSE 'timer' END
         AS kind, event_type AS name, 'k=' || (props->>'$.k') AS labels, ts, event_id, value FROM events)
       SELECT kind, name, labels, count(*) FILTER (WHERE kind = 'timer') AS count,
         round(CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE kind <> 'gauge') AS DOUBLE), 6) AS total,
         round(CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE kind = 'timer') AS DOUBLE)
               / nullif(count(*) FILTER (WHERE kind = 'timer'), 0), 6) AS average,
         max(value) FILTER (WHERE kind = 'timer') AS max,
         arg_max(value, (ts, event_id)) FILTER (WHERE kind = 'gauge') AS last FROM p GROUP BY 1, 2, 3""",
)
def _(t):
    return operations.metrics_snapshot(points_of(t))


@query(
    "I23_coverage_buckets",
    """SELECT event_type, CASE WHEN value / 100 < 0.5 THEN 'lt_50' WHEN value / 100 < 0.8 THEN 'ge_50_lt_80'
         WHEN value / 100 < 0.95 THEN 'ge_80_lt_95' ELSE 'ge_95' END AS bucket,
         CASE event_type WHEN 'click' THEN 'deterministic' WHEN 'view' THEN 'narrative' ELSE 'unknown' END AS route_class,
         count(*) AS n FROM events GROUP BY 1, 2, 3""",
)
def _(t):
    route = F.when(F.col("event_type") == "click", " Deterministic_Analytics").when(F.col("event_type") == "view", "narrative_retrieval")
    return t.events.groupBy(
        "event_type",
        operations.coverage_bucket(F.col("value") / 100).alias("bucket"),
        operations.route_class(route.otherwise(F.col("event_type"))).alias("route_class"),
    ).agg(F.count("*").alias("n"))


def lifecycle_of(t: Tables) -> DataFrame:
    names = {"click": "file_uploaded", "view": "extraction_started", "purchase": "embedding_started", "error": "processing_failed"}
    event = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("event_type")), F.col("event_type")
    )
    fields = F.create_map(
        F.lit("user_id"), F.col("user_id").cast("string"),
        F.lit("file_id"), F.when(F.col("value") < 40, F.col("event_id").cast("string")),
        F.lit("processing_id"), F.when(F.col("value") < 20, "p").otherwise(" "),
        F.lit("status"), F.lit("ok"),
        F.lit("embedding_model"), F.lit("m"),
    )
    return t.events.select("event_id", "ts", event.alias("event"), fields.alias("fields"))


@query(
    "I24_lifecycle_violations",
    """WITH v AS (SELECT event_id, CASE event_type
         WHEN 'click' THEN concat_ws(',', CASE WHEN value >= 40 THEN 'file_id' END, 'upload_id', 'storage_key')
         WHEN 'purchase' THEN concat_ws(',', CASE WHEN value >= 40 THEN 'file_id' END, CASE WHEN value >= 20 THEN 'processing_id' END,
           'embedding_provider')
         WHEN 'signup' THEN '' ELSE concat_ws(',', CASE WHEN value >= 40 THEN 'file_id' END,
           CASE WHEN value >= 20 THEN 'processing_id' END) END AS missing FROM events)
       SELECT * FROM v WHERE missing <> ''""",
)
def _(t):
    bad = operations.lifecycle_violations(lifecycle_of(t))
    return bad.select("event_id", F.array_join("missing", ",").alias("missing"))


@query(
    "I25_insert_if_absent",
    """SELECT DISTINCT o_custkey AS file_id, o_orderkey AS chat_id FROM orders
       UNION SELECT s_suppkey, o_orderkey FROM orders JOIN supplier ON s_suppkey = o_custkey""",
)
def _(t):
    links = t.orders.select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("chat_id"))
    new = t.supplier.join(t.orders, F.col("s_suppkey") == F.col("o_custkey")).select(
        F.col("s_suppkey").alias("file_id"), F.col("o_orderkey").alias("chat_id")
    )
    existing = links.filter("chat_id > 0")
    return operations.insert_if_absent(existing, new.unionByName(links), ["file_id", "chat_id"])


@query(
    "I26_allowed_state_filter",
    f"""WITH {FILES_SQL} SELECT lower(status) AS state, count(*) AS files,
        lower(status) IN ('uploaded', 'processing', 'ready') AS allowed FROM files GROUP BY 1""",
)
def _(t):
    return operations.attachable(files_of(t))
