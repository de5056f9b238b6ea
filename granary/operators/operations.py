"""Reports on conversations, files, processing runs, jobs and metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from granary.operators.ordering import first_per_group, with_position

# Statuses.
READY_RUN_STATUSES = ("ready", "completed", "partial_success", "partial_failed")
ATTACHABLE_STATUSES = ("uploaded", "processing", "ready")
STUCK_STATUSES = ("uploaded", "processing")
DELETED_STATUSES = ("deleting", "deleted")


def user_stats(
    users: DataFrame, conversations: DataFrame, messages: DataFrame, files: DataFrame, as_of: Column, days: int = 7
) -> DataFrame:
    """Per user: conversations, messages, live files and messages of the last days.

    Messages are counted per conversation first, so the join carries one row per conversation.
    """
    recent = F.col("timestamp") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    per_conversation = messages.groupBy("conversation_id").agg(
        F.count("*").alias("_messages"), F.count_if(recent).alias("_recent")
    )
    talk = conversations.join(per_conversation, "conversation_id", "left").groupBy("user_id").agg(
        F.count("*").alias("total_conversations"),
        F.sum(F.coalesce("_messages", F.lit(0))).alias("total_messages"),
        F.sum(F.coalesce("_recent", F.lit(0))).alias("recent_messages"),
    )
    kept = files.filter(F.col("status") != "deleted").groupBy("user_id").agg(F.count("*").alias("total_files"))
    names = ("total_conversations", "total_messages", "total_files", "recent_messages")
    joined = users.select("user_id").join(talk, "user_id", "left").join(kept, "user_id", "left")
    return joined.select("user_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def system_stats(activity: DataFrame, messages: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    recent = F.col("timestamp") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    users = activity.agg(
        F.countDistinct("user_id").alias("total_users"),
        F.countDistinct(F.when(recent, F.col("user_id"))).alias("active_users"),
    )
    talk = messages.agg(
        F.countDistinct("conversation_id").alias("total_conversations"), F.count("*").alias("total_messages")
    )
    return users.crossJoin(talk)  # one row each


def storage_quota(files: DataFrame, user: str, size: str, limit: int, upload: int) -> DataFrame:
    used = files.groupBy(user).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("used_bytes"))
    return used.withColumns(
        {
            "remaining_bytes": F.greatest(F.lit(0), F.lit(limit) - F.col("used_bytes")).cast("long"),
            "would_exceed": F.col("used_bytes") + upload > limit,
        }
    )


def recent_first(files: DataFrame, time: str, key: str, statuses: Sequence[str] | None, skip: int, limit: int) -> DataFrame:
    rows = files.filter(F.col("status").isin(list(statuses))) if statuses else files
    return rows.orderBy(F.col(time).desc_nulls_last(), F.col(key).desc()).offset(skip).limit(limit)


def active_run_per_file(runs: DataFrame) -> DataFrame:
    """The active run of each file, else its newest one."""
    order = [F.col("is_active").desc(), F.col("created_at").desc(), F.col("run_id").desc()]
    return first_per_group(runs, ["file_id"], order)


def activate_runs(runs: DataFrame, chosen: DataFrame, deleted: DataFrame) -> DataFrame:
    """Exactly one active run for each chosen file; deleted files and unknown runs change nothing."""
    valid = (
        chosen.join(runs.select("file_id", F.col("run_id").alias("chosen_run")), ["file_id", "chosen_run"], "left_semi")
        .join(deleted, "file_id", "left_anti")
    )
    flag = F.when(F.col("chosen_run").isNull(), F.col("is_active")).otherwise(F.col("run_id") == F.col("chosen_run"))
    return runs.join(valid, "file_id", "left").withColumn("is_active", flag).drop("chosen_run")


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    newest = first_per_group(messages, ["conversation_id"], [F.col("position").desc()], n)
    return newest.orderBy("conversation_id", "position")


def message_history(messages: DataFrame, skip: int, limit: int) -> DataFrame:
    """A page of every conversation's messages, in time order."""
    placed = with_position(messages, ["conversation_id"], ["position"], "_at")
    return placed.filter((F.col("_at") > skip) & (F.col("_at") <= skip + limit)).drop("_at")


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg(
        F.count("*").alias("message_count"), F.max("position").alias("last_position")
    )


def conversation_list(conversations: DataFrame, per_user: int) -> DataFrame:
    """The newest conversations of each user, archived ones hidden."""
    shown = conversations.filter(~F.col("is_archived"))
    return first_per_group(shown, ["user_id"], [F.col("updated_at").desc(), F.col("conversation_id").desc()], per_user)


def readiness_summary(files: DataFrame, active_runs: DataFrame) -> DataFrame:
    """Linked files by readiness of their active run, and why there may be nothing to retrieve."""
    joined = files.select("file_id").join(active_runs.select("file_id", F.lower("status").alias("_run")), "file_id", "left")
    ready = F.count_if(F.col("_run").isin(*READY_RUN_STATUSES))
    counts = joined.agg(
        F.count("*").alias("linked_files_total"),
        ready.alias("ready_files"),
        F.count_if(F.col("_run").isNotNull() & ~F.col("_run").isin(*READY_RUN_STATUSES)).alias("pending_files"),
        F.count_if(F.col("_run").isNull()).alias("missing_files"),
    )
    reason = (
        F.when(F.col("linked_files_total") == 0, "no_linked_files")
        .when(
            (F.col("ready_files") == 0) & (F.col("pending_files") + F.col("missing_files") > 0),
            "indexing_incomplete_or_not_ready",
        )
        .otherwise("no_retrievable_files")
    )
    return counts.withColumn("no_context_reason", reason)


def readiness_counts(files: DataFrame, active_runs: DataFrame) -> DataFrame:
    """Files per file status and run status."""
    joined = files.join(active_runs.select("file_id", F.lower("status").alias("_run")), "file_id", "left")
    return joined.groupBy(
        F.coalesce(F.nullif(F.lower("status"), F.lit("")), F.lit("unknown")).alias("file_status"),
        F.coalesce("_run", F.lit("missing")).alias("run_status"),
    ).agg(F.count("*").alias("files"))


def file_status(status: Column) -> Column:
    raw = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return (
        F.when(raw.isin(*READY_RUN_STATUSES), "ready")
        .when(raw.isin("failed", "deleting", "deleted", "uploaded"), raw)
        .otherwise("processing")
    )


def run_status(status: Column) -> Column:
    raw = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(raw == "completed", "ready").when(raw == "", "queued").otherwise(raw)


BAD_CHUNK_RATIO = 0.35


def finalize_runs(runs: DataFrame, threshold: float = BAD_CHUNK_RATIO) -> DataFrame:
    """Reconciled counters and the final status of each run."""
    reconciled = (
        runs.withColumn("expected", F.greatest("expected", "processed"))
        .withColumn("failed", F.col("failed") + F.col("expected") - F.col("processed"))
        .withColumn("processed", F.col("expected"))
        .withColumn("bad_ratio", F.coalesce(F.col("failed") / F.nullif("expected", F.lit(0)), F.lit(0.0)))
    )
    consistent = (F.col("processed") == F.col("indexed") + F.col("failed")) & (F.col("upserts") == F.col("indexed"))
    complete = (
        F.col("parsing_ok")
        & F.col("chunking_ok")
        & (F.col("expected") > 0)
        & (F.col("indexed") <= F.col("expected"))
        & consistent
        & (F.col("failed") <= 0)
        & (F.col("indexed") > 0)
        & ~F.col("fatal_error")
    )
    status = (
        F.when(complete, "completed")
        .when((F.col("indexed") <= 0) | F.col("fatal_error"), "failed")
        .when((F.col("failed") > 0) & (F.col("bad_ratio") > threshold), "failed")
        .when((F.col("failed") > 0) | ~consistent | (F.col("indexed") < F.col("expected")), "partial_failed")
        .otherwise("failed")
    )
    return reconciled.withColumn("final_status", status).withColumn("bad_ratio", F.round("bad_ratio", 6))


# Words of an error message and the HTTP codes behind each class.
AUTH_MARKERS = (
    "unauthorized", "forbidden", "invalid api key", "authentication", "access token", "keycloak", "auth failed",
)
TRANSIENT_MARKERS = (
    "timeout", "timed out", "connect", "connection", "network", "temporarily unavailable", "remote protocol",
)
FATAL_CODES = (400, 401, 403, 404, 422)
RETRYABLE_CODES = (408, 425, 429)


def failure_class(log: DataFrame, status_code: str, message: str) -> DataFrame:
    """code, retryable and fatal for each error, by HTTP code first and message words second."""
    code, text = F.col(status_code), F.lower(F.coalesce(message, F.lit("")))
    fatal_code = F.coalesce(code.isin(*FATAL_CODES), F.lit(False))
    retry_code = F.coalesce(code.isin(*RETRYABLE_CODES) | code.between(500, 599), F.lit(False))
    auth, transient = text.rlike("|".join(AUTH_MARKERS)), text.rlike("|".join(TRANSIENT_MARKERS))
    return log.withColumns(
        {
            "code": F.when(fatal_code | retry_code, F.concat(F.lit("http_"), code.cast("string")))
            .when(auth, "auth_error")
            .when(transient, "transient_error")
            .otherwise("unknown_error"),
            "retryable": ~fatal_code & (retry_code | (~auth & transient)),
            "fatal": fatal_code | (~retry_code & auth),
        }
    )


def idempotency_key(file_id: Column, *rest: Column) -> Column:
    raw = F.concat_ws("|", file_id.cast("string"), *[c.cast("string") for c in rest])
    return F.concat(F.lit("ingestion:"), file_id.cast("string"), F.lit(":"), F.substring(F.sha2(raw, 256), 1, 24))


def job_dedup(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Jobs from a log of 'enqueue' and 'finish' rows per key.

    The first enqueue creates the job.  An enqueue right after a finish runs it again, any other one is
    a duplicate.  Neighbours meet by position, so a hot key is spread over the cluster.
    """
    placed = with_position(log, [key], order, "_at")
    before = placed.select(F.col(key), (F.col("_at") + 1).alias("_at"), F.col("kind").alias("_before"))
    joined = placed.join(before, [key, "_at"], "left")
    enqueue = F.col("kind") == "enqueue"
    again = enqueue & F.coalesce(F.col("_before") == "finish", F.lit(False))
    facts = joined.groupBy(key).agg(
        F.count_if(enqueue).alias("_enqueued"),
        F.count_if(again).alias("_again"),
        # A finish before the first enqueue belongs to no job.
        F.min_by("kind", "_at").alias("_first"),
        F.max_by("kind", "_at").alias("_last"),
    )
    runs = F.col("_again") + F.when(F.col("_first") == "enqueue", 1).otherwise(0)
    return facts.filter(F.col("_enqueued") > 0).select(
        key,
        runs.alias("run_count"),
        (F.col("_enqueued") - runs).alias("dedup_hits"),
        F.when(F.col("_last") == "finish", "completed").otherwise("queued").alias("status"),
    )


def next_jobs(jobs: DataFrame, as_of: Column, limit: int) -> DataFrame:
    due = jobs.filter((F.col("status") == "queued") & (F.col("next_run_at") <= as_of))
    return due.orderBy("next_run_at", "created_at", "job_id").limit(limit)


def expired_leases(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Running jobs whose lease has passed, back in the queue."""
    late = (F.col("status") == "processing") & (F.col("lease_until") < as_of)
    return jobs.filter(late).withColumn("status", F.lit("queued"))


def queue_stats(jobs: DataFrame, as_of: Column) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("queued", "processing", "completed", "dead_letter")]
    oldest = F.min(F.when(F.col("status") == "queued", F.col("next_run_at")))
    beat = F.max("heartbeat_at")
    seconds = lambda time: F.greatest(F.lit(0.0), F.round((micros(as_of) - micros(time)) / 1e6, 3))
    return jobs.agg(
        *counts,
        F.coalesce(seconds(oldest), F.lit(0.0)).alias("lag_seconds"),
        seconds(beat).alias("heartbeat_age_seconds"),
    )


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time without zone, read as UTC."""
    return F.unix_micros(F.to_utc_timestamp(time.cast("timestamp"), F.current_timezone()))


RETRY_BASE_SECONDS = 2.0
RETRY_MAX_SECONDS = 60.0
MAX_RETRIES = 3


def retry_schedule(failures: DataFrame, attempt: str, retryable: str) -> DataFrame:
    """Delay before the next attempt, or dead letter."""
    delay = F.least(F.lit(RETRY_MAX_SECONDS), RETRY_BASE_SECONDS * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col(attempt) - 1)))
    retry = F.col(retryable) & (F.col(attempt) < MAX_RETRIES)
    return failures.withColumns(
        {"action": F.when(retry, "retry").otherwise("dead_letter"), "delay_seconds": F.when(retry, delay)}
    )


def stuck_files(files: DataFrame, runs: DataFrame, limit: int = 200) -> DataFrame:
    """The oldest unfinished files with the run to resume."""
    waiting = files.filter(F.col("status").isin(*STUCK_STATUSES)).orderBy("created_at", "file_id").limit(limit)
    mine = runs.join(F.broadcast(waiting.select("file_id")), "file_id", "left_semi")  # at most ``limit`` files
    best = active_run_per_file(mine).select("file_id", "run_id")
    return waiting.join(best, "file_id", "left")


def metrics_snapshot(points: DataFrame, scale: int = 2) -> DataFrame:
    """Counters, timers and last gauges by name and labels, in one pass."""
    kind, value = F.col("kind"), F.col("value")
    counted = F.col("kind").isin("counter", "timer")
    total = F.sum(F.when(counted, value.cast(f"decimal(18,{scale})"))).cast("double")
    timed = F.count_if(kind == "timer")
    return points.groupBy("kind", "name", "labels").agg(
        timed.alias("count"),
        F.round(total, 6).alias("total"),
        F.round(total / F.nullif(timed, F.lit(0)), 6).alias("average"),
        F.max(F.when(kind == "timer", value)).alias("max"),
        F.max_by(F.when(kind == "gauge", value), F.struct("ts", "seq")).alias("last"),
    )


def coverage_bucket(ratio: Column) -> Column:
    return (
        F.when(ratio < 0.5, "lt_50").when(ratio < 0.8, "ge_50_lt_80").when(ratio < 0.95, "ge_80_lt_95").otherwise("ge_95")
    )


# Route classes.
ROUTE_CLASSES = {
    "deterministic_analytics": "deterministic",
    "complex_analytics": "complex_analytics",
    "narrative_retrieval": "narrative",
}


def route_class(route: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ROUTE_CLASSES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(route))), F.lit("unknown"))


# Fields every lifecycle event must carry.
_RUN_FIELDS = ("user_id", "file_id", "processing_id", "status")
_EMBEDDING_FIELDS = ("user_id", "file_id", "processing_id", "embedding_provider", "embedding_model", "status")
REQUIRED_FIELDS: Mapping[str, tuple[str, ...]] = {
    "file_uploaded": ("user_id", "file_id", "upload_id", "storage_key", "status"),
    "file_attached_to_chat": ("user_id", "file_id", "chat_id", "status"),
    "processing_created": (
        "user_id", "file_id", "processing_id", "pipeline_version", "embedding_provider", "embedding_model", "status",
    ),
    "extraction_started": _RUN_FIELDS,
    "extraction_completed": _RUN_FIELDS,
    "chunking_completed": _RUN_FIELDS,
    "embedding_started": _EMBEDDING_FIELDS,
    "embedding_completed": _EMBEDDING_FIELDS,
    "indexing_completed": _RUN_FIELDS,
    "file_ready": _RUN_FIELDS,
    "processing_failed": _RUN_FIELDS,
}


def missing_fields(event: Column, fields: Column) -> Column:
    """Names of the required fields that are null or blank, in order; ``fields`` is a map of text."""
    required = F.create_map(
        *[x for name, names in REQUIRED_FIELDS.items() for x in (F.lit(name), F.array(*[F.lit(n) for n in names]))]
    )
    wanted = F.coalesce(F.try_element_at(required, event), F.array().cast("array<string>"))
    return F.filter(wanted, lambda n: F.trim(F.coalesce(F.try_element_at(fields, n), F.lit(""))) == "")


def lifecycle_violations(events: DataFrame) -> DataFrame:
    out = events.withColumn("missing", missing_fields(F.col("event"), F.col("fields")))
    return out.filter(F.size("missing") > 0)


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing links and the new ones whose key is not there yet, each once."""
    return existing.unionByName(new.dropDuplicates(list(keys)).join(existing, list(keys), "left_anti"))


def attachable(files: DataFrame) -> DataFrame:
    """Files per state with the verdict whether they may be attached."""
    state = F.coalesce(F.nullif(F.lower(F.trim("status")), F.lit("")), F.lit("unknown"))
    return files.groupBy(state.alias("state")).agg(F.count("*").alias("files")).withColumn(
        "allowed", F.col("state").isin(*ATTACHABLE_STATUSES)
    )
