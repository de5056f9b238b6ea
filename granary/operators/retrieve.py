"""Retrieval budgets, escalation, whole-document reads and scopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from granary.operators import coverage
from granary.operators.rank import TOKEN_PATTERN

# Words of a broad question and the budget policy.
BROAD_HINTS = (
    "проанализ", "анализ", "свод", "итог", "обзор", "сравн", "тренд", "динам", "весь", "все строки", "по всему",
    "analyze", "analysis", "summary", "overview", "compare", "trend", "entire", "whole",
)
SHORT_TOKENS = 4
RATIOS = {"short": 0.20, "fact": 0.10, "broad": 0.30}
MIN_TOP_K, MAX_TOP_K = 8, 96
FULL_CHUNKS, FULL_CHUNKS_REPASS = 800, 2_000
LOW_COVERAGE = 0.35
SMALL_SCOPE_CHUNKS = 120
ESCALATED_MAX = 192
MIN_ROW_COVERAGE = 0.95


def query_profile(text: Column) -> Column:
    folded = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    tokens = F.regexp_count(folded, F.lit(TOKEN_PATTERN))
    return (
        F.when(folded == "", "fact")
        .when(folded.rlike("|".join(BROAD_HINTS)), "broad")
        .when(tokens <= SHORT_TOKENS, "short")
        .otherwise("fact")
    )


def budget_plan(queries: DataFrame) -> DataFrame:
    """Top-k and pools per query; input: text, mode, requested_top_k, expected_chunks."""
    profile = query_profile(F.col("text"))
    expected, requested = F.col("expected_chunks"), F.greatest(F.lit(1), F.col("requested_top_k"))
    full = F.col("mode") == "full_file"
    # Tenths of percent as whole numbers: the product is exact before it is rounded up.
    percent = F.when(F.col("query_profile") == "short", 20).when(F.col("query_profile") == "broad", 30).otherwise(10)
    share = F.when(expected > 0, F.least(F.ceil(expected * percent / 100), expected)).otherwise(requested)
    dynamic = F.least(F.greatest(share, F.lit(MIN_TOP_K), requested), F.lit(MAX_TOP_K))
    effective = F.when(full, F.least(F.greatest(expected, requested), F.lit(FULL_CHUNKS))).otherwise(dynamic)
    return (
        queries.withColumn("query_profile", profile)
        .withColumn("ratio", F.when(full, 1.0).otherwise(percent / 100))
        .withColumn("effective_top_k", effective.cast("long"))
        .withColumn("fetch_k", F.greatest(F.col("effective_top_k") * 10, F.lit(40)))
        .withColumn("lexical_pool", F.least(F.greatest(F.col("fetch_k") * 3, F.lit(120)), F.lit(1_200)))
    )


def escalation(plans: DataFrame) -> DataFrame:
    """Next mode and top-k where coverage is low; input: mode, expected_chunks, effective_top_k, coverage_ratio."""
    expected, current = F.col("expected_chunks"), F.col("effective_top_k")
    low = (F.col("mode") != "full_file") & (expected > 0) & (F.col("coverage_ratio") < LOW_COVERAGE)
    small = (F.col("mode") == "auto") & (expected <= SMALL_SCOPE_CHUNKS)
    doubled = F.least(F.greatest(F.lit(1), current) * 2, F.lit(ESCALATED_MAX), expected)
    action = F.when(low & small, "full_file").when(low & (doubled > current), "increase_top_k").otherwise("none")
    return plans.withColumn("escalation", action).withColumns(
        {
            "next_mode": F.when(F.col("escalation") == "full_file", "full_file").otherwise(F.col("mode")),
            "next_top_k": F.when(F.col("escalation") == "full_file", F.least(expected, F.lit(FULL_CHUNKS)))
            .when(F.col("escalation") == "increase_top_k", doubled)
            .otherwise(current)
            .cast("long"),
        }
    )


def full_document(chunks: DataFrame, scope: Column, cap: int = FULL_CHUNKS) -> DataFrame:
    """All chunks of the scope in file and chunk order up to the cap, whether it was reached and how many it left out."""
    mine = chunks.filter(scope)
    reached = mine.agg((F.count("*") >= cap).alias("cap_reached"), F.greatest(F.count("*") - cap, F.lit(0)).alias("left_out"))
    return mine.orderBy("file_id", "chunk_index").limit(cap).crossJoin(F.broadcast(reached))  # one row


def with_row_repass(read: Callable[[int], DataFrame], cap: int = FULL_CHUNKS, repass_cap: int = FULL_CHUNKS_REPASS) -> DataFrame:
    """Read row groups up to the cap; read once more with a doubled cap when too few rows were covered.

    ``read`` takes the cap.  The check collects one row.
    """
    first = read(cap)
    ratio = coverage.row_coverage(first).first()["row_coverage_ratio"]
    if ratio is None or ratio >= MIN_ROW_COVERAGE:
        return first
    return read(min(repass_cap, 2 * cap))


def active_versions(chunks: DataFrame, active_runs: DataFrame) -> DataFrame:
    """Chunks of each file's active run only."""
    return chunks.join(active_runs.select("file_id", "run_id"), ["file_id", "run_id"], "left_semi")
