"""Scores of answers against golden cases, latency checks and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from granary.operators.profile import percentiles

TOLERANCE = 1e-9


def safe_ratio(passed: Column, total: Column) -> Column:
    return F.coalesce(F.round(passed / F.nullif(total, F.lit(0)), 6), F.lit(0.0))


def numeric_match(expected: DataFrame, actual: DataFrame, keys: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Each golden value beside the result, and whether they agree."""
    joined = expected.withColumnRenamed("value", "expected").join(actual.withColumnRenamed("value", "actual"), list(keys), "left")
    return joined.withColumn("passed", F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= tolerance, F.lit(False)))


def score(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    passed = F.count_if(F.col("passed"))
    return checks.groupBy(*by).agg(
        passed.alias("passed"), F.count("*").alias("total"), safe_ratio(passed, F.count("*")).alias("score")
    )


def stat_rows(profile: DataFrame, key: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """A profile as (key, stat, value) rows, the form expectations come in."""
    entries = [F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in stats]
    return profile.select(*key, F.inline(F.array(*entries)))


def fold(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def citation_support(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Whether each claim stands in the answer and its evidence in the cited passages.

    ``claims``: case_id, claim_id, claim, response, citations (array), evidence (array);
    ``passages``: case_id, passage_id, passage.  Only cited passages are gathered for a claim, or all
    of its case when it cites none.
    """
    cited = claims.select("case_id", "claim_id", F.posexplode("citations").alias("_no", "passage_id"))
    found = cited.join(passages, ["case_id", "passage_id"])
    every = (
        claims.filter(F.size("citations") == 0)
        .select("case_id", "claim_id")
        .join(passages, "case_id")
        .withColumn("_no", F.lit(0))
    )
    parts = found.select("case_id", "claim_id", "_no", "passage_id", "passage").unionByName(
        every.select("case_id", "claim_id", "_no", "passage_id", "passage")
    )
    texts = F.transform(
        F.sort_array(F.collect_list(F.struct("_no", "passage_id", "passage"))), lambda s: s["passage"]
    )
    joined = parts.groupBy("case_id", "claim_id").agg(fold(F.array_join(texts, " ")).alias("_sources"))
    claim, sources = fold(F.col("claim")), F.coalesce("_sources", F.lit(""))
    evidence = F.when(F.size("evidence") > 0, F.forall("evidence", lambda e: F.contains(sources, fold(e)))).otherwise(
        sources.contains(claim)
    )
    supported = (claim != "") & fold(F.col("response")).contains(claim) & evidence
    return claims.join(joined, ["case_id", "claim_id"], "left").select(
        "case_id", "claim_id", F.coalesce(supported, F.lit(False)).alias("passed")
    )


def required_phrases(answers: DataFrame, text: str, phrases: str) -> DataFrame:
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return answers.withColumn("passed", F.forall(phrases, lambda p: F.contains(low, F.lower(p))))


def label_accuracy(observed: DataFrame, expected: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Per label the share of cases where the observed value equals the expected one."""
    right = expected.select(*keys, *[F.col(c).alias(f"_want_{c}") for c in labels])
    joined = observed.join(right, list(keys))
    entries = [
        F.struct(F.lit(c).alias("label"), F.col(c).eqNullSafe(F.col(f"_want_{c}")).alias("passed")) for c in labels
    ]
    return score(joined.select(F.inline(F.array(*entries))), ["label"])


def payload_checks(payloads: DataFrame, payload: str, checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Checks of JSON payloads: equals, in, present, min, max, contains_all, contains_any.

    ``checks`` has the join keys, path ('$.a.b'), op and expected (array of text).
    """
    joined = payloads.join(checks, list(keys))
    seen = F.call_function("get_json_object", F.col(payload), F.col("path"))
    number, bound = seen.try_cast("double"), F.get("expected", F.lit(0)).try_cast("double")
    low = F.lower(F.coalesce(seen, F.lit("")))
    holds = (
        F.when(F.col("op") == "equals", seen == F.get("expected", F.lit(0)))
        .when(F.col("op") == "in", F.array_contains("expected", seen))
        .when(F.col("op") == "present", seen.isNotNull())
        .when(F.col("op") == "min", number >= bound)
        .when(F.col("op") == "max", number <= bound)
        .when(F.col("op") == "contains_all", seen.isNotNull() & F.forall("expected", lambda e: F.contains(low, F.lower(e))))
        .when(F.col("op") == "contains_any", seen.isNotNull() & F.exists("expected", lambda e: F.contains(low, F.lower(e))))
    )
    return joined.withColumn("passed", F.coalesce(holds, F.lit(False)))


def latency_p95(cases: DataFrame, by: Sequence[str], latency: str) -> DataFrame:
    return percentiles(cases, by, latency, 0.95, "p95").withColumn("p95", F.round("p95", 6))


def latency_violations(cases: DataFrame, latency: str, ceiling: str) -> DataFrame:
    return cases.filter((F.col(ceiling) > 0) & (F.col(latency) > F.col(ceiling)))


def metric_rollup(parts: DataFrame, variant: str | None = None) -> DataFrame:
    """passed / total per metric over all sets; with two variants also how much the first is ahead."""
    if variant is None:
        sums = parts.groupBy("metric").agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"))
        return sums.withColumn("score", safe_ratio(F.col("passed"), F.col("total")))
    new, old = F.col(variant) == "new", F.col(variant) == "old"
    ratio = lambda which: safe_ratio(
        F.sum(F.when(which, F.col("passed"))), F.sum(F.when(which, F.col("total")))
    )
    scores = parts.groupBy("metric").agg(ratio(new).alias("new_score"), ratio(old).alias("old_score"))
    return scores.withColumn("delta", F.round(F.col("new_score") - F.col("old_score"), 6))


def gate_check(observed: DataFrame, gates: DataFrame) -> DataFrame:
    """Each gate (name, kind 'min' or 'max', threshold) against its observed value, and the verdict over all."""
    joined = gates.join(observed, "name", "left").withColumn("observed", F.coalesce("observed", F.lit(0.0)))
    passed = F.when(F.col("kind") == "min", F.col("observed") >= F.col("threshold")).otherwise(
        F.col("observed") <= F.col("threshold")
    )
    checked = joined.withColumn("passed", passed)
    overall = checked.agg(F.bool_and("passed").alias("all_passed"))
    return checked.crossJoin(F.broadcast(overall))  # one row
