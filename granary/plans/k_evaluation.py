"""Scores against golden cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from granary.operators import aggregate, evaluate, profile
from granary.plans.registry import Tables, query
from granary.plans.shapes import TABLE_COLUMNS, sql_long

# Exact sums by priority are the golden values; every second case is spoiled on purpose.
GOLDEN_SQL = """golden AS (SELECT o_orderpriority AS case_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)
    + CASE WHEN o_orderpriority < '3' THEN 0.01 ELSE 0 END AS expected FROM orders GROUP BY 1),
  actual AS (SELECT o_orderpriority AS case_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS actual FROM orders GROUP BY 1)"""


def golden_checks(t: Tables) -> DataFrame:
    spoiled = F.when(F.col("case_id") < "3", 0.01).otherwise(0.0)
    exact = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    golden = t.orders.groupBy(F.col("o_orderpriority").alias("case_id")).agg(exact.alias("value"))
    golden = golden.withColumn("value", F.col("value") + spoiled)
    actual = aggregate.grouped(t.orders, "o_orderpriority", "sum", "o_totalprice", scale=2).withColumnRenamed("group_key", "case_id")
    return evaluate.numeric_match(golden, actual, ["case_id"])


@query(
    "K01_numeric_exact_match",
    f"""WITH {GOLDEN_SQL}, c AS (SELECT abs(actual - expected) <= 1e-9 AS ok FROM golden JOIN actual USING (case_id))
        SELECT count(*) FILTER (WHERE ok) AS passed, count(*) AS total, round(count(*) FILTER (WHERE ok) / count(*), 6) AS score FROM c""",
)
def _(t):
    return evaluate.score(golden_checks(t))


@query(
    "K02_profile_match",
    f"""WITH s AS (SELECT column_name, CAST(count(*) AS DOUBLE) AS filled, CAST(count(DISTINCT value) AS DOUBLE) AS distinct_
          FROM ({sql_long('orders', list(TABLE_COLUMNS['orders']))}) GROUP BY 1)
        SELECT stat, count(*) FILTER (WHERE ok) AS passed, count(*) AS total, round(count(*) FILTER (WHERE ok) / count(*), 6) AS score FROM (
          SELECT 'non_empty_count' AS stat, filled = (SELECT count(*) FROM orders) AS ok FROM s
          UNION ALL SELECT 'distinct_count', distinct_ = (SELECT count(*) FROM orders) FROM s) GROUP BY 1""",
)
def _(t):
    measured = profile.table_profile(t.orders, "o_orderkey")
    stats = ["non_empty_count", "distinct_count"]
    actual = evaluate.stat_rows(measured, ["column_name"], stats)
    # The golden profile expects every column to be a full key.
    wanted = measured.select("column_name", *[F.col("row_count").alias(s) for s in stats])
    expected = evaluate.stat_rows(wanted, ["column_name"], stats)
    return evaluate.score(evaluate.numeric_match(expected, actual, ["column_name", "stat"]), ["stat"])


@query(
    "K03_citation_faithfulness",
    r"""WITH c AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        j AS (SELECT *, lower(trim(lines[len(lines)])) AS claim, CASE WHEN doc_id % 3 = 0 THEN lower(array_to_string(lines[1:2], ' '))
          WHEN doc_id % 3 = 1 THEN lower(lines[len(lines)]) ELSE lower(array_to_string(lines, ' ')) END AS sources FROM c)
        SELECT doc_id AS case_id, 0 AS claim_id, claim <> '' AND CASE WHEN doc_id % 2 = 0 THEN contains(trim(sources), lower(trim(lines[1])))
          ELSE contains(trim(sources), claim) END AS passed FROM j""",
)
def _(t):
    """A claim is a document's last line, its evidence the first, its passages two lines, the last or all."""
    docs = t.documents.withColumn("lines", F.split("text", "\n", -1))
    passages = docs.select(F.col("doc_id").alias("case_id"), F.posexplode("lines").alias("passage_id", "passage"))
    n = F.col("doc_id")
    none = F.array().cast("array<int>")
    last = F.size("lines") - 1
    claims = docs.select(
        F.col("doc_id").alias("case_id"),
        F.lit(0).alias("claim_id"),
        F.element_at("lines", -1).alias("claim"),
        F.col("text").alias("response"),
        F.when(n % 3 == 0, F.array(F.lit(0), F.lit(1))).when(n % 3 == 1, F.array(last)).otherwise(none).alias("citations"),
        F.when(n % 2 == 0, F.array(F.get("lines", F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("evidence"),
    )
    return evaluate.citation_support(claims, passages)


@query(
    "K04_required_phrases",
    """SELECT lang, count(*) FILTER (WHERE contains(lower(text), 'the') AND contains(lower(text), 'er')) AS passed, count(*) AS total,
         round(count(*) FILTER (WHERE contains(lower(text), 'the') AND contains(lower(text), 'er')) / count(*), 6) AS score FROM documents GROUP BY 1""",
)
def _(t):
    answers = t.documents.withColumn("phrases", F.array(F.lit("THE"), F.lit("er")))
    return evaluate.score(evaluate.required_phrases(answers, "text", "phrases"), ["lang"])


def rule_labels(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        (F.col("n_chars") >= 400).cast("int").alias("quality"),
        F.lower("text").contains("hate").cast("int").alias("toxic"),
    )


@query(
    "K05_label_accuracy",
    """WITH j AS (SELECT quality = CAST(n_chars >= 400 AS INTEGER) AS q, toxic = CAST(contains(lower(text), 'hate') AS INTEGER) AS x
         FROM labels JOIN documents USING (doc_id))
       SELECT 'quality' AS label, count(*) FILTER (WHERE q) AS passed, count(*) AS total, round(count(*) FILTER (WHERE q) / count(*), 6) AS score FROM j
       UNION ALL SELECT 'toxic', count(*) FILTER (WHERE x), count(*), round(count(*) FILTER (WHERE x) / count(*), 6) FROM j""",
)
def _(t):
    return evaluate.label_accuracy(rule_labels(t), t.labels, ["doc_id"], ["quality", "toxic"])


PAYLOAD_CHECKS = (
    ("click", "$.k", "equals", ["7"]),
    ("click", "$.k", "present", []),
    ("view", "$.k", "in", ["1", "2", "3"]),
    ("view", "$.missing", "present", []),
    ("error", "$.k", "min", ["50"]),
    ("signup", "$.k", "max", ["20"]),
    ("purchase", "$.k", "contains_any", ["1", "9"]),
    ("purchase", "$.k", "contains_all", ["1", "2"]),
)


@query(
    "K06_payload_checks",
    """WITH p AS (SELECT event_type, props->>'$.k' AS k FROM events), c AS (
         SELECT event_type, 'equals' AS op, k = '7' AS ok FROM p WHERE event_type = 'click'
         UNION ALL SELECT event_type, 'present', k IS NOT NULL FROM p WHERE event_type = 'click'
         UNION ALL SELECT event_type, 'in', k IN ('1', '2', '3') FROM p WHERE event_type = 'view'
         UNION ALL SELECT event_type, 'present', false FROM p WHERE event_type = 'view'
         UNION ALL SELECT event_type, 'min', CAST(k AS DOUBLE) >= 50 FROM p WHERE event_type = 'error'
         UNION ALL SELECT event_type, 'max', CAST(k AS DOUBLE) <= 20 FROM p WHERE event_type = 'signup'
         UNION ALL SELECT event_type, 'contains_any', contains(k, '1') OR contains(k, '9') FROM p WHERE event_type = 'purchase'
         UNION ALL SELECT event_type, 'contains_all', contains(k, '1') AND contains(k, '2') FROM p WHERE event_type = 'purchase')
       SELECT event_type, op, count(*) FILTER (WHERE ok) AS passed, count(*) AS total, round(count(*) FILTER (WHERE ok) / count(*), 6) AS score FROM c GROUP BY 1, 2""",
)
def _(t):
    checks = t.spark.createDataFrame(list(PAYLOAD_CHECKS), "event_type string, path string, op string, expected array<string>")
    return evaluate.score(evaluate.payload_checks(t.events, "props", checks, ["event_type"]), ["event_type", "op"])


@query("K07_latency_p95", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def _(t):
    return evaluate.latency_p95(t.events, ["event_type"], "value")


CEILING_SQL = "CASE event_type WHEN 'error' THEN 60 WHEN 'view' THEN 80 ELSE 0 END"


@query("K08_latency_violations", f"SELECT event_id, event_type, value FROM events WHERE {CEILING_SQL} > 0 AND value > {CEILING_SQL}")
def _(t):
    ceiling = F.when(F.col("event_type") == "error", 60).when(F.col("event_type") == "view", 80).otherwise(0)
    cases = t.events.withColumn("ceiling", ceiling)
    return evaluate.latency_violations(cases, "value", "ceiling").select("event_id", "event_type", "value")


def label_parts(t: Tables) -> DataFrame:
    """Two labelling rules scored on the given labels: the new one uses length, the old one says yes to all."""
    docs = t.documents.join(t.labels, "doc_id")
    rules = {"new": (F.col("n_chars") >= 400).cast("int"), "old": F.lit(1)}
    parts = [
        docs.groupBy("lang").agg(F.count_if(F.col("quality") == rule).alias("passed"), F.count("*").alias("total")).select(
            F.lit("quality").alias("metric"), F.lit(name).alias("variant"), "passed", "total"
        )
        for name, rule in rules.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "K09_metric_rollup",
    """WITH j AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)),
       s AS (SELECT round(count(*) FILTER (WHERE quality = CAST(n_chars >= 400 AS INTEGER)) / count(*), 6) AS n,
             round(count(*) FILTER (WHERE quality = 1) / count(*), 6) AS o FROM j)
       SELECT 'quality' AS metric, n AS new_score, o AS old_score, round(n - o, 6) AS delta FROM s""",
)
def _(t):
    return evaluate.metric_rollup(label_parts(t), "variant")


@query(
    "K10_gate_check",
    """WITH o AS (SELECT 'p95_' || event_type AS name, round(quantile_cont(value, 0.95), 6) AS observed FROM events GROUP BY 1),
       g AS (SELECT 'p95_' || event_type AS name, 'max' AS kind, CASE event_type WHEN 'error' THEN 10.0 ELSE 100.0 END AS threshold FROM events GROUP BY 1, 3
             UNION ALL SELECT 'quality_score', 'min', 0.5
             UNION ALL SELECT 'never_measured', 'min', 0.0),
       q AS (SELECT 'quality_score' AS name, round(count(*) FILTER (WHERE quality = CAST(n_chars >= 400 AS INTEGER)) / count(*), 6) AS observed
             FROM labels JOIN documents USING (doc_id)),
       j AS (SELECT g.name, kind, CAST(threshold AS DOUBLE) AS threshold, coalesce(x.observed, 0.0) AS observed FROM g
             LEFT JOIN (SELECT * FROM o UNION ALL SELECT * FROM q) x ON g.name = x.name),
       c AS (SELECT *, CASE kind WHEN 'min' THEN observed >= threshold ELSE observed <= threshold END AS passed FROM j)
       SELECT *, (SELECT bool_and(passed) FROM c) AS all_passed FROM c""",
)
def _(t):
    p95 = evaluate.latency_p95(t.events, ["event_type"], "value").select(
        F.concat(F.lit("p95_"), "event_type").alias("name"), F.col("p95").alias("observed")
    )
    quality = evaluate.metric_rollup(label_parts(t).filter("variant = 'new'")).select(
        F.lit("quality_score").alias("name"), F.col("score").alias("observed")
    )
    limits = t.events.select("event_type").distinct().select(
        F.concat(F.lit("p95_"), "event_type").alias("name"),
        F.lit("max").alias("kind"),
        F.when(F.col("event_type") == "error", 10.0).otherwise(100.0).alias("threshold"),
    )
    floors = t.spark.createDataFrame([("quality_score", "min", 0.5), ("never_measured", "min", 0.0)], limits.schema)
    return evaluate.gate_check(p95.unionByName(quality), limits.unionByName(floors))


@query(
    "K11_metric_key_scores",
    """SELECT 'quality_' || lang AS metric_key, count(*) FILTER (WHERE quality = 1) AS passed, count(*) AS total,
         round(count(*) FILTER (WHERE quality = 1) / count(*), 6) AS score FROM labels JOIN documents USING (doc_id) GROUP BY 1""",
)
def _(t):
    cases = t.labels.join(t.documents, "doc_id").select(
        F.concat(F.lit("quality_"), "lang").alias("metric_key"), (F.col("quality") == 1).alias("passed")
    )
    return evaluate.score(cases, ["metric_key"])
