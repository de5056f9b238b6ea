"""Table profiles, summaries and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import aggregate, insight, profile
from granary.plans.registry import query
from granary.plans.shapes import TABLE_COLUMNS, sql_long, sql_placed, sql_plain, sql_text, text_orders, TEXT_ORDERS_SQL

CUSTOMER, ORDERS, PART = (list(TABLE_COLUMNS[t]) for t in ("customer", "orders", "part"))
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def counts_sql(table: str, columns: list[str]) -> str:
    return f"counts AS (SELECT ordinal, column_name, value, count(*) AS n FROM ({sql_long(table, columns)}) GROUP BY 1, 2, 3)"


TOP_SQL = """tops AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS value_rank
             FROM counts)"""


@query(
    "E20_column_non_empty_count",
    f"WITH {counts_sql('customer', CUSTOMER)} SELECT column_name, CAST(sum(n) AS BIGINT) AS non_empty_count FROM counts GROUP BY 1",
)
def _(t):
    return profile.non_empty_counts(t.customer)


@query(
    "E21_column_distinct_count",
    f"WITH {counts_sql('customer', CUSTOMER)} SELECT column_name, count(*) AS distinct_count FROM counts GROUP BY 1",
)
def _(t):
    return profile.distinct_counts(t.customer)


@query(
    "E22_column_top_values",
    f"""WITH {counts_sql('orders', ORDERS)}, {TOP_SQL}
        SELECT column_name, value_rank, value, n AS count FROM tops WHERE value_rank <= 3""",
)
def _(t):
    return profile.top_values(profile.value_counts(t.orders), 3)


@query(
    "E23_table_profile",
    f"""WITH {counts_sql('orders', ORDERS)}, {TOP_SQL},
        facts AS (SELECT column_name, CAST(sum(n) AS BIGINT) AS non_empty_count, count(*) AS distinct_count
                  FROM counts GROUP BY 1),
        listed AS (SELECT column_name, string_agg(value || ' (' || n || ')', ' | ' ORDER BY value_rank) AS top_values
                   FROM tops WHERE value_rank <= 3 GROUP BY 1),
        sample AS (SELECT column_name, string_agg(value, ' | ' ORDER BY k) AS sample_values
                   FROM ({sql_placed('orders', ORDERS, 'o_orderkey')}) WHERE position <= 3 GROUP BY 1)
        SELECT column_name, (SELECT count(*) FROM orders) AS row_count, non_empty_count, distinct_count, top_values,
               sample_values FROM facts JOIN listed USING (column_name) JOIN sample USING (column_name)""",
)
def _(t):
    return profile.table_profile(t.orders, "o_orderkey")


PURPOSE_SQL = """CASE WHEN regexp_matches(column_name, 'price') THEN 'financial metric field'
                 ELSE 'attribute used for segmentation/analysis' END"""
PART_TYPES = " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in TABLE_COLUMNS["part"].items())
COLUMN_PROFILE_SQL = f"""SELECT column_name, CASE column_name {PART_TYPES} END AS dtype, {PURPOSE_SQL} AS purpose_hint,
    non_null, (SELECT count(*) FROM part) - non_null AS null_count, unique_count, sample_values
    FROM (SELECT column_name, CAST(sum(n) AS BIGINT) AS non_null, count(*) AS unique_count FROM counts GROUP BY 1)
    JOIN (SELECT column_name, string_agg(value, ' | ' ORDER BY k) AS sample_values
          FROM ({sql_placed('part', PART, 'p_partkey')}) WHERE position <= 3 GROUP BY 1) USING (column_name)"""


@query("E24_column_profile", f"WITH {counts_sql('part', PART)} {COLUMN_PROFILE_SQL}")
def _(t):
    return profile.column_profile(t.part, "p_partkey")


def numeric_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
            round(CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / count({c}), 6) AS mean,
            CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS median FROM {table}
            HAVING count({c}) >= greatest(3, floor(count(*) * 0.1))"""
        for c in columns
    )


@query(
    "E25_numeric_summary",
    numeric_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_NUMBERS]),
)
def _(t):
    return profile.numeric_summary(t.lineitem, scale=2)


@query(
    "E26_datetime_summary",
    f"""WITH {TEXT_ORDERS_SQL} SELECT 'o_orderdate' AS column_name, count(*) AS count, min(o_orderdate) AS min,
        max(o_orderdate) AS max FROM text_orders""",
)
def _(t):
    return profile.datetime_summary(text_orders(t))


CATEGORY_SQL = """SELECT column_name, value_rank, value, n AS count FROM tops WHERE value_rank <= 8 AND column_name IN (
                    SELECT column_name FROM counts GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60)"""


@query("E27_categorical_summary", f"WITH {counts_sql('customer', CUSTOMER)}, {TOP_SQL} {CATEGORY_SQL}")
def _(t):
    return profile.categorical_summary(t.customer)


def pairs_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS c FROM {table}"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    )


TOP_PAIRS = "ORDER BY abs(c) DESC, feature_a DESC, feature_b DESC LIMIT 8"


@query(
    "E28_pairwise_correlation",
    f"SELECT feature_a, feature_b, round(c, 4) AS correlation FROM ({pairs_sql('lineitem', LINE_NUMBERS)}) {TOP_PAIRS}",
)
def _(t):
    return profile.pairwise_correlation(t.lineitem, LINE_NUMBERS)


@query(
    "E29_correlation_matrix",
    f"""WITH pairs AS ({pairs_sql('lineitem', LINE_NUMBERS)})
        SELECT feature_a, feature_b, round(c, 4) AS correlation FROM pairs
        UNION ALL SELECT feature_b, feature_a, round(c, 4) FROM pairs
        UNION ALL SELECT unnest({LINE_NUMBERS}), unnest({LINE_NUMBERS}), 1.0""",
)
def _(t):
    return profile.correlation_matrix(t.lineitem, LINE_NUMBERS)


@query(
    "E30_histogram",
    """SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS value
       FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1""",
)
def _(t):
    return profile.histogram(t.orders, "o_totalprice")


@query(
    "E31_scatter_pairs",
    """SELECT count(*) AS pairs, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 6) AS x_sum,
       count(*) >= 3 AS drawable FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""",
)
def _(t):
    pairs = profile.scatter_pairs(t.lineitem, "l_quantity", "l_extendedprice")
    return pairs.agg(
        F.count("*").alias("pairs"),
        F.round(F.sum(F.col("x").cast("decimal(18,2)")).cast("double"), 6).alias("x_sum"),
        (F.count("*") >= 3).alias("drawable"),
    )


@query(
    "E32_first_categorical_top10",
    """SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 2
       ORDER BY count DESC, value LIMIT 10""",
)
def _(t):
    orders = t.orders.select(F.lit("x").alias("constant"), "o_orderstatus", "o_orderpriority")
    return profile.first_categorical_top(orders)


@query(
    "E33_token_frequency",
    r"""SELECT token, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(
          regexp_replace(lower(text), '[^a-zа-я0-9\s]', ' ', 'g'), '\s+')) AS token FROM documents)
        WHERE length(token) > 2 GROUP BY 1 ORDER BY count DESC, token LIMIT 20""",
)
def _(t):
    return profile.token_frequency(t.documents, "text")


@query(
    "E34_entity_metrics",
    """SELECT 'unique' AS metric, 'user_id' AS name, CAST(count(DISTINCT user_id) AS VARCHAR) AS value FROM events
       UNION ALL SELECT 'time_min', 'ts', strftime(min(ts), '%Y-%m-%d %H:%M:%S') FROM events
       UNION ALL SELECT 'time_max', 'ts', strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events
       UNION ALL (SELECT 'top', event_type, CAST(count(*) AS VARCHAR) FROM events GROUP BY 2
                  ORDER BY count(*) DESC, event_type LIMIT 10)""",
)
def _(t):
    return profile.entity_metrics(t.events, "user_id", "event_type", "ts")


CUSTOMER_TYPES = " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in TABLE_COLUMNS["customer"].items())


@query(
    "E35_codegen_profile",
    f"""WITH {counts_sql('customer', CUSTOMER)}, firsts AS ({sql_placed('customer', CUSTOMER, 'c_custkey')}),
        facts AS (SELECT column_name, CAST(sum(n) AS BIGINT) AS non_null FROM counts GROUP BY 1),
        seen AS (SELECT column_name, count(DISTINCT value) AS sample_unique,
                   string_agg(value, ' | ' ORDER BY k) FILTER (WHERE position <= 4) AS sample_values FROM firsts GROUP BY 1)
        SELECT column_name, CASE column_name {CUSTOMER_TYPES} END AS dtype, non_null, sample_unique, sample_values,
          CASE WHEN column_name IN ('c_custkey', 'c_nationkey', 'c_acctbal') THEN 'numeric'
               WHEN sample_unique <= 80 THEN 'categorical' ELSE 'other' END AS column_class
        FROM facts JOIN seen USING (column_name)""",
)
def _(t):
    return profile.codegen_profile(t.customer, "c_custkey")


PART_NUMBERS = ["p_partkey", "p_size", "p_retailprice"]
D4 = "CAST(CAST(round({}, 4) AS DECIMAL(28,4)) AS VARCHAR)"


@query(
    "E36_full_report",
    f"""WITH {counts_sql('part', PART)}, {TOP_SQL}, prof AS ({COLUMN_PROFILE_SQL}),
        nums AS ({numeric_sql('part', PART_NUMBERS)}), cats AS ({CATEGORY_SQL}),
        pairs AS (SELECT * FROM ({pairs_sql('part', PART_NUMBERS)}) WHERE c IS NOT NULL {TOP_PAIRS})
        SELECT 'profile' AS section, column_name, metric, value FROM (
          SELECT column_name, unnest(['dtype', 'purpose_hint', 'non_null', 'null_count', 'unique_count']) AS metric,
            unnest([dtype, purpose_hint, CAST(non_null AS VARCHAR), CAST(null_count AS VARCHAR),
                    CAST(unique_count AS VARCHAR)]) AS value FROM prof)
        UNION ALL SELECT 'numeric', column_name, unnest(['count', 'min', 'max', 'mean', 'median']),
          unnest([CAST(count AS VARCHAR), {D4.format('min')}, {D4.format('max')}, {D4.format('mean')},
                  {D4.format('median')}]) FROM nums
        UNION ALL SELECT 'categorical', column_name, 'top_value', value || '=' || count FROM cats
        UNION ALL SELECT 'relationship', feature_a || ' ~ ' || feature_b, 'correlation', {D4.format('round(c, 4)')} FROM pairs
        UNION ALL SELECT 'insight', '', 'rows_total', CAST(count(*) AS VARCHAR) FROM part
        UNION ALL SELECT 'insight', '', 'numeric_columns', CAST(count(*) AS VARCHAR) FROM nums
        UNION ALL SELECT 'insight', '', 'categorical_summaries', CAST(count(DISTINCT column_name) AS VARCHAR) FROM cats
        UNION ALL SELECT 'insight', '', 'relationship_pairs', CAST(count(*) AS VARCHAR) FROM pairs""",
)
def _(t):
    return profile.full_report(t.part, "p_partkey", scale=2)


EVENT_BUCKETS = "b AS (SELECT event_type AS bucket, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1)"


def ranked_sql(buckets: str) -> str:
    return f"""WITH {buckets}, r AS (SELECT *, row_number() OVER (ORDER BY value DESC, bucket) AS rank,
               sum(value) OVER () AS total, count(*) OVER () AS buckets FROM b)"""


@query(
    "E37_share_of_total",
    ranked_sql(EVENT_BUCKETS)
    + """SELECT a.bucket AS top_bucket, a.value AS top_value, s.bucket AS runner_up,
         round(a.value / a.total * 100, 4) AS top_share, round(s.value / s.total * 100, 4) AS runner_up_share,
         a.value / a.total * 100 - s.value / s.total * 100 >= 12.0 AS clear_lead
         FROM r a JOIN r s ON a.rank = 1 AND s.rank = 2""",
)
def _(t):
    counts = t.events.groupBy(F.col("event_type").alias("bucket")).agg(F.count("*").alias("value"))
    return insight.top_bucket(counts)


SHAPE_SQL = """facts AS (SELECT max(buckets) AS buckets, max(total) AS total, max(value / total) AS top1,
    sum(value / total) FILTER (WHERE rank <= 3) AS top3, max(value / total) - min(value / total) AS spread
    FROM r WHERE rank <= 4), shaped AS (SELECT *, CASE WHEN buckets <= 2 THEN 'sparse' WHEN total <= 0 THEN 'unknown'
      WHEN buckets >= 6 AND top1 >= 0.45 AND top3 >= 0.75 AND 1 - top3 >= 0.12 THEN 'long_tail'
      WHEN top1 >= 0.65 OR top3 >= 0.85 THEN 'concentrated'
      WHEN buckets >= 4 AND top1 <= 0.32 AND spread <= 0.06 THEN 'flat'
      WHEN top1 <= 0.40 AND spread <= 0.10 THEN 'balanced' ELSE 'mixed' END AS shape FROM facts)"""


def _shape(name, column):
    buckets = f"b AS (SELECT CAST({column} AS VARCHAR) AS bucket, CAST(count(*) AS DOUBLE) AS value FROM part GROUP BY 1)"

    @query(
        name,
        f"""{ranked_sql(buckets)}, {SHAPE_SQL} SELECT buckets, round(top1, 6) AS top1_share, round(top3, 6) AS top3_share,
            round(spread, 6) AS spread_top4, shape FROM shaped""",
    )
    def _(t):
        return insight.distribution_shape(t.part.groupBy(F.col(column).alias("bucket")).agg(F.count("*").alias("value")))


for _column in ("p_brand", "p_type", "p_size"):
    _shape(f"E38_distribution_shape_{_column}", _column)


@query(
    "E39_trend_direction",
    """WITH b AS (SELECT strftime(o_orderdate, '%Y-%m') AS bucket,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY 1),
       r AS (SELECT *, row_number() OVER (ORDER BY bucket) AS pos FROM b),
       f AS (SELECT count(*) AS buckets, corr(pos, value) AS c, arg_min(value, pos) AS v1, arg_max(value, pos) AS v2,
             max(value) - min(value) AS rng FROM r),
       g AS (SELECT *, (v2 - v1) / greatest(abs(v1), 1e-9) * 100 AS change FROM f)
       SELECT buckets, round(change, 4) AS net_change_pct, round(c, 4) AS correlation,
         CASE WHEN buckets < 3 THEN 'none' WHEN rng <= 0 THEN 'flat'
           WHEN abs(change) < 8 OR abs(c) < 0.65 THEN 'no clear direction'
           WHEN v2 > v1 THEN 'increasing' ELSE 'decreasing' END AS trend FROM g""",
)
def _(t):
    return insight.trend_direction(aggregate.trend(t.orders, "o_orderdate", "month", "sum", "o_totalprice", scale=2))


@query(
    "E40_time_series_order",
    """WITH b AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS bucket FROM events)
       SELECT count(*) AS buckets, CASE WHEN count(*) >= 3 THEN 'descending' ELSE 'none' END AS time_order FROM b""",
)
def _(t):
    days = aggregate.with_bucket(t.events, "ts", "day").groupBy("bucket").agg(F.count("*").alias("value"))
    # The result as shown newest first: its row order is the reversed day.
    shown = days.withColumn("row_number", -F.unix_date(F.to_date("bucket")))
    return insight.time_series(shown)


@query(
    "E41_contrast",
    ranked_sql("b AS (SELECT p_brand AS bucket, CAST(count(*) AS DOUBLE) AS value FROM part GROUP BY 1)")
    + f""", {SHAPE_SQL} SELECT a.bucket AS leader, s.bucket AS runner_up,
        round((a.value / a.total - s.value / s.total) * 100, 4) AS gap_points, shape,
        CASE WHEN shape IN ('concentrated', 'long_tail') AND (a.value / a.total - s.value / s.total) * 100 >= 10 THEN 'leader_ahead'
             WHEN shape IN ('balanced', 'flat') AND (a.value / a.total - s.value / s.total) * 100 <= 3.5 THEN 'close'
             ELSE 'none' END AS contrast FROM r a JOIN r s ON a.rank = 1 AND s.rank = 2, shaped""",
)
def _(t):
    return insight.contrast(aggregate.value_distribution(t.part, "p_brand"))


@query("E45_interpolated_percentile", "SELECT round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def _(t):
    return profile.percentiles(t.events, [], "value", 0.95, "p95").select(F.round("p95", 6).alias("p95"))
