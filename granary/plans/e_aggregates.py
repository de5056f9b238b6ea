"""Counts, measures, buckets and specs."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import cells
from granary.operators import aggregate
from granary.plans.registry import query
from granary.plans.shapes import TEXT_ORDERS_SQL, TEXT_PRICE, text_orders

FILLED = "trim(coalesce(o_totalprice, '')) <> ''"


@query("E01_count_rows", "SELECT count(*) AS value FROM lineitem")
def _(t):
    return aggregate.scalar(t.lineitem, "count")


@query(
    "E02_grouped_count",
    """SELECT o_orderpriority AS group_key, count(*) AS value FROM orders GROUP BY 1
       ORDER BY value DESC, group_key""",
)
def _(t):
    return aggregate.grouped(t.orders, "o_orderpriority", "count")


@query(
    "E03_sum",
    f"""WITH {TEXT_ORDERS_SQL} SELECT round(CAST(sum(CAST({TEXT_PRICE} AS DECIMAL(18,2))) AS DOUBLE), 6) AS value
        FROM text_orders WHERE {FILLED}""",
)
def _(t):
    return aggregate.scalar(text_orders(t), "sum", "o_totalprice", scale=2)


@query(
    "E04_avg",
    f"""WITH {TEXT_ORDERS_SQL} SELECT round(CAST(sum(CAST({TEXT_PRICE} AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6)
        AS value FROM text_orders WHERE {FILLED}""",
)
def _(t):
    return aggregate.scalar(text_orders(t), "avg", "o_totalprice", scale=2)


@query("E05_min", f"WITH {TEXT_ORDERS_SQL} SELECT round(min({TEXT_PRICE}), 6) AS value FROM text_orders WHERE {FILLED}")
def _(t):
    return aggregate.scalar(text_orders(t), "min", "o_totalprice")


@query("E06_max", f"WITH {TEXT_ORDERS_SQL} SELECT round(max({TEXT_PRICE}), 6) AS value FROM text_orders WHERE {FILLED}")
def _(t):
    return aggregate.scalar(text_orders(t), "max", "o_totalprice")


@query(
    "E07_grouped_measure",
    """SELECT l_returnflag AS group_key, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 6) AS value
       FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1 ORDER BY value DESC, group_key""",
)
def _(t):
    return aggregate.grouped(t.lineitem, "l_returnflag", "sum", "l_extendedprice", scale=2)


@query(
    "E07_grouped_measure_avg",
    """SELECT l_suppkey AS group_key,
              round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(l_quantity), 6) AS value
       FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY value DESC, group_key""",
)
def _(t):
    return aggregate.grouped(t.lineitem, "l_suppkey", "avg", "l_quantity", scale=2)


def _spec(**more):
    conditions = (("o_orderstatus", "eq", "F"), ("o_totalprice", "gte", "100000"))
    return aggregate.AggregateSpec("sum", "o_totalprice", conditions=conditions, scale=2, **more)


SPEC_ROWS = f"lower(trim(o_orderstatus)) = 'f' AND TRY_CAST({TEXT_PRICE} AS DOUBLE) >= 100000 AND {FILLED}"


@query(
    "E08_spec_aggregate",
    f"""WITH {TEXT_ORDERS_SQL} SELECT o_orderpriority AS group_key,
        round(CAST(sum(CAST({TEXT_PRICE} AS DECIMAL(18,2))) AS DOUBLE), 6) AS value
        FROM text_orders WHERE {SPEC_ROWS} GROUP BY 1 ORDER BY 1""",
)
def _(t):
    return _spec(dimension="o_orderpriority").run(text_orders(t))


@query(
    "E08_spec_aggregate_bucket",
    f"""WITH {TEXT_ORDERS_SQL} SELECT strftime(TRY_CAST(o_orderdate AS TIMESTAMP), '%Y-%m') AS bucket,
        round(CAST(sum(CAST({TEXT_PRICE} AS DECIMAL(18,2))) AS DOUBLE), 6) AS value
        FROM text_orders WHERE {SPEC_ROWS} AND TRY_CAST(o_orderdate AS TIMESTAMP) IS NOT NULL GROUP BY 1 ORDER BY 1""",
)
def _(t):
    return _spec(time_field="o_orderdate", grain="month").run(text_orders(t))


BUCKETS = {
    "E09_time_bucket_day": ("events", "ts", "day", "strftime(ts, '%Y-%m-%d')"),
    "E10_time_bucket_week": ("events", "ts", "week", "strftime(date_trunc('week', ts), '%Y-%m-%d')"),
    "E11_time_bucket_month": ("orders", "o_orderdate", "month", "strftime(o_orderdate, '%Y-%m')"),
    "E12_time_bucket_quarter": (
        "orders",
        "o_orderdate",
        "quarter",
        "concat(strftime(o_orderdate, '%Y'), '-Q', CAST(quarter(o_orderdate) AS VARCHAR))",
    ),
    "E13_time_bucket_year": ("orders", "o_orderdate", "year", "strftime(o_orderdate, '%Y')"),
}


def _bucket_query(name, table, column, grain, expression):
    @query(name, f"SELECT {expression} AS bucket, count(*) AS value FROM {table} WHERE {column} IS NOT NULL GROUP BY 1")
    def _(t):
        rows = aggregate.with_bucket(getattr(t, table), column, grain)
        return rows.groupBy("bucket").agg(F.count("*").alias("value"))


for _name, _item in BUCKETS.items():
    _bucket_query(_name, *_item)


@query(
    "E14_trend",
    """SELECT strftime(o_orderdate, '%Y-%m') AS bucket,
              round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 6) AS value
       FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1 ORDER BY 1""",
)
def _(t):
    return aggregate.trend(t.orders, "o_orderdate", "month", "sum", "o_totalprice", scale=2)


@query(
    "E15_month_of_year_distribution",
    """SELECT strftime(l_shipdate, '%m') AS bucket, count(*) AS value FROM lineitem WHERE l_shipdate IS NOT NULL
       GROUP BY 1 ORDER BY value DESC, bucket""",
)
def _(t):
    return aggregate.month_of_year(t.lineitem, "l_shipdate")


@query(
    "E16_value_distribution",
    """SELECT p_brand AS bucket, count(*) AS value FROM part WHERE trim(coalesce(p_brand, '')) <> ''
       GROUP BY 1 ORDER BY value DESC, bucket""",
)
def _(t):
    return aggregate.value_distribution(t.part, "p_brand")


@query(
    "E17_comparison",
    """SELECT o_orderstatus AS group_key,
              round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice), 6) AS value
       FROM orders WHERE lower(trim(o_orderstatus)) IN ('f', 'o') AND o_totalprice IS NOT NULL GROUP BY 1""",
)
def _(t):
    return aggregate.comparison(t.orders, "o_orderstatus", ["F", "O"], "avg", "o_totalprice", scale=2)


@query(
    "E18_row_coverage",
    f"""WITH {TEXT_ORDERS_SQL} SELECT count(*) AS rows_total, count(*) FILTER (WHERE {FILLED}) AS effective_rows,
        round(count(*) FILTER (WHERE {FILLED}) / count(*), 6) AS row_coverage_ratio FROM text_orders""",
)
def _(t):
    return aggregate.row_coverage(text_orders(t), "o_totalprice")


@query("E19_filtered_row_count", f"WITH {TEXT_ORDERS_SQL} SELECT count(*) AS value FROM text_orders WHERE {SPEC_ROWS}")
def _(t):
    return _spec().count(text_orders(t))


@query(
    "E42_active_entities",
    """SELECT count(DISTINCT user_id) AS active_entities FROM events
       WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 10 DAY""",
)
def _(t):
    return aggregate.active_entities(t.events, "user_id", "ts", F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), 10)


@query(
    "E43_conditional_counts",
    """SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS error_count,
       count(*) FILTER (WHERE event_type = 'purchase') AS purchase_count FROM events""",
)
def _(t):
    return aggregate.conditional_counts(t.events, "event_type", ["error", "purchase"])


@query("E44_sum_with_default", "SELECT source, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS used FROM documents GROUP BY 1")
def _(t):
    return aggregate.sum_or_zero(t.documents, "source", "n_chars")
