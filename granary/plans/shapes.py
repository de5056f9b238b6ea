"""Views the queries share: the given tables in the shape the reports expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from granary.plans.registry import Tables

# SQL text of a double: its shortest exact form, of whole numbers without the fraction.
def sql_plain(column: str) -> str:
    return rf"regexp_replace(CAST({column} AS VARCHAR), '\.0$', '')"


def text_orders(t: Tables) -> DataFrame:
    """Orders as user-typed text: decimal commas, stray blanks, no price while pending."""
    price = F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.concat(F.lit(" "), F.lower("o_orderstatus"), F.lit(" ")).alias("o_orderstatus"),
        F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.concat(price, F.lit(" "))).alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        "o_orderpriority",
    )


TEXT_ORDERS_SQL = """text_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, ' ' || lower(o_orderstatus) || ' ' AS o_orderstatus,
         CASE WHEN o_orderstatus = 'P' THEN '  '
              ELSE replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || ' ' END AS o_totalprice,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
  FROM orders)"""

# SQL for a number written with a decimal comma.
TEXT_PRICE = "CAST(replace(nullif(trim(o_totalprice), ''), ',', '.') AS DOUBLE)"

# Columns of the given tables with their Spark types, for SQL that lists columns.
TABLE_COLUMNS = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {
        "c_custkey": "bigint",
        "c_name": "string",
        "c_nationkey": "int",
        "c_acctbal": "double",
        "c_mktsegment": "string",
    },
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {
        "p_partkey": "bigint",
        "p_name": "string",
        "p_brand": "string",
        "p_type": "string",
        "p_size": "int",
        "p_retailprice": "double",
    },
    "orders": {
        "o_orderkey": "bigint",
        "o_custkey": "bigint",
        "o_orderstatus": "string",
        "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz",
        "o_orderpriority": "string",
    },
    "lineitem": {
        "l_orderkey": "bigint",
        "l_partkey": "bigint",
        "l_suppkey": "bigint",
        "l_linenumber": "int",
        "l_quantity": "double",
        "l_extendedprice": "double",
        "l_discount": "double",
        "l_tax": "double",
        "l_returnflag": "string",
        "l_linestatus": "string",
        "l_shipdate": "timestamp_ntz",
    },
    "events": {
        "event_id": "bigint",
        "ts": "timestamp_ntz",
        "user_id": "bigint",
        "event_type": "string",
        "value": "double",
        "props": "string",
    },
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}


def sql_text(table: str, column: str) -> str:
    kind = TABLE_COLUMNS[table][column]
    if kind == "double":
        return f"coalesce({sql_plain(column)}, '')"
    return f"trim(coalesce(CAST({column} AS VARCHAR), ''))"


def sql_long(table: str, columns: list[str], key: str = "NULL") -> str:
    """Non-empty cells as (ordinal, column_name, k, value) rows."""
    return " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS column_name, {key} AS k, {sql_text(table, c)} AS value "
        f"FROM {table} WHERE {sql_text(table, c)} <> ''"
        for i, c in enumerate(columns, start=1)
    )


def sql_placed(table: str, columns: list[str], key: str) -> str:
    """Non-empty cells with their place in the column."""
    return f"SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY k) AS position FROM ({sql_long(table, columns, key)})"


SQL_KIND = r"""CASE
  WHEN count(*) FILTER (WHERE lower(value) IN ('true','false','yes','no','y','n','0','1')) / count(*) >= 0.8 THEN 'boolean'
  WHEN count(*) FILTER (WHERE value NOT IN ('0','1') AND regexp_matches(value, '^[+-]?[0-9]+$')) / count(*) >= 0.8 THEN 'integer'
  WHEN count(*) FILTER (WHERE value NOT IN ('0','1') AND regexp_matches(value,
       '^[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?$')) / count(*) >= 0.8 THEN 'number'
  WHEN count(*) FILTER (WHERE regexp_matches(value, '[-/:]') AND NOT regexp_matches(value,
       '^[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?$')) / count(*) >= 0.6 THEN 'datetime_like'
  ELSE 'text' END"""

SQL_FOLD = r"lower(trim(regexp_replace(value, '\s+', ' ', 'g')))"


def sql_hint(unique: str = "unique_count", total: str = "value_count") -> str:
    return f"""CASE WHEN {total} = 0 THEN 'empty' WHEN {unique} <= 1 THEN 'single'
      WHEN {unique} <= 12 AND {unique} / {total} <= 0.35 THEN 'low'
      WHEN {unique} <= 64 AND {unique} / {total} <= 0.8 THEN 'medium' ELSE 'high' END"""


def sql_metadata(table: str, columns: list[str], key: str) -> str:
    """Column metadata of one table as SQL: dtype, hint, sample values and aliases."""
    return f"""SELECT '{table}' AS table_name, ordinal, column_name AS normalized_name, dtype, hint AS cardinality_hint,
        samples, CASE WHEN replace(column_name, '_', ' ') = column_name THEN column_name
                 ELSE column_name || ' | ' || replace(column_name, '_', ' ') END AS aliases
      FROM (SELECT ordinal, column_name, {sql_hint("count(DISTINCT lower(v))", "count(*)")} AS hint
            FROM (SELECT *, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS v
                  FROM ({sql_placed(table, columns, key)})) GROUP BY 1, 2)
      JOIN (SELECT column_name, CASE {SQL_KIND} WHEN 'number' THEN 'numeric' WHEN 'datetime_like' THEN 'datetime'
              ELSE {SQL_KIND} END AS dtype
            FROM ({sql_placed(table, columns, key)}) GROUP BY 1) USING (column_name)
      JOIN (SELECT column_name, string_agg(s, ' | ' ORDER BY p) AS samples
            FROM (SELECT column_name, s, p, row_number() OVER (PARTITION BY column_name ORDER BY p) AS r
                  FROM (SELECT column_name, arg_min(s, position) AS s, min(position) AS p
                        FROM (SELECT *, rtrim(substr(trim(regexp_replace(value, '\\s+', ' ', 'g')), 1, 80)) AS s
                              FROM ({sql_placed(table, columns, key)})) GROUP BY column_name, lower(s)))
            WHERE r <= 5 GROUP BY 1) USING (column_name)"""
