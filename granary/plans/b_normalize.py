"""Table normalisation, kinds and column metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from granary.operators import catalog, normalize
from granary.plans.a_sources import CATALOG_SQL, catalog_of
from granary.plans.registry import Tables, query
from granary.plans.shapes import (
    SQL_FOLD,
    SQL_KIND,
    TABLE_COLUMNS,
    sql_placed,
    sql_hint,
    sql_metadata,
    sql_text,
)

PROFILED = {"customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}


def metadata_of(t: Tables) -> DataFrame:
    parts = [
        normalize.column_metadata(getattr(t, name), key).withColumn("table_name", F.lit(name))
        for name, key in PROFILED.items()
    ]
    return reduce(DataFrame.unionByName, parts)


METADATA_SQL = "metadata AS (" + " UNION ALL ".join(
    f"({sql_metadata(name, list(TABLE_COLUMNS[name]), key)})" for name, key in PROFILED.items()
) + ")"


@query(
    "B01_normalize_headers",
    """SELECT p_partkey AS part_key, p_name AS name, p_brand AS name_2, p_type AS t_1st_type, p_size AS col_5,
              p_retailprice AS retail_price FROM part""",
)
def _(t):
    messy = t.part.toDF(" Part Key ", "Name", "NAME!", "1st type", "??", "_Retail__price_".replace("__", " "))
    return normalize.normalize_headers(messy)[0]


@query(
    "B02_normalize_cells",
    "SELECT " + ", ".join(f"{sql_text('customer', c)} AS {c}" for c in TABLE_COLUMNS["customer"]) + " FROM customer",
)
def _(t):
    return normalize.normalize_cells(t.customer)


@query(
    "B03_drop_empty_rows_and_columns",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer
       WHERE c_mktsegment <> 'BUILDING'""",
)
def _(t):
    blank = F.col("c_mktsegment") == "BUILDING"
    messy = t.customer.select(
        *[F.when(blank, " ").otherwise(F.col(c).cast("string")).alias(c) for c in ("c_custkey", "c_name", "c_mktsegment")],
        F.lit("  ").alias("c_note"),
        F.lit(None).cast("string").alias("c_flag"),
    )
    return normalize.drop_empty(messy)


def _kinds(name, table, key):
    columns = list(TABLE_COLUMNS[table])

    @query(name, f"SELECT column_name, {SQL_KIND} AS kind FROM ({sql_placed(table, columns, key)}) GROUP BY 1")
    def _(t):
        return normalize.column_kinds(getattr(t, table), key)


_kinds("B04_infer_column_kind_orders", "orders", "o_orderkey")
_kinds("B04_infer_column_kind_events", "events", "event_id")

ALL_COLUMNS_SQL = "cols(table_name, ordinal, column_name, type_name) AS (VALUES " + ", ".join(
    f"('{t}', {i}, '{c}', '{k}')" for t, cols in TABLE_COLUMNS.items() for i, (c, k) in enumerate(cols.items(), 1)
) + ")"


def columns_of(t: Tables) -> DataFrame:
    return catalog.describe_columns({name: getattr(t, name) for name in TABLE_COLUMNS})


@query(
    "B05_canonical_dtype",
    f"""WITH {ALL_COLUMNS_SQL} SELECT table_name, column_name,
        CASE WHEN contains(type_name, 'int') THEN 'integer'
             WHEN regexp_matches(type_name, 'float|double|decimal') THEN 'numeric'
             WHEN regexp_matches(type_name, 'date|time') THEN 'datetime'
             WHEN contains(type_name, 'bool') THEN 'boolean'
             WHEN regexp_matches(type_name, 'str|char|text') THEN 'text' ELSE type_name END AS dtype FROM cols""",
)
def _(t):
    return columns_of(t).select("table_name", "column_name", normalize.canonical_dtype(F.col("type_name")).alias("dtype"))




@query(
    "B06_cardinality_hint",
    f"""SELECT column_name, value_count, unique_count, {sql_hint()} AS cardinality_hint FROM (
        SELECT column_name, count(*) AS value_count, count(DISTINCT {SQL_FOLD}) AS unique_count
        FROM ({sql_placed("customer", list(TABLE_COLUMNS["customer"]), "c_custkey")}) GROUP BY 1)
        UNION ALL SELECT column_name, value_count, unique_count, {sql_hint()} FROM (
        SELECT column_name, count(*) AS value_count, count(DISTINCT {SQL_FOLD}) AS unique_count
        FROM ({sql_placed("orders", list(TABLE_COLUMNS["orders"]), "o_orderkey")}) GROUP BY 1)""",
)
def _(t):
    customers = normalize.cardinality_hints(t.customer, "c_custkey")
    return customers.unionByName(normalize.cardinality_hints(t.orders, "o_orderkey"))


@query(
    "B07_column_metadata",
    f"""WITH {METADATA_SQL} SELECT table_name, ordinal, normalized_name, dtype, cardinality_hint, samples, aliases
        FROM metadata""",
)
def _(t):
    return metadata_of(t).select(
        "table_name",
        "ordinal",
        "normalized_name",
        "dtype",
        "cardinality_hint",
        F.concat_ws(" | ", "sample_values").alias("samples"),
        F.concat_ws(" | ", "aliases").alias("aliases"),
    )


@query(
    "B09_metadata_stats_rollup",
    f"""WITH {METADATA_SQL}, cells AS (SELECT *, len(string_split(samples, ' | ')) AS n_samples,
          len(string_split(aliases, ' | ')) AS n_aliases,
          strlen(normalized_name) + strlen(replace(samples, ' | ', '')) + strlen(replace(aliases, ' | ', '')) AS size
        FROM metadata),
        per AS (SELECT table_name, sum(size) AS size FROM cells GROUP BY 1)
        SELECT count(DISTINCT table_name) AS tables_count, count(*) AS columns_total, count(*) AS columns_with_metadata,
          count(*) FILTER (WHERE n_samples > 0) AS columns_with_samples, CAST(sum(n_aliases) AS BIGINT) AS aliases_total,
          CAST(sum(n_samples) AS BIGINT) AS sample_values_total, 0 AS aliases_trimmed_total,
          0 AS sample_values_trimmed_total, 0 AS metadata_columns_dropped, CAST(sum(size) AS BIGINT) AS metadata_bytes,
          CAST(48000 * count(DISTINCT table_name) AS BIGINT) AS metadata_budget_bytes,
          (SELECT bool_or(size > 48000) FROM per) AS metadata_budget_enforced FROM cells""",
)
def _(t):
    return catalog.stats_rollup(catalog.metadata_stats(metadata_of(t)))


RANKED_SQL = f"""{METADATA_SQL}, scored AS (SELECT table_name, ordinal, normalized_name AS column_name,
    CASE dtype WHEN 'integer' THEN 'numeric' WHEN 'empty' THEN 'other' ELSE dtype END AS dtype_family,
    regexp_matches(normalized_name, '(^id$|_id$|(^|_)id_)') AS identifier_like,
    round(CASE WHEN dtype IN ('integer', 'numeric', 'datetime') THEN 4.0 WHEN dtype = 'text' THEN 1.0 ELSE 0.0 END
      + CASE WHEN cardinality_hint IN ('single', 'low', 'medium') THEN 1.5 WHEN cardinality_hint = 'high' THEN 0.4 ELSE 0.0 END
      + 0.8 - CASE WHEN regexp_matches(normalized_name, '(^id$|_id$|(^|_)id_)') THEN 2.5 ELSE 0.0 END
      + greatest(0.0, 0.2 - (ordinal - 1) * 0.01), 4) AS score FROM metadata),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY score DESC, identifier_like, ordinal)
      AS field_rank FROM scored)"""


@query(
    "B10_rank_relevant_fields",
    f"""WITH {RANKED_SQL} SELECT table_name, ordinal, column_name, dtype_family, identifier_like,
        CAST(score AS DOUBLE) AS score, field_rank FROM ranked WHERE field_rank <= 6""",
)
def _(t):
    return catalog.rank_relevant_fields(metadata_of(t))


@query(
    "B11_schema_summary",
    f"""WITH {RANKED_SQL}, {CATALOG_SQL}, mine AS (SELECT * FROM catalog
          WHERE table_name IN ('customer', 'part', 'orders', 'events')),
        facts AS (SELECT table_name, string_agg(column_name, ', ' ORDER BY field_rank) FILTER (WHERE field_rank <= 6) AS top_fields,
          concat_ws(', ', CASE WHEN bool_or(dtype_family = 'numeric') THEN 'numeric measures' END,
            CASE WHEN bool_or(dtype_family = 'datetime') THEN 'date/time dimensions' END,
            CASE WHEN bool_or(dtype_family = 'text') THEN 'categorical/text fields' END) AS kinds
          FROM ranked WHERE field_rank <= 12 GROUP BY 1)
        SELECT table_name, row_count, column_count AS columns_total, 'includes ' || kinds AS data_characteristics, top_fields,
          (SELECT count(*) FROM mine) AS tables_total, (SELECT CAST(sum(row_count) AS BIGINT) FROM mine) AS rows_total
        FROM mine JOIN facts USING (table_name)""",
)
def _(t):
    tables = catalog.describe_tables({name: getattr(t, name) for name in PROFILED})
    return catalog.schema_summary(tables, metadata_of(t))


@query(
    "B13_column_purpose",
    f"""WITH {ALL_COLUMNS_SQL} SELECT table_name, column_name, CASE
          WHEN regexp_matches(column_name, '_id$|^id$|uuid') THEN 'identifier/key column'
          WHEN regexp_matches(column_name, 'date|time|_at$') THEN 'time/event timestamp'
          WHEN regexp_matches(column_name, 'comment|text|descr|message') THEN 'free-text/narrative field'
          WHEN regexp_matches(column_name, 'office|region|city|branch') THEN 'organizational or location dimension'
          WHEN regexp_matches(column_name, 'status|stage|state') THEN 'process state dimension'
          WHEN regexp_matches(column_name, 'amount|sum|price|cost|total|revenue') THEN 'financial metric field'
          WHEN regexp_matches(column_name, 'count|qty|volume') THEN 'volume/count metric field'
          ELSE 'attribute used for segmentation/analysis' END AS purpose FROM cols""",
)
def _(t):
    return columns_of(t).select("table_name", "column_name", catalog.column_purpose(F.col("column_name")).alias("purpose"))


@query(
    "B13_process_context",
    f"""WITH {CATALOG_SQL} SELECT table_name, CASE table_name
          WHEN 'orders' THEN 'Order-to-cash / document processing workflow.'
          ELSE 'Likely an operational process dataset with records, dimensions, and process indicators.' END AS context
        FROM catalog""",
)
def _(t):
    # The given headers carry a table prefix; orders are read under the names users give them.
    renamed = {"o_orderkey": "order_id", "o_orderstatus": "status"}
    tables = {name: getattr(t, name).withColumnsRenamed(renamed) for name in TABLE_COLUMNS}
    return catalog.describe_tables(tables).select("table_name", catalog.process_context(F.col("columns")).alias("context"))
