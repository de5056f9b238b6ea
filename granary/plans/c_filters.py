"""Filters, lookups and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import cells
from granary.operators import aggregate, budget, catalog, filters
from granary.plans.registry import query
from granary.plans.shapes import TEXT_ORDERS_SQL, text_orders
from granary.plans.a_sources import CATALOG_SQL, catalog_of


@query(
    "C01_lookup",
    """SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(trim(c_mktsegment)), 'mach')
       ORDER BY 1, 2, 3 LIMIT 30""",
)
def _(t):
    return filters.lookup(t.customer, ["c_custkey", "c_name", "c_mktsegment"], "c_mktsegment", "MACH")


@query(
    "C02_filter_eq",
    f"WITH {TEXT_ORDERS_SQL} SELECT o_orderkey, o_orderstatus FROM text_orders WHERE lower(trim(o_orderstatus)) = 'f'",
)
def _(t):
    orders = text_orders(t)
    return orders.filter(filters.equals_text(orders, "o_orderstatus", "F")).select("o_orderkey", "o_orderstatus")


@query("C03_filter_contains", "SELECT p_partkey, p_name FROM part WHERE lower(trim(p_name)) LIKE '%r_ng%'")
def _(t):
    part = t.part
    return part.filter(filters.contains_text(part, "p_name", "R_ng", literal=False)).select("p_partkey", "p_name")


@query("C03_filter_contains_literal", "SELECT p_partkey, p_name FROM part WHERE contains(lower(trim(p_name)), 'gear')")
def _(t):
    part = t.part
    return part.filter(filters.contains_text(part, "p_name", "Gear")).select("p_partkey", "p_name")


@query(
    "C04_filter_range",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_extendedprice >= 90000.5",
)
def _(t):
    items = t.lineitem
    return items.filter(filters.in_range(items, "l_extendedprice", "gte", "90000,5")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )


@query(
    "C05_conjunctive_filter",
    f"""WITH {TEXT_ORDERS_SQL} SELECT o_orderkey FROM text_orders
        WHERE lower(trim(o_orderstatus)) = 'f' AND lower(trim(o_orderpriority)) LIKE '%urgent%'
          AND TRY_CAST(replace(nullif(trim(o_totalprice), ''), ',', '.') AS DOUBLE) > 250000""",
)
def _(t):
    orders = text_orders(t)
    wanted = [("o_orderstatus", "eq", "F"), ("o_orderpriority", "contains", "urgent"), ("o_totalprice", "gt", "250000")]
    return orders.filter(filters.conjunction(orders, wanted)).select("o_orderkey")


@query(
    "C06_non_empty_filter",
    f"WITH {TEXT_ORDERS_SQL} SELECT o_orderkey FROM text_orders WHERE trim(coalesce(o_totalprice, '')) <> ''",
)
def _(t):
    orders = text_orders(t)
    return orders.filter(cells.non_empty(orders, "o_totalprice")).select("o_orderkey")


@query(
    "C07_coerce_number",
    f"""WITH {TEXT_ORDERS_SQL} SELECT o_orderkey,
        CAST(replace(nullif(trim(o_totalprice), ''), ',', '.') AS DOUBLE) AS strict_value,
        TRY_CAST(replace(nullif(trim(o_orderpriority), ''), ',', '.') AS DOUBLE) AS tolerant_value FROM text_orders""",
)
def _(t):
    orders = text_orders(t)
    return orders.select(
        "o_orderkey",
        cells.strict_number(orders, "o_totalprice").alias("strict_value"),
        cells.tolerant_number(orders, "o_orderpriority").alias("tolerant_value"),
    )


@query(
    "C08_metadata_predicate",
    """SELECT doc_id, lang, source, n_chars FROM documents
       WHERE (lang IN ('en', 'de') AND n_chars > 500) OR (source <> 'web' AND lang NOT IN ('en', 'de', 'fr')
              AND n_chars <= 4000 AND contains(text, 'que'))""",
)
def _(t):
    where = {
        "$or": [
            {"lang": {"$in": ["en", "de"]}, "n_chars": {"$gt": 500}},
            {
                "source": {"$ne": "web"},
                "lang": {"$nin": ["en", "de", "fr"]},
                "$and": [{"n_chars": {"$lte": 4000}}, {"text": {"$contains": "que"}}],
            },
        ]
    }
    return t.documents.filter(filters.metadata_predicate(where)).select("doc_id", "lang", "source", "n_chars")


@query(
    "C09_retrieval_scope",
    """SELECT vec_id AS file_id, label AS processing_id FROM embeddings
       WHERE label IN (1, 2, 3) AND (CASE WHEN label % 2 = 0 THEN 'local' ELSE 'aihub' END) = 'aihub'""",
)
def _(t):
    chunks = t.embeddings.select(
        F.col("vec_id").alias("file_id"),
        F.col("label").alias("processing_id"),
        F.when(F.col("label") % 2 == 0, "local").otherwise("aihub").alias("embedding_mode"),
        F.lit("nomic").alias("embedding_model"),
    )
    scope = filters.retrieval_scope(
        processing_ids=[1, 2, 3], embedding_mode="Corporate", embedding_model="aihub:nomic"
    )
    return chunks.filter(scope).select("file_id", "processing_id")


@query("C10_sample_rows", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 5")
def _(t):
    return filters.sample_rows(t.nation, "n_nationkey")


@query(
    "C11_scan_budget",
    f"WITH {CATALOG_SQL} SELECT table_name, row_count, row_count <= 20000 AS within_budget FROM catalog",
)
def _(t):
    return budget.scan_verdicts(catalog_of(t), 20_000)


@query(
    "C12_row_budget",
    "SELECT least(count(*), 201) AS rows_seen, count(*) > 200 AS over_limit FROM lineitem",
)
def _(t):
    return budget.row_verdict(t.lineitem)


@query(
    "C13_byte_budget",
    """SELECT CAST(coalesce(sum(2 + strlen(coalesce(CAST(r_regionkey AS VARCHAR), 'null')) + 1
                + strlen(coalesce(r_name, 'null')) + 1), 0) AS BIGINT) AS result_bytes FROM region""",
)
def _(t):
    return budget.result_bytes(t.region)


@query(
    "C14_rename_projection",
    "SELECT n_regionkey AS group_key, count(*) AS value FROM nation GROUP BY 1",
)
def _(t):
    counts = t.nation.groupBy("n_regionkey").agg(F.count("*"))
    return filters.result_shape(counts, ["group_key", "value"])


@query("C15_pagination", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def _(t):
    return filters.page(t.orders, [F.col("o_orderkey").asc()], 50, 25)
