"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import cells
from granary.operators import joins
from granary.plans.registry import query
from granary.plans.b_normalize import metadata_of

FOLD = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(
    "D01_inner_join",
    """SELECT c_custkey AS user_id, c_mktsegment, count(*) AS conversations FROM customer JOIN orders ON c_custkey = o_custkey
       GROUP BY 1, 2""",
)
def _(t):
    users = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return joins.children_per_parent(users, t.orders, "user_id", "o_custkey", "conversations")


@query(
    "D02_bridge_join",
    """SELECT o_orderkey, p_partkey, p_name, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS attached_at
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
       WHERE o_orderstatus = 'F'""",
)
def _(t):
    chats = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    links = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
    linked = joins.bridge(chats, links, t.part, ("o_orderkey", "l_orderkey"), ("l_partkey", "p_partkey"))
    return linked.select(
        "o_orderkey", "p_partkey", "p_name", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("attached_at")
    ).orderBy(F.col("attached_at").desc(), "o_orderkey", "l_linenumber", "p_partkey")


@query(
    "D03_semi_join",
    """SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000
       OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 400000)""",
)
def _(t):
    runs = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    ready = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400_000)
    return joins.with_ready_run(t.customer, runs, "c_custkey", ready, F.col("c_acctbal") > 9000).select("c_custkey", "c_name")


@query(
    "D04_anti_join",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (
         SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def _(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.without_match(t.customer, urgent, ["c_custkey"]).select("c_custkey", "c_name")


@query(
    "D05_eager_child_load",
    r"""SELECT conv_id, page, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars,
          string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript
        FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS page FROM conversations) GROUP BY 1, 2""",
)
def _(t):
    pages = joins.child_pages(t.conversations, ["conv_id"], ["turn"], ["turn", "role", "text"], 4)
    lines = F.transform("items", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return pages.select(
        "conv_id",
        "page",
        F.size("items").alias("messages"),
        F.aggregate("items", F.lit(0).cast("long"), lambda n, m: n + F.length(m["text"])).alias("chars"),
        F.array_join(lines, "\n").alias("transcript"),
    )


@query(
    "D06_group_map_join",
    """SELECT n_nationkey, coalesce(page, 0) AS page, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS ids
       FROM (SELECT n_nationkey FROM nation UNION ALL SELECT 100 + r_regionkey FROM region)
       LEFT JOIN (SELECT *, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 50 AS page FROM supplier)
         ON n_nationkey = s_nationkey GROUP BY 1, 2""",
)
def _(t):
    parents = t.nation.select("n_nationkey").unionByName(t.region.select((F.col("r_regionkey") + 100).alias("n_nationkey")))
    children = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    lists = joins.grouped_ids(parents, children, "n_nationkey", "s_suppkey", 50)
    return lists.select("n_nationkey", "page", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


TAIL = "lower(trim(regexp_replace(string_split(url, '/')[-1], '\\s+', ' ', 'g')))"


@query(
    "D07_alias_match_join",
    f"""WITH files AS (SELECT page_id, unnest(list_distinct([{TAIL}, '0000abcd-' || page_id || '_' || {TAIL},
            regexp_replace('0000abcd-' || page_id || '_' || {TAIL}, '^[0-9a-fA-F\\-]{{8,}}_', ''),
            'page ' || page_id])) AS name FROM pages),
        known AS (SELECT name, count(*) AS matches, min(page_id) AS first_id FROM files WHERE name <> '' GROUP BY 1)
        SELECT page_id AS request_id, name, coalesce(matches, 0) AS matches,
          CASE WHEN matches IS NULL THEN 'missing' WHEN matches = 1 THEN 'matched' ELSE 'ambiguous' END AS status,
          CASE WHEN matches = 1 THEN first_id END AS matched_file
        FROM (SELECT page_id, {TAIL} AS name FROM pages
              UNION ALL SELECT page_id, 'page ' || (page_id + 10) FROM pages) LEFT JOIN known USING (name)""",
)
def _(t):
    tail = F.element_at(F.split("url", "/"), -1)
    files = t.pages.select(
        "page_id",
        tail.alias("original"),
        F.concat(F.lit("0000abcd-"), F.col("page_id"), F.lit("_"), tail).alias("stored"),
        F.concat(F.lit("Page "), F.col("page_id")).alias("display"),
    )
    aliases = joins.file_aliases(files, "page_id", "original", "stored", "display")
    asked = t.pages.select("page_id", F.concat(F.lit("'C:\\docs\\"), F.upper(tail), F.lit("' ")).alias("requested"))
    more = t.pages.select("page_id", F.concat(F.lit("`PAGE  "), F.col("page_id") + 10, F.lit("`")).alias("requested"))
    resolved = joins.resolve_file_names(asked.unionByName(more), "requested", aliases, "page_id")
    return resolved.select(F.col("page_id").alias("request_id"), "name", "matches", "status", "matched_file")


FIRST_WORDS = "array_to_string(string_split({}, ' ')[1:2], ' ')"


@query(
    "D08_contains_join",
    f"""WITH terms AS (SELECT DISTINCT {FIRST_WORDS.format(FOLD.format('text'))} AS term FROM benchmark),
        texts AS (SELECT doc_id, ' ' || {FOLD.format('text')} || ' ' AS folded FROM documents)
        SELECT doc_id, term FROM texts JOIN terms ON contains(folded, ' ' || term || ' ')""",
)
def _(t):
    words = F.split(cells.folded_words(F.col("text")), " ")
    terms = t.benchmark.select(F.array_join(F.slice(words, 1, 2), " ").alias("term")).distinct()
    return joins.phrase_mentions(t.documents, "doc_id", "text", terms, "term")


@query("D09_fuzzy_join")
def _(t):
    metadata = metadata_of(t).withColumnRenamed("normalized_name", "column_name")
    variants = joins.column_variants(metadata)
    words = F.array_distinct(F.split(cells.folded_words(F.col("text")), " "))
    asked = t.benchmark.select(F.explode(words).alias("requested")).distinct()
    # Every table of the catalog is asked for every word of the benchmark.
    requests = asked.select(F.explode(F.array(*[F.lit(n) for n in ("customer", "orders")])).alias("table_name"), "requested")
    named = metadata.select("table_name", F.concat(F.col("display_name"), F.lit(" total")).alias("requested"))
    return joins.resolve_fields(requests.unionByName(named), variants)


@query(
    "D10_hits_to_sources_join",
    """WITH d AS (SELECT vec_id AS id, round(1.0 / (1.0 + label), 6) AS dense FROM embeddings),
       l AS (SELECT doc_id AS id, lang, CAST(n_chars AS DOUBLE) AS lexical FROM documents)
       SELECT coalesce(d.id, l.id) AS id, dense, lexical, lang FROM d FULL JOIN l ON d.id = l.id""",
)
def _(t):
    dense = t.embeddings.select(
        F.col("vec_id").alias("id"), F.round(1.0 / (1.0 + F.col("label")), 6).alias("dense")
    )
    lexical = t.documents.select(
        F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("lexical"), "lang"
    )
    return joins.merge_scores(dense, lexical, "id")
