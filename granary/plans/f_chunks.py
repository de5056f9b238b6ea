"""Chunks of documents and tables, vector collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from granary.operators import catalog, chunk, normalize, vectors
from granary.operators.ordering import with_position
from granary.plans.a_sources import CATALOG_SQL, catalog_of
from granary.plans.registry import Tables, query
from granary.plans.shapes import SQL_KIND, TABLE_COLUMNS, sql_placed, sql_plain
from granary.session import shared_folder
from granary.sources import artifacts, stores

SIZE, OVERLAP = 2_000, 400
STEP = SIZE - OVERLAP


def chunks_of(t: Tables) -> DataFrame:
    """Whole documents in fixed windows: file_id, chunk_index, content, lang, source."""
    segments = chunk.window_segments(t.documents, "doc_id", "text", SIZE, OVERLAP)
    owner = t.documents.select("doc_id", "lang", "source")
    return segments.join(owner, "doc_id").select(
        F.col("doc_id").alias("file_id"), F.col("segment_index").alias("chunk_index"), "content", "lang", "source"
    )


CHUNKS_SQL = f"""chunks AS (SELECT * FROM (SELECT doc_id AS file_id, CAST(i AS INTEGER) AS chunk_index,
    substr(text, CAST(i * {STEP} + 1 AS BIGINT), {SIZE}) AS content, lang, source
  FROM (SELECT *, unnest(range(0, CAST(greatest(0, ceil((length(text) - {SIZE}) / {STEP})) AS BIGINT) + 1)) AS i
        FROM documents WHERE length(text) > 0)) WHERE length(regexp_replace(content, '\\s+', '', 'g')) > 0)"""


@query("F01_chunk_text")
def _(t):
    return chunk.split_documents(t.documents, "doc_id", "text")


@query("F02_chunk_by_file_type")
def _(t):
    kind = F.when(F.col("lang") == "en", "md").when(F.col("lang") == "de", "json").when(F.col("lang") == "fr", "csv").otherwise("txt")
    return chunk.split_documents(t.documents.withColumn("kind", kind), "doc_id", "text", "kind")


@query(
    "F03_chunk_positions",
    f"""WITH {CHUNKS_SQL} SELECT source, file_id, row_number() OVER (PARTITION BY source ORDER BY file_id, chunk_index) - 1 AS chunk_index,
        count(*) OVER (PARTITION BY source) AS total_chunks, length(content) AS chunk_size FROM chunks""",
)
def _(t):
    placed = chunk.positions(chunks_of(t).withColumnRenamed("chunk_index", "part"), "source", ["file_id", "part"])
    return placed.select("source", "file_id", "chunk_index", "total_chunks", "chunk_size")


@query(
    "F04_fixed_window_segments",
    f"WITH {CHUNKS_SQL} SELECT file_id AS doc_id, chunk_index AS segment_index, content FROM chunks",
)
def _(t):
    return chunk.window_segments(t.documents, "doc_id", "text", SIZE, OVERLAP)


@query(
    "F05_chunk_stats",
    f"""WITH {CHUNKS_SQL} SELECT count(*) AS total_chunks, CAST(floor(sum(length(content)) / count(*)) AS BIGINT) AS avg_chunk_size,
        min(length(content)) AS min_chunk_size, max(length(content)) AS max_chunk_size,
        CAST(sum(length(content)) AS BIGINT) AS total_size, 0.2 AS overlap_ratio FROM chunks""",
)
def _(t):
    return chunk.chunk_stats(chunks_of(t), "content", SIZE, OVERLAP)


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
ROW_SQL = f"""rows_ AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, 'o_orderkey: ' || o_orderkey || ' | o_custkey: ' || o_custkey
    || ' | o_orderstatus: ' || o_orderstatus || ' | o_totalprice: ' || {sql_plain('o_totalprice')}
    || ' | o_orderpriority: ' || o_orderpriority AS body FROM orders)"""


def order_lines(t: Tables, max_chars: int) -> DataFrame:
    return chunk.table_lines(t.orders, ["o_orderkey"], ORDER_COLUMNS, F.lit("orders"), max_chars)


@query(
    "F06_row_group_chunks",
    f"""WITH {ROW_SQL} SELECT 'orders' AS sheet_name, (n - 1) // 40 AS row_group_index, min(n) AS row_start, max(n) AS row_end,
        (SELECT count(*) FROM orders) AS total_rows,
        'sheet=orders rows=' || min(n) || '-' || max(n) || '/' || (SELECT count(*) FROM orders) || chr(10)
        || string_agg('Row ' || n || ': ' || body, chr(10) ORDER BY n) AS content FROM rows_ GROUP BY (n - 1) // 40""",
)
def _(t):
    return chunk.row_group_chunks(order_lines(t, 20_000), 40, 20_000)


# A group ends where its lines and the breaks between them would pass the size; every row knows where a group that starts
# at it would end, and the groups are the starts reached from the first row.
@query(
    "F06_row_group_chunks_by_chars",
    f"""WITH RECURSIVE {ROW_SQL}, lines AS (SELECT n, 'Row ' || n || ': ' || body AS line FROM rows_),
       placed AS (SELECT n, length(line) AS size, sum(length(line) + 1) OVER (ORDER BY n) AS upto FROM lines),
       ends AS (SELECT a.n AS first, max(b.n) AS last FROM placed a JOIN placed b ON b.n BETWEEN a.n AND a.n + {chunk.ROW_CHUNK_ROWS - 1}
          WHERE b.n = a.n OR b.upto - a.upto + a.size <= {chunk.ROW_CHUNK_CHARS} GROUP BY 1),
       groups AS (SELECT 0 AS row_group_index, first, last FROM ends WHERE first = 1
          UNION ALL SELECT row_group_index + 1, e.first, e.last FROM groups g JOIN ends e ON e.first = g.last + 1)
       SELECT 'orders' AS sheet_name, row_group_index, first AS row_start, last AS row_end, (SELECT count(*) FROM orders) AS total_rows,
         'sheet=orders rows=' || first || '-' || last || '/' || (SELECT count(*) FROM orders) || chr(10) || string_agg(line, chr(10) ORDER BY n) AS content
       FROM groups JOIN lines ON n BETWEEN first AND last GROUP BY row_group_index, first, last""",
)
def _(t):
    return chunk.row_group_chunks(order_lines(t, chunk.ROW_CHUNK_CHARS), 40)


@query(
    "F07_row_group_size",
    f"""WITH {CATALOG_SQL} SELECT table_name, CASE WHEN row_count % 7 = 0 THEN 41 ELSE column_count END AS columns,
        least(80, CASE WHEN row_count % 7 = 0 THEN 50 WHEN column_count >= 12 THEN 100 ELSE 200 END) AS row_group_size FROM catalog""",
)
def _(t):
    shown = F.when(F.col("row_count") % 7 == 0, 41).otherwise(F.col("column_count")).alias("columns")
    return catalog_of(t).select("table_name", shown).withColumn("row_group_size", chunk.row_group_size(F.col("columns"), 80))


# Only the text of a document can pass the size of a line here: what stands before it is the first line, its slices follow.
@query(
    "F08_long_row_continuation",
    """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS row_number, doc_id, lang, source, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS body FROM documents),
       p AS (SELECT row_number, 'Row ' || row_number || ': ' AS head, 'Row ' || row_number || ' (cont): ' AS cont,
          concat_ws(' | ', 'doc_id: ' || doc_id, 'lang: ' || nullif(trim(lang), ''), 'source: ' || nullif(trim(source), '')) AS few,
          CASE WHEN body = '' THEN '' ELSE 'text: ' || substr(body, 1, 2000) || CASE WHEN length(body) > 2000 THEN '...' ELSE '' END END AS long FROM d),
       s AS (SELECT *, 992 - length(cont) AS step, concat_ws(' | ', few, nullif(long, '')) AS whole FROM p),
       k AS (SELECT *, CAST(greatest(0, ceil((length(long) + length(cont) - 1000) / step)) AS INTEGER) AS slices FROM s),
       l AS (SELECT row_number, CASE WHEN length(head || whole) <= 1000 THEN [head || whole] ELSE list_concat([head || few],
          list_transform(list_filter(range(0, slices + 1), lambda i: substr(long, CAST(i * step + 1 AS BIGINT)) <> ''),
            lambda i: cont || CASE WHEN i < slices THEN substr(long, CAST(i * step + 1 AS BIGINT), step) ELSE substr(long, CAST(i * step + 1 AS BIGINT)) END)) END AS lines FROM k),
       u AS (SELECT row_number, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_number FROM l)
       SELECT row_number, line_number, line, length(line) AS line_chars FROM u""",
)
def _(t):
    lines = chunk.table_lines(t.documents, ["doc_id"], ["doc_id", "lang", "source", "text"], F.lit("documents"), 1_000)
    return lines.select("row_number", "line_number", "line", "line_chars")


@query(
    "F09_density_column_pruning",
    """SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name ELSE '' END AS p_name, p_type,
              CASE WHEN p_size > 5 THEN p_brand END AS p_brand FROM part""",
)
def _(t):
    messy = t.part.select(
        "p_partkey",
        F.when(F.col("p_size") > 10, F.col("p_name")).otherwise("").alias("p_name"),
        F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size"),
        "p_type",
        F.when(F.col("p_size") > 5, F.col("p_brand")).alias("p_brand"),
        F.lit(None).cast("string").alias("p_note"),
    )
    return messy.select(*chunk.fullest_columns(messy, 4)[0])


SUMMARISED = {"orders": "o_orderkey", "events": "event_id", "nation": "n_nationkey"}
KINDS_SQL = "kinds AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, ordinal, column_name, {SQL_KIND} AS kind FROM ({sql_placed(name, list(TABLE_COLUMNS[name]), key)}) GROUP BY 1, 2, 3"
    for name, key in SUMMARISED.items()
) + ")"


@query(
    "F10_sheet_summary",
    f"""WITH {CATALOG_SQL}, {KINDS_SQL} SELECT table_name, 'Sheet summary: sheet=' || table_name || ' total_rows=' || any_value(row_count)
        || ' selected_columns=' || any_value(column_count) || ' all_columns=' || any_value(column_count) || ' row_group_size=40' || chr(10)
        || 'Columns: ' || string_agg(column_name, ', ' ORDER BY ordinal) || chr(10) || 'Inferred column types: '
        || string_agg(column_name || ':' || kind, ', ' ORDER BY ordinal) AS content
        FROM catalog JOIN kinds USING (table_name) GROUP BY 1""",
)
def _(t):
    kinds = None
    for name, key in SUMMARISED.items():
        df = getattr(t, name)
        one = normalize.column_kinds(df, key).join(normalize.column_list(df), "column_name").withColumn("table_name", F.lit(name))
        kinds = one if kinds is None else kinds.unionByName(one)
    return chunk.sheet_summary(catalog.describe_tables({name: getattr(t, name) for name in SUMMARISED}), kinds)


ALL_NAMES = sorted({c for columns in TABLE_COLUMNS.values() for c in columns})
TABLE_LINES = " || chr(10) || ".join(
    f"'- sheet={name} rows=' || (SELECT count(*) FROM {name}) || ' cols={len(columns)}'" for name, columns in TABLE_COLUMNS.items()
)


@query(
    "F11_file_summary",
    f"""WITH {CATALOG_SQL} SELECT 'given' AS dataset_id, 'Table file summary: type=parquet sheets={len(TABLE_COLUMNS)} total_rows='
        || CAST(sum(row_count) AS BIGINT) || ' unique_columns={len(ALL_NAMES)}' || chr(10) || {TABLE_LINES} || chr(10)
        || 'Top columns: {", ".join(ALL_NAMES[:12])}' AS content FROM catalog""",
)
def _(t):
    order = {name: i for i, name in enumerate(TABLE_COLUMNS)}
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("table_name"))
    return chunk.file_summary(catalog_of(t).withColumns({"dataset_id": F.lit("given"), "ordinal": rank}), "parquet")


@query(
    "F12_column_summary",
    f"""WITH {KINDS_SQL}, firsts AS (SELECT * FROM nation ORDER BY n_nationkey LIMIT 5),
        long AS (SELECT 'n_nationkey' AS column_name, n_nationkey AS k, CAST(n_nationkey AS VARCHAR) AS v FROM firsts
          UNION ALL SELECT 'n_name', n_nationkey, n_name FROM firsts
          UNION ALL SELECT 'n_regionkey', n_nationkey, CAST(n_regionkey AS VARCHAR) FROM firsts),
        ex AS (SELECT column_name, string_agg(v, ', ' ORDER BY k) AS shown FROM (SELECT column_name, v, min(k) AS k,
          row_number() OVER (PARTITION BY column_name ORDER BY min(k)) AS r FROM long GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1)
        SELECT column_name, 'Column summary: sheet=nation column=' || column_name || ' inferred_type=' || kind || chr(10)
          || 'Examples: ' || shown AS content FROM kinds JOIN ex USING (column_name) WHERE table_name = 'nation'""",
)
def _(t):
    return chunk.column_summary(t.nation, "n_nationkey", "nation")


@query(
    "F13_doc_cap",
    f"""WITH g AS (SELECT l_suppkey AS file_id, l_orderkey // 10 AS o FROM lineitem GROUP BY 1, 2),
        r AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY o) - 1 AS row_group_index,
                count(*) OVER (PARTITION BY file_id) AS n FROM g),
        picks AS (SELECT DISTINCT file_id, n, CAST(round_even((n - 1) / 317 * i, 0) AS BIGINT) AS row_group_index
                  FROM (SELECT DISTINCT file_id, n FROM r WHERE n + 2 > 320), range(318) AS s(i)),
        kept AS (SELECT file_id, n, 'row_group' AS chunk_type, row_group_index FROM r WHERE n + 2 <= 320
          UNION ALL SELECT file_id, n, 'row_group', row_group_index FROM picks
          UNION ALL SELECT DISTINCT file_id, n, unnest(['file_summary', 'sheet_summary']), NULL FROM r)
        SELECT file_id, chunk_type, row_group_index, n + 2 - count(*) OVER (PARTITION BY file_id) AS left_out FROM kept""",
)
def _(t):
    groups = t.lineitem.select(F.col("l_suppkey").alias("file_id"), F.floor(F.col("l_orderkey") / 10).alias("o")).distinct()
    placed = with_position(groups, ["file_id"], ["o"], "at").select(
        "file_id", F.lit("row_group").alias("chunk_type"), F.col("at").alias("chunk_order"), (F.col("at") - 1).alias("row_group_index")
    )
    summaries = groups.select("file_id").distinct().select(
        "file_id", F.posexplode(F.array(F.lit("file_summary"), F.lit("sheet_summary"))).alias("chunk_order", "chunk_type")
    ).withColumn("row_group_index", F.lit(None).cast("long"))
    return chunk.cap_chunks(placed.unionByName(summaries)).select("file_id", "chunk_type", "row_group_index", "left_out")


@query(
    "F14_document_summary",
    """SELECT source, string_agg(substr(trim(text), 1, 420), chr(10) || chr(10) ORDER BY doc_id) AS content FROM (
         SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 4 GROUP BY 1""",
)
def _(t):
    return chunk.document_summary(t.documents, "source", "doc_id", "text")


@query(
    "F15_chunk_identity",
    f"""WITH {CHUNKS_SQL} SELECT file_id || '_' || chunk_index AS chunk_id, file_id, chunk_index, source AS owner_id, 'v1' AS pipeline_version,
        'local' AS embedding_mode, 'mini' AS embedding_model, trim(content) AS content FROM chunks""",
)
def _(t):
    return chunk.chunk_identity(chunks_of(t), F.col("source"), "v1", "local", "mini")


@query(
    "F16_extraction_stats",
    """SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars,
         CAST(sum(length(regexp_replace(text, '\\s+', '', 'g'))) AS BIGINT) AS non_whitespace_chars,
         count(*) FILTER (WHERE length(trim(text)) > 0) AS non_empty_docs, 'ok' AS verdict FROM documents GROUP BY 1""",
)
def _(t):
    return chunk.extraction_stats(t.documents, "source", "text")


@query(
    "F17_near_empty_extraction",
    """WITH p AS (SELECT doc_id AS file, length(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', '', 'g')) AS size FROM documents)
       SELECT file, count(*) FILTER (WHERE size > 0) AS pages, max(size) < 24 AND sum(size) < greatest(24, count(*) FILTER (WHERE size > 0) * 16)
         AS near_empty FROM p GROUP BY 1""",
)
def _(t):
    pages = t.documents.select(F.col("doc_id").alias("file"), F.explode(F.split("text", "\n", -1)).alias("text"))
    return chunk.near_empty(pages, "file", "text")


@query(
    "F18_sheet_row_stats",
    """SELECT l_suppkey AS file_id, count(DISTINCT l_returnflag) AS sheets_count, CAST(max(l_orderkey) AS BIGINT) AS rows_estimate
       FROM lineitem GROUP BY 1""",
)
def _(t):
    groups = t.lineitem.select(
        F.col("l_suppkey").alias("file_id"), F.col("l_returnflag").alias("sheet_name"), F.col("l_orderkey").alias("row_end")
    )
    return chunk.sheet_row_stats(groups, "file_id")


@query(
    "F19_mean_pool",
    """SELECT label, i AS position, round(avg(CAST(embedding[i] AS DOUBLE)), 5) AS mean FROM embeddings, range(1, 65) AS s(i) GROUP BY 1, 2""",
)
def _(t):
    pooled = vectors.mean_pool(t.embeddings, ["label"], "embedding", 5)
    return pooled.select("label", F.posexplode("vector").alias("p", "mean")).select(
        "label", (F.col("p") + 1).cast("long").alias("position"), "mean"
    )


@query(
    "F20_dimension_check",
    """SELECT count(*) AS vectors, count(*) FILTER (WHERE label = 3) AS wrong_dimension, min(vec_id) FILTER (WHERE label = 3) AS first_wrong
       FROM embeddings""",
)
def _(t):
    cut = F.when(F.col("label") == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return vectors.dimension_check(t.embeddings.withColumn("embedding", cut), "vec_id", "embedding", 64)


@query(
    "F21_vector_partitioning",
    """SELECT 'documents_' || len(embedding) || 'd' || CASE WHEN label = 0 THEN '' ELSE '_local_m' || label || '_'
         || substr(sha1('local:m' || label), 1, 10) END AS collection, count(*) AS vectors FROM embeddings GROUP BY 1""",
)
def _(t):
    blank = F.col("label") == 0
    name = vectors.collection_name(
        "documents",
        F.size("embedding"),
        F.when(blank, "").otherwise("local"),
        F.when(blank, "").otherwise(F.concat(F.lit("m"), F.col("label"))),
    )
    return t.embeddings.groupBy(name.alias("collection")).agg(F.count("*").alias("vectors"))


def vector_store(t: Tables) -> stores.Store:
    """The embeddings as stored collections: one per label, as if each came from a model of its own."""
    rows = t.embeddings.select(
        "vec_id", "embedding", F.size("embedding").alias("dim"), F.lit("local").alias("embedding_mode"),
        F.concat(F.lit("m"), "label").alias("embedding_model"), F.lit(1).alias("version"),
    )
    return stores.create(rows, shared_folder(t.spark, "vectors"), "vec_id", ("version",), stores.VECTOR_PARTS, 4)


@query(
    "F21_collection_search",
    """SELECT item_id, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, vec_id) AS rank FROM (
         SELECT b.item_id, e.vec_id, round(pow(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 2), 6) AS distance
         FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id JOIN embeddings e ON e.label = 1)) WHERE rank <= 5""",
)
def _(t):
    points = t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("point"))
    asked = t.benchmark.select("item_id", F.lit("local").alias("embedding_mode"), F.lit("m1").alias("embedding_model")).join(points, "item_id")
    return stores.nearest(vector_store(t), "embedding", asked, "item_id", "point", 5)


@query(
    "F22_upsert_stored",
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) AS event_id,
         (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'view') AS before FROM events GROUP BY 1""",
)
def _(t):
    rows = t.events.select("user_id", "event_type", "ts", "event_id")
    store = stores.create(rows.filter("event_type = 'view'"), shared_folder(t.spark, "users"), "user_id", ("ts", "event_id"))
    before = store.rows().count()
    stores.upsert(store, rows.filter("event_type <> 'view'"))
    stores.upsert(store, rows.filter("event_type = 'error'"))  # old news changes nothing
    return store.rows().select("user_id", "event_type", "event_id", F.lit(before).alias("before"))


@query(
    "F23_delete_stored",
    f"""WITH {CHUNKS_SQL} SELECT lang, count(*) AS kept, (SELECT count(*) FROM chunks WHERE lang = 'de') AS deleted FROM chunks
        WHERE lang <> 'de' GROUP BY 1""",
)
def _(t):
    chunks = chunks_of(t).select(F.concat_ws("_", "file_id", "chunk_index").alias("chunk_id"), "lang", "content", F.lit(1).alias("version"))
    store = stores.create(chunks, shared_folder(t.spark, "chunks"), "chunk_id", ("version",))
    deleted = stores.delete_where(store, F.col("lang") == "de")
    return store.rows().groupBy("lang").agg(F.count("*").alias("kept"), F.lit(deleted).cast("long").alias("deleted"))


@query(
    "F22_upsert_by_id",
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1""",
)
def _(t):
    rows = t.events.select("user_id", "event_type", "ts", "event_id")
    old, new = rows.filter("event_type = 'view'"), rows.filter("event_type <> 'view'")
    return vectors.upsert(old, new, "user_id", ["ts", "event_id"]).drop("ts")


@query(
    "F23_delete_by_metadata",
    f"""WITH {CHUNKS_SQL} SELECT count(*) FILTER (WHERE lang = 'de') AS deleted, count(*) FILTER (WHERE lang <> 'de') AS kept FROM chunks""",
)
def _(t):
    return vectors.delete_where(chunks_of(t), F.col("lang") == "de")[1]


@query(
    "F24_batching",
    f"""WITH {CHUNKS_SQL}, b AS (SELECT source, file_id, chunk_index,
          (row_number() OVER (PARTITION BY source ORDER BY file_id, chunk_index) - 1) // 32 AS batch FROM chunks)
        SELECT source, file_id, chunk_index, batch FROM b WHERE batch >= 2""",
)
def _(t):
    return chunk.batches(chunks_of(t), "source", ["file_id", "chunk_index"], 2).select("source", "file_id", "chunk_index", "batch")


@query(
    "A12_artifact_manifest",
    f"""WITH {CHUNKS_SQL} SELECT file_id, count(*) AS total_artifacts, count(*) FILTER (WHERE chunk_index = 0) AS document_summary_count,
        count(*) FILTER (WHERE chunk_index > 0) AS chunk_count, CAST(sum(length(trim(content))) AS BIGINT) AS extracted_chars
        FROM chunks GROUP BY 1""",
)
def _(t):
    kind = F.when(F.col("chunk_index") == 0, "document_summary").otherwise("chunk")
    path = shared_folder(t.spark, "artifacts")
    artifacts.write_manifest(chunks_of(t).withColumn("chunk_type", kind), ["document_summary", "chunk"], path)
    schema = "file_id long, total_artifacts long, document_summary_count long, chunk_count long, extracted_chars long"
    return t.spark.read.schema(schema).json(f"{path}/manifest")
