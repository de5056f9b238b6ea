"""Sources, sinks and the dataset catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import catalog
from granary.plans.registry import Tables, query
from granary.plans.shapes import TABLE_COLUMNS
from granary.session import shared_folder
from granary.sources import artifacts, commits, files

CATALOG_SQL = "catalog AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count, {len(c)} AS column_count"
    for t, c in TABLE_COLUMNS.items()
) + ")"


def catalog_of(t: Tables):
    return catalog.describe_tables({name: getattr(t, name) for name in TABLE_COLUMNS})


@query(
    "A01_csv_tsv_source",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey,
              CASE WHEN c_custkey % 10 = 2 THEN c_name || chr(10) || 'Клиент' ELSE c_name END AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
              CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS c_acctbal, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment,
              (SELECT count(*) FROM customer WHERE c_custkey % 10 = 1) AS skipped
       FROM customer WHERE c_custkey % 10 <> 1""",
)
def _(t):
    """Rows with a field too few, one too many or a line break in quotes, in windows-1251."""
    path = shared_folder(t.spark, "customer-csv")
    kind = F.col("c_custkey") % 10
    name = F.when(kind == 2, F.concat(F.lit('"'), "c_name", F.lit("\nКлиент"), F.lit('"'))).otherwise(F.col("c_name"))
    fields = [F.col("c_custkey").cast("string"), name, F.col("c_nationkey").cast("string"), F.col("c_acctbal").cast("decimal(18,2)").cast("string")]
    end = F.when(kind == 0, "").when(kind == 1, F.concat(F.lit(";"), "c_mktsegment", F.lit(";more"))).otherwise(F.concat(F.lit(";"), "c_mktsegment"))
    head = t.spark.range(1).select(F.lit("c_custkey;c_name;c_nationkey;c_acctbal;c_mktsegment").alias("value"))
    lines = head.unionByName(t.customer.select(F.concat(F.concat_ws(";", *fields), end).alias("value"))).coalesce(1)
    t.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    lines.select(F.encode("value", "windows-1251").cast("string").alias("value")).write.text(path)
    read = files.open_delimited(t.spark, path)
    return read.table.crossJoin(F.broadcast(read.skipped))  # one row


@query(
    "A02_table_set_source",
    """SELECT 'sheet_1_regions' AS table_name, (SELECT count(*) FROM region) AS row_count, 2 AS column_count
       UNION ALL SELECT 'sheet_3_nations', (SELECT count(*) FROM nation), 3""",
)
def _(t):
    sheets = {}
    blank = t.region.select(F.lit("").alias("a"), F.lit("").alias("b"))
    for name, df in (("Regions", t.region), ("Blank", blank), ("Nations", t.nation)):
        sheets[name] = shared_folder(t.spark, name)
        df.write.option("header", True).option("emptyValue", "").csv(sheets[name])
    return files.read_table_set(t.spark, sheets).catalog.drop("columns")


@query(
    "A03_text_source",
    """SELECT count(*) AS documents, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents""",
)
def _(t):
    path = shared_folder(t.spark, "texts")
    t.documents.select("text").write.option("maxRecordsPerFile", 50).text(path)
    whole = files.read_text(t.spark, path)
    docs = t.documents.agg(F.count("*").alias("documents"))
    return whole.agg(F.sum(F.length("text")).alias("chars")).crossJoin(F.broadcast(docs))  # one row each


GOLDEN_SCHEMA = "id string, query string, expected struct<operation:string, value:double>, max_latency_ms int"


@query(
    "A04_json_source",
    """SELECT 'sum_' || o_orderpriority AS id, 'show sum of o_totalprice for ' || o_orderpriority AS query,
              'sum' AS operation, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value,
              2000 AS max_latency_ms FROM orders GROUP BY o_orderpriority""",
)
def _(t):
    path = shared_folder(t.spark, "golden")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    cases = t.orders.groupBy("o_orderpriority").agg(total.alias("value"))
    cases.select(
        F.concat(F.lit("sum_"), "o_orderpriority").alias("id"),
        F.concat(F.lit("show sum of o_totalprice for "), "o_orderpriority").alias("query"),
        F.struct(F.lit("sum").alias("operation"), "value").alias("expected"),
        F.lit(2000).alias("max_latency_ms"),
    ).write.json(path)
    golden = files.read_json(t.spark, path, GOLDEN_SCHEMA)
    return golden.select("id", "query", "expected.operation", "expected.value", "max_latency_ms")


@query("A05_parquet_table_scan", "SELECT * FROM supplier")
def _(t):
    return files.scan_table(t.spark, f"{t.folder}/supplier.parquet", "granary_supplier")


@query("A06_capped_scan", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 2000")
def _(t):
    return files.capped_scan(t.orders, "o_orderkey", 2_000)


@query("A07_write_dataset_version", "SELECT 2 AS version, * FROM supplier")
def _(t):
    root = shared_folder(t.spark, "datasets")
    for created_at in ("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"):
        version = commits.publish(root, "stock", {"supplier": t.supplier}, created_at)
    stored = commits.open_table(t.spark, root, "stock", "supplier")
    return stored.select(F.lit(version).alias("version"), "*")


@query("A08_next_dataset_version", "SELECT conv_id, coalesce(max(turn), 0) + 1 AS next_version FROM conversations GROUP BY 1")
def _(t):
    return catalog.next_version(t.conversations, "conv_id", "turn")


@query(
    "A09_fingerprint",
    """SELECT doc_id, sha256(text) AS fingerprint, sha256(CAST(doc_id AS VARCHAR) || '|1|' || sha256(text)) AS provenance_id
       FROM documents""",
)
def _(t):
    mark = catalog.fingerprint(F.col("text"))
    return t.documents.select(
        "doc_id", mark.alias("fingerprint"), catalog.provenance_id(F.col("doc_id"), F.lit(1), mark).alias("provenance_id")
    )


@query(
    "A10_dataset_cleanup",
    """SELECT o_custkey AS dataset_id, count(DISTINCT CAST(year(o_orderdate) AS INTEGER)) AS datasets_deleted,
              count(*) AS tables_deleted
       FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1
       UNION ALL SELECT c_custkey, 0, 0 FROM customer
       WHERE c_mktsegment = 'MACHINERY' AND c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def _(t):
    tables = t.orders.select(
        F.col("o_custkey").alias("dataset_id"), F.year("o_orderdate").alias("version"), F.col("o_orderkey").alias("table_name")
    )
    datasets = tables.select("dataset_id", "version").distinct()
    removed = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("dataset_id"))
    return catalog.remove_datasets(datasets, tables, removed)[2]


@query(
    "A10_dataset_cleanup_of_stored_tables",
    """SELECT 'parties' AS dataset_id, 2 AS datasets_deleted, 3 AS tables_deleted, 3 AS paths_deleted, 0 AS rows_left
       UNION ALL SELECT 'unknown', 0, 0, 0, 0
       UNION ALL SELECT 'trade', 0, 0, 0, (SELECT count(*) FROM orders)""",
)
def _(t):
    root = shared_folder(t.spark, "datasets")
    commits.publish(root, "parties", {"customer": t.customer, "supplier": t.supplier}, "2024-01-01T00:00:00Z")
    commits.publish(root, "trade", {"orders": t.orders}, "2024-01-01T00:00:00Z")
    commits.publish(root, "parties", {"customer": t.customer}, "2024-01-02T00:00:00Z")
    counts = commits.cleanup(t.spark, root, ["parties", "unknown"])
    left = commits.versions(t.spark, root).select("dataset_id", F.col("row_count").alias("rows_left"))
    joined = counts.join(left, "dataset_id", "full")
    return joined.select("dataset_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in joined.columns[1:]])


@query(
    "A11_select_table",
    f"WITH {CATALOG_SQL} SELECT table_name, row_count FROM catalog ORDER BY row_count DESC, table_name LIMIT 1",
)
def _(t):
    return catalog.select_table(catalog_of(t))


@query(
    "A11_select_table_named",
    "SELECT 'part' AS table_name, count(*) AS row_count FROM part",
)
def _(t):
    return catalog.select_table(catalog_of(t), "Part")


@query(
    "A13_chart_points_sink",
    """SELECT label, value FROM (SELECT trim(event_type) AS label, CAST(count(*) AS DOUBLE) AS value FROM events
       GROUP BY 1) WHERE label <> '' UNION ALL SELECT trim(user_id::VARCHAR), 0.0 FROM events GROUP BY 1""",
)
def _(t):
    counts = t.events.groupBy("event_type").agg(F.count("*").cast("string").alias("n"))
    bad = t.events.groupBy(F.col("user_id").cast("string").alias("event_type")).agg(F.lit("n/a").alias("n"))
    path = shared_folder(t.spark, "points")
    artifacts.chart_points(counts.unionByName(bad), "event_type", "n").write.parquet(path)
    return t.spark.read.parquet(path)


@query(
    "A14_artifact_retention",
    """SELECT event_id FROM events WHERE event_id NOT IN (
         SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 168 HOUR
         ORDER BY ts DESC, event_id DESC LIMIT 2000)""",
)
def _(t):
    as_of = F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")
    return artifacts.expired(t.events, "event_id", "ts", as_of).select("event_id")
