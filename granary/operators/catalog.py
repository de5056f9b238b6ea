"""The dataset catalog: tables, columns, versions and what can be said about them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.operators import normalize

# Counters summed over tables.
METADATA_COUNTERS = (
    "columns_total",
    "columns_with_metadata",
    "columns_with_samples",
    "aliases_total",
    "sample_values_total",
    "aliases_trimmed_total",
    "sample_values_trimmed_total",
    "metadata_columns_dropped",
    "metadata_bytes",
    "metadata_budget_bytes",
)
IDENTIFIER_PATTERN = r"(^id$|_id$|(^|_)id_|\buuid\b|\bkey\b)"
TOP_FIELDS = 6


def describe_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One catalog row per table; the count reads only Parquet footers."""
    rows = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(len(df.columns)).alias("column_count"),
            F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def describe_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    rows = [
        normalize.column_list(df).withColumn("table_name", F.lit(name)) for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def next_version(catalog: DataFrame, dataset: str, version: str) -> DataFrame:
    return catalog.groupBy(dataset).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def provenance_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def remove_datasets(datasets: DataFrame, tables: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalog rows left after removing datasets, for both catalogs, and the counts per dataset."""
    kept_datasets = datasets.join(removed, "dataset_id", "left_anti")
    kept_tables = tables.join(removed, "dataset_id", "left_anti")
    versions = datasets.join(removed, "dataset_id", "left_semi").groupBy("dataset_id").agg(
        F.countDistinct("version").alias("datasets_deleted")
    )
    files = tables.join(removed, "dataset_id", "left_semi").groupBy("dataset_id").agg(
        F.count("*").alias("tables_deleted")
    )
    zero = F.lit(0)
    counts = removed.join(versions, "dataset_id", "left").join(files, "dataset_id", "left").select(
        "dataset_id",
        F.coalesce("datasets_deleted", zero).alias("datasets_deleted"),
        F.coalesce("tables_deleted", zero).alias("tables_deleted"),
    )
    return kept_datasets, kept_tables, counts


def select_table(catalog: DataFrame, named: str | None = None) -> DataFrame:
    """The table named in the request, else the one with most rows; one row."""
    wanted = (F.lower("table_name") == named.strip().lower()) if named else F.lit(False)
    order = [wanted.desc(), F.col("row_count").desc(), F.col("table_name").asc()]
    return catalog.select("table_name", "row_count", wanted.alias("_named")).orderBy(
        *[F.col("_named").desc(), *order[1:]]
    ).limit(1).drop("_named")


def metadata_stats(metadata: DataFrame, budget_bytes: int = 48_000) -> DataFrame:
    """Counters per table over column metadata rows that carry a table_name."""
    text_size = (
        F.octet_length("normalized_name")
        + F.octet_length(F.concat_ws("", "aliases"))
        + F.octet_length(F.concat_ws("", "sample_values"))
    )
    return metadata.groupBy("table_name").agg(
        F.count("*").alias("columns_total"),
        F.count("dtype").alias("columns_with_metadata"),
        F.count_if(F.size("sample_values") > 0).alias("columns_with_samples"),
        F.sum(F.size("aliases")).alias("aliases_total"),
        F.sum(F.size("sample_values")).alias("sample_values_total"),
        F.lit(0).cast("long").alias("aliases_trimmed_total"),
        F.lit(0).cast("long").alias("sample_values_trimmed_total"),
        F.lit(0).cast("long").alias("metadata_columns_dropped"),
        F.sum(text_size).alias("metadata_bytes"),
        F.lit(budget_bytes).cast("long").alias("metadata_budget_bytes"),
        (F.sum(text_size) > budget_bytes).alias("metadata_budget_enforced"),
    )


def stats_rollup(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count("*").alias("tables_count"),
        *[F.sum(c).cast("long").alias(c) for c in METADATA_COUNTERS],
        F.bool_or("metadata_budget_enforced").alias("metadata_budget_enforced"),
    )


def dtype_family(dtype: Column) -> Column:
    text = F.trim(F.regexp_replace(F.lower(dtype), "[^a-z0-9]+", " "))
    return (
        F.when(text == "", "unknown")
        .when(text.rlike("date|time"), "datetime")
        .when(text.rlike("int|float|double|decimal|number|numeric"), "numeric")
        .when(text.rlike("char|str|text|object"), "text")
        .when(text.rlike("bool"), "boolean")
        .otherwise("other")
    )


def field_scores(metadata: DataFrame) -> DataFrame:
    """Additive relevance of each column: dtype, cardinality, samples, alias, identifier, position."""
    family, hint, name = F.col("dtype_family"), F.col("cardinality_hint"), F.col("normalized_name")
    plain = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    plain_alias = F.trim(F.regexp_replace(F.lower("display_name"), "[^a-z0-9]+", " "))
    identifier = F.replace(plain, F.lit(" "), F.lit("_")).rlike(IDENTIFIER_PATTERN)
    score = (
        F.when(family.isin("numeric", "datetime"), 4.0).when(family == "text", 1.0).otherwise(0.0)
        + F.when(hint.isin("single", "low", "medium"), 1.5).when(hint == "high", 0.4).otherwise(0.0)
        + F.when(F.size("sample_values") > 0, 0.8).otherwise(0.0)
        + F.when(plain != plain_alias, 0.4).otherwise(0.0)
        - F.when(identifier, 2.5).otherwise(0.0)
        + F.greatest(F.lit(0.0), 0.2 - (F.col("ordinal") - 1) * 0.01)
    )
    return metadata.withColumn("dtype_family", dtype_family(F.col("dtype"))).select(
        "table_name",
        "ordinal",
        F.col("normalized_name").alias("column_name"),
        "dtype_family",
        identifier.alias("identifier_like"),
        F.round(score, 4).alias("score"),
    )


def rank_relevant_fields(metadata: DataFrame, limit: int = TOP_FIELDS) -> DataFrame:
    order = Window.partitionBy("table_name").orderBy(
        F.col("score").desc(), F.col("identifier_like").asc(), F.col("ordinal").asc()
    )
    ranked = field_scores(metadata).withColumn("field_rank", F.row_number().over(order))
    return ranked.filter(F.col("field_rank") <= limit)


def schema_summary(catalog: DataFrame, metadata: DataFrame) -> DataFrame:
    """Per table: rows, columns, what it includes and its top fields; totals of the dataset beside them."""
    ranked = rank_relevant_fields(metadata, 12)
    has = {f: F.max(F.col("dtype_family") == f) for f in ("numeric", "datetime", "text")}
    top = F.sort_array(F.collect_list(F.when(F.col("field_rank") <= TOP_FIELDS, F.struct("field_rank", "column_name"))))
    facts = ranked.groupBy("table_name").agg(
        F.concat_ws(", ", F.transform(top, lambda s: s["column_name"])).alias("top_fields"),
        F.concat_ws(
            ", ",
            F.when(has["numeric"], "numeric measures"),
            F.when(has["datetime"], "date/time dimensions"),
            F.when(has["text"], "categorical/text fields"),
        ).alias("_kinds"),
    )
    totals = catalog.agg(F.count("*").alias("tables_total"), F.sum("row_count").alias("rows_total"))
    limited = "schema metadata is limited; core fields are still available for analysis"
    return (
        catalog.join(facts, "table_name", "left")
        .crossJoin(F.broadcast(totals))  # one row
        .select(
            "table_name",
            "row_count",
            F.col("column_count").cast("long").alias("columns_total"),
            F.when(F.coalesce("_kinds", F.lit("")) == "", limited)
            .otherwise(F.concat(F.lit("includes "), F.col("_kinds")))
            .alias("data_characteristics"),
            F.coalesce("top_fields", F.lit("")).alias("top_fields"),
            "tables_total",
            "rows_total",
        )
    )


def column_purpose(name: Column) -> Column:
    c = F.lower(F.trim(name))
    other = "attribute used for segmentation/analysis"
    return (
        F.when(c.rlike("_id$|^id$|uuid"), "identifier/key column")
        .when(c.rlike("date|time|_at$"), "time/event timestamp")
        .when(c.rlike("comment|text|descr|message"), "free-text/narrative field")
        .when(c.rlike("office|region|city|branch"), "organizational or location dimension")
        .when(c.rlike("status|stage|state"), "process state dimension")
        .when(c.rlike("amount|sum|price|cost|total|revenue"), "financial metric field")
        .when(c.rlike("count|qty|volume"), "volume/count metric field")
        .otherwise(other)
    )


def process_context(columns: Column) -> Column:
    names = F.transform(columns, lambda c: F.lower(F.trim(c)))

    def any_name(*wanted: str) -> Column:
        return F.arrays_overlap(names, F.array(*[F.lit(w) for w in wanted]))

    reviewed = ("application_id", "comment_time", "comment_text", "office")
    is_review = F.size(F.array_except(F.array(*[F.lit(w) for w in reviewed]), names)) == 0
    return (
        F.when(is_review, "Application review / processing workflow with distributed offices and analyst comments.")
        .when(
            any_name("order_id", "invoice_id") & any_name("status", "stage"),
            "Order-to-cash / document processing workflow.",
        )
        .when(
            any_name("ticket_id", "incident_id") & any_name("status", "comment_text"),
            "Support or incident management workflow.",
        )
        .otherwise("Likely an operational process dataset with records, dimensions, and process indicators.")
    )


