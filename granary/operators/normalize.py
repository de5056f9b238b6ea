"""Header and cell normalisation, column kinds and column metadata."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from granary.functions import cells
from granary.session import settle

# What a column's description shows.
MAX_ALIASES = 6
ALIAS_CHARS = 96
MAX_SAMPLES = 5
SAMPLE_CHARS = 80

# Kind of a column and the dtype written to the catalog.
KIND_DTYPES = {
    "integer": "integer",
    "number": "numeric",
    "boolean": "boolean",
    "datetime_like": "datetime",
    "text": "text",
    "empty": "empty",
}


def identifier(name: str | None, fallback: str) -> str:
    """A lower-case name of letters, digits and underscores that does not start with a digit."""
    folded = re.sub("[^a-z0-9_]+", "_", (name or "").strip().lower()).strip("_") or fallback
    return f"t_{folded}" if folded[0].isdigit() else folded


def normal_headers(names: Sequence[str | None]) -> tuple[list[str], dict[str, str]]:
    """Unique column names for raw headers, and the raw header of each."""
    used: Counter[str] = Counter()
    out: list[str] = []
    aliases: dict[str, str] = {}
    for number, raw in enumerate(names, start=1):
        original = (raw or "").strip() or f"col_{number}"
        base = identifier(original, f"col_{number}")
        used[base] += 1
        unique = base if used[base] == 1 else f"{base}_{used[base]}"
        out.append(unique)
        aliases[unique] = original
    return out, aliases


def normalize_headers(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    names, aliases = normal_headers(df.columns)
    return df.toDF(*names), aliases


def normalize_cells(df: DataFrame) -> DataFrame:
    """Every cell as trimmed text, '' for null."""
    return df.select(*[cells.cell_text(df, c).alias(c) for c in df.columns])


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop rows whose cells are all empty, then columns whose cells are all empty (one small action)."""
    filled = {c: cells.non_empty(df, c) for c in df.columns}
    rows = df.filter(cells.any_of(list(filled.values())))
    counts = rows.agg(*[F.max(filled[c]).alias(c) for c in df.columns]).first()
    keep = [c for c in df.columns if counts[c]]
    return rows.select(*keep) if keep else rows


def column_list(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: ordinal, column_name, type_name (schema only, no scan)."""
    types = dict(df.dtypes)
    entries = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), F.lit(types[c]).alias("type_name"))
        for i, c in enumerate(columns or df.columns, start=1)
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*entries)))


def long_cells(df: DataFrame, columns: Sequence[str], key: str | None = None) -> DataFrame:
    """Non-empty cells as (ordinal, column_name, value) rows, with the row's key as ``_key`` if one is named."""
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(c).alias("column_name"),
            F.when(cells.non_empty(df, c), cells.cell_text(df, c)).alias("value"),
        )
        for i, c in enumerate(columns, start=1)
    ]
    keys = [] if key is None else [F.col(key).alias("_key")]
    return df.select(*keys, F.inline(F.array(*entries))).filter(F.col("value").isNotNull())


#: Rows at the head of a table in which the first values of most columns are found.
HEAD_ROWS = 200


def first_values(df: DataFrame, columns: Sequence[str], key: str, n: int) -> DataFrame:
    """The first n non-empty values of each column in key order, numbered.

    The rows with the smallest keys hold them but for columns that are mostly empty, and only for those are all rows
    made text and ranked; Spark cuts every map task to n values per column before the shuffle.
    """
    order = F.col(key).asc_nulls_last()
    head = settle(df.orderBy(order).limit(HEAD_ROWS))

    def numbered(rows: DataFrame, wanted: Sequence[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.col("_key").asc_nulls_last()))
        return long_cells(rows, wanted, key).withColumn("position", place).filter(F.col("position") <= n).drop("_key")

    filled = head.agg(F.count("*").alias("_rows"), *[F.count_if(cells.non_empty(df, c)).alias(f"_n{i}") for i, c in enumerate(columns)]).first()
    short = [c for i, c in enumerate(columns) if filled["_rows"] == HEAD_ROWS and filled[f"_n{i}"] < n]
    found = numbered(head, [c for c in columns if c not in short] or columns[:1])
    if not short:
        return found
    rest = numbered(df, short)
    return found.unionByName(rest) if len(short) < len(columns) else rest


def cell_counts(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """``(column_name, value, n, first)``: each value of each column, its rows and the smallest key it stands at.

    One scan, counted before the shuffle; what follows reads only the distinct values.
    """
    return (
        long_cells(df, columns, key)
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("n"), F.min("_key").alias("first"))
    )


def _kind() -> Column:
    """Aggregate: kind of a column from the counts of its values."""
    value, rows = F.col("value"), F.col("n")
    is_bool = F.lower(value).isin(*cells.BOOLEAN_WORDS)
    is_int = ~is_bool & value.rlike(cells.INTEGER_PATTERN)
    is_float = ~is_bool & ~is_int & value.rlike(cells.NUMBER_PATTERN)
    is_time = ~is_bool & ~is_int & ~is_float & value.rlike("[-/:]")
    share = lambda test: F.sum(F.when(test, rows).otherwise(0)) / F.sum(rows)
    return (
        F.when(share(is_bool) >= 0.8, "boolean")
        .when(share(is_int) >= 0.8, "integer")
        .when(share(is_int | is_float) >= 0.8, "number")
        .when(share(is_time) >= 0.6, "datetime_like")
        .otherwise("text")
    )


def column_kinds(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Kind of each column, judged by all its values."""
    columns = list(columns or df.columns)
    kinds = cell_counts(df, columns, key).groupBy("column_name").agg(_kind().alias("kind"))
    return (
        column_list(df, columns)
        .join(F.broadcast(kinds), "column_name", "left")
        .select("column_name", F.coalesce("kind", F.lit("empty")).alias("kind"))
    )


def folded_value(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))


def cardinality(unique: Column, total: Column) -> Column:
    ratio = unique / total
    return (
        F.when(total == 0, "empty")
        .when(unique <= 1, "single")
        .when((unique <= 12) & (ratio <= 0.35), "low")
        .when((unique <= 64) & (ratio <= 0.8), "medium")
        .otherwise("high")
    )


def cardinality_hints(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    folded = cell_counts(df, columns, key).groupBy("column_name", folded_value(F.col("value"))).agg(F.sum("n").alias("n"))
    counts = folded.groupBy("column_name").agg(F.count("*").alias("unique_count"), F.sum("n").alias("value_count"))
    zero = F.lit(0)
    return (
        column_list(df, columns)
        .join(F.broadcast(counts), "column_name", "left")
        .select(
            "column_name",
            F.coalesce("value_count", zero).alias("value_count"),
            F.coalesce("unique_count", zero).alias("unique_count"),
            cardinality(F.coalesce("unique_count", zero), F.coalesce("value_count", zero)).alias("cardinality_hint"),
        )
    )


def canonical_dtype(type_text: Column) -> Column:
    text = folded_value(F.coalesce(type_text, F.lit("")))
    return (
        F.when(text == "", "unknown")
        .when(text.rlike("int"), "integer")
        .when(text.rlike("float|double|decimal|numeric|number"), "numeric")
        .when(text.rlike("date|time"), "datetime")
        .when(text.rlike("bool"), "boolean")
        .when(text.rlike("text|str|object|category|char"), "text")
        .otherwise(text)
    )


def folded_cells(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Non-empty cells as ``(_key, ordinal, value, folded, sample)``: white space as single blanks, in lower case, and its head.

    ``sample`` is the folded head of a value whose folded text is longer than a sample, else null: the folded text itself.

    The text of a cell is a long expression and stands once per column, in an array of its own: compiled into one method
    with the steps that follow it passes the length up to which Java optimises a method.
    """

    def single(text: Column) -> Column:
        # few cells hold more than single blanks, and looking for that is cheaper than the pattern
        spaced = cells.any_of([F.contains(text, F.lit(mark)) for mark in ("  ", *"\t\n\x0b\f\r")])
        return F.when(spaced, F.trim(F.regexp_replace(text, r"\s+", " "))).when(text != "", text)

    texts = df.select(F.col(key).alias("_key"), F.array(*[cells.cell_text(df, c) for c in columns]).alias("_texts"))
    rows = texts.select("_key", F.posexplode(F.transform("_texts", single)).alias("_at", "value")).filter("value IS NOT NULL")
    head = F.lower(F.rtrim(F.substring("value", 1, SAMPLE_CHARS)))
    return rows.select(
        "_key",
        (F.col("_at") + 1).alias("ordinal"),
        "value",
        F.lower("value").alias("folded"),
        F.when(F.length(F.lower("value")) > SAMPLE_CHARS, head).alias("sample"),
    )


#: Shares of a column's samples whose first places bound that of its last sample shown.
SAMPLE_SHARES = 64


def first_samples(df: DataFrame, columns: Sequence[str], key: str, counts: DataFrame) -> DataFrame:
    """``(ordinal, sample_values)``: the first distinct sample values of each column, by the smallest key they stand at.

    ``counts`` has ordinal, folded, sample and first.  Samples of different shares differ, so none of the first
    ``MAX_SAMPLES`` stands after the share that comes that late; what stands after it is left out before samples are made
    distinct.  Their text is read from the rows they stand at.
    """
    found = counts.select("ordinal", F.coalesce("sample", "folded").alias("folded"), "first")
    shares = found.groupBy("ordinal", F.pmod(F.xxhash64("folded"), F.lit(SAMPLE_SHARES))).agg(F.min("first").alias("first"))
    last = shares.groupBy("ordinal").agg(F.get(F.sort_array(F.collect_list("first")), F.lit(MAX_SAMPLES - 1)).alias("last"))
    early = found.join(F.broadcast(last), "ordinal").where("last IS NULL OR first IS NULL OR first <= last")
    distinct = early.groupBy("ordinal", "folded").agg(F.min("first").alias("first"))
    rank = Window.partitionBy("ordinal").orderBy("first", "folded")
    top = settle(distinct.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= MAX_SAMPLES))
    rows = df.join(F.broadcast(top.select(F.col("first").alias(key)).distinct()), key, "left_semi")
    texts = folded_cells(rows, columns, key).select(
        "ordinal",
        F.coalesce("sample", "folded").alias("folded"),
        F.col("_key").alias("first"),
        F.rtrim(F.substring("value", 1, SAMPLE_CHARS)).alias("text"),
    )
    texts = texts.groupBy("ordinal", "folded", "first").agg(F.min("text").alias("text"))
    # a value that stands at null keys only has no first row to show
    shown = top.join(texts, ["ordinal", "folded", "first"], "left")
    listed = shown.groupBy("ordinal").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("_samples"))
    return listed.select("ordinal", F.transform("_samples", lambda s: s["text"]).alias("sample_values"))


def column_metadata(
    df: DataFrame, key: str, columns: Sequence[str] | None = None, aliases: dict[str, str] | None = None
) -> DataFrame:
    """Names, aliases, dtype, cardinality hint and the first distinct sample values of each column.

    Cells are folded before they are counted, so all values are shuffled once.
    """
    columns = list(columns or df.columns)
    raw = {c: (aliases or {}).get(c, c) for c in columns}
    counts = settle(
        folded_cells(df, columns, key)
        .groupBy("ordinal", "folded", "sample")
        .agg(F.count("*").alias("n"), F.min("_key").alias("first"))
    )
    values = counts.select("ordinal", F.col("folded").alias("value"), "n", (F.length("folded") > SAMPLE_CHARS).alias("_long"))
    # only of long values may one folded text have several samples
    longer = values.where("_long").groupBy("ordinal", "value").count().groupBy("ordinal").agg(F.count("*").alias("_longer"))
    profile = (
        values.groupBy("ordinal")
        .agg(F.count_if(~F.col("_long")).alias("_shorter"), F.sum("n").alias("value_count"), _kind().alias("kind"))
        .join(F.broadcast(longer), "ordinal", "left")
        .withColumn("unique_count", F.col("_shorter") + F.coalesce("_longer", F.lit(0)))
    )
    samples = first_samples(df, columns, key, counts)
    names = column_list(df, columns).select("ordinal", "column_name")
    raw_name = F.element_at(F.create_map(*[F.lit(x) for pair in raw.items() for x in pair]), F.col("column_name"))
    display = F.substring(F.trim(F.regexp_replace(raw_name, r"\s+", " ")), 1, ALIAS_CHARS)
    spaced = F.trim(F.replace("column_name", F.lit("_"), F.lit(" ")))
    alias_list = F.when(F.lower(display) == F.lower(spaced), F.array(display)).otherwise(F.array(display, spaced))
    dtype_of = F.create_map(*[F.lit(x) for pair in KIND_DTYPES.items() for x in pair])
    zero = F.lit(0)
    return (
        names.join(F.broadcast(profile), "ordinal", "left")
        .join(F.broadcast(samples), "ordinal", "left")
        .select(
            "ordinal",
            display.alias("raw_name"),
            F.col("column_name").alias("normalized_name"),
            display.alias("display_name"),
            F.slice(alias_list, 1, MAX_ALIASES).alias("aliases"),
            F.element_at(dtype_of, F.coalesce("kind", F.lit("empty"))).alias("dtype"),
            F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
            cardinality(F.coalesce("unique_count", zero), F.coalesce("value_count", zero)).alias("cardinality_hint"),
        )
    )
