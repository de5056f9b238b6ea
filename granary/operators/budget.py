"""Budgets on rows scanned, rows returned and bytes returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_SCANNED_ROWS = 1_000_000
MAX_RESULT_ROWS = 200
MAX_RESULT_BYTES = 200_000


class BudgetExceeded(RuntimeError):
    pass


def scan_verdicts(catalog: DataFrame, max_rows: int = MAX_SCANNED_ROWS) -> DataFrame:
    """Per catalog table, whether its row count fits the scan budget."""
    return catalog.select("table_name", "row_count", (F.col("row_count") <= max_rows).alias("within_budget"))


def check_scan(catalog: DataFrame, table: str, max_rows: int = MAX_SCANNED_ROWS) -> None:
    row = catalog.filter(F.col("table_name") == table).select("row_count").first()
    if row is not None and row[0] > max_rows:
        raise BudgetExceeded(f"{table}: {row[0]} rows exceed the scan budget of {max_rows}")


def row_verdict(df: DataFrame, limit: int = MAX_RESULT_ROWS) -> DataFrame:
    """Probe one row past the limit: rows seen and whether the result is too long."""
    seen = df.limit(limit + 1).agg(F.count("*").alias("rows_seen"))
    return seen.withColumn("over_limit", F.col("rows_seen") > limit)


def bounded_rows(df: DataFrame, limit: int = MAX_RESULT_ROWS) -> list:
    """Rows of a small result; more than the limit is an error, never a silent cut."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise BudgetExceeded(f"result has more than {limit} rows")
    return rows


def result_bytes(df: DataFrame) -> DataFrame:
    """Estimated size of a result: two bytes per row, text length plus one per cell, four for null."""
    cell_sizes = [F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit("null"))) + 1 for c in df.columns]
    row_size = sum(cell_sizes, F.lit(2))
    return df.agg(F.coalesce(F.sum(row_size), F.lit(0)).cast("long").alias("result_bytes"))
