"""Counts, measures, time buckets and the specs that combine them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from granary.functions import cells
from granary.operators import filters


def measure(df: DataFrame, kind: str, column: str | None = None, scale: int | None = None) -> Column:
    """count, sum, avg, min or max of a column that may hold numbers as text, rounded to six places.

    ``scale`` says that the values are exact to that many decimals; sums then use decimals and do not
    depend on the order in which the cluster adds them.
    """
    if kind == "count":
        return F.count("*")
    number = cells.strict_number(df, column)
    if kind in ("min", "max"):
        return F.round(F.min(number) if kind == "min" else F.max(number), 6)
    if scale is None:
        return F.round(F.sum(number) if kind == "sum" else F.avg(number), 6)
    total = F.sum(cells.cents(number, scale)).cast("double")
    return F.round(total if kind == "sum" else total / F.count(number), 6)


def cut(ordered: DataFrame, top: int | None) -> DataFrame:
    """The first ``top`` rows, or all."""
    return ordered if top is None else ordered.limit(top)


def scalar(df: DataFrame, kind: str, column: str | None = None, scale: int | None = None) -> DataFrame:
    rows = df if column is None else df.filter(cells.non_empty(df, column))
    return rows.agg(measure(df, kind, column, scale).alias("value"))


def grouped(
    df: DataFrame,
    by: str,
    kind: str,
    column: str | None = None,
    scale: int | None = None,
    top: int | None = None,
) -> DataFrame:
    """Groups with the largest value first, all of them or the ``top`` first; the key breaks ties."""
    rows = df if column is None else df.filter(cells.non_empty(df, column))
    out = rows.groupBy(F.col(by).alias("group_key")).agg(measure(df, kind, column, scale).alias("value"))
    return cut(out.orderBy(F.col("value").desc_nulls_last(), F.col("group_key").asc_nulls_last()), top)


def time_bucket(time: Column, grain: str) -> Column:
    if grain == "day":
        return F.date_format(time, "yyyy-MM-dd")
    if grain == "week":
        return F.date_format(F.date_trunc("week", time), "yyyy-MM-dd")
    if grain == "month":
        return F.date_format(time, "yyyy-MM")
    if grain == "quarter":
        return F.concat(F.date_format(time, "yyyy"), F.lit("-Q"), F.quarter(time).cast("string"))
    if grain == "year":
        return F.date_format(time, "yyyy")
    raise ValueError(f"unknown grain {grain}")


def with_bucket(df: DataFrame, column: str, grain: str) -> DataFrame:
    time = cells.tolerant_timestamp(df, column)
    return df.filter(time.isNotNull()).withColumn("bucket", time_bucket(time, grain))


def trend(
    df: DataFrame,
    time_column: str,
    grain: str,
    kind: str = "count",
    column: str | None = None,
    scale: int | None = None,
    newest: int | None = None,
) -> DataFrame:
    """A measure per time bucket, oldest first, of all buckets or the ``newest``; rows without a readable time drop out."""
    rows = with_bucket(df, time_column, grain)
    if column is not None:
        rows = rows.filter(cells.non_empty(df, column))
    out = rows.groupBy("bucket").agg(measure(df, kind, column, scale).alias("value"))
    return (out if newest is None else out.orderBy(F.col("bucket").desc()).limit(newest)).orderBy("bucket")


def _largest_first(df: DataFrame, top: int | None) -> DataFrame:
    return cut(df.orderBy(F.col("value").desc(), F.col("bucket").asc()), top)


def month_of_year(df: DataFrame, time_column: str, top: int | None = None) -> DataFrame:
    time = cells.tolerant_timestamp(df, time_column)
    rows = df.filter(time.isNotNull()).select(F.date_format(time, "MM").alias("bucket"))
    return _largest_first(rows.groupBy("bucket").agg(F.count("*").alias("value")), top)


def value_distribution(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    rows = df.filter(cells.non_empty(df, column)).select(F.col(column).cast("string").alias("bucket"))
    return _largest_first(rows.groupBy("bucket").agg(F.count("*").alias("value")), top)


def comparison(
    df: DataFrame, by: str, categories: Sequence[str], kind: str, column: str | None = None, scale: int | None = None
) -> DataFrame:
    """A grouped measure over named categories only."""
    wanted = [c.strip().lower() for c in categories]
    return grouped(df.filter(cells.folded_cell(df, by).isin(wanted)), by, kind, column, scale)


def row_coverage(df: DataFrame, column: str) -> DataFrame:
    """Rows in all, rows that carry the measure, and their ratio, in one pass."""
    effective = F.count_if(cells.non_empty(df, column))
    return df.agg(
        F.count("*").alias("rows_total"),
        effective.alias("effective_rows"),
        F.coalesce(F.round(effective / F.nullif(F.count("*"), F.lit(0)), 6), F.lit(0.0)).alias("row_coverage_ratio"),
    )


def active_entities(df: DataFrame, entity: str, time_column: str, as_of: Column, days: int = 30) -> DataFrame:
    recent = df.filter(F.col(time_column) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    return recent.agg(F.countDistinct(entity).alias("active_entities"))


def conditional_counts(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == v).alias(f"{v}_count") for v in values])


def sum_or_zero(df: DataFrame, by: str, column: str) -> DataFrame:
    return df.groupBy(by).agg(F.coalesce(F.sum(column), F.lit(0)).cast("long").alias("used"))


@dataclass(frozen=True)
class AggregateSpec:
    """One validated request: filters, one measure, and a dimension or a time bucket."""

    aggregation: str = "count"
    measure_field: str | None = None
    dimension: str | None = None
    time_field: str | None = None
    grain: str | None = None
    conditions: tuple[tuple[str, str, Any], ...] = field(default=())
    scale: int | None = None

    def rows(self, df: DataFrame) -> DataFrame:
        out = df.filter(filters.conjunction(df, self.conditions))
        if self.aggregation != "count" and self.measure_field:
            out = out.filter(cells.non_empty(df, self.measure_field))
        return with_bucket(out, self.time_field, self.grain) if self.grain and self.time_field else out

    def run(self, df: DataFrame) -> DataFrame:
        value = measure(df, self.aggregation, self.measure_field, self.scale).alias("value")
        rows = self.rows(df)
        if self.grain and self.time_field:
            return rows.groupBy("bucket").agg(value).orderBy("bucket")
        if self.dimension:
            key = F.col(self.dimension).alias("group_key")
            return rows.groupBy(key).agg(value).orderBy(F.col("group_key").asc_nulls_last())
        return rows.agg(value)

    def count(self, df: DataFrame) -> DataFrame:
        return self.rows(df).agg(F.count("*").alias("value"))
