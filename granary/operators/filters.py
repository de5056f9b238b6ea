"""Row predicates, lookups, paging and nested metadata conditions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from granary.functions import cells

LOOKUP_COLUMNS = 8
LOOKUP_ROWS = 30


def equals_text(df: DataFrame, column: str, value: str) -> Column:
    return cells.folded_cell(df, column) == value.strip().lower()


def contains_text(df: DataFrame, column: str, value: str, literal: bool = True) -> Column:
    """Substring test; with ``literal=False`` the signs % and _ in the value act as wildcards."""
    text, needle = cells.folded_cell(df, column), value.strip().lower()
    return text.contains(needle) if literal else text.like(f"%{needle}%")


def in_range(df: DataFrame, column: str, operator: str, bound: str | float) -> Column:
    """gt, gte, lt, lte on numbers written with a dot or a comma; other text drops out."""
    number, limit = cells.tolerant_number(df, column), F.lit(float(str(bound).replace(",", ".")))
    return {"gt": number > limit, "gte": number >= limit, "lt": number < limit, "lte": number <= limit}[operator]


def condition(df: DataFrame, field: str, operator: str, value: Any) -> Column:
    if operator == "eq":
        return equals_text(df, field, str(value))
    if operator == "contains":
        return contains_text(df, field, str(value), literal=False)
    return in_range(df, field, operator, value)


def conjunction(df: DataFrame, conditions: Sequence[tuple[str, str, Any]]) -> Column:
    return cells.all_of([condition(df, *item) for item in conditions])


def lookup(df: DataFrame, columns: Sequence[str], field: str, value: str) -> DataFrame:
    """Rows whose field contains the value, at most eight columns and thirty rows in order."""
    shown = list(columns)[:LOOKUP_COLUMNS]
    matching = df.filter(contains_text(df, field, value)).select(*shown)
    return matching.orderBy(*[F.col(c).asc_nulls_last() for c in shown]).limit(LOOKUP_ROWS)


def sample_rows(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.col(key).asc_nulls_last()).limit(n)


def page(df: DataFrame, order: Sequence[Column], skip: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def metadata_predicate(where: Mapping[str, Any]) -> Column:
    """Nested ``$and $or $in $nin $gt $gte $lt $lte $ne $eq $contains``; several fields mean AND."""
    parts: list[Column] = []
    for key, value in where.items():
        if key == "$and":
            parts.append(cells.all_of([metadata_predicate(item) for item in value]))
        elif key == "$or":
            parts.append(cells.any_of([metadata_predicate(item) for item in value]))
        elif isinstance(value, Mapping):
            parts.extend(_operator(F.col(key), op, operand) for op, operand in value.items())
        else:
            parts.append(F.col(key) == F.lit(value))
    return cells.all_of(parts)


def _operator(column: Column, op: str, operand: Any) -> Column:
    simple = {
        "$eq": lambda: column == operand,
        "$ne": lambda: column != operand,
        "$gt": lambda: column > operand,
        "$gte": lambda: column >= operand,
        "$lt": lambda: column < operand,
        "$lte": lambda: column <= operand,
        "$in": lambda: column.isin(list(operand)),
        "$nin": lambda: ~column.isin(list(operand)),
        "$contains": lambda: column.contains(operand),
    }
    if op not in simple:
        raise ValueError(f"unknown operator {op}")
    return simple[op]()


# Embedding modes that name the same provider.
MODE_ALIASES = {"ollama": "local", "corporate": "aihub"}


def retrieval_scope(
    file_ids: Sequence[Any] | None = None,
    chat_id: Any | None = None,
    processing_ids: Sequence[Any] | None = None,
    user_id: Any | None = None,
    sheet_names: Sequence[str] | None = None,
    chunk_types: Sequence[str] | None = None,
    namespace: str | None = None,
    embedding_mode: str | None = None,
    embedding_model: str | None = None,
) -> Column:
    """Scope of a retrieval, applied before ranking; explicit files win over the chat."""
    parts: list[Column] = []
    if file_ids:
        parts.append(F.col("file_id").isin(list(file_ids)))
    elif chat_id is not None:
        parts.append(F.col("chat_id") == chat_id)
    for name, values in (("processing_id", processing_ids), ("sheet_name", sheet_names), ("chunk_type", chunk_types)):
        if values:
            parts.append(F.col(name).isin(list(values)))
    if user_id is not None:
        parts.append(F.col("user_id") == user_id)
    if namespace and namespace.strip():
        parts.append(F.col("namespace") == namespace.strip())
    if embedding_mode:
        mode = embedding_mode.strip().lower()
        parts.append(F.col("embedding_mode") == MODE_ALIASES.get(mode, mode))
    if embedding_model:
        parts.append(F.col("embedding_model") == embedding_model.strip().split(":", 1)[-1])
    return cells.all_of(parts)


def result_shape(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename a two- or one-column result to its public names and check that the value is a number."""
    if len(df.columns) != len(names):
        raise ValueError(f"expected {len(names)} columns, got {df.columns}")
    out = df.toDF(*names)
    if not isinstance(out.schema["value"].dataType, T.NumericType):
        raise ValueError(f"value is {out.schema['value'].dataType.simpleString()}, not a number")
    return out
