"""Positions and running sums over large ordered groups.

A window over a hot group runs in one task.  These helpers cut the ordered rows into range
partitions, which also cuts a hot group, work inside each piece, and carry a small summary per piece
over to the next ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.session import settle

PIECE = "_piece"


def in_pieces(df: DataFrame, group: Sequence[str], order: Sequence[str], descending: Sequence[str] = ()) -> DataFrame:
    """Rows range-partitioned by group and order, with the piece number as a settled column."""
    keys = [*group, *order]
    sort = [F.col(k).desc_nulls_last() if k in descending else F.col(k).asc_nulls_last() for k in keys]
    ranged = df.repartitionByRange(*sort).withColumn(PIECE, F.spark_partition_id())
    return settle(ranged)


def order_columns(order: Sequence[str], descending: Sequence[str] = ()) -> list[Column]:
    return [F.col(k).desc_nulls_last() if k in descending else F.col(k).asc_nulls_last() for k in order]


def carried(pieces: DataFrame, group: Sequence[str], summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """One row per (group, piece) with what the earlier pieces of the group hand over.

    ``summary`` aggregates one piece; ``carry`` folds the earlier summaries (window expressions).
    The summary has at most as many rows per group as there are range partitions.
    """
    small = pieces.groupBy(*group, PIECE).agg(*[e.alias(n) for n, e in summary.items()])
    before = Window.partitionBy(*group).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    return small.select(*group, PIECE, *[e.over(before).alias(n) for n, e in carry.items()])


def attach(pieces: DataFrame, carry: DataFrame, group: Sequence[str]) -> DataFrame:
    """Join the carry back; null group values match each other."""
    names = [*group, PIECE]
    right = carry.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in carry.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names]
    return pieces.join(right, same).drop(*[f"_r_{c}" for c in names])


def with_position(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    descending: Sequence[str] = (),
) -> DataFrame:
    """1-based position of each row inside its group; exact, and no group goes to one task."""
    pieces = in_pieces(df, group, order, descending)
    local = Window.partitionBy(*group, PIECE).orderBy(*order_columns(order, descending))
    carry = carried(pieces, group, {"_n": F.count("*")}, {"_before": F.sum("_n")})
    numbered = pieces.withColumn("_local", F.row_number().over(local))
    return (
        attach(numbered, carry, group)
        .withColumn(name, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long"))
        .drop("_local", "_before", PIECE)
    )


def with_running_sum(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    descending: Sequence[str] = (),
) -> DataFrame:
    """Sum of ``value`` up to and including the row, in order, per group."""
    pieces = in_pieces(df, group, order, descending)
    local = (
        Window.partitionBy(*group, PIECE)
        .orderBy(*order_columns(order, descending))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    carry = carried(pieces, group, {"_n": F.sum(value)}, {"_before": F.sum("_n")})
    summed = pieces.withColumn("_local", F.sum(value).over(local))
    return (
        attach(summed, carry, group)
        .withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0)))
        .drop("_local", "_before", PIECE)
    )


SALTS = 32


def salted_join(large: DataFrame, small: DataFrame, keys: Sequence[str], deal_by: str, salts: int = SALTS) -> DataFrame:
    """Inner join whose hot keys are dealt over ``salts`` tasks; the small side is repeated that often."""
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(deal_by), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*keys, "_salt"]).drop("_salt")


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """First k rows of each group; Spark cuts every map task to k rows per group before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k).drop("_rank")
