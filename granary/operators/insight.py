"""What a bucketed result says: shares, shape, contrast, order of time and trend.

Inputs are (bucket, value) results of a grouped query.  They can have many buckets, so ranks that only
matter at the top are cut first and totals come from plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.operators.ordering import with_position

# Thresholds of the verdicts.
CLEAR_LEAD_POINTS = 12.0
CONTRAST_POINTS = 10.0
CLOSE_POINTS = 3.5
TREND_CHANGE = 8.0
TREND_CORRELATION = 0.65


def _usable(buckets: DataFrame) -> DataFrame:
    return buckets.select(F.trim(F.col("bucket").cast("string")).alias("bucket"), F.col("value").cast("double").alias("value")).filter(
        (F.col("bucket") != "") & (F.col("value") >= 0)
    )


def leading(buckets: DataFrame, k: int) -> DataFrame:
    """The k largest buckets with rank and share of the total."""
    rows = _usable(buckets)
    total = rows.agg(F.sum("value").alias("total"), F.count("*").alias("buckets"))
    top = rows.orderBy(F.col("value").desc(), F.col("bucket")).limit(k)
    rank = Window.orderBy(F.col("value").desc(), F.col("bucket"))  # over at most k rows
    return (
        top.withColumn("rank", F.row_number().over(rank))
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("share", F.when(F.col("total") > 0, F.col("value") / F.col("total")))
    )


def top_bucket(buckets: DataFrame) -> DataFrame:
    """Leader and runner-up with shares in percent; a gap of twelve points is clear."""
    first, second = F.col("rank") == 1, F.col("rank") == 2
    out = leading(buckets, 2).agg(
        F.max(F.when(first, F.col("bucket"))).alias("top_bucket"),
        F.max(F.when(first, F.col("value"))).alias("top_value"),
        F.max(F.when(second, F.col("bucket"))).alias("runner_up"),
        (F.max(F.when(first, F.col("share"))) * 100).alias("_top"),
        (F.max(F.when(second, F.col("share"))) * 100).alias("_second"),
    )
    return out.select(
        "top_bucket",
        "top_value",
        "runner_up",
        F.round("_top", 4).alias("top_share"),
        F.round("_second", 4).alias("runner_up_share"),
        (F.col("_top") - F.col("_second") >= CLEAR_LEAD_POINTS).alias("clear_lead"),
    )


def _shape(buckets: Column, total: Column, top1: Column, top3: Column, spread: Column) -> Column:
    return (
        F.when(buckets == 0, "unknown")
        .when(buckets <= 2, "sparse")
        .when(total <= 0, "unknown")
        .when((buckets >= 6) & (top1 >= 0.45) & (top3 >= 0.75) & (1 - top3 >= 0.12), "long_tail")
        .when((top1 >= 0.65) | (top3 >= 0.85), "concentrated")
        .when((buckets >= 4) & (top1 <= 0.32) & (spread <= 0.06), "flat")
        .when((top1 <= 0.40) & (spread <= 0.10), "balanced")
        .otherwise("mixed")
    )


def distribution_shape(buckets: DataFrame) -> DataFrame:
    rank = F.col("rank")
    facts = leading(buckets, 4).agg(
        F.coalesce(F.max("buckets"), F.lit(0)).alias("buckets"),
        F.coalesce(F.max("total"), F.lit(0.0)).alias("total"),
        F.max(F.when(rank == 1, F.col("share"))).alias("top1"),
        F.sum(F.when(rank <= 3, F.col("share"))).alias("top3"),
        (F.max("share") - F.min("share")).alias("spread"),
    )
    shape = _shape(*[F.col(c) for c in ("buckets", "total", "top1", "top3", "spread")])
    return facts.select(
        "buckets",
        F.round("top1", 6).alias("top1_share"),
        F.round("top3", 6).alias("top3_share"),
        F.round("spread", 6).alias("spread_top4"),
        shape.alias("shape"),
    )


def contrast(buckets: DataFrame) -> DataFrame:
    """Gap between leader and runner-up in points, and what it means for the shape."""
    first, second = F.col("rank") == 1, F.col("rank") == 2
    gap = leading(buckets, 2).agg(
        F.max(F.when(first, F.col("bucket"))).alias("leader"),
        F.max(F.when(second, F.col("bucket"))).alias("runner_up"),
        (F.max(F.when(first, F.col("share"))) - F.max(F.when(second, F.col("share")))).alias("_gap"),
    )
    points = F.col("_gap") * 100
    verdict = (
        F.when(F.col("shape").isin("concentrated", "long_tail") & (points >= CONTRAST_POINTS), "leader_ahead")
        .when(F.col("shape").isin("balanced", "flat") & (F.abs(points) <= CLOSE_POINTS), "close")
        .otherwise("none")
    )
    shape = distribution_shape(buckets).select("shape")
    return gap.crossJoin(F.broadcast(shape)).select(  # one row each
        "leader", "runner_up", F.round(points, 4).alias("gap_points"), "shape", verdict.alias("contrast")
    )


def time_key(bucket: Column) -> Column:
    """Start of a time bucket written as day, month, quarter or year."""
    text = F.trim(bucket)
    quarter_of = lambda q: F.lpad(((q.cast("int") - 1) * 3 + 1).cast("string"), 2, "0")
    year_first = r"^(\d{4})[-/ ]?[Qq]([1-4])$"
    quarter_first = r"^[Qq]([1-4])[-/ ]?(\d{4})$"
    plain = (
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text)
        .when(text.rlike(r"^\d{4}-\d{1,2}$"), F.concat(text, F.lit("-01")))
        .when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01")))
        .when(
            text.rlike(year_first),
            F.concat(
                F.regexp_extract(text, year_first, 1), F.lit("-"), quarter_of(F.regexp_extract(text, year_first, 2).try_cast("int")), F.lit("-01")
            ),
        )
        .when(
            text.rlike(quarter_first),
            F.concat(
                F.regexp_extract(text, quarter_first, 2),
                F.lit("-"),
                quarter_of(F.regexp_extract(text, quarter_first, 1).try_cast("int")),
                F.lit("-01"),
            ),
        )
    )
    return plain.try_cast("timestamp_ntz")


def time_series(rows: DataFrame, order: str = "row_number") -> DataFrame:
    """Verdict on a result as a time series: its keys must all parse and be strictly monotonic."""
    keyed = rows.withColumn("_key", time_key(F.col("bucket")))
    placed = with_position(keyed, [], [order], "_at").select("_at", "_key")
    nxt = placed.select((F.col("_at") - 1).alias("_at"), F.col("_key").alias("_next"))
    facts = placed.join(nxt, "_at", "left").agg(
        F.count("*").alias("buckets"),
        F.count_if(F.col("_key").isNull()).alias("_bad"),
        F.bool_and(F.col("_next").isNull() | (F.col("_next") > F.col("_key"))).alias("_up"),
        F.bool_and(F.col("_next").isNull() | (F.col("_next") < F.col("_key"))).alias("_down"),
    )
    usable = (F.col("buckets") >= 3) & (F.col("_bad") == 0)
    verdict = F.when(usable & F.col("_up"), "ascending").when(usable & F.col("_down"), "descending").otherwise("none")
    return facts.select("buckets", verdict.alias("time_order"))


def trend_direction(buckets: DataFrame) -> DataFrame:
    """Direction of a time series by net change and correlation with the bucket order."""
    rows = _usable(buckets).withColumn("_key", time_key(F.col("bucket")))
    placed = with_position(rows, [], ["_key"], "_at")
    facts = placed.agg(
        F.count("*").alias("buckets"),
        F.corr(F.col("_at").cast("double"), "value").alias("_corr"),
        F.min_by("value", "_at").alias("first_value"),
        F.max_by("value", "_at").alias("last_value"),
        (F.max("value") - F.min("value")).alias("_range"),
    )
    change = (F.col("last_value") - F.col("first_value")) / F.greatest(F.abs("first_value"), F.lit(1e-9)) * 100
    verdict = (
        F.when(F.col("buckets") < 3, "none")
        .when(F.col("_range") <= 0, "flat")
        .when((F.abs(change) < TREND_CHANGE) | (F.abs("_corr") < TREND_CORRELATION), "no clear direction")
        .when(F.col("last_value") > F.col("first_value"), "increasing")
        .otherwise("decreasing")
    )
    return facts.select(
        "buckets", F.round(change, 4).alias("net_change_pct"), F.round("_corr", 4).alias("correlation"), verdict.alias("trend")
    )
