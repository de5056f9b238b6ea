"""Whole-table profiles: counts, distinct values, summaries, correlations, histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from granary.functions import cells
from granary.operators import catalog, normalize
from granary.operators.ordering import with_running_sum
from granary.session import settle, spread

# Profile limits.
CATEGORY_MAX_DISTINCT = 60
CATEGORY_TOP = 8
MIN_NUMBERS = 3
RELATION_TOP = 8
CODEGEN_CATEGORY_DISTINCT = 80
HISTOGRAM_BINS = 20


def _unpivot(row: DataFrame, columns: Sequence[str], facts: dict[str, str], shared: Sequence[str] = ()) -> DataFrame:
    """One aggregate row with columns '{column}__{fact}' turned into one row per column."""
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(c).alias("column_name"),
            *[F.col(f"`{c}__{fact}`").cast(kind).alias(fact) for fact, kind in facts.items()],
            *[F.col(name).alias(name) for name in shared],
        )
        for i, c in enumerate(columns, start=1)
    ]
    return row.select(F.inline(F.array(*entries)))


def non_empty_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Filled cells per column, all in one pass."""
    columns = list(columns or df.columns)
    row = df.agg(*[F.count_if(cells.non_empty(df, c)).alias(f"{c}__non_empty_count") for c in columns])
    return _unpivot(row, columns, {"non_empty_count": "long"}).drop("ordinal")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per (column, value), pre-aggregated before the shuffle; the base of distinct and top values."""
    columns = list(columns or df.columns)
    return normalize.long_cells(spread(df.select(*columns)), columns).groupBy("ordinal", "column_name", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    columns = list(columns or df.columns)
    if approximate:
        row = df.agg(
            *[
                F.approx_count_distinct(F.when(cells.non_empty(df, c), cells.cell_text(df, c))).alias(
                    f"{c}__distinct_count"
                )
                for c in columns
            ]
        )
        return _unpivot(row, columns, {"distinct_count": "long"}).drop("ordinal")
    counted = value_counts(df, columns).groupBy("column_name").agg(F.count("*").alias("distinct_count"))
    return _with_missing(df, columns, counted, "distinct_count")


def _with_missing(df: DataFrame, columns: Sequence[str], counted: DataFrame, name: str) -> DataFrame:
    names = normalize.column_list(df, columns).select("column_name")
    return names.join(F.broadcast(counted), "column_name", "left").select(
        "column_name", F.coalesce(name, F.lit(0)).alias(name)
    )


def top_values(counts: DataFrame, k: int = 3) -> DataFrame:
    order = [F.col("n").desc(), F.col("value").asc()]
    window = Window.partitionBy("column_name").orderBy(*order)
    ranked = counts.withColumn("value_rank", F.row_number().over(window)).filter(F.col("value_rank") <= k)
    return ranked.select("column_name", "value_rank", "value", F.col("n").alias("count"))


def table_profile(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, filled, distinct, the three most frequent values; one counted pass for all."""
    columns = list(columns or df.columns)
    counts = value_counts(df, columns)
    facts = counts.groupBy("column_name").agg(
        F.sum("n").alias("non_empty_count"), F.count("*").alias("distinct_count")
    )
    tops = _listed(top_values(counts, 3), "value_rank", F.concat("value", F.lit(" ("), F.col("count"), F.lit(")")), "top_values")
    total = df.agg(F.count("*").alias("row_count"))
    sample = _listed(
        normalize.first_values(df, columns, key, 3), "position", F.col("value"), "sample_values"
    )
    zero, blank = F.lit(0), F.lit("")
    return (
        normalize.column_list(df, columns)
        .crossJoin(F.broadcast(total))  # one row
        .join(F.broadcast(facts), "column_name", "left")
        .join(F.broadcast(tops), "column_name", "left")
        .join(F.broadcast(sample), "column_name", "left")
        .select(
            "column_name",
            "row_count",
            F.coalesce("non_empty_count", zero).alias("non_empty_count"),
            F.coalesce("distinct_count", zero).alias("distinct_count"),
            F.coalesce("top_values", blank).alias("top_values"),
            F.coalesce("sample_values", blank).alias("sample_values"),
        )
    )


def _listed(df: DataFrame, order: str, text: Column, name: str) -> DataFrame:
    """A few ordered texts per column as one line; the input is already cut per column."""
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return df.groupBy("column_name").agg(F.concat_ws(" | ", F.transform(items, lambda s: s["t"])).alias(name))


def column_profile(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """dtype, purpose, non-null, null and unique counts and three samples of each column."""
    columns = list(columns or df.columns)
    total = df.agg(F.count("*").alias("row_count"))
    facts = value_counts(df, columns).groupBy("column_name").agg(
        F.sum("n").alias("filled"), F.count("*").alias("distinct")
    )
    sample = _listed(normalize.first_values(df, columns, key, 3), "position", F.col("value"), "sample_values")
    zero = F.lit(0)
    return (
        normalize.column_list(df, columns)
        .crossJoin(F.broadcast(total))  # one row
        .join(F.broadcast(facts), "column_name", "left")
        .join(F.broadcast(sample), "column_name", "left")
        .select(
            "column_name",
            F.col("type_name").alias("dtype"),
            catalog.column_purpose(F.col("column_name")).alias("purpose_hint"),
            F.coalesce("filled", zero).alias("non_null"),
            (F.col("row_count") - F.coalesce("filled", zero)).alias("null_count"),
            F.coalesce("distinct", zero).alias("unique_count"),
            F.coalesce("sample_values", F.lit("")).alias("sample_values"),
        )
    )


def numeric_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Readable numbers as (column_name, number) rows."""
    entries = [
        F.struct(F.lit(c).alias("column_name"), cells.tolerant_number(df, c).alias("number")) for c in columns
    ]
    return spread(df.select(*columns)).select(F.inline(F.array(*entries))).filter(F.col("number").isNotNull())


def percentiles(df: DataFrame, group: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """Exact interpolated percentile per group without gathering a group in one task."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    return percentiles_of_counts(settle(counts), group, value, share, name)


def percentiles_of_counts(counts: DataFrame, group: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """Percentiles of settled (group, value, _n) rows.

    The counts get running sums over range pieces, and only the two rows that cover the wanted ranks
    are kept.
    """
    running = with_running_sum(counts, group, [value], "_n", "_upto")
    totals = counts.groupBy(*group).agg(F.sum("_n").alias("_total"))
    if group:
        ranked = running.join(totals, list(group))
    else:
        ranked = running.crossJoin(F.broadcast(totals))  # one row
    place = (F.col("_total") - 1) * F.lit(share)
    low, high = F.floor(place) + 1, F.ceil(place) + 1
    covers = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
    picked = ranked.filter(covers(low) | covers(high))
    lower = F.max(F.when(covers(low), F.col(value)))
    upper = F.max(F.when(covers(high), F.col(value)))
    weight = F.max(place - F.floor(place))
    return picked.groupBy(*group).agg((lower + (upper - lower) * weight).alias(name))


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, scale: int | None = None) -> DataFrame:
    """count, min, max, mean and median of columns with at least max(3, 10 %) numbers.

    Everything comes from the counts per value, so the table is read and pre-aggregated once.
    """
    columns = list(columns or df.columns)
    columns = [c for c in columns if cells.is_text(df, c) or isinstance(cells.data_type(df, c), T.NumericType)]
    counts = settle(numeric_cells(df, columns).groupBy("column_name", "number").agg(F.count("*").alias("_n")))
    number = F.col("number") if scale is None else cells.cents(F.col("number"), scale)
    total = F.sum(number * F.col("_n")).cast("double")
    facts = counts.groupBy("column_name").agg(
        F.sum("_n").alias("count"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        F.round(total / F.sum("_n"), 6).alias("mean"),
    )
    medians = percentiles_of_counts(counts, ["column_name"], "number", 0.5, "median")
    rows = df.agg(F.greatest(F.lit(3), F.floor(F.count("*") * 0.1)).alias("_enough"))
    return (
        facts.crossJoin(F.broadcast(rows))  # one row
        .filter(F.col("count") >= F.col("_enough"))
        .join(F.broadcast(medians), "column_name")
        .select("column_name", "count", "min", "max", "mean", "median")
    )


def datetime_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    columns = [c for c in columns if cells.is_text(df, c) or isinstance(cells.data_type(df, c), T.DatetimeType)]
    aggregates = []
    for c in columns:
        time = cells.tolerant_timestamp(df, c)
        text = lambda e: F.date_format(e, "yyyy-MM-dd HH:mm:ss")
        aggregates += [
            F.count(time).alias(f"{c}__count"),
            text(F.min(time)).alias(f"{c}__min"),
            text(F.max(time)).alias(f"{c}__max"),
        ]
    row = df.agg(*aggregates, F.count("*").alias("row_count"))
    enough = F.greatest(F.lit(3), F.floor(F.col("row_count") * 0.1))
    kinds = {"count": "long", "min": "string", "max": "string"}
    summary = _unpivot(row, columns, kinds, ["row_count"])
    return summary.filter(F.col("count") >= enough).select("column_name", "count", "min", "max")


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Top eight values of columns with 2 to 60 distinct ones."""
    columns = list(columns or df.columns)
    counts = value_counts(df, columns)
    wanted = (
        counts.groupBy("column_name")
        .agg(F.count("*").alias("_distinct"))
        .filter((F.col("_distinct") > 1) & (F.col("_distinct") <= CATEGORY_MAX_DISTINCT))
        .select("column_name")
    )
    return top_values(counts.join(F.broadcast(wanted), "column_name", "left_semi"), CATEGORY_TOP)


def _correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson of every pair over rows where both are numbers, in one aggregate.

    Columns with fewer than ``MIN_NUMBERS`` numbers, and so pairs with fewer rows, have no correlation.
    """
    number = {c: cells.tolerant_number(df, c) for c in columns}
    pairs = list(combinations(columns, 2))
    # A column without spread has no correlation; dividing by its zero deviation gives NaN.
    none = F.lit(None).cast("double")
    enough = lambda a, b: F.count_if(number[a].isNotNull() & number[b].isNotNull()) >= MIN_NUMBERS
    row = df.agg(
        *[F.when(enough(a, b), F.nanvl(F.corr(number[a], number[b]), none)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    )
    entries = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*entries))).filter(F.col("correlation").isNotNull())


def relation_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    columns = list(columns or df.columns)
    return [c for c in columns if cells.is_text(df, c) or isinstance(cells.data_type(df, c), T.NumericType)]


def pairwise_correlation(df: DataFrame, columns: Sequence[str] | None = None, top: int = RELATION_TOP) -> DataFrame:
    pairs = _correlations(df, relation_columns(df, columns))
    order = [F.abs("correlation").desc(), F.col("feature_a").desc(), F.col("feature_b").desc()]
    return pairs.orderBy(*order).limit(top).withColumn("correlation", F.round("correlation", 4))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Both triangles and the diagonal, as rows."""
    columns = relation_columns(df, columns)
    upper = _correlations(df, columns)
    mirror = upper.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "correlation")
    names = normalize.column_list(df, columns)
    diagonal = names.select(
        F.col("column_name").alias("feature_a"), F.col("column_name").alias("feature_b"), F.lit(1.0).alias("correlation")
    )
    both = upper.unionByName(mirror).unionByName(diagonal)
    return both.withColumn("correlation", F.round("correlation", 4))


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between the smallest and the largest value; the last bin is closed."""
    numbers = df.select(cells.tolerant_number(df, column).alias("x")).filter(F.col("x").isNotNull())
    ends = numbers.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return (
        numbers.crossJoin(F.broadcast(ends))  # one row
        .groupBy(number.cast("int").alias("bin"))
        .agg(F.count("*").alias("value"))
    )


def scatter_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows where both columns are numbers."""
    pairs = df.select(cells.tolerant_number(df, x).alias("x"), cells.tolerant_number(df, y).alias("y"))
    return pairs.filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def first_categorical_top(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The ten most frequent values of the first column with more than one value."""
    columns = list(columns or df.columns)
    several = [
        (F.max(v) != F.min(v)).alias(c)
        for c, v in ((c, F.when(cells.non_empty(df, c), cells.cell_text(df, c))) for c in columns)
    ]
    verdict = df.agg(*several).first()  # one row
    chosen = next((c for c in columns if verdict[c]), None)
    if chosen is None:
        return value_counts(df, columns[:1]).filter(F.lit(False)).select("column_name", "value", F.col("n").alias("count"))
    counts = value_counts(df, [chosen])
    return counts.orderBy(F.col("n").desc(), F.col("value")).limit(k).select("column_name", "value", F.col("n").alias("count"))


def token_frequency(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """Most frequent words of more than two letters."""
    plain = F.regexp_replace(F.lower(column), r"[^a-zа-я0-9\s]", " ")
    words = spread(df.select(column)).select(F.explode(F.split(plain, r"\s+")).alias("token")).filter(F.length("token") > 2)
    counts = words.groupBy("token").agg(F.count("*").alias("count"))
    return counts.orderBy(F.col("count").desc(), F.col("token")).limit(k)


def entity_metrics(df: DataFrame, entity: str, category: str, time: str, k: int = 10) -> DataFrame:
    """Distinct ids, top categories and the time range, as (metric, name, value) rows."""
    when = cells.tolerant_timestamp(df, time)
    facts = df.agg(
        F.countDistinct(entity).cast("string").alias("unique"),
        F.date_format(F.min(when), "yyyy-MM-dd HH:mm:ss").alias("first"),
        F.date_format(F.max(when), "yyyy-MM-dd HH:mm:ss").alias("last"),
    )
    scalars = facts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.lit(n).alias("name"), F.col(c).alias("value"))
                    for m, n, c in (
                        ("unique", entity, "unique"),
                        ("time_min", time, "first"),
                        ("time_max", time, "last"),
                    )
                ]
            )
        )
    )
    text = cells.cell_text(df, category)
    tops = (
        df.filter(text != "")
        .groupBy(text.alias("name"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), F.col("name"))
        .limit(k)
    )
    return scalars.unionByName(
        tops.select(F.lit("top").alias("metric"), "name", F.col("n").cast("string").alias("value"))
    )


def codegen_profile(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """dtype, non-null count, distinct values, samples and class of each column."""
    columns = list(columns or df.columns)
    seen = value_counts(df, columns).groupBy("column_name").agg(F.count("*").alias("distinct"))
    sample = _listed(normalize.first_values(df, columns, key, 4), "position", F.col("value"), "sample_values")
    dtype, name = F.col("type_name"), F.lower("column_name")
    kind = (
        F.when(dtype.rlike("int|float|double|decimal"), "numeric")
        .when(dtype.rlike("date|time"), "datetime")
        .when(name.rlike("date|time|created|updated"), "datetime")
        .when(F.coalesce("distinct", F.lit(0)) <= CODEGEN_CATEGORY_DISTINCT, "categorical")
        .otherwise("other")
    )
    return (
        normalize.column_list(df, columns)
        .join(F.broadcast(non_empty_counts(df, columns)), "column_name")
        .join(F.broadcast(seen), "column_name", "left")
        .join(F.broadcast(sample), "column_name", "left")
        .select(
            "column_name",
            dtype.alias("dtype"),
            F.col("non_empty_count").alias("non_null"),
            F.coalesce("distinct", F.lit(0)).alias("sample_unique"),
            F.coalesce("sample_values", F.lit("")).alias("sample_values"),
            kind.alias("column_class"),
        )
    )


def full_report(df: DataFrame, key: str, columns: Sequence[str] | None = None, scale: int | None = None) -> DataFrame:
    """All summaries as (section, column_name, metric, value) rows, with the insight counts on top."""
    columns = list(columns or df.columns)
    text = lambda c: F.col(c).cast("string")
    number = lambda c: F.round(c, 4).cast("decimal(28,4)").cast("string")

    def rows(section: str, frame: DataFrame, metrics: dict[str, Column], name: Column = F.col("column_name")) -> DataFrame:
        entries = [F.struct(F.lit(m).alias("metric"), e.alias("value")) for m, e in metrics.items()]
        return frame.select(F.lit(section).alias("section"), name.alias("column_name"), F.inline(F.array(*entries)))

    profile = column_profile(df, key, columns)
    numeric = numeric_summary(df, columns, scale)
    times = datetime_summary(df, columns)
    categories = categorical_summary(df, columns)
    pairs = pairwise_correlation(df, columns)
    pair_name = F.concat("feature_a", F.lit(" ~ "), "feature_b")
    parts = [
        rows("profile", profile, {m: text(m) for m in ("dtype", "purpose_hint", "non_null", "null_count", "unique_count")}),
        rows("numeric", numeric, {"count": text("count"), **{m: number(m) for m in ("min", "max", "mean", "median")}}),
        rows("datetime", times, {m: text(m) for m in ("min", "max")}),
        rows("categorical", categories, {"top_value": F.concat("value", F.lit("="), text("count"))}),
        rows("relationship", pairs, {"correlation": number("correlation")}, pair_name),
    ]
    counts = [
        ("rows_total", df.agg(F.count("*").alias("n"))),
        ("numeric_columns", numeric.agg(F.count("*").alias("n"))),
        ("categorical_summaries", categories.agg(F.countDistinct("column_name").alias("n"))),
        ("relationship_pairs", pairs.agg(F.count("*").alias("n"))),
    ]
    parts += [rows("insight", frame, {metric: text("n")}, F.lit("")) for metric, frame in counts]
    return reduce(DataFrame.unionByName, parts)
