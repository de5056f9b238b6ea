"""Joins of the report side: inner, bridge, semi, anti, nested children, names and phrases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.functions import cells
from granary.functions.similarity import similarity_ratio
from granary.operators.ordering import salted_join, with_position
from granary.session import spread


def children_per_parent(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str) -> DataFrame:
    """Parents with the number of their children; children are counted before they are joined."""
    counts = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count("*").alias(name))
    return parents.join(counts, parent_key, "inner")


def bridge(left: DataFrame, link: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str]) -> DataFrame:
    """Many-to-many join through a link table."""
    return left.join(link, left[left_on[0]] == link[left_on[1]]).join(right, link[right_on[0]] == right[right_on[1]])


def with_ready_run(files: DataFrame, runs: DataFrame, key: str, ready: Column, own: Column) -> DataFrame:
    """Files that are ready themselves or have a ready run, each once."""
    by_run = runs.filter(ready).select(key)
    return files.filter(own).unionByName(files.filter(~F.coalesce(own, F.lit(False))).join(by_run, key, "left_semi"))


def without_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left_anti")


def child_pages(
    children: DataFrame, key: Sequence[str], order: Sequence[str], fields: Sequence[str], page_size: int
) -> DataFrame:
    """Children as ordered nested lists, in pages of ``page_size``, so that no parent becomes one huge cell."""
    placed = with_position(children, key, order, "_position")
    item = F.struct("_position", *fields)
    pages = placed.groupBy(*key, F.floor((F.col("_position") - 1) / page_size).cast("long").alias("page")).agg(
        F.sort_array(F.collect_list(item)).alias("_items")
    )
    plain = F.transform("_items", lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    return pages.select(*key, "page", plain.alias("items"))


def grouped_ids(parents: DataFrame, children: DataFrame, key: str, value: str, page_size: int) -> DataFrame:
    """Ids of the children per parent, page by page; a parent without children has one empty page."""
    pages = child_pages(children, [key], [value], [value], page_size)
    lists = pages.select(key, "page", F.transform("items", lambda s: s[value]).alias("ids"))
    kind = children.schema[value].dataType
    return parents.select(key).join(lists, key, "left").select(
        key, F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("ids", F.array().cast(f"array<{kind.simpleString()}>")).alias("ids")
    )


def folded_file_name(name: Column) -> Column:
    """Name without folder, quotes and case."""
    text = F.replace(F.regexp_replace(F.trim(name), "^[`'\"]+|[`'\"]+$", ""), F.lit("\\"), F.lit("/"))
    return F.lower(F.trim(F.regexp_replace(F.element_at(F.split(text, "/"), -1), r"\s+", " ")))


def file_aliases(files: DataFrame, key: str, original: str, stored: str, display: str) -> DataFrame:
    """Distinct (file, folded name) rows: original, stored, stored without its prefix, and display name."""
    names = F.array(
        F.col(original), F.col(stored), F.regexp_replace(F.col(stored), r"^[0-9a-fA-F\-]{8,}_", ""), F.col(display)
    )
    folded = F.array_distinct(F.filter(F.transform(names, folded_file_name), lambda n: n.isNotNull() & (n != "")))
    return files.select(F.col(key), F.explode(folded).alias("name"))


def resolve_file_names(requests: DataFrame, requested: str, aliases: DataFrame, key: str) -> DataFrame:
    """Per request, how many files answer to the name, and the file when it is only one.

    The files of a name are counted before the join, so a name shared by many files and many requests
    does not multiply.
    """
    known = aliases.groupBy("name").agg(F.count("*").alias("matches"), F.min(key).alias("_first"))
    wanted = requests.withColumn("name", folded_file_name(F.col(requested)))
    status = F.when(F.col("matches").isNull(), "missing").when(F.col("matches") == 1, "matched").otherwise("ambiguous")
    return wanted.join(known, "name", "left").withColumns(
        {
            "status": status,
            "matched_file": F.when(F.col("matches") == 1, F.col("_first")),
            "matches": F.coalesce("matches", F.lit(0)),
        }
    ).drop("_first")


def word_runs(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space; one pass over shifted copies of the list."""
    if n == 1:
        return words
    shifted = F.arrays_zip(*[F.slice(words, k, F.size(words)) for k in range(1, n + 1)])
    joined = F.transform(shifted, lambda s: F.concat_ws(" ", *[s[str(k)] for k in range(n)]))
    return F.slice(joined, 1, F.greatest(F.size(words) - n + 1, F.lit(0)))


def phrase_mentions(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """(text, term) pairs where the term occurs as whole words.

    A phrase of n words can only match a run of n words, so this is an equi-join on such runs and not
    a comparison of every text with every term.
    """
    known = terms.select(F.col(term), cells.folded_words(F.col(term)).alias("_phrase")).filter("_phrase <> ''").distinct()
    lengths = sorted(r[0] for r in known.select(F.size(F.split("_phrase", " "))).distinct().collect())  # few numbers
    worded = spread(texts).select(F.col(key), F.split(cells.folded_words(F.col(text)), " ").alias("_words"))
    runs = F.array(*[word_runs(F.col("_words"), n) for n in lengths]).cast("array<array<string>>")
    found = worded.select(key, F.explode(F.array_distinct(F.flatten(runs))).alias("_phrase"))
    return found.join(known, "_phrase").select(key, term)


# Words that tell what kind of column a request wants.
ID_WORDS = ("id", "uuid", "guid", "identifier")
TIME_WORDS = ("date", "time", "month", "year", "day", "week", "quarter", "timestamp")
NUMBER_WORDS = (
    "sum", "avg", "average", "mean", "count", "total", "amount", "price", "cost", "value", "score", "ratio", "percent",
    "quantity",
)
# Score of an exact match and bonus of a fuzzy one, by the kind of name.
EXACT_SCORES = {
    "raw_column_name": 1.0,
    "normalized_column_name": 0.995,
    "display_name": 0.985,
    "metadata_display_name": 0.98,
    "metadata_alias": 0.975,
}
SOURCE_BONUS = {
    "display_name": 0.03,
    "metadata_display_name": 0.025,
    "metadata_alias": 0.025,
    "normalized_column_name": 0.015,
}
MIN_CONFIDENCE = 0.72
AMBIGUITY_GAP = 0.08


def column_variants(columns: DataFrame) -> DataFrame:
    """Distinct folded names of each column with the best exact score and bonus among the kinds of name.

    Input has table_name, column_name, dtype, display_name, aliases and sample_values.
    """
    spaced = F.replace("column_name", F.lit("_"), F.lit(" "))

    def named(source: str, variant: Column) -> Column:
        return F.struct(
            variant.alias("variant"),
            F.lit(EXACT_SCORES[source]).alias("exact_score"),
            F.lit(SOURCE_BONUS.get(source, 0.0)).alias("bonus"),
        )

    names = F.array(
        named("raw_column_name", F.col("column_name")),
        named("normalized_column_name", spaced),
        named("display_name", F.col("display_name")),
        named("metadata_display_name", F.col("display_name")),
    )
    aliased = F.transform("aliases", lambda a: named("metadata_alias", a))
    rows = columns.select("table_name", "column_name", "dtype", "sample_values", F.inline(F.concat(names, aliased)))
    folded = rows.withColumn("variant", cells.folded_words(F.col("variant"))).filter(F.col("variant") != "")
    return folded.groupBy("table_name", "column_name", "dtype", "sample_values", "variant").agg(
        F.max("exact_score").alias("exact_score"), F.max("bonus").alias("bonus")
    )


def _has_word(words: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in wanted]))


def resolve_fields(requests: DataFrame, variants: DataFrame) -> DataFrame:
    """The column each requested field of a table means: matched, ambiguous or no_match.

    ``requests`` has table_name and requested.  A request meets only the columns of its own table, and
    equal requests are scored once.
    """
    asked = requests.select("table_name", "requested", cells.folded_words(F.col("requested")).alias("_asked")).filter("_asked <> ''")
    words = F.split("_asked", " ")
    wanted = (
        asked.select("table_name", "_asked")
        .distinct()
        .withColumn("_words", F.array_distinct(words))
        .withColumn(
            "_expected",
            F.when(_has_word(F.col("_words"), TIME_WORDS), "datetime")
            .when(_has_word(F.col("_words"), NUMBER_WORDS), "numeric")
            .when(_has_word(F.col("_words"), ID_WORDS), "identifier"),
        )
        .withColumn("_id_like", _has_word(F.col("_words"), ID_WORDS))
    )
    # Python work follows the join, and one table may be asked about most.
    pairs = salted_join(wanted, variants, ["table_name"], "_asked").withColumn("_ratio", similarity_ratio("_asked", "variant"))
    variant_words = F.array_distinct(F.split("variant", " "))
    overlap = F.size(F.array_intersect("_words", variant_words))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    inside = F.when(padded("variant").contains(padded("_asked")), 0.88).otherwise(
        F.when(padded("_asked").contains(padded("variant")), 0.84).otherwise(0.0)
    )
    token = F.when(overlap > 0, 0.42 + 0.42 * overlap / F.size("_words")).otherwise(0.0)
    fuzzy = 0.18 + 0.68 * F.col("_ratio")
    exact = F.col("_asked") == F.col("variant")
    base = F.when(exact, F.col("exact_score")).otherwise(
        F.least(F.lit(1.0), F.greatest(inside, token, fuzzy) + F.col("bonus"))
    )
    strategy = (
        F.when(exact, "exact_match")
        .when(fuzzy > F.greatest(inside, token), "fuzzy_similarity")
        .when(token > inside, "token_overlap")
        .otherwise("contains_match")
    )
    scored = pairs.groupBy("table_name", "_asked", "column_name").agg(
        F.max(F.struct(base.alias("score"), strategy.alias("strategy"))).alias("_best"),
        F.first("_expected").alias("_expected"),
        F.first("_id_like").alias("_id_like"),
        F.first("dtype").alias("_dtype"),
        F.first("sample_values").alias("_samples"),
    )
    dtype = F.lower("_dtype")
    family = (
        F.when(dtype.rlike("int|float|double|decimal|numeric|number"), "numeric")
        .when(dtype.rlike("date|time"), "datetime")
        .when(dtype.rlike("bool"), "boolean")
        .when(dtype.rlike("str|text|object|category"), "categorical")
        .when(cells.folded_words(F.col("column_name")).rlike(r"(^|.* )(id|uuid|guid|identifier)( .*|$)"), "identifier")
        .otherwise("categorical")
    )
    expected = F.col("_expected")
    adjusted = (
        F.col("_best.score")
        + F.when(expected.isNull(), 0.0).when(family == expected, 0.06).otherwise(-0.08)
        + F.when(family != "identifier", 0.0).when(F.col("_id_like"), 0.04).otherwise(-0.06)
        - F.when(F.array_contains(F.transform("_samples", cells.folded_words), F.col("_asked")), 0.04).otherwise(0.0)
    )
    final = scored.select(
        "table_name",
        "_asked",
        "column_name",
        F.col("_best.strategy").alias("strategy"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), adjusted)).alias("score"),
    )
    order = Window.partitionBy("table_name", "_asked").orderBy(
        F.col("score").desc(), F.length("column_name").asc(), F.lower("column_name").asc()
    )
    top = final.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= 2)
    first, second = F.col("_rank") == 1, F.col("_rank") == 2
    verdicts = top.groupBy("table_name", "_asked").agg(
        F.max(F.when(first, F.col("score"))).alias("match_score"),
        F.max(F.when(second, F.col("score"))).alias("_second"),
        F.max(F.when(first, F.col("column_name"))).alias("_column"),
        F.max(F.when(first, F.col("strategy"))).alias("match_strategy"),
    )
    close = (F.col("_second") >= MIN_CONFIDENCE) & (F.col("match_score") - F.col("_second") < AMBIGUITY_GAP)
    status = (
        F.when(F.col("match_score") < MIN_CONFIDENCE, "no_match")
        .when(F.coalesce(close, F.lit(False)), "ambiguous")
        .otherwise("matched")
    )
    decided = verdicts.withColumn("status", status)
    return asked.join(decided, ["table_name", "_asked"]).select(
        "table_name",
        "requested",
        "status",
        F.when(F.col("status") == "matched", F.col("_column")).alias("matched_column"),
        F.round("match_score", 6).alias("match_score"),
        "match_strategy",
    )


def merge_scores(dense: DataFrame, lexical: DataFrame, key: str) -> DataFrame:
    """Dense and lexical scores side by side; a hit of either list is kept."""
    return dense.join(lexical, key, "full_outer")
