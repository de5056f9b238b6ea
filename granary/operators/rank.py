"""Lexical and fused ranking, and the selections made from a ranked list.

Ranked lists are bounded by construction: every list is cut to its best k per query before anything
looks at a whole list.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from granary.operators.ordering import first_per_group
from granary.session import settle, spread

# Token pattern, fusion and hybrid weights, BM25 defaults.
TOKEN_PATTERN = "[A-Za-zА-Яа-яЁё0-9_]+"
DENSE_WEIGHT, LEXICAL_WEIGHT = 0.75, 0.25
FUSION_CONSTANT = 60
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
BLOCKS_PER_PARTITION = 2
SCORE_DIGITS = 6  # equal to six digits counts as a tie, which the document id breaks


def tokenize(text: Column) -> Column:
    """Lower-case tokens of at least two characters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0)), lambda w: F.length(w) >= 2)


def words(text: Column) -> Column:
    """Whitespace tokens as they stand."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def term_counts(texts: DataFrame, key: str, tokens: Column, vocabulary: DataFrame | None = None) -> DataFrame:
    """(key, token, tf, length): occurrences per text, of the words of ``vocabulary`` (token) if one is given.

    Other words are dropped before anything is shuffled where Spark finds the vocabulary small enough to send.
    """
    listed = spread(texts).select(F.col(key), tokens.alias("_tokens"))
    exploded = listed.select(key, F.size("_tokens").alias("length"), F.explode("_tokens").alias("token"))
    if vocabulary is not None:
        exploded = exploded.join(vocabulary, "token", "left_semi")
    return exploded.groupBy(key, "length", "token").agg(F.count("*").alias("tf"))


def lexical_terms(docs: DataFrame, doc: str, text: str, queries: DataFrame, query: str, query_text: str):
    """Document and query sides of the lexical score, whose product is the score."""
    query_counts = settle(term_counts(queries, query, tokenize(F.col(query_text))))
    vocabulary = settle(query_counts.select("token").distinct())  # its size is known to the join that follows
    found = settle(term_counts(docs, doc, tokenize(F.col(text)), vocabulary))  # read twice, tokenised once
    df = found.groupBy("token").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("n"))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    query_terms = (
        query_counts.join(df, "token")
        .crossJoin(F.broadcast(total))  # one row
        .select(query, "token", (idf * (1.0 + 0.2 * F.col("tf"))).alias("weight"))
    )
    return found.select(doc, "token", (F.col("tf") / F.greatest("length", F.lit(1))).alias("weight")), query_terms


def bm25_terms(docs: DataFrame, doc: str, text: str, queries: DataFrame, query: str, query_text: str):
    """Both sides of Okapi BM25; a term in more than half of the texts gets a share of the average idf."""
    doc_counts = term_counts(docs, doc, words(F.col(text)))
    query_counts = term_counts(queries, query, words(F.col(query_text)))
    every = settle(doc_counts.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("_tf")))
    n, length = docs.count(), every.agg(F.sum("_tf")).first()[0] or 0  # two numbers
    average_length = max(1e-9, length / max(1, n))
    raw_idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = every.select("token", raw_idf.alias("idf"))
    floor = idf.agg((BM25_EPSILON * F.avg("idf")).alias("_floor"))
    query_terms = (
        query_counts.join(idf, "token")
        .crossJoin(F.broadcast(floor))  # one row
        .select(query, "token", (F.when(F.col("idf") < 0, F.col("_floor")).otherwise(F.col("idf")) * F.col("tf")).alias("weight"))
    )
    pull = BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / average_length)
    saturated = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + pull)
    doc_terms = doc_counts.join(query_counts.select("token").distinct(), "token").select(doc, "token", saturated.alias("weight"))
    return doc_terms, query_terms


def sparse_topk(doc_terms: DataFrame, doc: str, query_terms: DataFrame, query: str, k: int) -> DataFrame:
    """The k best documents of each query by the product of term weights: query, doc, score, rank.

    Documents are dealt over ``BLOCKS_PER_PARTITION`` blocks per shuffle partition, so a block is a fraction of what the
    session lets a task hold; the terms of the queries go to every block, and a block brings k rows back per query.  A word
    that stands in a third of all documents costs a scan of its weights and not a list of pairs, and neither side passes
    the driver.
    """
    blocks = BLOCKS_PER_PARTITION * int(doc_terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = doc_terms.select(F.pmod(F.xxhash64(doc), F.lit(blocks)).cast("int").alias("_block"), doc, "token", "weight")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")
    sent = settle(query_terms).select(every, query, "token", "weight")
    schema = T.StructType(
        [query_terms.schema[query], doc_terms.schema[doc], T.StructField("score", T.DoubleType())]
    )
    found = dealt.groupBy("_block").cogroup(sent.groupBy("_block")).applyInPandas(_best_in_block(doc, query, k), schema)
    order = [F.col("score").desc(), F.col(doc).asc()]
    best = first_per_group(found, [query], order, k)
    rank = Window.partitionBy(query).orderBy(*order)  # at most k rows per query
    return best.withColumn("rank", F.row_number().over(rank))


def _best_in_block(doc: str, query: str, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(terms: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        number = {token: i for i, token in enumerate(asked["token"].unique())}
        terms = terms[terms["token"].isin(number)]
        if terms.empty:
            return pd.DataFrame({query: [], doc: [], "score": []})
        ids = terms["token"].map(number).to_numpy("int64")
        keys, owner = np.unique(terms[doc].to_numpy(), return_inverse=True)
        weights = terms["weight"].to_numpy("float64")
        order = np.argsort(ids, kind="stable")  # rows of a word stand together
        ids, owner, weights = ids[order], owner[order], weights[order]
        starts = np.searchsorted(ids, np.arange(len(number) + 1))
        parts = []
        for one, mine in asked.sort_values([query, "token"]).groupby(query, sort=False):
            scores = np.zeros(len(keys))
            for word, value in zip(mine["token"].map(number), mine["weight"]):
                rows = slice(starts[word], starts[word + 1])
                scores[owner[rows]] += value * weights[rows]  # a word stands once per document
            scores = np.round(scores, SCORE_DIGITS)
            hit = np.flatnonzero(scores > 0)
            best = hit[np.lexsort((keys[hit], -scores[hit]))[:k]]
            parts.append(pd.DataFrame({query: one, doc: keys[best], "score": scores[best]}))
        return pd.concat(parts, ignore_index=True)

    return search


def relative(ranked: DataFrame, query: str) -> DataFrame:
    """Scores divided by the best score of their query."""
    best = ranked.filter(F.col("rank") == 1).select(query, F.col("score").alias("_best"))
    return ranked.join(best, query).withColumn("score", F.col("score") / F.col("_best")).drop("_best")


def reciprocal_fusion(dense: DataFrame, lexical: DataFrame, query: str, item: str, top_k: int) -> DataFrame:
    """Weighted reciprocal ranks of two ranked lists; keeps max(3 k, 20) per query."""
    part = lambda side, weight: side.select(
        query, item, (F.lit(weight) / (FUSION_CONSTANT + F.col("rank"))).alias("_part")
    )
    both = part(dense, DENSE_WEIGHT).unionByName(part(lexical, LEXICAL_WEIGHT))
    fused = both.groupBy(query, item).agg(F.round(F.sum("_part"), 10).alias("score"))
    return ranked_list(fused, query, item, "score", max(3 * top_k, 20))


def ranked_list(scored: DataFrame, query: str, item: str, score: str, k: int) -> DataFrame:
    order = [F.col(score).desc(), F.col(item).asc()]
    best = first_per_group(scored, [query], order, k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def hybrid_merge(dense: DataFrame, lexical: DataFrame, contents: DataFrame, query: str, item: str) -> DataFrame:
    """0.75 dense similarity plus 0.25 lexical score, over the hits of either list that have content."""
    left = dense.select(query, item, (1.0 / (1.0 + F.col("distance"))).alias("dense_score"))
    right = lexical.select(query, item, F.col("score").alias("lexical_score"))
    joined = left.join(right, [query, item], "full_outer").select(
        query, item, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dense_score", "lexical_score")]
    )
    score = DENSE_WEIGHT * F.col("dense_score") + LEXICAL_WEIGHT * F.col("lexical_score")
    filled = contents.filter(F.trim("content") != "")
    return joined.join(filled, item).withColumn("hybrid_score", F.round(score, 8))


def above(scored: DataFrame, query: str, score: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Hits that reach the threshold, and per query how many did and did not."""
    good = F.col(score) >= threshold
    counts = scored.groupBy(query).agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))
    return scored.filter(good), counts


def coverage_selection(ranked: DataFrame, query: str, file: str, top_k: int, per_file_min: int = 1) -> DataFrame:
    """The ``per_file_min`` best hits of every file first when k allows it, then the rest by rank; input is a cut list per query."""
    per_file = Window.partitionBy(query, file).orderBy("rank")
    marked = ranked.withColumn("_nth", F.row_number().over(per_file))
    files = F.sum((F.col("_nth") == 1).cast("int")).over(Window.partitionBy(query))
    ahead = (F.col("_nth") <= per_file_min) & (F.lit(top_k) >= F.col("_files") * per_file_min)
    order = Window.partitionBy(query).orderBy(F.when(ahead, 0).otherwise(1), "rank")
    chosen = marked.withColumn("_files", files).withColumn("position", F.row_number().over(order))
    return chosen.filter(F.col("position") <= top_k).drop("_nth", "_files")


# Row groups a sheet gives, and what makes a hit one of a table.
ROW_GROUPS_PER_SHEET = 2
TABLE_TYPES = ("file_summary", "sheet_summary", "row_group")
TABLE_FILES = ("xlsx", "xls", "csv", "tsv")


def staged_selection(ranked: DataFrame, query: str, top_k: int) -> DataFrame:
    """Selection of a ranked list that holds tables: summaries of files and sheets before row groups, then the rest.

    Every hit gets a stage by its place among its like: 0 the leading file summaries, 1 the first of the leading sheet
    summaries of each sheet, 2 row groups (a range once, two places a sheet, one of which its summary takes), 3 other
    hits, 4 what is left of the summaries; row groups beyond are out.  ``position`` follows stage and rank and ends at
    ``top_k``.  Lists without tables stay whole and in order.
    """
    kind = F.lower(F.coalesce("chunk_type", F.lit("")))
    of_table = kind.isin(*TABLE_TYPES)
    if "file_type" in ranked.columns:
        of_table = of_table | F.lower(F.coalesce("file_type", F.lit(""))).isin(*TABLE_FILES)
    alike = Window.partitionBy(query, "_kind").orderBy("rank")
    sheet = [query, F.coalesce(F.col("file_id").cast("string"), F.lit("")), F.coalesce("sheet_name", F.lit(""))]
    placed = ranked.withColumns({"_kind": kind, "_table": F.max(of_table).over(Window.partitionBy(query))}).withColumn(
        "_nth", F.row_number().over(alike)
    )
    leads = F.when(F.col("_kind") == "file_summary", F.col("_nth") <= max(2, top_k // 4)).otherwise(
        (F.col("_kind") == "sheet_summary") & (F.col("_nth") <= max(4, top_k // 2))
    )
    placed = placed.withColumn("_leads", leads)
    first_of_sheet = F.row_number().over(Window.partitionBy(*sheet, "_kind", "_leads").orderBy("rank")) == 1
    heads_sheet = (F.col("_kind") == "sheet_summary") & F.col("_leads") & first_of_sheet
    ranged = F.col("row_start").isNotNull() & F.col("row_end").isNotNull()
    repeated = ranged & (F.row_number().over(Window.partitionBy(*sheet, "_kind", "row_start", "row_end").orderBy("rank")) > 1)
    placed = placed.withColumns({"_heads": heads_sheet, "_again": repeated})
    taken = F.max(F.col("_heads").cast("int")).over(Window.partitionBy(*sheet))
    number = F.row_number().over(Window.partitionBy(*sheet, "_kind", "_again").orderBy("rank"))
    stage = (
        F.when(F.col("_kind") == "file_summary", F.when(F.col("_leads"), 0).otherwise(4))
        .when(F.col("_kind") == "sheet_summary", F.when(F.col("_heads"), 1).otherwise(4))
        .when(F.col("_kind") == "row_group", F.when(~F.col("_again") & (number + taken <= ROW_GROUPS_PER_SHEET), 2))
        .otherwise(3)
    )
    order = Window.partitionBy(query).orderBy("_stage", "rank")
    chosen = placed.withColumn("_stage", F.when(F.col("_table"), stage).otherwise(3)).where("_stage is not null")
    chosen = chosen.withColumn("position", F.row_number().over(order))
    return chosen.where((F.col("position") <= top_k) | ~F.col("_table")).select(*ranked.columns, "position")


def merge_context(hits: DataFrame, query: str, arrival: str, score: str, max_docs: int = 64) -> DataFrame:
    """The first arrival of each chunk, best score first, cut per query."""
    fields = [c for c in hits.columns if c not in (query, "chunk_id")]
    first = hits.groupBy(query, "chunk_id").agg(F.min_by(F.struct(*fields), F.col(arrival)).alias("_row"))
    merged = first.select(query, "chunk_id", "_row.*")
    order = [F.col(score).desc(), F.col(arrival).asc()]
    best = first_per_group(merged, [query], order, max_docs)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def scope_from_hits(hits: DataFrame, query: str, score: str) -> DataFrame:
    """The file with the best hit, and the sheet with the best hit inside it."""
    sheets = hits.groupBy(query, "file_id", "sheet_name").agg(F.max(score).alias("_score"))
    files = sheets.groupBy(query, "file_id").agg(
        F.max("_score").alias("_best"),
        F.min_by("sheet_name", F.struct(-F.col("_score"), F.col("sheet_name"))).alias("selected_sheet"),
    )
    choice = F.min_by(F.struct("file_id", "selected_sheet"), F.struct(-F.col("_best"), F.col("file_id")))
    return files.groupBy(query).agg(choice.alias("_c")).select(
        query, F.col("_c.file_id").alias("selected_file"), F.col("_c.selected_sheet").alias("selected_sheet")
    )


def context_block(hits: DataFrame, query: str, score: str) -> DataFrame:
    """Ranked hits of a query as one numbered text; input is a cut list per query."""
    # format_number rounds the exact value; format_string would round its shortest decimal form.
    shown = F.call_function("format_number", F.col(score), F.lit("0.0000"))
    head = F.format_string("[%d] file=%s chunk=%s score=%s\n", "rank", "filename", "chunk_index", shown)
    text = F.concat(head, F.trim("content"))
    items = F.sort_array(F.collect_list(F.when(F.trim("content") != "", F.struct("rank", text.alias("text")))))
    return hits.groupBy(query).agg(F.array_join(F.transform(items, lambda s: s["text"]), "\n\n---\n\n").alias("context"))
