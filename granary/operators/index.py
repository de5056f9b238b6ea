"""A stored inverted index: lexical ranking that does not read the texts again.

Documents are dealt over blocks of like lengths.  The index holds one row per block and token: the head, which bounds
what the token can add to the score of any document of the block, and the postings.  A question reads heads first:
each block has a document of a sure score, the k-th best of those is a threshold, and only blocks whose bound passes it
have their postings read.  New documents are a new segment, statistics are summed over segments.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from granary.operators import rank
from granary.operators.ordering import first_per_group
from granary.session import settle, spread

#: Documents of a block on average.
BLOCK_DOCS = 1024
#: Queries that one task scores against one block.
SLICE_QUERIES = 512
#: Length classes per doubling of the length; a class is a folder, so classes that no question needs are not opened.
CLASSES_PER_DOUBLING = 2
BLOCK = ("segment", "class", "block")
SLACK = 10.0**-rank.SCORE_DIGITS


@dataclass(frozen=True)
class Scorer:
    """How a question scores a document: the sum over its tokens of a token weight times a document weight.

    ``tokens`` gives the tokens of a text; ``weight`` of (tf, length) grows with tf and falls with length, so its
    value for a block's largest tf and least length is a bound.
    """

    name: str
    tokens: Callable[[Column], Column]


LEXICAL = Scorer("lexical", rank.tokenize)
BM25 = Scorer("bm25", rank.words)


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    doc: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def totals(self) -> tuple[int, int]:
        """Documents and tokens of all segments."""
        row = self.table("totals").agg(F.sum("docs"), F.sum("tokens")).first()
        return row[0] or 0, row[1] or 0

    def document_frequency(self) -> DataFrame:
        return self.table("terms").groupBy("token").agg(F.sum("df").alias("df"))


def token_lists(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """``(doc, length, class, terms)`` of the texts with tokens: each different token and how often it stands there."""
    listed = spread(docs).select(F.col(doc), F.sort_array(tokens).alias("s")).where("size(s) > 0")
    opens = "filter(sequence(0, size(s) - 1), i -> i = 0 or s[i] <> s[i - 1])"
    counted = "transform(o, (b, r) -> struct(s[b] as token, cast(coalesce(get(o, r + 1), size(s)) - b as long) as tf))"
    return listed.select(
        doc,
        F.size("s").alias("length"),
        F.floor(F.log2(F.size("s")) * CLASSES_PER_DOUBLING).cast("int").alias("class"),
        F.expr(f"transform(array({opens}), o -> {counted})[0]").alias("terms"),
    )


def add_segment(docs: DataFrame, doc: str, text: str, how: Scorer, path: str, segment: int = 0) -> Index:
    """Index ``docs`` as a segment of the index at ``path``; ids of one segment do not stand in another.

    Rows that share an id and a length count as one text.  Null texts have no tokens and are counted only.
    The totals are written last: a segment without them has not been finished.
    """
    spark = docs.sparkSession
    texts = settle(token_lists(docs, doc, how.tokens(F.coalesce(F.col(text), F.lit("")))))
    sizes = settle(texts.groupBy("class").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("blocks")))
    tasks = sizes.agg(F.sum("blocks")).first()[0] or 1  # one number
    placed = texts.join(F.broadcast(sizes), "class")  # a row per class, of which there are a hundred at most
    placed = placed.withColumn("block", F.pmod(F.xxhash64(doc), F.greatest("blocks", F.lit(1))).cast("int"))
    # texts are shuffled as they stand, one row each; what follows groups within the blocks
    counts = placed.repartition(tasks, "class", "block").select("class", "block", doc, "length", F.inline("terms"))
    counts = counts.groupBy("class", "block", doc, "length", "token").agg(F.sum("tf").alias("tf"))
    postings = counts.groupBy("class", "block", "token").agg(
        F.sort_array(F.collect_list(F.struct(doc, "tf", "length"))).alias("postings"),
        F.max(F.col("tf") / F.col("length")).alias("max_share"),
        F.max("tf").alias("max_tf"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.count("*").alias("df"),
        F.sum("tf").alias("tf"),
    )
    target = f"{path}/postings/segment={segment}"
    postings.sortWithinPartitions("class", "token", "block").write.partitionBy("class").parquet(target)
    heads = spark.read.schema(postings.schema).parquet(target)
    terms = heads.groupBy("token").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    terms.sortWithinPartitions("token").write.parquet(f"{path}/terms/segment={segment}")
    tokens = spark.read.parquet(f"{path}/terms/segment={segment}").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
    docs.agg(F.count("*").alias("docs")).crossJoin(tokens).write.parquet(f"{path}/totals/segment={segment}")  # one row each
    return Index(spark, path, doc)


@dataclass(frozen=True)
class Question:
    """Tokens of the queries with their weight (``query, token, weight``), and the document's side of a score.

    Of a head, ``most`` is what no document of the block exceeds, ``sure`` what one of them reaches.
    """

    terms: DataFrame
    weight: Callable[[Column, Column], Column]
    most: Column
    sure: Column


def lexical_question(index: Index, queries: DataFrame, query: str, text: str) -> Question:
    """The product of a word's share of the document, its rarity and a little for repetition in the query."""
    n, _ = index.totals()
    asked = rank.term_counts(queries, query, rank.tokenize(F.col(text))).join(index.document_frequency(), "token")
    idf = F.log(1.0 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = asked.select(query, "token", (idf * (1.0 + 0.2 * F.col("tf"))).alias("weight"))
    return Question(terms, lambda tf, length: tf / length, F.col("max_share"), F.col("max_share"))


def bm25_question(index: Index, queries: DataFrame, query: str, text: str) -> Question:
    """Okapi BM25; a term in more than half of the texts gets a share of the average idf."""
    n, tokens = index.totals()
    idf = index.document_frequency().select("token", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    floor = idf.agg(F.coalesce(F.avg("idf"), F.lit(0.0))).first()[0] * rank.BM25_EPSILON  # one number
    asked = rank.term_counts(queries, query, rank.words(F.col(text))).join(idf, "token")
    weight = F.when(F.col("idf") < 0, F.lit(floor)).otherwise(F.col("idf")) * F.col("tf")
    average = max(1e-9, tokens / max(1, n))

    def saturated(tf: Column, length: Column) -> Column:
        pull = rank.BM25_K1 * (1 - rank.BM25_B + rank.BM25_B * length / average)
        return tf * (rank.BM25_K1 + 1) / (tf + pull)

    terms = asked.select(query, "token", weight.alias("weight"))
    return Question(terms, saturated, *[saturated(F.col("max_tf"), F.col(c)) for c in ("min_length", "max_length")])


def promises(index: Index, asked: Question, query: str) -> DataFrame:
    """Bounds of the blocks, from heads only: ``(query, segment, class, block, most, sure)``.

    ``most`` is beyond every document of the block, ``sure`` is reached by one; tokens of negative weight take from both
    ends what they can.
    """
    heads = index.table("postings").select(*BLOCK, "token", asked.most.alias("_most"), asked.sure.alias("_sure"))
    gain, loss = F.greatest("weight", F.lit(0.0)), F.least("weight", F.lit(0.0))
    bounds = heads.join(asked.terms, "token").groupBy(query, *BLOCK).agg(
        F.sum(gain * F.col("_most")).alias("most"), (F.max(gain * F.col("_sure")) + F.sum(loss * F.col("_most"))).alias("sure")
    )
    return bounds.where("most > 0")


def passing(promised: DataFrame, query: str, k: int) -> DataFrame:
    """The blocks that may hold one of the k best: fewer than k sure scores are no threshold."""
    best = first_per_group(promised.where("sure > 0").select(query, "sure"), [query], [F.col("sure").desc()], k)
    least = best.groupBy(query).agg(F.min("sure").alias("_least"), F.count("*").alias("_n")).where(F.col("_n") >= k)
    rows = promised.join(least, query, "left")
    return rows.where(F.col("most") + SLACK >= F.coalesce("_least", F.lit(0.0))).select(*promised.columns)


def scored(index: Index, asked: Question, query: str, wanted: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query among the blocks ``wanted`` (query and block): ``(query, doc, score)``.

    Only the folders of the length classes that are wanted are opened.
    """
    asks = wanted.agg(F.collect_set("class").alias("classes"), F.count_distinct(query).alias("queries")).first()
    # a hundred classes at most
    postings = index.table("postings").where(F.col("class").isin(asks["classes"])).select(*BLOCK, "token", "postings")
    slices = max(1, -(-asks["queries"] // SLICE_QUERIES))
    asking = wanted.select(query, *BLOCK).join(asked.terms, query)
    asking = asking.withColumn("slice", F.pmod(F.xxhash64(query), F.lit(slices)).cast("int"))
    tokens = settle(asking.select(*BLOCK, "token", "slice").distinct())
    # the tokens of all blocks are many rows however few bytes they fill, so they are not sent whole
    asked_for = postings.join(asked.terms.select("token").distinct(), "token", "left_semi")
    rows = asked_for.join(tokens.hint("merge"), [*BLOCK, "token"]).select(
        *BLOCK,
        "slice",
        "token",
        F.col(f"postings.{index.doc}").alias("docs"),
        F.transform("postings", lambda p: asked.weight(p["tf"], p["length"]).cast("double")).alias("shares"),
    )
    place = [*BLOCK, "slice"]
    schema = T.StructType(
        [
            wanted.schema[query],
            T.StructField(index.doc, rows.schema["docs"].dataType.elementType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    # a block is much work and few bytes, so partitions are not to be merged by their bytes
    tasks = int(index.spark.conf.get("spark.sql.shuffle.partitions"))
    left, right = (side.repartition(tasks, *place).groupBy(*place) for side in (rows, asking))
    scores = left.cogroup(right).applyInPandas(_best_of_block(query, index.doc, k), schema)
    return first_per_group(scores, [query], [F.col("score").desc(), F.col(index.doc).asc()], k)


def _best_of_block(query: str, doc: str, k: int):
    """The k best documents of one block for each query of a slice, by adding the postings of its tokens up."""

    def best(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asking.empty:
            return pd.DataFrame({query: [], doc: [], "score": []})
        keys, owner = np.unique(np.concatenate(rows["docs"].tolist()), return_inverse=True)
        ends = np.cumsum(rows["docs"].map(len))
        owners = np.split(owner, ends[:-1])
        lists = {t: (o, np.asarray(s)) for t, o, s in zip(rows["token"], owners, rows["shares"])}
        asking = asking.sort_values([query, "token"])
        queries, starts = np.unique(asking[query].to_numpy(), return_index=True)
        tokens, weights = asking["token"].tolist(), asking["weight"].tolist()
        of, found, values = [], [], []
        for at, stop in zip(starts, [*starts[1:], len(tokens)]):
            scores = np.zeros(len(keys))
            for token, weight in zip(tokens[at:stop], weights[at:stop]):
                if token in lists:
                    place, share = lists[token]
                    scores[place] += weight * share  # a token stands once per document
            scores = np.round(scores, rank.SCORE_DIGITS)
            hit = np.flatnonzero(scores > 0)
            if len(hit) > k:
                hit = hit[scores[hit] >= np.partition(scores[hit], -k)[-k]]
            hit = hit[np.lexsort((keys[hit], -scores[hit]))[:k]]
            of.append(len(hit))
            found.append(keys[hit])
            values.append(scores[hit])
        return pd.DataFrame({query: np.repeat(queries, of), doc: np.concatenate(found), "score": np.concatenate(values)})

    return best


@dataclass(frozen=True)
class Answer:
    """``hits``: query, document, score and rank; ``opened`` and ``promised``: blocks whose postings were and might be read."""

    hits: DataFrame
    opened: DataFrame
    promised: DataFrame


def search(index: Index, asked: Question, query: str, k: int) -> Answer:
    """The k best documents of each query by score, ties to the smaller id; documents without a common token are no hits.

    Equal to scoring every document.
    """
    asked = Question(settle(asked.terms), asked.weight, asked.most, asked.sure)
    promised = settle(promises(index, asked, query))
    opened = settle(passing(promised, query, k))
    hits = settle(scored(index, asked, query, opened, k))
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(index.doc).asc())  # at most k rows per query
    return Answer(hits.withColumn("rank", F.row_number().over(order)), opened, promised)
