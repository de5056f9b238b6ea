"""The stored inverted index: equal to scoring every document, in one segment or several, and blocks that cannot pass stay shut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import index, rank
from granary.session import shared_folder

ASK = {"lexical": index.lexical_question, "bm25": index.bm25_question}


def corpus(spark, random, n, first=0):
    vocabulary = [f"w{i}" for i in range(60)]
    odds = 1 / np.arange(1, 61)
    rows = [(first + i, " ".join(random.choice(vocabulary, random.integers(0, 90), p=odds / odds.sum()))) for i in range(n)]
    rows += [(first + n, None), (first + n + 1, "  "), (first + n + 2, "w1 w1 w2"), (first + n + 3, "w1 w1 w2")]
    return spark.createDataFrame(rows, "d long, text string")


def hits(frame):
    return sorted((r["q"], r["d"], r["score"], r["rank"]) for r in frame.select("q", "d", "score", "rank").collect())


def all_documents(how, docs, queries, k):
    terms = {"lexical": rank.lexical_terms, "bm25": rank.bm25_terms}[how.name](docs, "d", "text", queries, "q", "text")
    return hits(rank.sparse_topk(*[terms[0], "d", terms[1], "q"], k))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "w1 w2 w2"), (2, "w40 w59 w3 unknown"), (3, "unknown"), (4, "w5"), (5, None)], "q long, text string")


@pytest.mark.parametrize("how", [index.LEXICAL, index.BM25])
def test_equals_scoring_every_document(spark, queries, how, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_DOCS", 16)
    monkeypatch.setattr(index, "SLICE_QUERIES", 2)
    docs = corpus(spark, np.random.default_rng(2), 600)
    stored = index.add_segment(docs, "d", "text", how, shared_folder(spark, "index"))
    for k in (1, 7, 1000):
        found = index.search(stored, ASK[how.name](stored, queries, "q", "text"), "q", k)
        assert hits(found.hits) == all_documents(how, docs, queries, k)
    assert stored.totals()[0] == 604


@pytest.mark.parametrize("how", [index.LEXICAL, index.BM25])
def test_new_documents_are_a_new_segment(spark, queries, how):
    random = np.random.default_rng(3)
    old, new = corpus(spark, random, 200), corpus(spark, random, 90, 1000)
    path = shared_folder(spark, "index")
    index.add_segment(old, "d", "text", how, path)
    before = set(spark.read.parquet(f"{path}/postings").inputFiles())
    stored = index.add_segment(new, "d", "text", how, path, segment=1)
    assert before < set(spark.read.parquet(f"{path}/postings").inputFiles())
    got = index.search(stored, ASK[how.name](stored, queries, "q", "text"), "q", 9)
    assert hits(got.hits) == all_documents(how, old.unionByName(new), queries, 9)


def test_blocks_below_the_threshold_are_not_read(spark, queries, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_DOCS", 8)
    short = [(i, f"w1 w{2 + i % 5}") for i in range(200)]
    long = [(1000 + i, "w1 " + " ".join(f"x{j}" for j in range(900 + i))) for i in range(60)]
    docs = spark.createDataFrame(short + long, "d long, text string")
    stored = index.add_segment(docs, "d", "text", index.LEXICAL, shared_folder(spark, "index"))
    found = index.search(stored, index.lexical_question(stored, queries.where("q = 1"), "q", "text"), "q", 5)
    assert hits(found.hits) == all_documents(index.LEXICAL, docs, queries.where("q = 1"), 5)
    opened, promised = found.opened.select("class").distinct().collect(), found.promised.select("class").distinct().collect()
    assert {r["class"] for r in opened} == {2} < {r["class"] for r in promised}
    asked = index.lexical_question(stored, queries.where("q = 1"), "q", "text")
    read = index.scored(stored, asked, "q", found.opened, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in read and "class" in read.split("PartitionFilters: [")[1].split("]")[0]


def test_empty(spark, queries):
    docs = spark.createDataFrame([], "d long, text string")
    stored = index.add_segment(docs, "d", "text", index.LEXICAL, shared_folder(spark, "index"))
    assert stored.totals() == (0, 0)


def test_tokens_are_counted_where_their_text_is(spark):
    """Counting shuffles nothing, and rows that share an id and a length still count as one text."""
    docs = corpus(spark, np.random.default_rng(4), 80)
    docs = docs.unionByName(docs.where("d < 30")).unionByName(spark.createDataFrame([(None, "w1 w2 w1"), (None, "w2 w3 w4")], "d long, text string"))
    lists = index.token_lists(docs, "d", rank.tokenize(F.coalesce("text", F.lit(""))))
    assert "Aggregate" not in lists._jdf.queryExecution().optimizedPlan().toString()
    stored = index.add_segment(docs, "d", "text", index.LEXICAL, shared_folder(spark, "index"))
    kept = stored.table("postings").select("token", F.inline("postings")).select("token", "d", "tf", "length")
    want = rank.term_counts(docs, "d", rank.tokenize(F.coalesce("text", F.lit("")))).select("token", "d", "tf", F.col("length"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert sorted(map(tuple, stored.table("terms").select("token", "df", "tf").collect())) == sorted(
        map(tuple, want.groupBy("token").agg(F.count("*"), F.sum("tf")).collect())
    )
