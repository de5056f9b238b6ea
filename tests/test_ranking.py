"""Ranked selections and scores on literal cases."""

import math
from collections import Counter

from granary.operators import rank, vectors


def hit(kind, sheet="s", start=None, end=None, file="f", file_type=None):
    return (file, sheet, kind, start, end, file_type)


def chosen(spark, hits, top_k):
    schema = "q int, rank int, file_id string, sheet_name string, chunk_type string, row_start int, row_end int, file_type string"
    frame = spark.createDataFrame([(1, i, *h) for i, h in enumerate(hits)], schema)
    return [r["rank"] for r in rank.staged_selection(frame, "q", top_k).orderBy("position").collect()]


def test_summaries_come_before_row_groups(spark):
    hits = [hit("row_group", start=1, end=5), hit("row_group", start=6, end=9), hit("row_group", start=10, end=12)]
    hits += [hit("sheet_summary"), hit("file_summary")]
    assert chosen(spark, hits, 3) == [4, 3, 0]


def test_at_most_two_row_groups_of_a_sheet(spark):
    hits = [hit("file_summary"), hit("sheet_summary")] + [hit("row_group", start=i, end=i + 1) for i in range(0, 8, 2)]
    assert chosen(spark, hits, 5) == [0, 1, 2]
    assert chosen(spark, hits[2:], 5) == [0, 1]


def test_ranges_once_and_leftover_summaries_last(spark):
    hits = [hit("row_group", start=1, end=2), hit("row_group", start=1, end=2), hit("row_group", "t", 1, 2), hit("chunk", None)]
    hits += [hit("file_summary", None, file=f"f{i}") for i in range(4)] + [hit("sheet_summary", "t"), hit("sheet_summary", "t")]
    assert chosen(spark, hits, 9) == [4, 5, 8, 0, 2, 3, 6, 7, 9]


def test_lists_without_tables_stay_as_they_are(spark):
    hits = [hit("chunk"), hit("chunk")]
    assert chosen(spark, hits, 1) == [0, 1]
    assert chosen(spark, [hit("chunk", file_type="csv"), hit("chunk")], 1) == [0]


def test_lexical_scores_equal_the_formula(spark):
    docs = {1: "the cat sat on the mat", 2: "dogs and cats and the rest", 3: "nothing at all", 4: "Cat cat cat"}
    queries = {10: "the cat", 11: "cat cat dogs"}
    d = spark.createDataFrame(list(docs.items()), "d long, text string")
    q = spark.createDataFrame(list(queries.items()), "q long, text string")
    terms = rank.lexical_terms(d, "d", "text", q, "q", "text")
    got = {(r["q"], r["d"]): r["score"] for r in rank.sparse_topk(terms[0], "d", terms[1], "q", 10).collect()}
    tokens = {k: Counter(w for w in v.lower().split() if len(w) >= 2) for k, v in docs.items()}
    df = Counter(w for c in tokens.values() for w in c)
    for qi, text in queries.items():
        for di, counts in tokens.items():
            score = sum(
                counts[w] / sum(counts.values()) * math.log(1 + (4 - df[w] + 0.5) / (df[w] + 0.5)) * (1 + 0.2 * n)
                for w, n in Counter(text.lower().split()).items()
            )
            assert abs(got.get((qi, di), 0.0) - score) < 1e-6


def test_nearest_in_scope(spark):
    rows = [(i, [float(i), 1.0], i % 2) for i in range(20)]
    points = spark.createDataFrame(rows, "i long, v array<float>, g int").repartition(4)
    queries = spark.createDataFrame([(100, [4.2, 1.0], 1)], "q long, p array<float>, g int")
    got = vectors.nearest(points, "i", "v", queries, "q", "p", 3, "g").orderBy("rank").collect()
    assert [r["i"] for r in got] == [5, 3, 7] and abs(got[0]["distance"] - 0.64) < 1e-6


def test_coverage_selection_takes_every_file_once_first(spark):
    rows = [(1, r, f) for r, f in enumerate(["a", "a", "a", "b", "c"], 1)]
    ranked = spark.createDataFrame(rows, "q long, rank int, f string")
    got = rank.coverage_selection(ranked, "q", "f", 4).orderBy("position").collect()
    assert [(r["rank"], r["f"]) for r in got] == [(1, "a"), (4, "b"), (5, "c"), (2, "a")]
