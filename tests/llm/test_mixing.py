"""Mixing against brute force, and its exponent."""

import brute
import pytest
from pyspark.sql import functions as F

from granary.llm import mixing


def corpus():
    docs = [(d, "x" * (40 + d % 7 * 12), "big") for d in range(300)]
    docs += [(1000 + d, "y" * 100, "small") for d in range(20)] + [(2000 + d, "z" * (4 * d), "tiny") for d in range(5)]
    return docs


def test_matches_brute_force(documents):
    docs = corpus()
    got = sorted((r["doc_id"], r["epoch"]) for r in mixing.mix(documents(docs)).collect())
    assert got == brute.mixed([(d, s, -(-len(t) // 4)) for d, t, s in docs])
    taken = [d for d, _ in got]
    assert {d for d, _, _ in docs} <= set(taken) and max(map(taken.count, set(taken))) <= 3


def test_weights_are_realised(documents):
    docs = [(d, "x" * 40, "big") for d in range(900)] + [(1000 + d, "y" * 40, "small") for d in range(100)]
    for limit in (1.0, 1.5, 4.0):
        rows = mixing.mix(documents(docs), limit).groupBy("source").agg(F.count("*").alias("n"), F.first("weight").alias("w")).collect()
        total = sum(r["n"] for r in rows)
        assert all(abs(r["n"] / total - r["w"]) < 0.01 for r in rows)
        assert abs(next(r["n"] for r in rows if r["source"] == "small") / 100 - limit) < 0.02


def test_target_entropy(spark):
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, total long")
    exponent = mixing.fitted_exponent(totals, None, 1.2)
    weights = [r["weight"] for r in mixing.budgets(totals, exponent).collect()]
    import math

    assert abs(-sum(w * math.log2(w) for w in weights) - 1.2) < 1e-6
    assert mixing.fitted_exponent(totals, 2.0, 1.2) > exponent
    assert mixing.fitted_exponent(totals, None, 99.0) == 0.0
    assert mixing.fitted_exponent(totals, 1.0, None) == pytest.approx(1.0, abs=1e-8)


def test_odd_rows(odd, none):
    got = mixing.mix(odd)
    assert got.columns == [*odd.columns, "weight", "epoch", "block"]  # n_tokens is a column of the table
    first = got.where("epoch = 0").select(odd.columns).collect()
    assert sorted(repr(tuple(r)) for r in first) == sorted(repr(tuple(r)) for r in odd.collect())
    assert mixing.mix(none).count() == 0
    blank = odd.where("doc_id in (1, 2)")
    assert sorted(r["doc_id"] for r in mixing.mix(blank).collect()) == [1, 2]


def test_rows_are_placed_by_the_permutation(documents):
    docs = [(d, "x" * 40, "big") for d in range(900)] + [(1000 + d, "y" * 40, "small") for d in range(100)]
    rows = mixing.mix(documents(docs), 4.0).select("doc_id", "epoch", "block", F.monotonically_increasing_id().alias("at")).collect()
    rows.sort(key=lambda r: r["at"])
    places = [(r["epoch"], r["block"]) for r in rows]
    assert places == sorted(places)
    ids = [r["doc_id"] for r in rows]
    assert not any(a == b for a, b in zip(ids, ids[1:])) and ids[:50] != sorted(ids[:50])
    first = [r["doc_id"] < 1000 for r in rows if r["epoch"] == 0]
    assert 0.8 < sum(first[:250]) / 250 < 1  # sources lie mixed


def test_rows_without_an_id_spread_over_blocks(documents):
    docs = [(None, f"text {i} " + "x" * 40, "a") for i in range(600)] + [(i, "y" * 48, "a") for i in range(1200)] + [(5000, "z" * 9000, "b")]
    blocks = [r["block"] for r in mixing.mix(documents(docs)).where("doc_id is null").collect()]
    assert len(blocks) >= 600 and max(map(blocks.count, set(blocks))) < 10
