"""Stores that change: whole results, untouched files, repeated and late changes, deletes, compaction, pruned searches."""

import os

import pytest
from pyspark.sql import functions as F

from granary.session import shared_folder
from granary.sources import stores

SCHEMA = "id long, text string, kind string, version int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def store(spark):
    rows = [(i, f"t{i}", "" if i % 3 else "a", 1) for i in range(200)] + [(0, "older", "a", 0), (None, "no id", "a", 1)]
    return stores.create(table(spark, rows), shared_folder(spark, "store"), "id", ("version",), ("kind",), 8)


def files(store):
    """Data files with their times."""
    found = store.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(store.path)
    return {r["path"]: r["modificationTime"] for r in found.select("path", "modificationTime").collect()}


def held(store):
    return {(r["id"], r["kind"]): (r["text"], r["version"]) for r in store.rows().collect()}


def test_newest_of_a_key_is_kept(store):
    rows = held(store)
    assert len(rows) == 201 and rows[0, "a"] == ("t0", 1) and rows[1, None] == ("t1", 1) and rows[None, "a"][0] == "no id"


def test_upsert_rewrites_touched_buckets_only(spark, store):
    before, rows = files(store), held(store)
    changes = table(spark, [(3, "new", "a", 2), (3, "between", "a", 1), (6, "late", "a", 0), (900, "more", "a", 1)])
    assert stores.upsert(store, changes) == 2
    want = rows | {(3, "a"): ("new", 2), (900, "a"): ("more", 1)}
    assert held(store) == want
    after = files(store)
    kept = [f for f in before if after.get(f) == before[f]]
    assert len(before) - 2 <= len(kept) < len(before)
    assert stores.upsert(store, changes) == 0 and files(store) == after and held(store) == want


def test_delete_leaves_markers_that_late_news_do_not_undo(spark, store):
    before, rows = files(store), held(store)
    gone = [k for k in rows if k[0] in (9, 12, 10)]
    assert stores.delete_where(store, F.col("id").isin(9, 12, 10)) == 3
    assert held(store) == {k: v for k, v in rows.items() if k not in gone}
    assert len([f for f, t in files(store).items() if before.get(f) == t]) >= len(before) - 3
    assert stores.upsert(store, table(spark, [(9, "t9", "a", 1)])) == 0 and (9, "a") not in held(store)
    assert stores.upsert(store, table(spark, [(9, "again", "a", 2)])) == 1 and held(store)[9, "a"] == ("again", 2)
    assert stores.delete_where(store, F.col("id") == 12) == 0


def test_compaction_and_empty_buckets(spark, store):
    assert stores.delete_where(store, F.col("kind") == "a") == 68
    left = held(store)
    assert set(k[1] for k in left) == {None} and len(left) == 133
    dropped = stores.compact(store)
    markers = store.stored().where(stores.GONE).count()
    assert dropped + markers == 68 and markers <= 8 and held(store) == left
    assert stores.compact(store) == 0


def test_empty_changes(spark, store):
    rows = held(store)
    assert stores.upsert(store, table(spark, [])) == 0 and held(store) == rows


def test_search_opens_the_collections_asked_for_only(spark):
    rows = [(i, [float(i), 0.0] + [1.0] * (i % 2), 2 + i % 2, "local", f"m{i % 5}", 1) for i in range(100)]
    schema = "id long, v array<double>, dim int, embedding_mode string, embedding_model string, version int"
    store = stores.create(spark.createDataFrame(rows, schema), shared_folder(spark, "v"), "id", ("version",), stores.VECTOR_PARTS, 2)
    asked = spark.createDataFrame([(1, [0.0, 0.0], "local", "m0"), (2, [0.0, 0.0, 1.0], "local", "m3")], "q long, p array<double>, embedding_mode string, embedding_model string")
    found = stores.nearest(store, "v", asked, "q", "p", 3)
    assert [(r["q"], r["id"]) for r in found.orderBy("q", "rank").collect()] == [(1, 0), (1, 10), (1, 20), (2, 3), (2, 13), (2, 23)]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert os.path.basename(store.path).startswith("v-")
