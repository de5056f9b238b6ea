"""Centroid clustering against a plain version, with ties, repeated rows and odd vectors."""

import hashlib
import math

import numpy as np
import pytest

from granary.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, n int, codes string, cluster string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, 1, "c", "d") for i, v in rows], SCHEMA)


def plain(rows, how):
    """``(id, cluster, distance)`` and the centroids, with Python integers."""
    kept = [(i, [math.floor(how.scale * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == how.size and all(c is not None and math.isfinite(c) for c in v)]
    named = sorted((hashlib.sha256(f"{how.seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centres = [x for _, x in named[: how.k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centres))

    for _ in range(how.rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for k, members in groups.items():
            centres[k] = [sum(column) // len(members) for column in zip(*members)]
    return sorted(((i, *nearest(x)[::-1]) for i, x in kept), key=repr), centres


def got(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "cluster", "distance").collect()), key=repr)


HOW = centroids.Clustering(size=6, rounds=4)


def test_equals_plain_version(spark):
    random = np.random.default_rng(5)
    rows = [(i, np.round(random.standard_normal(6) + 3 * (i % 5), 1)) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(7, rows[7][1])] * 3 + [(None, rows[3][1])]
    want, centres = plain(rows, HOW)
    frame, found = centroids.cluster(table(spark, rows).repartition(5), HOW)
    assert got(frame) == want and found.tolist() == centres


def test_blocks_are_cut_and_do_not_matter(spark, monkeypatch):
    random = np.random.default_rng(6)
    rows = [(i, random.standard_normal(6)) for i in range(90)]
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 7)
    frame, found = centroids.cluster(table(spark, rows), HOW)
    want, centres = plain(rows, HOW)
    assert got(frame) == want and found.tolist() == centres


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1] * 5), (4, [nan] * 6), (5, [inf] + [0] * 5), (6, [None] + [0] * 5), (8, [0] * 6), (9, [-0.0004] * 6)]
    want, _ = plain(odd, HOW)
    frame, found = centroids.cluster(table(spark, odd), HOW)
    assert got(frame) == want and [r[0] for r in want] == [8, 9] and len(found) == 2
    assert found.tolist() and sorted(map(tuple, found.tolist())) == [(-1,) * 6, (0,) * 6]
    named = centroids.with_inertia(frame, found).collect()
    assert {r["inertia"] for r in named} == {0} and len({r["centroid_sha256"] for r in named}) == 2


def test_empty_and_without_ids(spark):
    frame, found = centroids.cluster(table(spark, []), HOW)
    assert len(found) == 0 and centroids.with_inertia(frame, found).count() == 0
    frame, found = centroids.cluster(table(spark, [(None, [1] * 6)]), HOW)
    assert [tuple(r) for r in frame.collect()] == [(None, None, None)]
    assert centroids.with_inertia(frame, found).first()["inertia"] is None


def test_components_too_large_for_a_long_distance(spark):
    with pytest.raises(Exception, match="would not fit"):
        centroids.cluster(table(spark, [(1, [1e9] * 6)]), HOW)
