"""Approximate nearest neighbours: multiprobe p-stable hashing with exact distances."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.llm.batches import map_rows
from granary.session import settle

#: Rows of an index block and visits of a slice: the unit of work is a block that is compared with a slice of the visits.
BLOCK_ROWS = 1024
SLICE_VISITS = 2048
#: Rows and queries the index is fitted on, the smallest by hash of their ids; fewer queries weigh the shapes tried.
SAMPLE_ROWS = 4000
SAMPLE_QUERIES = 200
TRIAL_QUERIES = 16
#: Shapes tried: tables, hashes of a table and widths in units of the reach; a shape that asks a trial query for more
#: buckets than ``TRIAL_PROBES`` is not taken.
TABLES = (1, 2, 3)
HASHES = (2, 3, 4, 6, 8, 12)
WIDTHS = (0.75, 1.5, 3.0, 6.0)
TRIAL_PROBES = 1500
#: Chance that a neighbour at the reach lies in a visited bucket of some table.
SUCCESS = 0.97


@dataclass(frozen=True)
class Hashing:
    """Tables of p-stable hashes: ``floor((a . x + b) / width)`` for ``hashes`` Gaussian directions a per table."""

    tables: int = 1
    hashes: int = 3
    #: Width of a cell, and the distance within which neighbours are sought; :func:`fitted` finds the whole shape.
    width: float = 1.5
    reach: float = 1.0
    #: Chance, in one table, that a neighbour at ``reach`` lies in a visited bucket.
    success: float = SUCCESS
    seed: int = 11

    def directions(self, table: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng([self.seed, table, size])
        return random.standard_normal((size, self.hashes)), random.uniform(0, self.width, self.hashes)

    def projected(self, vectors: np.ndarray, table: int) -> np.ndarray:
        directions, shift = self.directions(table, vectors.shape[1])
        return vectors @ directions + shift

    def cells(self, projected: np.ndarray) -> np.ndarray:
        return np.floor(projected / self.width).astype(np.int64)


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``(vec_id, x, size)``: rows with an id and a vector that is neither null, empty, zero nor holds a null or non-finite part."""
    x = F.col(vector_column).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda v: v != 0)).select(
        "vec_id", "x", F.size("x").alias("size")
    )


def fitted(rows: DataFrame, queries: DataFrame, k: int, seed: int = Hashing.seed) -> Hashing:
    """The shape of the index, from bounded samples: the one of those tried that compares queries with fewest rows.

    The reach is a usual distance of a k-th neighbour; among a sample of the rows neighbours lie farther off than
    among all, so it errs to the wide side.  Where neighbours are much nearer than other rows, many narrow hashes
    exclude most of the table; where all rows are about equally far, no shape excludes much, and one table with few
    probes is the cheapest.
    """

    def sample(df: DataFrame, count: int) -> list:
        chosen = df.withColumn("_h", F.xxhash64("vec_id")).orderBy("_h", "vec_id").limit(count)
        return [(r["vec_id"], r["size"], np.array(r["x"])) for r in chosen.collect()]

    near, trials = [], []
    base = sample(rows, SAMPLE_ROWS)
    sized = {s: (np.array([i for i, t, _ in base if t == s]), np.array([x for _, t, x in base if t == s])) for s in {b[1] for b in base}}
    for own, size, q in sample(queries, SAMPLE_QUERIES):
        if size in sized:
            ids, xs = sized[size]
            away = np.sort(np.sqrt(((xs - q) ** 2).sum(axis=1))[ids != own])
            if len(away):
                near.append(away[min(k, len(away)) - 1])
                trials.append((size, q))
    if not near or not max(near) > 0:
        return Hashing(seed=seed)
    reach = float(np.quantile(near, 0.75)) or float(max(near))
    best, least = None, np.inf
    for tables in TABLES:
        for hashes in HASHES:
            for width in WIDTHS:
                shape = Hashing(tables, hashes, width * reach, reach, 1 - (1 - SUCCESS) ** (1 / tables), seed)
                cost = compared(shape, sized, trials[:TRIAL_QUERIES], least)
                if cost < least:
                    best, least = shape, cost
    return best or Hashing(TABLES[0], HASHES[0], WIDTHS[-1] * reach, reach, SUCCESS, seed)


def compared(shape: Hashing, sized: dict, trials: list, limit: float) -> float:
    """Share of the sampled rows that a trial query meets, in all tables together; infinite if beyond ``limit`` or too many probes."""
    met = 0.0
    for size in {s for s, _ in trials}:
        _, xs = sized[size]
        for table in range(shape.tables):
            cells, counts = np.unique(shape.cells(shape.projected(xs, table)), axis=0, return_counts=True)
            held = {c.tobytes(): n for c, n in zip(cells, counts)}
            for s, q in trials:
                if s == size:
                    visited = probed(shape, shape.projected(q[None, :], table)[0], TRIAL_PROBES)
                    if visited is None:
                        return np.inf
                    met += sum(held.get(c.tobytes(), 0) for c in visited) / len(xs) / len(trials)
                    if met >= limit:
                        return np.inf
    return met


def bucket(size: int, table: int, cells: np.ndarray) -> list[str]:
    return [f"{size}:{table}:" + ",".join(map(str, row)) for row in cells.tolist()]


def by_size(columns: dict):
    """Positions and stacked vectors of the rows of each dimension."""
    sizes = np.array(columns["size"], dtype=np.int64)
    for size in np.unique(sizes):
        at = np.where(sizes == size)[0]
        yield int(size), at, np.array([columns["x"][i] for i in at], dtype=np.float64)


def indexed(rows: DataFrame, shape: Hashing) -> DataFrame:
    """Every row in its bucket of each table: ``(bucket, table, vec_id, x)``."""

    def make():
        def run(columns):
            out = {"bucket": [], "table": [], "vec_id": [], "x": []}
            for size, at, xs in by_size(columns):
                for table in range(shape.tables):
                    out["bucket"] += bucket(size, table, shape.cells(shape.projected(xs, table)))
                    out["table"] += [table] * len(at)
                    out["vec_id"] += [columns["vec_id"][i] for i in at]
                    out["x"] += [columns["x"][i] for i in at]
            return out

        return run

    return map_rows(rows, make, "bucket string, table int, vec_id long, x array<double>")


NORMAL = np.frompyfunc(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)), 1, 1)


def chances(shape: Hashing, projected: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Chance that a neighbour at ``reach`` lies in each cell, per hash: its projection is the query's plus Gaussian noise."""
    low = (cells * shape.width - projected) / shape.reach
    high = ((cells + 1) * shape.width - projected) / shape.reach
    return (NORMAL(high) - NORMAL(low)).astype(np.float64)


def probed(shape: Hashing, projected: np.ndarray, limit: int | None = None) -> np.ndarray | None:
    """Cells to visit around a query, likeliest first, until they hold a neighbour with the chance ``success``.

    Per hash the cells within four times the reach are weighed, so what is enumerated does not depend on the data.
    Each step visits the likeliest cell left and puts up the cells that differ from it by the next choice of one hash.
    None if more than ``limit`` would be visited.
    """
    axes, odds = [], []
    for at in projected:
        low, high = np.floor((at + np.array([-4, 4]) * shape.reach) / shape.width).astype(np.int64)
        axis = np.arange(low, high + 1)
        chance = chances(shape, at, axis)
        order = np.argsort(-chance, kind="stable")
        axes.append(axis[order].tolist())
        odds.append(np.maximum(chance[order], 1e-300).tolist())
    goal = min(shape.success, math.prod(sum(o) for o in odds) * 0.999)
    first = (0,) * len(axes)
    waiting, covered, out = [(-math.prod(o[0] for o in odds), first, 0)], 0.0, []
    while waiting and covered < goal:
        if limit is not None and len(out) >= limit:
            return None
        chance, choice, last = heapq.heappop(waiting)
        covered -= chance
        out.append([axis[c] for axis, c in zip(axes, choice)])
        for j in range(last, len(axes)):  # only from the last changed hash on, so no cell comes up twice
            if choice[j] + 1 < len(axes[j]):
                after = chance / odds[j][choice[j]] * odds[j][choice[j] + 1]
                heapq.heappush(waiting, (after, (*choice[:j], choice[j] + 1, *choice[j + 1 :]), j))
    return np.array(out, dtype=np.int64)


def visits(queries: DataFrame, shape: Hashing) -> DataFrame:
    """Buckets each query visits, in estimated order of success: ``(bucket, query_id, q)``."""

    def make():
        def run(columns):
            out = {"bucket": [], "query_id": [], "q": []}
            for size, at, xs in by_size(columns):
                for table in range(shape.tables):
                    for i, place in zip(at, shape.projected(xs, table)):
                        chosen = bucket(size, table, probed(shape, place))
                        out["bucket"] += chosen
                        out["query_id"] += [columns["vec_id"][i]] * len(chosen)
                        out["q"] += [columns["x"][i]] * len(chosen)
            return out

        return run

    return map_rows(queries, make, "bucket string, query_id long, q array<double>")


HITS = "query_id long, vec_id long, score double"


def nearest_in_block(k: int):
    """The k nearest rows of one block for each query that visits it; ties go to the smaller id, repeated ids count once."""

    def run(block: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(block) and len(asking):
            ids = block["vec_id"].to_numpy(dtype=np.int64)
            rows = np.array(block["x"].tolist(), dtype=np.float64)
            repeated = len(np.unique(ids)) < len(ids)
            for query, q in zip(asking["query_id"], asking["q"]):
                scores = np.sqrt(((rows - np.asarray(q, dtype=np.float64)) ** 2).sum(axis=1))
                near = ids != query
                if not repeated and len(ids) > k + 1:
                    near &= scores <= np.partition(scores, k)[k]
                own_ids, own_scores = ids[near], scores[near]
                order = np.lexsort((own_ids, own_scores))
                if repeated:
                    order = order[np.sort(np.unique(own_ids[order], return_index=True)[1])]
                out["query_id"] += [query] * len(order[:k])
                out["vec_id"] += own_ids[order[:k]].tolist()
                out["score"] += own_scores[order[:k]].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def dealt(index: DataFrame, counts: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """Meet visits and index: a bucket's rows are dealt over blocks, its visits over slices, and each block meets each slice."""
    slices = asking.groupBy("bucket").agg(F.ceil(F.count("*") / SLICE_VISITS).cast("int").alias("slices"))
    parts = settle(counts.select("bucket", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")).join(slices, "bucket"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def one(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    left = index.join(parts, "bucket").select("bucket", one("vec_id", "blocks").alias("block"), every("slices").alias("slice"), "vec_id", "x")
    right = asking.join(parts, "bucket").select("bucket", every("blocks").alias("block"), one("query_id", "slices").alias("slice"), "query_id", "q")
    place = ("bucket", "block", "slice")
    return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(nearest_in_block(k), HITS)


def best(hits: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        hits.groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(ranked).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def search(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    shape: Hashing | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows found for each row of ``is_query``, itself left out.

    score is the Euclidean distance in double precision; ties go to the smaller id.  Vectors that are null, empty,
    zero or hold a null or non-finite part take no part, nor do rows without an id; vectors meet only those of their
    own dimension.  Rows that repeat an id and vector count once; a row never meets its own id.  A query of which the
    visited buckets gave fewer than k rows is compared with all rows, in blocks, so it gets all there are if they
    are fewer.  An empty table gives an empty table; other columns are ignored.  ``shape`` is fitted to samples if
    it is not given.
    """
    base = settle(usable(rows, id_column, vector_column))
    queries = base.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("size", F.size("x"))
    shape = shape or fitted(base, queries, k)
    index = settle(indexed(base, shape))
    counts = settle(index.groupBy("bucket", "table").agg(F.count("*").alias("rows")))
    found = settle(best(dealt(index, counts, settle(visits(queries, shape)), k), k))

    full = found.groupBy("query_id").count().where(F.col("count") >= k)
    short = settle(queries.join(full, queries["vec_id"] == full["query_id"], "left_anti"))
    first = counts.where(F.col("table") == 0).withColumn("size", F.split_part("bucket", F.lit(":"), F.lit(1)).cast("int"))
    everywhere = short.select("size", F.col("vec_id").alias("query_id"), F.col("x").alias("q")).join(first.select("size", "bucket"), "size")
    more = best(dealt(index.where(F.col("table") == 0), first, everywhere.select("bucket", "query_id", "q"), k), k)
    return found.join(full, "query_id", "left_semi").unionByName(more)
