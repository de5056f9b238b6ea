"""Centroid clustering over integer vectors, with distances read from tables of squared differences.

Vectors are written once as blocks of codes: per dimension the integers that occur in the block, and for each vector
the place of its integer among them.  A round tabulates, per block and dimension, the squared difference of every
occurring integer to every centroid; a distance is then a sum of gathered table entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from granary.llm.batches import arrow_schema
from granary.session import settle

#: Vectors of a block at most; so a code fits in 16 bits, and a block of 64 dimensions takes 4 MB.
BLOCK_ROWS = 32_768
#: Components are below this in size, so that a squared distance over 64 dimensions fits in 64 bits.
COMPONENT_LIMIT = float(1 << 17)

BLOCKS = "ids binary, missing binary, codes binary, values binary, sizes binary, n int"
SUMS = "cluster int, n long, sums array<long>"
ASSIGNED = "vec_id long, cluster int, distance long"


@dataclass(frozen=True)
class Clustering:
    """``k`` centroids, the integer scale of a component, rounds, and the seed that starting vectors are hashed with."""

    size: int = 64
    k: int = 8
    scale: int = 1024
    rounds: int = 10
    seed: int = 3


def integers(rows: DataFrame, how: Clustering, id_column: str, vector_column: str) -> DataFrame:
    """``(vec_id, x)``: vectors of the wanted size without null or non-finite parts, scaled and floored."""
    x = F.col(vector_column).cast("array<double>")
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = rows.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("x").isNotNull() & (F.size("x") == how.size) & whole
    )
    beyond = F.raise_error(F.lit(f"a component of {COMPONENT_LIMIT:.0f} or more: distances would not fit in a long"))
    fits = F.forall("x", lambda v: F.abs(v) < F.lit(COMPONENT_LIMIT))
    floored = F.transform("x", lambda v: F.floor(v * F.lit(float(how.scale))).cast("int"))
    return kept.select("vec_id", F.when(fits, floored).otherwise(beyond.cast("array<int>")).alias("x"))


def starting(vectors: DataFrame, how: Clustering) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of their id, in that order; rows without an id do not start a cluster.

    Rows that share an id come in order of their components.  At most ``k`` rows reach the driver.
    """
    name = F.concat(F.lit(f"{how.seed}:"), F.col("vec_id").cast("string"))
    first = vectors.where("vec_id is not null").withColumn("_h", F.sha2(name, 256)).orderBy("_h", "x").limit(how.k)
    return np.array([r["x"] for r in first.collect()], dtype=np.int64).reshape(-1, how.size)


def coded(vectors: DataFrame, how: Clustering) -> DataFrame:
    """Blocks of at most ``BLOCK_ROWS`` vectors of a partition: ids, the occurring integers per dimension, and codes.

    codes: 16-bit places among the block's integers, a dimension after the other; values: those integers, ascending,
    of all dimensions; sizes: how many each dimension has.
    """
    schema = arrow_schema(BLOCKS)

    def block(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        values, codes = zip(*(np.unique(column, return_inverse=True) for column in x.T))
        cells = [
            ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"),
            np.asarray(ids.is_null().to_numpy(zero_copy_only=False), dtype=np.uint8),
            np.array(codes, dtype="<u2"),
            np.concatenate(values).astype("<i4"),
            np.array([len(v) for v in values], dtype="<i4"),
        ]
        columns = [pa.array([c.tobytes()], pa.binary()) for c in cells]
        return pa.RecordBatch.from_arrays([*columns, pa.array([len(x)], pa.int32())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, held = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                if held and held + part.num_rows > BLOCK_ROWS:
                    yield block(pa.concat_arrays(ids), np.concatenate(xs))
                    ids, xs, held = [], [], 0
                ids.append(part.column("vec_id"))
                xs.append(part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, how.size))
                held += part.num_rows
        if held:
            yield block(pa.concat_arrays(ids), np.concatenate(xs))

    return vectors.mapInArrow(run, BLOCKS)


def distances(row: dict, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of a block's vectors to every centroid, gathered from tables: ``(vectors, centroids)``."""
    codes = np.frombuffer(row["codes"], "<u2").reshape(centroids.shape[1], -1)
    values, ends = np.frombuffer(row["values"], "<i4").astype(np.int64), np.cumsum(np.frombuffer(row["sizes"], "<i4"))
    total = np.zeros((codes.shape[1], len(centroids)), dtype=np.int64)
    for d, (code, end) in enumerate(zip(codes, ends)):
        occurring = values[0 if d == 0 else ends[d - 1] : end]
        table = (occurring[:, None] - centroids[None, :, d]) ** 2
        total += table[code]
    return total


def over_blocks(blocks: DataFrame, columns: list[str], function, schema: str) -> DataFrame:
    """Run ``function`` from a block to output columns over every block; one block is unpacked at a time."""
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                out = function({c: batch.column(c)[at].as_py() for c in columns})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return blocks.select(*columns).mapInArrow(run, schema)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor of the mean of their vectors, ties in distance to the smaller number."""
    k, size = centroids.shape

    def partial(row: dict) -> dict:
        nearest = distances(row, centroids).argmin(axis=1)
        codes = np.frombuffer(row["codes"], "<u2").reshape(size, -1)
        values, ends = np.frombuffer(row["values"], "<i4").astype(np.int64), np.cumsum(np.frombuffer(row["sizes"], "<i4"))
        sums = np.zeros((k, size), dtype=np.int64)
        for d, (code, end) in enumerate(zip(codes, ends)):
            np.add.at(sums[:, d], nearest, values[0 if d == 0 else ends[d - 1] : end][code])
        counts = np.bincount(nearest, minlength=k)
        there = np.flatnonzero(counts)
        return {"cluster": there.tolist(), "n": counts[there].tolist(), "sums": sums[there].tolist()}

    parts = over_blocks(blocks, ["codes", "values", "sizes"], partial, SUMS)
    totals = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(size)]).alias("sums")
    )
    out = centroids.copy()
    for row in totals.collect():  # one row per centroid
        out[row["cluster"]] = [s // row["n"] for s in row["sums"]]
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every vector."""

    def nearest(row: dict) -> dict:
        away = distances(row, centroids)
        cluster = away.argmin(axis=1)
        ids, missing = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["missing"], np.uint8).astype(bool)
        return {
            "vec_id": pa.array(ids, pa.int64(), mask=missing),
            "cluster": pa.array(cluster, pa.int32()),
            "distance": pa.array(away[np.arange(len(away)), cluster], pa.int64()),
        }

    return over_blocks(blocks, ["ids", "missing", "codes", "values", "sizes"], nearest, ASSIGNED)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    rows: DataFrame, how: Clustering = Clustering(), id_column: str = "vec_id", vector_column: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` for every vector that takes part, and the final centroids.

    Vectors that are null, of another size, or hold a null or non-finite part take no part.  Repeated rows count as
    often as they come; rows without an id are clustered, but none of them starts a cluster.  Fewer vectors with an
    id than ``k`` give fewer centroids; without any, rows have neither cluster nor distance.  An empty table gives an
    empty table; other columns are ignored.  A component of 2 ** 17 or more raises an error, since distances would
    not fit in a long.  A round that moves no centroid is the last, as further rounds would repeat it.
    """
    vectors = settle(integers(rows, how, id_column, vector_column))
    centroids = starting(vectors, how)
    if not len(centroids):
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"))]
        return vectors.select("vec_id", *nothing), centroids
    blocks = settle(coded(vectors, how))
    for _ in range(how.rounds):
        after = moved(blocks, centroids)
        if np.array_equal(after, centroids):
            break
        centroids = after
    return settle(assigned(blocks, centroids)), centroids


def with_inertia(clusters: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``clusters`` with the distance summed over the row's cluster and over all rows, and the centroid's digest.

    A sum that does not fit in a long is null.
    """
    amount = F.sum(F.col("distance").cast("decimal(38,0)")).alias("amount")
    own = {r["cluster"]: int(r["amount"]) for r in clusters.where("cluster is not null").groupBy("cluster").agg(amount).collect()}
    every = sum(own.values())

    def as_long(value: int) -> int | None:
        return value if value < 1 << 63 else None

    # one row per centroid
    small = clusters.sparkSession.createDataFrame(
        [(i, as_long(own.get(i, 0)), as_long(every), digest(c)) for i, c in enumerate(centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return clusters.join(F.broadcast(small), "cluster", "left")


def rounds_in_sql(how: Clustering) -> str:
    """The unrolled rounds for :data:`SQL`."""
    out = []
    for r in range(1, how.rounds + 1):
        out.append(f"""
), away{r} AS (
  SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM parts v JOIN centre{r - 1} c ON v.d = c.d GROUP BY v.r, c.c
), near{r} AS (
  SELECT r, arg_min(c, (distance, c)) AS c FROM away{r} GROUP BY r
), mean{r} AS (
  SELECT c, d, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM near{r} JOIN parts USING (r) GROUP BY c, d
), centre{r} AS (
  SELECT o.c, o.d, CASE WHEN n IS NULL THEN o.x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x
  FROM centre{r - 1} o LEFT JOIN mean{r} m ON o.c = m.c AND o.d = m.d""")
    return "".join(out)


HOW = Clustering()
SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) = {HOW.size} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), parts AS MATERIALIZED (
  SELECT r, d, floor({HOW.scale} * e[d])::BIGINT AS x FROM kept, unnest(range(1, {HOW.size + 1})) AS u(d)
), first AS (
  SELECT r, row_number() OVER (ORDER BY sha256('{HOW.seed}:' || vec_id::VARCHAR), e) - 1 AS c
  FROM kept WHERE vec_id IS NOT NULL
), centre0 AS (
  SELECT c, d, x FROM first JOIN parts USING (r) WHERE c < {HOW.k}{rounds_in_sql(HOW)}
), away AS (
  SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM parts v JOIN centre{HOW.rounds} c ON v.d = c.d GROUP BY v.r, c.c
), near AS (
  SELECT r, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM away GROUP BY r
), names AS (
  SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM centre{HOW.rounds} GROUP BY c
)
SELECT vec_id, c::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN near USING (r) JOIN names USING (c)
"""
