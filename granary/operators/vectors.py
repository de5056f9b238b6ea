"""Vector collections: pooling, checks, identity, upsert and nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from granary.operators.ordering import first_per_group

#: Vectors one task compares with the queries sent to it.
BLOCK_ROWS = 4096


def dimension(vectors: DataFrame, vector: str) -> int:
    """Length of the first vector."""
    row = vectors.select(F.size(vector)).first()
    return int(row[0]) if row else 0


def mean_pool(vectors: DataFrame, by: Sequence[str], vector: str, digits: int = 6) -> DataFrame:
    """Average vector per group; a vector of another length raises.

    One average per position in a single aggregate: it combines on the map side and explodes nothing.
    """
    size = dimension(vectors, vector)
    same = F.when(F.size(vector) == size, F.col(vector)).otherwise(
        F.raise_error(F.lit("vectors of one collection differ in length")).cast(vectors.schema[vector].dataType)
    )
    checked = vectors.select(*by, same.alias("_v"))
    return checked.groupBy(*by).agg(
        F.array(*[F.round(F.avg(F.get("_v", F.lit(i)).cast("double")), digits) for i in range(size)]).alias("vector")
    )


def dimension_check(vectors: DataFrame, key: str, vector: str, expected: int) -> DataFrame:
    """Vectors in all, those of another dimension, and one of them as an example."""
    wrong = F.size(vector) != expected
    return vectors.agg(
        F.count("*").alias("vectors"),
        F.count_if(wrong).alias("wrong_dimension"),
        F.min(F.when(wrong, F.col(key))).alias("first_wrong"),
    )


def collection_name(base: str, size: Column, mode: Column, model: Column) -> Column:
    """Base, dimension and, where known, the embedding identity with a short hash."""
    stem = F.concat(F.lit(f"{base}_"), size.cast("string"), F.lit("d"))
    mark = F.substring(F.sha1(F.concat_ws(":", mode, model).cast("binary")), 1, 10)
    return F.when((mode == "") & (model == ""), stem).otherwise(F.concat_ws("_", stem, mode, model, mark))


def write_collections(vectors: DataFrame, path: str) -> None:
    """One directory per dimension, mode and model; a search then reads only its own."""
    vectors.write.partitionBy("dim", "embedding_mode", "embedding_model").parquet(path)


def upsert(rows: DataFrame, changes: DataFrame, key: str, version: Sequence[str]) -> DataFrame:
    """The newest row per id of old and new rows together."""
    fields = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*fields), F.struct(*version))
    return rows.unionByName(changes).groupBy(key).agg(newest.alias("_row")).select(key, "_row.*")


def delete_where(rows: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows left after a delete by metadata, and how many went."""
    gone = F.coalesce(condition, F.lit(False))
    return rows.filter(~gone), rows.agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


def nearest(
    vectors: DataFrame,
    key: str,
    vector: str,
    queries: DataFrame,
    query_key: str,
    query_vector: str,
    k: int,
    scope: str | None = None,
) -> DataFrame:
    """The k nearest vectors of each query by squared L2: query, id, distance, rank.

    Vectors are dealt over blocks of about ``BLOCK_ROWS`` per scope value and dimension; a query goes to the blocks of
    its own scope and dimension only and brings k rows back from each, whatever the number of vectors.  Both sides
    are distributed.  Null vectors, null scopes and vectors of another dimension take no part.
    """
    own = F.col(scope) if scope else F.lit(0)
    place = ["_scope", "_size"]
    rows = vectors.select(F.col(key), F.col(vector).cast("array<double>").alias("_x"), own.alias("_scope"))
    rows = rows.where(F.col("_x").isNotNull()).withColumn("_size", F.size("_x"))
    asked = queries.select(F.col(query_key), F.col(query_vector).cast("array<double>").alias("_q"), own.alias("_scope"))
    asked = asked.where(F.col("_q").isNotNull()).withColumn("_size", F.size("_q"))
    blocks = rows.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_blocks"))
    block = F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int").alias("_block")
    dealt = rows.join(blocks, place).select(*place, block, key, "_x")
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block")
    sent = asked.join(blocks, place).select(*place, every, query_key, "_q")
    schema = T.StructType(
        [queries.schema[query_key], vectors.schema[key], T.StructField("distance", T.DoubleType())]
    )
    found = (
        dealt.groupBy(*place, "_block")
        .cogroup(sent.groupBy(*place, "_block"))
        .applyInPandas(_nearest_in_block(key, query_key, k), schema)
    )
    order = [F.col("distance").asc(), F.col(key).asc()]
    ranked = first_per_group(found, [query_key], order, k)
    rank = Window.partitionBy(query_key).orderBy(*order)  # at most k rows per query
    return ranked.withColumn("rank", F.row_number().over(rank))


def _nearest_in_block(key: str, query_key: str, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(block: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if block.empty or asking.empty:
            return pd.DataFrame({query_key: [], key: [], "distance": []})
        rows, ids = np.array(block["_x"].tolist(), dtype="float64"), block[key].to_numpy()
        parts = []
        for query, point in zip(asking[query_key], asking["_q"]):
            distance = np.round(((rows - np.asarray(point, dtype="float64")) ** 2).sum(axis=1), 6)
            best = np.lexsort((ids, distance))[:k]
            parts.append(pd.DataFrame({query_key: query, key: ids[best], "distance": distance[best]}))
        return pd.concat(parts, ignore_index=True)

    return search


def with_distance(vectors: DataFrame, vector: str, point: Sequence[float], name: str = "distance") -> DataFrame:
    """Squared L2 distance of every row to one query vector."""
    target = F.array(*[F.lit(float(x)) for x in point])
    square = F.zip_with(F.col(vector).cast("array<double>"), target, lambda a, b: (a - b) * (a - b))
    return vectors.withColumn(name, F.round(F.aggregate(square, F.lit(0.0), lambda s, x: s + x), 6))


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def multi_collection(scored: DataFrame, collection: str, key: str, per_collection: int, k: int) -> DataFrame:
    """The best of each collection, merged and cut again."""
    order = [F.col("distance").asc(), F.col(key).asc()]
    return first_per_group(scored, [collection], order, per_collection).orderBy(*order).limit(k)


def filtered_fetch(rows: DataFrame, condition: Column, collection: str, order: Sequence[str], cap: int) -> DataFrame:
    return first_per_group(rows.filter(condition), [collection], [F.col(c).asc() for c in order], cap)
