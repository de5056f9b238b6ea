"""Stored rows that change: collections in partition folders, ids in buckets, and only touched buckets written again.

A store is a Parquet table partitioned by its collection columns and a bucket of the id.  An upsert or delete reads the
buckets it touches, writes them again by dynamic overwrite and leaves all other files alone.  A deleted id leaves a
marker with its version behind, so that news older than the delete does not bring it back; compaction drops markers.
One writer at a time; an interrupted change is completed by running it again, and a repeated one writes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from granary.operators import vectors
from granary.operators.ordering import first_per_group
from granary.session import settle

BUCKET, GONE = "bucket", "is_deleted"
VECTOR_PARTS = ("dim", "embedding_mode", "embedding_model")


@dataclass(frozen=True)
class Store:
    """``key`` names a row inside its collection (``parts``); of two rows with one key the larger ``version`` holds."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    version: tuple[str, ...]
    parts: tuple[str, ...] = ()
    buckets: int = 16

    @property
    def place(self) -> list[str]:
        return [*self.parts, BUCKET]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def stored(self) -> DataFrame:
        """All rows with their bucket, deleted ones included; an empty collection name reads as null."""
        fields = [f for f in self.schema.fields if f.name not in self.parts]
        fields += [T.StructField(GONE, T.BooleanType()), *[self.schema[p] for p in self.parts], T.StructField(BUCKET, T.IntegerType())]
        return self.spark.read.schema(T.StructType(fields)).parquet(self.path)

    def rows(self) -> DataFrame:
        return self.stored().where(~F.col(GONE)).select(self.schema.names)

    def write(self, rows: DataFrame, mode: str) -> None:
        out = rows.repartition(*self.place).sortWithinPartitions(*self.place, self.key)
        out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*self.place).parquet(self.path)


def shaped(store: Store, rows: DataFrame, gone: bool = False) -> DataFrame:
    """Rows as they are stored, the newest of each key; an empty collection name is null."""
    named = [F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) if c in store.parts else F.col(c) for c in store.schema.names]
    rows = rows.select(*named).select("*", F.lit(gone).alias(GONE), store.bucket())
    return first_per_group(rows, [*store.place, store.key], [F.col(c).desc_nulls_last() for c in store.version])


def create(
    rows: DataFrame, path: str, key: str, version: tuple[str, ...], parts: tuple[str, ...] = (), buckets: int = 16
) -> Store:
    """A store of ``rows``; of rows that share a key the newest is kept."""
    store = Store(rows.sparkSession, path, rows.schema, key, tuple(version), tuple(parts), buckets)
    store.write(shaped(store, rows), "errorifexists")
    return store


def touched(store: Store, changes: DataFrame) -> Column:
    """The partitions that ``changes`` fall in, as a condition on folders; as many as the layout has at most."""
    places = changes.groupBy(*store.parts).agg(F.collect_set(BUCKET).alias("buckets")).collect()
    condition = F.lit(False)
    for row in places:
        own = F.col(BUCKET).isin(row["buckets"])
        for part in store.parts:
            own &= F.col(part).eqNullSafe(F.lit(row[part]).cast(store.schema[part].dataType))
        condition |= own
    return condition


def same_row(store: Store, left: DataFrame, right: DataFrame) -> Column:
    return reduce(Column.__and__, [left[c].eqNullSafe(right[c]) for c in (*store.place, store.key)])


def put(store: Store, changes: DataFrame) -> int:
    """Write stored-form ``changes`` that are newer than what the store holds; the number of rows written anew."""
    changes = settle(changes)
    current = store.stored().where(touched(store, changes))
    held = current.select(*store.place, store.key, F.struct(*store.version).alias("_held"), F.col(GONE).alias("_gone"))
    newer = F.struct(*[changes[c] for c in store.version])
    # a delete has the version of the row it deletes
    news = held["_held"].isNull() | (newer > held["_held"]) | ((newer == held["_held"]) & changes[GONE] & ~held["_gone"])
    fresh = settle(changes.join(held, same_row(store, changes, held), "left").where(news).select(*[changes[c] for c in changes.columns]))
    written = fresh.count()
    if written:
        before = store.stored().where(touched(store, fresh))
        rest = before.join(fresh, same_row(store, before, fresh), "left_anti")
        store.write(settle(rest.unionByName(fresh)), "overwrite")
    return written


def upsert(store: Store, changes: DataFrame) -> int:
    """Insert or replace rows by key where they are newer; files of buckets without news keep their names."""
    return put(store, shaped(store, changes))


def delete_where(store: Store, condition: Column) -> int:
    """Delete the rows that ``condition`` holds for; the number of rows deleted."""
    hit = store.stored().where(~F.col(GONE) & F.coalesce(condition, F.lit(False)))
    kept = {store.key, *store.version, *store.place}
    blank = [F.col(c) if c in kept else F.lit(None).cast(hit.schema[c].dataType).alias(c) for c in hit.columns if c != GONE]
    return put(store, hit.select(*blank, F.lit(True).alias(GONE)).select(hit.columns))


def compact(store: Store) -> int:
    """Drop the markers of deleted rows; the number dropped.  A bucket without any other row keeps one, as it keeps its folder."""
    marked = store.stored().where(GONE)
    mine = store.stored().where(touched(store, marked))
    first = settle(first_per_group(mine, store.place, [F.col(GONE).asc(), F.col(store.key).asc()]).where(GONE))
    dropped = mine.where(GONE).count() - first.count()
    if dropped:
        store.write(settle(mine.where(~F.col(GONE)).unionByName(first)), "overwrite")
    return dropped


def nearest(store: Store, vector: str, queries: DataFrame, query: str, point: str, k: int) -> DataFrame:
    """The k nearest stored vectors of each query inside its own collection: query, id, distance, rank.

    ``queries`` carry the embedding mode and model; their point gives the dimension.  Folders of other collections are
    left out while the query runs, by the collections that the queries name.
    """
    asked = queries.withColumn("dim", F.size(point))
    names = asked.where(F.col("dim") > 0).select(*VECTOR_PARTS).distinct()  # a row per collection asked
    mine = store.rows().join(F.broadcast(names), list(VECTOR_PARTS), "left_semi")
    scope = F.concat_ws(":", "embedding_mode", "embedding_model")
    return vectors.nearest(
        mine.withColumn("scope", scope), store.key, vector, asked.withColumn("scope", scope), query, point, k, "scope"
    )
