"""Dataset versions by a commit log: tables are written first, and one small file then makes them a version.

A dataset's log holds one file per commit, named by its number and created only where no other stands, so two writers
never share a version: the later one takes the next number.  Readers see what the log names and nothing else.  A log
file that is empty or cut short names nothing, and tables of a writer that died go with the next vacuum.
"""

from __future__ import annotations

import json
import time
import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.operators import catalog
from granary.session import settle

LOG = (
    "dataset_id string, version int, kind string, created_at string, "
    "tables array<struct<table_name: string, row_count: bigint, column_count: int, columns: array<string>, path: string>>"
)
TABLES, REMOVAL = "tables", "removal"
#: Unnamed tables younger than this may belong to a writer that has not committed yet.
GRACE_SECONDS = 24 * 3600


def located(spark: SparkSession, path: str):
    """The file system of a path, and the path as that file system names it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(place)


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; false where one stands already.  Of several writers exactly one succeeds."""
    system, place = located(spark, path)
    system.mkdirs(place.getParent())
    try:
        if system.getScheme() == "file":  # there Hadoop looks and creates in two steps
            with open(place.toUri().getPath(), "x", encoding="utf-8") as file:
                file.write(text)
        else:
            stream = system.create(place, False)
            stream.write(bytearray(text, "utf-8"))
            stream.close()
    except (FileExistsError, Py4JJavaError):
        if system.exists(place):
            return False
        raise
    return True


def folder(dataset: str) -> str:
    return quote(dataset, safe="")


def last_number(spark: SparkSession, root: str, dataset: str) -> int:
    system, place = located(spark, f"{root}/{folder(dataset)}/log")
    if not system.exists(place):
        return 0
    names = [status.getPath().getName() for status in system.listStatus(place)]
    return max((int(n[: -len(".json")]) for n in names if n.endswith(".json")), default=0)


def append(spark: SparkSession, root: str, dataset: str, entry: dict) -> int:
    """Put an entry at the end of a dataset's log; its number."""
    number = last_number(spark, root, dataset)
    while True:
        number += 1
        line = json.dumps({"dataset_id": dataset, "version": number, **entry}, ensure_ascii=False) + "\n"
        if put_once(spark, f"{root}/{folder(dataset)}/log/{number:012d}.json", line):
            return number


def publish(root: str, dataset: str, tables: dict[str, DataFrame], created_at: str) -> int:
    """Write tables as the next version of a dataset; all of them become visible at once, or none."""
    spark = next(iter(tables.values())).sparkSession
    base = f"{folder(dataset)}/data/{uuid.uuid4().hex}"
    paths = {name: f"{base}/{quote(name, safe='')}.parquet" for name in tables}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{paths[name]}")
    stored = {name: spark.read.parquet(f"{root}/{paths[name]}") for name in tables}
    facts = [row.asDict() for row in catalog.describe_tables(stored).collect()]  # a row per table
    entry = {"kind": TABLES, "created_at": created_at, "tables": [{**f, "path": paths[f["table_name"]]} for f in facts]}
    return append(spark, root, dataset, entry)


def entries(spark: SparkSession, root: str) -> DataFrame:
    system, place = located(spark, f"{root}/*/log/*.json")
    if not system.globStatus(place):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(f"{root}/*/log/*.json").where("version IS NOT NULL AND kind IS NOT NULL")


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The catalog: a row per table of every version that was committed and not removed since."""
    log = entries(spark, root)
    removed = log.where(F.col("kind") == REMOVAL).groupBy("dataset_id").agg(F.max("version").alias("_until"))
    live = (
        log.where(F.col("kind") == TABLES)
        .join(removed, "dataset_id", "left")
        .where(F.col("_until").isNull() | (F.col("version") > F.col("_until")))
    )
    one = live.select("dataset_id", "version", "created_at", F.explode("tables").alias("_t"))
    return one.select(
        "dataset_id",
        "version",
        "created_at",
        "_t.table_name",
        "_t.row_count",
        "_t.column_count",
        "_t.columns",
        F.concat(F.lit(f"{root}/"), "_t.path").alias("path"),
        catalog.provenance_id(F.col("dataset_id"), F.col("version"), F.col("_t.table_name"), F.col("created_at")).alias(
            "provenance_id"
        ),
    )


def open_table(spark: SparkSession, root: str, dataset: str, table: str, version: int | None = None) -> DataFrame:
    """A table of a version, of the newest that holds it where none is named."""
    found = versions(spark, root).where((F.col("dataset_id") == dataset) & (F.col("table_name") == table))
    if version is not None:
        found = found.where(F.col("version") == version)
    row = found.orderBy(F.col("version").desc()).first()
    if row is None:
        raise LookupError(f"no table {table!r} in version {version or 'any'} of dataset {dataset!r}")
    return spark.read.parquet(row["path"])


def cleanup(spark: SparkSession, root: str, datasets: list[str]) -> DataFrame:
    """Remove all versions of the datasets named and delete their stored tables; counts per dataset.

    The removal is committed before anything is deleted, so a reader of the log never meets a version without its
    tables, and what an interrupted cleanup leaves is unnamed and goes with the next vacuum.
    """
    mine = settle(versions(spark, root).where(F.col("dataset_id").isin(datasets)))
    known = {row["dataset_id"]: row for row in mine.groupBy("dataset_id").agg(
        F.countDistinct("version").alias("versions"), F.count("*").alias("tables")
    ).collect()}
    for dataset in known:
        append(spark, root, dataset, {"kind": REMOVAL})
    deleted = dict.fromkeys(datasets, 0)
    for row in mine.select("dataset_id", "path").toLocalIterator():
        system, place = located(spark, row["path"])
        deleted[row["dataset_id"]] += int(system.delete(place, True))
    rows = [
        (d, known[d]["versions"] if d in known else 0, known[d]["tables"] if d in known else 0, deleted[d])
        for d in deleted
    ]
    return spark.createDataFrame(
        rows, "dataset_id string, datasets_deleted bigint, tables_deleted bigint, paths_deleted bigint"
    )


def vacuum(spark: SparkSession, root: str, grace_seconds: float = GRACE_SECONDS) -> int:
    """Delete folders of tables that no live version names and that are older than the grace; how many."""
    system, place = located(spark, f"{root}/*/data/*")
    limit = (time.time() - grace_seconds) * 1000
    old = [
        (f"{s.getPath().getParent().getParent().getName()}/data/{s.getPath().getName()}",)
        for s in system.globStatus(place) or []
        if s.getModificationTime() <= limit
    ]  # a name per version
    if not old:
        return 0
    inside = F.substring("path", F.lit(len(root) + 2), F.length("path"))
    named = versions(spark, root).select(F.substring_index(inside, "/", 3).alias("folder")).distinct()
    count = 0
    for row in settle(spark.createDataFrame(old, "folder string").join(named, "folder", "left_anti")).toLocalIterator():
        system, place = located(spark, f"{root}/{row['folder']}")
        count += int(system.delete(place, True))
    return count
