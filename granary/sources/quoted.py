"""Delimited files with line breaks inside quotes, read by as many tasks as their size asks for.

A block of a file (what one task reads of it) may begin inside a quoted field.  A first pass works out, for each block
and either state it may begin in, the state it ends in; these small maps are composed along each file, which gives the
state every block begins in.  A second pass then cuts its block into records from a true record start.  What a block
holds of a record that began before or goes on after it is a fragment, and fragments are put together by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

QUOTE = b'"'
STATES = "file string, block long, from_outside boolean, from_inside boolean"
RECORDS = "file string, block long, opens boolean, closes boolean, first boolean, record binary"


def ends_inside(line: bytes, inside: bool, delimiter: bytes) -> bool:
    """Whether a quoted field is open at the end of ``line``.

    A quote opens a field only where the field begins, a doubled one inside a quoted field is text, and what follows the
    closing quote up to the delimiter is text again.
    """
    if QUOTE not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] == QUOTE:
                inside, at = True, at + 1
            else:
                at = line.find(delimiter, at) + len(delimiter)
                if at < len(delimiter):
                    return False
                continue
        while inside:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == QUOTE:
                at += 2
            else:
                inside, at = False, at + 1
        at = line.find(delimiter, at) + len(delimiter)
        if at < len(delimiter):
            return False


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, line)`` in the order of each block, which holds as long as nothing is shuffled."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )


def by_block(batches: Iterator[pa.RecordBatch], *more: str):
    """``(file, block, more, line)`` of every line of a task, in order."""
    for batch in batches:
        places = zip(*[batch.column(c).to_pylist() for c in ("file", "block", *more, "line")])
        yield from places


def block_states(lines: DataFrame, delimiter: str) -> DataFrame:
    """Per block the state at its end for both states it may begin in: one small row per block."""
    sign = delimiter.encode()

    def run(batches):
        own, out = None, None
        for file, block, line in by_block(batches):
            if own != (file, block):
                if own:
                    yield row(own, out)
                own, out = (file, block), (False, True)
            if QUOTE in line:
                out = tuple(ends_inside(line, state, sign) for state in out)
        if own:
            yield row(own, out)

    def row(own, out):
        return pa.RecordBatch.from_pydict(
            {"file": [own[0]], "block": pa.array([own[1]], pa.int64()), "from_outside": [out[0]], "from_inside": [out[1]]}
        )

    return lines.mapInArrow(run, STATES)


def begin_states(states: DataFrame) -> DataFrame:
    """``(file, block, inside, next_inside)``: the state each block begins in, by composing the maps of the blocks before it.

    A map of two states keeps them, swaps them or forgets them.  So the state is what the last forgetting block left,
    swapped as often as blocks since then swap; without such a block a file begins outside.
    """
    along = Window.partitionBy("file").orderBy("block")
    forgets = F.col("from_outside") == F.col("from_inside")
    swaps = F.col("from_outside") & ~F.col("from_inside")
    turned = states.withColumn("swaps", F.sum(swaps.cast("int")).over(along))
    left = F.struct(F.col("from_outside").alias("state"), F.col("swaps").alias("swaps"))
    turned = turned.withColumn("left", F.last(F.when(forgets, left), ignorenulls=True).over(along))
    state = F.coalesce(F.col("left.state"), F.lit(False)).cast("int")
    turns = F.col("swaps") - F.coalesce(F.col("left.swaps"), F.lit(0))
    after = turned.withColumn("next_inside", ((state + turns) % 2) == 1)
    return after.select("file", "block", F.coalesce(F.lag("next_inside").over(along), F.lit(False)).alias("inside"), "next_inside")


def records(lines: DataFrame, begins: DataFrame, delimiter: str, fragments: bool) -> DataFrame:
    """Records of every block, or only the fragments of records that span blocks.

    ``opens``: the record begins in this block; ``closes``: it ends here; ``first``: it is the first of its file.
    ``begins`` holds one row per block, a millionth of the files, and is sent to the tasks.
    """
    sign = delimiter.encode()
    if fragments:
        begins = begins.where("inside or next_inside")
    placed = lines.join(F.broadcast(begins), ["file", "block"]).select("file", "block", "inside", "line")
    names = ["file", "block", "opens", "closes", "first", "record"]

    def run(batches):
        own, held, opens, state, first, out = None, [], True, False, False, []

        def close(closes: bool):
            nonlocal held, opens, first
            if fragments != (opens and closes):
                out.append((own[0], own[1], opens, closes, first, b"\n".join(held)))
            held, opens, first = [], True, False

        def emit():
            nonlocal out
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), *[pa.bool_()] * 3, pa.binary()))]
            out = []
            return pa.RecordBatch.from_arrays(columns, names=names)

        size = 0
        for file, block, inside, line in by_block(batches, "inside"):
            if own != (file, block):
                if held:
                    close(False)
                own, state, opens, first = (file, block), inside, not inside, block == 0
            held.append(line)
            size += len(line)
            state = ends_inside(line, state, sign)
            if not state:
                close(True)
            if out and size > 1 << 20:
                size = 0
                yield emit()
        if held:
            close(False)
        if out:
            yield emit()

    return placed.mapInArrow(run, RECORDS)


def stitched(fragments: DataFrame) -> DataFrame:
    """Whole records from fragments: ``(first, record)``; one that the file ends in is taken as it is."""
    along = Window.partitionBy("file").orderBy("block", "opens")
    chained = fragments.withColumn("chain", F.sum(F.col("opens").cast("int")).over(along))
    pieces = F.array_sort(F.collect_list(F.struct("block", "record")))["record"]
    # binary is joined as text, which changes no byte
    joined = F.array_join(F.transform(pieces, lambda p: p.cast("string")), "\n").cast("binary")
    return chained.groupBy("file", "chain").agg(F.bool_or("first").alias("first"), joined.alias("record")).select("first", "record")


def read_records(spark: SparkSession, path: str, delimiter: str, settle) -> DataFrame:
    """``(first, record)``: every record of the files as bytes, whether it is the first of its file."""
    lines = lines_of(spark, path)
    begins = settle(begin_states(block_states(lines, delimiter)))
    pieces = settle(stitched(records(lines, begins, delimiter, fragments=True)))
    whole = records(lines, begins, delimiter, fragments=False).select("first", "record")
    return whole.unionByName(pieces)
