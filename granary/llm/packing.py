"""Packing by concatenation: documents end to end, cut into windows of fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.llm.batches import arrow_schema, pieces
from granary.llm.tokens import encoder, packed
from granary.session import settle

END_ID = 0
LENGTH = 1024
TOKENS = "part int, local long, doc_id long, n long, ids binary"


def token_ids(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID) -> DataFrame:
    """First pass: ids of every text, with the number of its partition and the ids before it in that partition.

    A row per document: ``(part, local, doc_id, n, ids)``; ids are 32-bit little-endian, the end id included.  Null
    texts are empty.  The table is written, so the second pass and a retried task see the same partitions.
    """
    schema = arrow_schema(TOKENS)
    tail = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            for piece in pieces(batch):
                texts, counts, starts, blobs = piece.column("text").to_pylist(), [], [], []
                for text in texts:
                    ids = (encode.ids(text) if text else []) + tail
                    starts.append(local)
                    counts.append(len(ids))
                    blobs.append(packed(ids))
                    local += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(texts), pa.int32()),
                        pa.array(starts, pa.int64()),
                        piece.column("doc_id"),
                        pa.array(counts, pa.int64()),
                        pa.array(blobs, pa.binary()),
                    ],
                    schema=schema,
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(narrow.mapInArrow(run, TOKENS))


def part_offsets(tokens: DataFrame) -> DataFrame:
    """``(part, before, total)``: ids in all earlier partitions; one small row per partition of the first pass."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("size"))
    ordered = Window.orderBy("part")
    return totals.select(
        "part",
        F.coalesce(F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("size").over(Window.partitionBy()).alias("total"),
    )


def concatenate_and_cut(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Second pass: every document's pieces in the windows of ``length`` ids that it falls in.

    Columns: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset, padded``.  The windows are full but for
    the last, which is padded to the next power of two (``padded``); a document crosses a window's end as two
    pieces.  Every id lies in exactly one piece, and offsets in a window leave no gap.  A table without rows gives
    none; a document without ids (no end id, empty text) has no piece.
    """
    offsets = settle(part_offsets(tokens))  # its size is then known, so that the join needs no shuffle of ids
    size = F.lit(length)
    begin, end = F.col("before") + F.col("local"), F.col("before") + F.col("local") + F.col("n")
    placed = tokens.where("n > 0").join(offsets, "part").withColumns({"_begin": begin, "_end": end})

    def cut(window: Column) -> Column:
        first = F.greatest(F.col("_begin"), window * size)
        last = F.least(F.col("_end"), (window + 1) * size)
        at, count = (first - F.col("_begin")), last - first
        return F.struct(
            at.alias("start"),
            count.alias("length"),
            F.substring("ids", (at * 4 + 1).cast("int"), (count * 4).cast("int")).alias("ids"),
            window.alias("sequence_id"),
            (first - window * size).alias("offset"),
        )

    windows = F.sequence(F.floor(F.col("_begin") / size), F.floor((F.col("_end") - 1) / size))
    rows = placed.select("doc_id", F.col("n").alias("doc_tokens"), "total", F.explode(F.transform(windows, cut)).alias("p"))
    left = F.col("total") - F.col("p.sequence_id") * size
    padded = F.when(left >= size, size.cast("long")).otherwise(F.pow(F.lit(2), F.ceil(F.log2(left))).cast("long"))
    return rows.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset", padded.alias("padded"))


def boundaries(pieces_: DataFrame) -> DataFrame:
    """Boundary records: one row per sequence with its pieces in order and whether it opens and ends inside a document."""
    piece = F.struct("offset", "doc_id", "start", "length")
    return pieces_.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(piece)).alias("pieces"),
        F.max((F.col("offset") == 0) & (F.col("start") > 0)).alias("opens_inside"),
        F.max(F.col("start") + F.col("length") < F.col("doc_tokens")).alias("ends_inside"),
        F.sum("length").alias("filled"),
        F.max("padded").alias("padded"),
    )


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int | None = END_ID) -> DataFrame:
    """Both passes over a table of documents; rows keep no order but that of the input's partitions.

    Null ids stay null, repeated rows are packed as often as they come, other columns are ignored.
    """
    return concatenate_and_cut(token_ids(docs, tokenizer, end_id), length)
