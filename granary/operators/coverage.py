"""Which rows and chunks an answer really used."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.operators.ordering import PIECE, attach, carried, first_per_group, in_pieces, with_running_sum
from granary.operators.packing import packed

# Limits of reports and batches.
SOURCE_LINES = 8
SHOWN_RANGES = 4
BATCH_DOCS = 12
BATCH_CHARS = 25_000
CRITIC_CHARS = 12_000
PREVIEW_CHARS = 220


def merge_ranges(ranges: DataFrame, group: Sequence[str], start: str = "row_start", end: str = "row_end") -> DataFrame:
    """Union of overlapping or adjacent ranges per group.

    Ranges with one start collapse first.  The running end crosses pieces of a large group as a carried
    maximum, and so does the start of the island a piece begins in.
    """
    low, high = F.least(start, end), F.greatest(start, end)
    reduced = ranges.groupBy(*group, low.alias("_s")).agg(F.max(high).alias("_e"))
    pieces = in_pieces(reduced, group, ["_s"])
    before = Window.partitionBy(*group, PIECE).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ends = carried(pieces, group, {"_m": F.max("_e")}, {"_carried_end": F.max("_m")})
    opened = attach(pieces.withColumn("_local_end", F.max("_e").over(before)), ends, group).withColumn(
        "_island",
        F.when(F.col("_s") > F.coalesce(F.greatest("_local_end", "_carried_end"), F.col("_s") - 2) + 1, F.col("_s")),
    )
    starts = carried(opened, group, {"_m": F.max("_island")}, {"_carried_start": F.max("_m")})
    upto = Window.partitionBy(*group, PIECE).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    placed = attach(opened.withColumn("_here", F.max("_island").over(upto)), starts, group)
    return placed.groupBy(*group, F.coalesce("_here", "_carried_start").alias(start)).agg(F.max("_e").alias(end))


def row_coverage_by(chunks: DataFrame, group: Sequence[str] = ("file_id", "sheet_name")) -> DataFrame:
    """Expected and retrieved rows per file and sheet."""
    expected = chunks.groupBy(*group).agg(
        F.greatest(F.max(F.greatest("row_start", "row_end")), F.max("total_rows")).alias("rows_expected")
    )
    merged = merge_ranges(chunks.filter("row_start IS NOT NULL AND row_end IS NOT NULL"), list(group))
    used = merged.groupBy(*group).agg(F.sum(F.col("row_end") - F.col("row_start") + 1).alias("rows_retrieved"))
    return expected.join(used, list(group), "left").select(
        *group, F.coalesce("rows_expected", F.lit(0)).alias("rows_expected"), F.coalesce("rows_retrieved", F.lit(0)).alias("rows_retrieved")
    )


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(part / F.nullif(whole, F.lit(0)), 6), F.lit(0.0))


def row_coverage(chunks: DataFrame, group: Sequence[str] = ("file_id", "sheet_name")) -> DataFrame:
    totals = row_coverage_by(chunks, group).agg(
        F.coalesce(F.sum("rows_expected"), F.lit(0)).alias("rows_expected_total"),
        F.coalesce(F.sum("rows_retrieved"), F.lit(0)).alias("rows_retrieved_total"),
    )
    return totals.withColumn("row_coverage_ratio", ratio(F.col("rows_retrieved_total"), F.col("rows_expected_total")))


def chunk_coverage(expected: DataFrame, retrieved: DataFrame, key: str) -> DataFrame:
    """Chunks expected and retrieved per key, their ratio and whether nothing is missing."""
    want = expected.groupBy(key).agg(F.count("*").alias("expected_chunks"))
    got = retrieved.groupBy(key).agg(F.count("*").alias("retrieved_chunks"))
    both = want.join(got, key, "left").withColumn("retrieved_chunks", F.coalesce("retrieved_chunks", F.lit(0)))
    return both.withColumns(
        {
            "ratio": ratio(F.col("retrieved_chunks"), F.col("expected_chunks")),
            "complete": F.col("retrieved_chunks") >= F.col("expected_chunks"),
        }
    )


def silent_row_loss(chunk_stats: DataFrame, row_stats: DataFrame, key: str) -> DataFrame:
    """Nearly all chunks are there but rows are missing."""
    close = F.col("retrieved_chunks") >= F.greatest(F.lit(1), F.floor(F.col("expected_chunks") * 9 / 10))
    lost = (F.col("rows_expected") > 0) & (ratio(F.col("rows_retrieved"), F.col("rows_expected")) < 0.95)
    return chunk_stats.join(row_stats, key).withColumn("silent_row_loss", close & lost)


def coverage_sources(chunks: DataFrame, max_lines: int = SOURCE_LINES) -> DataFrame:
    """One line per file and sheet: its first merged row ranges, else its chunk range."""
    group = ["filename", "sheet_name"]
    merged = merge_ranges(chunks.filter("row_start IS NOT NULL AND row_end IS NOT NULL"), group)
    counts = merged.groupBy(*group).agg(F.count("*").alias("_n"))
    shown = first_per_group(merged, group, [F.col("row_start").asc()], SHOWN_RANGES)
    listed = F.transform(
        F.sort_array(F.collect_list(F.struct("row_start", "row_end"))),
        lambda s: F.concat_ws("-", s["row_start"].cast("string"), s["row_end"].cast("string")),
    )
    ranges = shown.groupBy(*group).agg(F.array_join(listed, ", ").alias("_ranges")).join(counts, group)
    spans = chunks.groupBy(*group).agg(F.min("chunk_index").alias("_lo"), F.max("chunk_index").alias("_hi"))
    joined = spans.join(ranges, group, "left")
    what = (
        F.when(
            F.col("_ranges").isNotNull(),
            F.concat(F.lit("rows="), "_ranges", F.when(F.col("_n") > SHOWN_RANGES, ", ...").otherwise("")),
        )
        .when(F.col("_lo").isNotNull(), F.concat(F.lit("chunk_range="), F.col("_lo"), F.lit("-"), F.col("_hi")))
        .otherwise("coverage=unknown")
    )
    sheet = F.when(F.coalesce("sheet_name", F.lit("")) != "", F.concat(F.lit("sheet="), F.col("sheet_name")))
    line = F.concat_ws(" | ", "filename", sheet, what)
    return joined.orderBy(*group).limit(max_lines).select("filename", "sheet_name", line.alias("line"))


def source_list(hits: DataFrame, query: str, max_lines: int = SOURCE_LINES) -> DataFrame:
    """Distinct source labels of a query in hit order."""
    sheet = F.when(F.coalesce("sheet_name", F.lit("")) != "", F.concat(F.lit("sheet="), F.col("sheet_name")))
    rows = F.when(
        F.col("row_start").isNotNull() & F.col("row_end").isNotNull(),
        F.concat(F.lit("rows="), F.col("row_start"), F.lit("-"), F.col("row_end")),
    )
    chunk = F.concat(F.lit("chunk="), F.coalesce(F.col("chunk_index").cast("string"), F.lit("?")))
    label = F.concat_ws(" | ", "filename", sheet, chunk, rows)
    first = hits.groupBy(query, label.alias("source")).agg(F.min("rank").alias("first_rank"))
    return first_per_group(first, [query], [F.col("first_rank").asc(), F.col("source").asc()], max_lines)


def batch_context(
    docs: DataFrame, request: str, order: Sequence[str], content: str, max_docs: int = BATCH_DOCS, max_chars: int = BATCH_CHARS
) -> DataFrame:
    """Documents of a request packed in order into batches of bounded count and size."""

    def reach(v: dict[str, np.ndarray], start: int) -> int:
        chars, at = 0, start
        sizes = v["_chars"]
        while at < len(sizes) and at - start < max_docs and (at == start or chars + sizes[at] <= max_chars):
            chars += sizes[at]
            at += 1
        return at

    filled = docs.withColumn("_chars", F.length(F.trim(content))).filter(F.col("_chars") > 0)
    out = packed(filled, [request], order, ["_chars"], reach, max_docs, "batch")
    return out.withColumnRenamed("_chars", "chars")


def merge_partials(partials: DataFrame, request: str) -> DataFrame:
    """Distinct facts, aggregates and missing data of a request in order of first appearance.

    Input: request, part, item_index, kind, item; the list stays in rows.
    """
    text = F.trim(F.regexp_replace("item", r"\s+", " "))
    cleaned = partials.withColumn("item", text).filter(F.col("item") != "")
    first = F.min(F.struct("part", "item_index"))
    return cleaned.groupBy(request, "kind", "item").agg(first.alias("_at")).select(request, "kind", "item", "_at.*")


# What is given up last comes first.
KEEP_ORDER = {"row_ranges_covered": 0, "aggregates": 1, "missing_data": 2, "facts": 3}
EMPTY_CHARS = len(json.dumps({kind: [] for kind in KEEP_ORDER}, indent=2))


def trim_to_budget(merged: DataFrame, request: str, max_chars: int) -> DataFrame:
    """Rows that stay when facts, then missing data, aggregates and ranges are dropped from the end until all fits.

    The size is that of indented JSON: six characters around each item and two per filled list.
    """
    priority = F.element_at(F.create_map(*[F.lit(x) for kv in KEEP_ORDER.items() for x in kv]), F.col("kind"))
    quoted = F.length(F.to_json(F.struct("item"))) - F.length(F.lit('{"item":}'))
    firsts = merged.groupBy(request, "kind").agg(F.min(F.struct("part", "item_index")).alias("_first"))
    opens = F.struct("part", "item_index") == F.col("_first")
    sized = (
        merged.join(firsts, [request, "kind"])
        .withColumn("_priority", priority)
        .withColumn("_size", (quoted + 6 + F.when(opens, 2).otherwise(0)).cast("long"))
        .drop("_first")
    )
    running = with_running_sum(sized, [request], ["_priority", "part", "item_index", "item"], "_size", "chars_upto")
    return running.filter(F.col("chars_upto") + EMPTY_CHARS <= max_chars).drop("_priority", "_size")


def batch_diagnostics(batches: DataFrame, request: str, max_chars: int = BATCH_CHARS) -> DataFrame:
    """Documents and characters of each batch and whether a single document overflows it."""
    return batches.groupBy(request, "batch").agg(
        F.count("*").alias("docs"), F.sum("chars").alias("chars_in"), (F.sum("chars") > max_chars).alias("truncated")
    )


def token_estimate(text: str) -> Column:
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), F.floor(F.length(text) / 4))).otherwise(F.lit(0))


def top_chunks(hits: DataFrame, query: str, score: str, k: int = SOURCE_LINES) -> DataFrame:
    """The first hits with a preview, and their average score."""
    top = hits.filter(F.col("rank") <= k)
    total = F.sum(F.col(score).cast("decimal(18,8)")).cast("double")
    average = top.groupBy(query).agg((total / F.count("*")).alias("average_score"))
    return top.join(average, query).select(
        query, "rank", "file_id", "chunk_index", score, F.substring("content", 1, PREVIEW_CHARS).alias("preview"), "average_score"
    )


def caveats(stats: DataFrame, key: str) -> DataFrame:
    """One row per limitation of a request; input holds the coverage numbers and flags."""
    c = F.col
    entries = F.array(
        F.when(c("partial_files") > 0, F.format_string("Some files were indexed partially: %d", "partial_files")),
        F.when(c("retrieved_chunks") == 0, "No relevant chunks were retrieved for this query."),
        F.when(
            (c("expected_chunks") > 0) & (c("retrieved_chunks") < c("expected_chunks")),
            F.format_string("Full-file coverage is incomplete: retrieved %d/%d chunks.", "retrieved_chunks", "expected_chunks"),
        ),
        F.when(
            (c("rows_expected") > 0) & (c("rows_retrieved") < c("rows_expected")),
            F.format_string("Row-level coverage is incomplete: used %d/%d rows.", "rows_retrieved", "rows_expected"),
        ),
        F.when(c("silent_row_loss"), "Potential silent row loss detected: chunk coverage looks high but row coverage is low."),
        F.when(c("truncated"), "Context was truncated by retrieval limits; answer may be incomplete."),
    )
    numbered = stats.select(key, F.posexplode(entries).alias("caveat_no", "caveat"))
    return numbered.filter(c("caveat").isNotNull())


def char_budget_prefix(hits: DataFrame, request: str, max_chars: int = CRITIC_CHARS) -> DataFrame:
    """Blocks of a request in order until the budget is used; the last one is cut.

    A block has at least twenty characters, which bounds how many can matter.
    """
    block = F.concat(F.format_string("[%d] file=%s chunk=%s\n", "rank", "filename", "chunk_index"), F.trim("content"), F.lit("\n"))
    filled = hits.filter(F.trim("content") != "").select(request, "rank", block.alias("block"))
    first = first_per_group(filled, [request], [F.col("rank").asc()], max_chars // 20 + 1)
    before = Window.partitionBy(request).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = first.withColumn("_used", F.coalesce(F.sum(F.length("block")).over(before), F.lit(0)))
    kept = used.filter(F.col("_used") < max_chars)
    return kept.select(request, "rank", F.substring("block", F.lit(1), (max_chars - F.col("_used")).cast("int")).alias("block"))
