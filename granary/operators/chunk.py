"""Documents and tables cut into retrievable chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from granary.functions import cells, splitting
from granary.operators import normalize
from granary.operators.ordering import first_per_group, with_position
from granary.operators.packing import packed
from granary.session import settle, spread

# Chunk sizes and table limits.
CHUNK_SIZE = 2_000
CHUNK_OVERLAP = 400
ROW_CHUNK_CHARS = 3_500
ROW_CHUNK_ROWS = 40
CELL_CHARS = 2_000
MAX_TABLE_CHUNKS = 320
SUMMARY_COLUMNS = 12
SUMMARY_SHEETS = 20
BATCH = 32
SUMMARY_TYPES = ("file_summary", "sheet_summary", "column_summary")


SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about 2 MB, so that texts and chunks do not pile up as Python objects."""
    start = 0
    while start < batch.num_rows:
        rows = batch.num_rows - start
        while rows > 1 and batch.slice(start, rows).nbytes > SLICE_BYTES:
            rows = rows // 2
        yield batch.slice(start, rows)
        start += rows


def split_documents(
    docs: DataFrame, key: str, text: str, kind: str | None = None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row per chunk: key, chunk_index, content, total_chunks, chunk_size; separators follow the kind."""
    size, overlap = splitting.limits(size, overlap)
    slim = spread(docs).select(F.col(key), F.col(text).alias("_text"), (F.col(kind) if kind else F.lit("txt")).alias("_kind"))
    schema = T.StructType(
        [
            docs.schema[key],
            T.StructField("chunk_index", T.IntegerType()),
            T.StructField("content", T.StringType()),
            T.StructField("total_chunks", T.IntegerType()),
        ]
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for one, body, form in zip(*(part.column(i).to_pylist() for i in range(3))):
                    separators = splitting.separators_for(form)
                    table = separators is splitting.TABLE_SEPARATORS
                    chunks = splitting.split_text(
                        body or "", size, min(overlap, splitting.TABLE_OVERLAP) if table else overlap, separators
                    )
                    rows += [(one, i, chunk, len(chunks)) for i, chunk in enumerate(chunks)]
                types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.int32()]
                columns = [pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)]
                del rows
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return slim.mapInArrow(split, schema).withColumn("chunk_size", F.length("content"))


def window_segments(docs: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """Fixed windows of ``size`` characters, each starting ``size - overlap`` after the last; blanks dropped."""
    step = max(1, size - max(0, min(overlap, size - 1)))
    length = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((length - size) / step)).cast("int")
    starts = F.explode(F.sequence(F.lit(0), last)).alias("segment_index")
    segment = F.substring(F.col(text), F.col("segment_index") * step + 1, F.lit(size))
    return (
        docs.filter(length > 0)
        .select(key, text, starts)
        .select(key, "segment_index", segment.alias("content"))
        .filter(F.length(F.regexp_replace("content", r"\s+", "")) > 0)
    )


def positions(chunks: DataFrame, file: str, order: Sequence[str]) -> DataFrame:
    """chunk_index inside its file, chunks of the file in all, and size."""
    placed = with_position(chunks, [file], order, "_at")
    totals = chunks.groupBy(file).agg(F.count("*").alias("total_chunks"))
    return placed.join(totals, file).withColumns(
        {"chunk_index": F.col("_at") - 1, "chunk_size": F.length("content")}
    ).drop("_at")


def chunk_stats(chunks: DataFrame, content: str, size: int, overlap: int) -> DataFrame:
    length = F.length(content)
    return chunks.agg(
        F.count("*").alias("total_chunks"),
        F.coalesce(F.floor(F.sum(length) / F.count("*")), F.lit(0)).alias("avg_chunk_size"),
        F.coalesce(F.min(length), F.lit(0)).alias("min_chunk_size"),
        F.coalesce(F.max(length), F.lit(0)).alias("max_chunk_size"),
        F.coalesce(F.sum(length), F.lit(0)).alias("total_size"),
        F.lit(overlap / size if size else 0.0).alias("overlap_ratio"),
    )


def row_group_size(columns: Column, hard_cap: int = ROW_CHUNK_ROWS) -> Column:
    """Rows per chunk by the number of columns, never above the cap."""
    return F.least(F.lit(hard_cap), F.when(columns >= 40, 50).when(columns >= 12, 100).otherwise(200))


def row_parts(df: DataFrame, columns: Sequence[str], cell_chars: int = CELL_CHARS) -> Column:
    """'column: cell' for each filled cell; a long cell is cut and marked."""
    # each text stands once in the expression: code made of several copies of it is too long for Java to compile
    texts = F.array(*[cells.cell_text(df, c) for c in columns])

    def part(text: Column, name: Column) -> Column:
        short = F.when(F.length(text) > cell_chars, F.concat(F.substring(text, 1, cell_chars), F.lit("..."))).otherwise(text)
        return F.when(text != "", F.concat(name, short))

    return F.filter(F.zip_with(texts, F.array(*[F.lit(f"{c}: ") for c in columns]), part), lambda p: p.isNotNull())


def row_lines(parts: Column, row_number: Column, max_chars: int) -> Column:
    """Lines of one table row: one when it fits, else continued lines of at most ``max_chars``."""
    head = F.concat(F.lit("Row "), row_number.cast("string"), F.lit(": "))
    cont = F.concat(F.lit("Row "), row_number.cast("string"), F.lit(" (cont): "))
    whole = F.concat(head, F.array_join(parts, " | "))
    payload = F.greatest(F.lit(120), max_chars - F.length(cont) - 8)

    def lead(lines: Column) -> Column:
        return F.when(F.size(lines) == 0, head).otherwise(cont)

    def add(state: Column, part: Column) -> Column:
        lines, current = state["lines"], state["current"]
        joined = F.when(current == "", part).otherwise(F.concat(current, F.lit(" | "), part))
        closed = F.when(current != "", F.concat(lines, F.array(F.concat(lead(lines), current)))).otherwise(lines)
        slices = F.greatest(F.lit(0), F.ceil((F.length(part) + F.length(cont) - max_chars) / payload)).cast("int")
        numbers = F.when(slices > 0, F.sequence(F.lit(0), slices - 1)).otherwise(F.array().cast("array<int>"))
        long = F.transform(
            numbers,
            lambda i: F.concat(
                F.when((i == 0) & (F.size(closed) == 0), head).otherwise(cont), F.substring(part, i * payload + 1, payload)
            ),
        )
        rest = F.substring(part, slices * payload + 1, F.length(part))
        fits = F.length(lead(lines)) + F.length(joined) <= max_chars
        return F.struct(
            F.when(fits, lines).otherwise(F.concat(closed, long)).alias("lines"),
            F.when(fits, joined).otherwise(rest).alias("current"),
        )

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("current"))
    split = F.aggregate(
        parts,
        start,
        add,
        lambda s: F.when(
            s["current"] != "", F.concat(s["lines"], F.array(F.concat(lead(s["lines"]), s["current"])))
        ).otherwise(s["lines"]),
    )
    return (
        F.when(F.size(parts) == 0, F.array(F.concat(head, F.lit("<empty>"))))
        .when(F.length(whole) <= max_chars, F.array(whole))
        .otherwise(split)
    )


def table_lines(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], sheet: Column, max_chars: int = ROW_CHUNK_CHARS
) -> DataFrame:
    """Numbered text lines of a table in key order: sheet_name, row_number, line_number, line, is_last, row_chars."""
    # Keys are numbered first; cell text is made afterwards, so the ordering passes move typed columns only.
    numbered = with_position(df.select(*dict.fromkeys([*key, *columns])), [], list(key), "row_number")
    rows = numbered.select(sheet.alias("sheet_name"), "row_number", row_parts(numbered, columns).alias("_parts"))
    rows = rows.select("sheet_name", "row_number", row_lines(F.col("_parts"), F.col("row_number"), max_chars).alias("_lines"))
    sized = rows.withColumn(
        "row_chars",
        F.length(F.array_join("_lines", "\n")),
    )
    return sized.select(
        "sheet_name", "row_number", "row_chars", F.size("_lines").alias("_count"), F.posexplode("_lines").alias("line_number", "line")
    ).select(
        "sheet_name",
        "row_number",
        "line_number",
        "line",
        "row_chars",
        (F.col("line_number") == F.col("_count") - 1).alias("is_last"),
        F.length("line").alias("line_chars"),
    )


def row_group_chunks(lines: DataFrame, group_size: int, max_chars: int = ROW_CHUNK_CHARS) -> DataFrame:
    """Row groups packed by rows and characters, with a header line that names the rows."""

    def ends(v: dict[str, np.ndarray]) -> np.ndarray:
        """For each line, the one after the last of a group that starts at it."""
        count = len(v["line_chars"])
        starts = np.arange(count)
        # characters and finished rows before each line; each line but a group's first has a line break before it
        chars = np.concatenate(([0], np.cumsum(v["line_chars"].astype("int64") + 1)))
        done = np.concatenate(([0], np.cumsum(v["is_last"].astype("int64"))))
        limit = chars[:-1] + max_chars + 1
        out = np.searchsorted(chars, limit, "right") - 1
        # a row begins only where it fits whole and the group has rows left; what rows reach to grows along the table
        heads = np.flatnonzero(v["line_number"] == 0)
        after = np.searchsorted(heads, starts, "right")
        full = np.searchsorted(done[heads], done[:-1] + group_size, "left")
        long = np.searchsorted(chars[heads] + v["row_chars"][heads].astype("int64"), limit, "right")
        barred = np.maximum(after, np.minimum(full, long))
        return np.maximum(starts + 1, np.minimum(out, np.concatenate((heads, [count]))[barred]))

    columns = ["line_number", "row_chars", "line_chars", "is_last"]
    bound = 2 * group_size + 4
    lines = settle(lines)
    narrow = lines.select("sheet_name", "row_number", *columns)
    packs = packed(narrow, ["sheet_name"], ["row_number", "line_number"], columns, None, bound, "row_group_index", ends=ends)
    at = ["sheet_name", "row_number", "line_number"]
    placed = lines.select(*at, "line").join(packs.select(*at, "row_group_index"), at)
    totals = lines.groupBy("sheet_name").agg(F.max("row_number").alias("total_rows"))
    text = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("row_number", "line_number", "line"))), lambda s: s["line"]), "\n"
    )
    groups = placed.groupBy("sheet_name", "row_group_index").agg(
        F.min("row_number").alias("row_start"), F.max("row_number").alias("row_end"), text.alias("_body")
    )
    header = F.format_string("sheet=%s rows=%d-%d/%d\n", "sheet_name", "row_start", "row_end", "total_rows")
    return groups.join(totals, "sheet_name").select(
        "sheet_name", "row_group_index", "row_start", "row_end", "total_rows", F.concat(header, "_body").alias("content")
    )


def fullest_columns(df: DataFrame, n: int, columns: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """The n columns with most filled cells in table order, and the others (one small action)."""
    columns = list(columns or df.columns)
    if n <= 0 or len(columns) <= n:
        return columns, []
    filled = df.agg(*[F.count_if(cells.non_empty(df, c)).alias(c) for c in columns]).first()
    ranked = sorted(columns, key=lambda c: (-filled[c], columns.index(c)))
    picked = [c for c in ranked if filled[c] > 0][:n] or columns[:n]
    return [c for c in columns if c in picked], [c for c in columns if c not in picked]


def sheet_summary(catalog: DataFrame, kinds: DataFrame) -> DataFrame:
    """One text per table: size, leading columns and their kinds; kinds has table_name, ordinal, column_name, kind."""
    typed = kinds.filter(F.col("ordinal") <= SUMMARY_COLUMNS).groupBy("table_name").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "column_name", "kind"))).alias("_top")
    )
    names = F.array_join(F.transform("_top", lambda s: s["column_name"]), ", ")
    types = F.array_join(F.transform("_top", lambda s: F.concat(s["column_name"], F.lit(":"), s["kind"])), ", ")
    size = F.format_string(
        "Sheet summary: sheet=%s total_rows=%d selected_columns=%d all_columns=%d row_group_size=%d",
        "table_name", "row_count", "column_count", "column_count", row_group_size(F.col("column_count")),
    )
    content = F.concat(size, F.lit("\nColumns: "), names, F.lit("\nInferred column types: "), types)
    return catalog.join(typed, "table_name").select("table_name", content.alias("content"))


def file_summary(catalog: DataFrame, file_type: str) -> DataFrame:
    """One text per file (dataset_id) over its tables."""
    columns = F.array_sort(F.array_distinct(F.flatten(F.collect_list("columns"))))
    sheets = F.sort_array(F.collect_list(F.struct("ordinal", "table_name", "row_count", "column_count")))
    facts = catalog.groupBy("dataset_id").agg(
        F.count("*").alias("_sheets"), F.sum("row_count").alias("_rows"), columns.alias("_columns"), sheets.alias("_tables")
    )
    lines = F.transform(
        F.slice("_tables", 1, SUMMARY_SHEETS),
        lambda s: F.format_string("- sheet=%s rows=%d cols=%d", s["table_name"], s["row_count"], s["column_count"]),
    )
    head = F.format_string(
        f"Table file summary: type={file_type} sheets=%d total_rows=%d unique_columns=%d", "_sheets", "_rows", F.size("_columns")
    )
    top = F.concat(F.lit("Top columns: "), F.array_join(F.slice("_columns", 1, SUMMARY_COLUMNS), ", "))
    return facts.select("dataset_id", F.concat_ws("\n", head, F.array_join(lines, "\n"), top).alias("content"))


def column_summary(df: DataFrame, key: str, sheet: str, max_columns: int = 6, preview_rows: int = 5) -> DataFrame:
    """One text per leading column: its kind and up to three distinct values of the first rows."""
    columns = df.columns[:max_columns]
    preview = df.orderBy(F.col(key).asc_nulls_last()).limit(preview_rows)
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(key).alias("_key"), cells.cell_text(df, c).alias("value")) for c in columns
    ]
    values = preview.select(F.inline(F.array(*entries))).filter("value <> ''")
    firsts = values.groupBy("column_name", "value").agg(F.min("_key").alias("_key"))
    examples = firsts.groupBy("column_name").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("_key", "value"))), 1, 3).alias("_examples")
    )
    kinds = normalize.column_kinds(df, key, columns)
    shown = F.coalesce(F.nullif(F.array_join(F.transform("_examples", lambda s: s["value"]), ", "), F.lit("")), F.lit("n/a"))
    content = F.concat(
        F.format_string(f"Column summary: sheet={sheet} column=%s inferred_type=%s\nExamples: ", "column_name", "kind"), shown
    )
    return kinds.join(F.broadcast(examples), "column_name", "left").select("column_name", content.alias("content"))


def cap_chunks(chunks: DataFrame, cap: int = MAX_TABLE_CHUNKS) -> DataFrame:
    """At most ``cap`` chunks per file: summaries first, then row groups at even steps from first to last.

    Input: file_id, chunk_type, chunk_order (order of summaries), row_group_index (dense from zero).  ``left_out`` counts
    the chunks of the file that the cap leaves out.
    """
    is_group = F.col("chunk_type") == "row_group"
    counts = chunks.groupBy("file_id").agg(
        F.count("*").alias("_all"), F.count_if(is_group).alias("_groups"), F.count_if(~is_group).alias("_others")
    )
    over, room = F.col("_all") > cap, F.greatest(F.lit(0), F.lit(cap) - F.col("_others"))
    left = F.when(~over, 0).otherwise(F.col("_all") - F.least("_others", F.lit(cap)) - room)
    names = ["file_id", *[c for c in chunks.columns if c != "file_id"], "left_out"]
    facts = counts.select("file_id", over.alias("_over"), room.alias("_room"), "_groups", left.cast("long").alias("left_out"))
    marked = chunks.join(facts, "file_id")
    # steps are longer than one, so a row group can only be the one at the step nearest to it
    step = (F.col("_groups") - 1) / F.nullif(F.col("_room") - 1, F.lit(0))
    nearest = F.bround(F.col("row_group_index") / step).cast("long")
    at_step = nearest.between(0, F.col("_room") - 1) & (F.bround(step * nearest).cast("long") == F.col("row_group_index"))
    picked = F.when(F.col("_room") > 1, at_step).otherwise((F.col("_room") == 1) & (F.col("row_group_index") == 0))
    kept = marked.filter(~F.col("_over") | (is_group & picked)).select(*names)
    others = marked.filter(F.col("_over") & ~is_group).select(*names)
    return kept.unionByName(first_per_group(others, ["file_id"], [F.col("chunk_order").asc()], cap))


def document_summary(parts: DataFrame, file: str, order: str, text: str, n: int = 4, chars: int = 420) -> DataFrame:
    """The beginning of the first parts of each file as one chunk."""
    first = first_per_group(parts, [file], [F.col(order).asc()], n)
    body = F.substring(F.trim(text), 1, chars)
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), body.alias("t"))))
    kept = F.filter(F.transform(items, lambda s: s["t"]), lambda t: t != "")
    return first.groupBy(file).agg(F.array_join(kept, "\n\n").alias("content"))


def chunk_identity(chunks: DataFrame, owner: Column, version: str, mode: str, model: str) -> DataFrame:
    """Chunk rows with their ids, owner, version and embedding identity; blank ones are left out."""
    return chunks.filter(F.trim("content") != "").select(
        F.concat(F.col("file_id").cast("string"), F.lit("_"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "file_id",
        "chunk_index",
        owner.alias("owner_id"),
        F.lit(version).alias("pipeline_version"),
        F.lit(mode).alias("embedding_mode"),
        F.lit(model).alias("embedding_model"),
        F.trim("content").alias("content"),
    )


def blank_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_id").agg(
        F.count_if(F.trim("content") != "").alias("chunks_valid"), F.count_if(F.trim("content") == "").alias("chunks_failed")
    )


def dense_chars(text: str) -> Column:
    return F.length(F.regexp_replace(text, r"\s+", ""))


def extraction_stats(docs: DataFrame, file: str, text: str) -> DataFrame:
    """Characters and filled parts per file, and whether it is empty or nearly so."""
    stats = docs.groupBy(file).agg(
        F.sum(F.length(text)).alias("chars"),
        F.sum(dense_chars(text)).alias("non_whitespace_chars"),
        F.count_if(F.length(F.trim(text)) > 0).alias("non_empty_docs"),
    )
    empty = (F.col("non_empty_docs") == 0) | (F.col("non_whitespace_chars") == 0)
    verdict = F.when(empty, "empty").when(F.col("non_whitespace_chars") < 50, "very_small").otherwise("ok")
    return stats.withColumn("verdict", verdict)


def near_empty(pages: DataFrame, file: str, text: str) -> DataFrame:
    """Files whose pages hold almost no text."""
    size = dense_chars(text)
    facts = pages.groupBy(file).agg(
        F.count_if(size > 0).alias("pages"), F.max(size).alias("_largest"), F.sum(size).alias("_total")
    )
    none = F.col("pages") == 0
    thin = (F.col("_largest") < 24) & (F.col("_total") < F.greatest(F.lit(24), F.col("pages") * 16))
    return facts.select(file, "pages", (none | thin).alias("near_empty"))


def sheet_row_stats(chunks: DataFrame, file: str) -> DataFrame:
    return chunks.groupBy(file).agg(
        F.countDistinct(F.nullif("sheet_name", F.lit(""))).alias("sheets_count"),
        F.coalesce(F.max("row_end"), F.lit(0)).alias("rows_estimate"),
    )


def batches(chunks: DataFrame, file: str, order: Sequence[str], resume_at: int = 0, size: int = BATCH) -> DataFrame:
    """Batches of 32 chunks per file, from the batch where indexing resumes."""
    placed = with_position(chunks, [file], order, "_at")
    numbered = placed.withColumn("batch", F.floor((F.col("_at") - 1) / size).cast("long"))
    return numbered.filter(F.col("batch") >= resume_at).drop("_at")
