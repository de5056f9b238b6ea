"""Coverage accounting and the reduce side of whole-file reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from granary.operators import coverage
from granary.plans.f_chunks import CHUNKS_SQL, chunks_of
from granary.plans.g_retrieval import HITS_SQL, hits_of, row_groups_of
from granary.plans.registry import Tables, query

GROUPS_SQL = """groups AS (SELECT l_suppkey AS file_id, 'file' || l_suppkey AS filename, l_returnflag AS sheet_name, l_orderkey AS s,
    CAST(l_orderkey + l_quantity AS BIGINT) AS e, l_linenumber AS chunk_index FROM lineitem),
  flagged AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER w, s - 2) + 1 THEN 1 ELSE 0 END AS new FROM groups
    WINDOW w AS (PARTITION BY file_id, sheet_name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  islands AS (SELECT *, sum(new) OVER (PARTITION BY file_id, sheet_name ORDER BY s, e) AS island FROM flagged),
  merged AS (SELECT file_id, filename, sheet_name, min(s) AS row_start, max(e) AS row_end FROM islands GROUP BY 1, 2, 3, island)"""


def all_groups(t: Tables) -> DataFrame:
    return row_groups_of(t)


@query("H01_merge_ranges", f"WITH {GROUPS_SQL} SELECT file_id, sheet_name, row_start, row_end FROM merged")
def _(t):
    return coverage.merge_ranges(all_groups(t), ["file_id", "sheet_name"])


ROWS_SQL = f"""{GROUPS_SQL}, want AS (SELECT file_id, sheet_name, greatest(max(e), 15000) AS rows_expected FROM groups GROUP BY 1, 2),
  got AS (SELECT file_id, sheet_name, CAST(sum(row_end - row_start + 1) AS BIGINT) AS rows_retrieved FROM merged GROUP BY 1, 2),
  rows_ AS (SELECT * FROM want JOIN got USING (file_id, sheet_name))"""


@query(
    "H02_row_coverage",
    f"""WITH {ROWS_SQL} SELECT CAST(sum(rows_expected) AS BIGINT) AS rows_expected_total, CAST(sum(rows_retrieved) AS BIGINT) AS rows_retrieved_total,
        round(sum(rows_retrieved) / sum(rows_expected), 6) AS row_coverage_ratio FROM rows_""",
)
def _(t):
    return coverage.row_coverage(all_groups(t))


CHUNK_COVER_SQL = f"""{CHUNKS_SQL}, cover AS (SELECT source, count(*) AS expected_chunks,
    count(*) FILTER (WHERE lang <> 'es' OR chunk_index = 0) AS retrieved_chunks FROM chunks GROUP BY 1)"""


def chunk_cover(t: Tables) -> DataFrame:
    chunks = chunks_of(t)
    return coverage.chunk_coverage(chunks, chunks.filter("lang <> 'es' OR chunk_index = 0"), "source")


@query(
    "H03_chunk_coverage",
    f"""WITH {CHUNK_COVER_SQL} SELECT source, expected_chunks, retrieved_chunks, round(retrieved_chunks / expected_chunks, 6) AS ratio,
        retrieved_chunks >= expected_chunks AS complete FROM cover""",
)
def _(t):
    return chunk_cover(t)


LOSS_SQL = f"""{CHUNK_COVER_SQL}, {ROWS_SQL}, per_file AS (SELECT 'src' || file_id AS source, CAST(sum(rows_expected) AS BIGINT) AS rows_expected,
    CAST(sum(rows_retrieved) AS BIGINT) AS rows_retrieved FROM rows_ GROUP BY 1),
  loss AS (SELECT *, retrieved_chunks >= greatest(1, floor(expected_chunks * 9 / 10)) AND rows_expected > 0
    AND round(rows_retrieved / rows_expected, 6) < 0.95 AS silent_row_loss FROM cover JOIN per_file USING (source))"""


def loss_of(t: Tables) -> DataFrame:
    rows = coverage.row_coverage_by(all_groups(t)).groupBy(F.concat(F.lit("src"), F.col("file_id")).alias("source")).agg(
        F.sum("rows_expected").alias("rows_expected"), F.sum("rows_retrieved").alias("rows_retrieved")
    )
    return coverage.silent_row_loss(chunk_cover(t), rows, "source")


@query("H04_silent_row_loss", f"WITH {LOSS_SQL} SELECT source, expected_chunks, retrieved_chunks, rows_expected, rows_retrieved, silent_row_loss FROM loss")
def _(t):
    return loss_of(t).select("source", "expected_chunks", "retrieved_chunks", "rows_expected", "rows_retrieved", "silent_row_loss")


@query(
    "H05_coverage_sources",
    f"""WITH {GROUPS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY filename, sheet_name ORDER BY row_start) AS i,
          count(*) OVER (PARTITION BY filename, sheet_name) AS n FROM merged)
        SELECT filename, sheet_name, filename || ' | sheet=' || sheet_name || ' | rows='
          || string_agg(row_start || '-' || row_end, ', ' ORDER BY row_start) FILTER (WHERE i <= 4) || CASE WHEN any_value(n) > 4 THEN ', ...' ELSE '' END AS line
        FROM r GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 8""",
)
def _(t):
    return coverage.coverage_sources(all_groups(t))


@query(
    "H06_source_list",
    f"""WITH {HITS_SQL}, l AS (SELECT item_id, filename || ' | sheet=' || sheet_name || ' | chunk=' || chunk_index
          || CASE WHEN row_start IS NOT NULL THEN ' | rows=' || row_start || '-' || row_end ELSE '' END AS source, min(rank) AS first_rank
          FROM hits GROUP BY 1, 2)
        SELECT item_id, source, first_rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY first_rank, source) AS r FROM l) WHERE r <= 8""",
)
def _(t):
    return coverage.source_list(hits_of(t), "item_id")


def batches_of(t: Tables) -> DataFrame:
    return coverage.batch_context(t.documents.select("source", "doc_id", "text"), "source", ["doc_id"], "text")


PACKED_SQL = """RECURSIVE docs AS (SELECT source, doc_id, length(trim(text)) AS chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n
    FROM documents WHERE length(trim(text)) > 0),
  packed AS (SELECT source, doc_id, n, chars, 0 AS batch, 1 AS held, chars AS total FROM docs WHERE n = 1
    UNION ALL SELECT d.source, d.doc_id, d.n, d.chars, p.batch + CASE WHEN p.held >= 12 OR p.total + d.chars > 25000 THEN 1 ELSE 0 END,
      CASE WHEN p.held >= 12 OR p.total + d.chars > 25000 THEN 1 ELSE p.held + 1 END,
      CASE WHEN p.held >= 12 OR p.total + d.chars > 25000 THEN d.chars ELSE p.total + d.chars END
    FROM packed p JOIN docs d ON d.source = p.source AND d.n = p.n + 1)"""


@query("H07_batch_context", f"WITH {PACKED_SQL} SELECT source, doc_id, chars, batch FROM packed")
def _(t):
    return batches_of(t).select("source", "doc_id", "chars", "batch")


PARTIALS_SQL = r"""partials AS (SELECT source, doc_id AS part, i - 1 AS item_index,
    CASE lang WHEN 'en' THEN 'facts' WHEN 'de' THEN 'aggregates' WHEN 'fr' THEN 'missing_data' ELSE 'row_ranges_covered' END AS kind,
    trim(regexp_replace(line, '\s+', ' ', 'g')) AS item
  FROM (SELECT source, doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
  firsts AS (SELECT source, kind, item, min((part, item_index)) AS p FROM partials WHERE item <> '' GROUP BY 1, 2, 3),
  merged AS (SELECT source, kind, item, p[1] AS part, p[2] AS item_index FROM firsts)"""


def partials_of(t: Tables) -> DataFrame:
    """The lines of every document as partial findings of a request over its source."""
    kind = (
        F.when(F.col("lang") == "en", "facts").when(F.col("lang") == "de", "aggregates").when(F.col("lang") == "fr", "missing_data")
    ).otherwise("row_ranges_covered")
    lines = F.posexplode(F.split("text", "\n", -1)).alias("item_index", "item")
    return t.documents.select("source", F.col("doc_id").alias("part"), kind.alias("kind"), lines)


@query("H09_merge_partials", f"WITH {PARTIALS_SQL} SELECT source, kind, item, part, item_index FROM merged")
def _(t):
    return coverage.merge_partials(partials_of(t), "source")


@query(
    "H10_trim_to_budget",
    f"""WITH {PARTIALS_SQL}, sized AS (SELECT *, CASE kind WHEN 'row_ranges_covered' THEN 0 WHEN 'aggregates' THEN 1 WHEN 'missing_data' THEN 2 ELSE 3 END AS o,
          length(CAST(to_json(item) AS VARCHAR)) + 6 + CASE WHEN (part, item_index) = min((part, item_index)) OVER (PARTITION BY source, kind) THEN 2 ELSE 0 END AS size FROM merged),
        run AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY o, part, item_index, item) AS BIGINT) AS chars_upto FROM sized)
        SELECT source, kind, item, part, item_index, chars_upto FROM run WHERE chars_upto + 87 <= 60000""",
)
def _(t):
    return coverage.trim_to_budget(coverage.merge_partials(partials_of(t), "source"), "source", 60_000)


@query(
    "H11_batch_diagnostics",
    f"""WITH {PACKED_SQL} SELECT source, batch, count(*) AS docs, CAST(sum(chars) AS BIGINT) AS chars_in, sum(chars) > 25000 AS truncated
        FROM packed GROUP BY 1, 2""",
)
def _(t):
    return coverage.batch_diagnostics(batches_of(t), "source")


@query(
    "H12_token_estimate",
    """SELECT source, CAST(sum(CASE WHEN length(text) > 0 THEN greatest(1, floor(length(text) / 4)) ELSE 0 END) AS BIGINT) AS tokens
       FROM documents GROUP BY 1""",
)
def _(t):
    return t.documents.groupBy("source").agg(F.sum(coverage.token_estimate("text")).cast("long").alias("tokens"))


@query(
    "H13_top_chunks_report",
    f"""WITH {HITS_SQL} SELECT item_id, rank, file_id, chunk_index, score, substr(content, 1, 220) AS preview,
        CAST(sum(CAST(score AS DECIMAL(18,8))) OVER (PARTITION BY item_id) AS DOUBLE) / count(*) OVER (PARTITION BY item_id) AS average_score FROM hits WHERE rank <= 8""",
)
def _(t):
    return coverage.top_chunks(hits_of(t), "item_id", "score")


@query(
    "H14_caveats",
    f"""WITH {LOSS_SQL} SELECT * FROM (SELECT source, unnest(range(6)) AS caveat_no, unnest([
          CASE WHEN expected_chunks % 3 > 0 THEN 'Some files were indexed partially: ' || (expected_chunks % 3) END,
          CASE WHEN retrieved_chunks = 0 THEN 'No relevant chunks were retrieved for this query.' END,
          CASE WHEN retrieved_chunks < expected_chunks THEN 'Full-file coverage is incomplete: retrieved ' || retrieved_chunks || '/' || expected_chunks || ' chunks.' END,
          CASE WHEN rows_retrieved < rows_expected THEN 'Row-level coverage is incomplete: used ' || rows_retrieved || '/' || rows_expected || ' rows.' END,
          CASE WHEN silent_row_loss THEN 'Potential silent row loss detected: chunk coverage looks high but row coverage is low.' END,
          CASE WHEN retrieved_chunks < expected_chunks THEN 'Context was truncated by retrieval limits; answer may be incomplete.' END]) AS caveat
        FROM loss) WHERE caveat IS NOT NULL""",
)
def _(t):
    stats = loss_of(t).withColumns(
        {
            "partial_files": F.col("expected_chunks") % 3,
            "truncated": F.col("retrieved_chunks") < F.col("expected_chunks"),
        }
    )
    return coverage.caveats(stats, "source")


@query(
    "H15_char_budget_prefix",
    f"""WITH {HITS_SQL}, b AS (SELECT item_id, rank, '[' || rank || '] file=' || filename || ' chunk=' || chunk_index || chr(10) || trim(content) || chr(10) AS block
          FROM hits WHERE trim(content) <> ''),
        u AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b)
        SELECT item_id, rank, substr(block, 1, CAST(12000 - used AS BIGINT)) AS block FROM u WHERE used < 12000""",
)
def _(t):
    return coverage.char_budget_prefix(hits_of(t), "item_id")
