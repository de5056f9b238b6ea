"""Retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from granary.operators import aggregate, index, rank, retrieve, vectors
from granary.plans.f_chunks import CHUNKS_SQL, chunks_of
from granary.plans.i_operations import ACTIVE_SQL, RUNS_SQL, runs_of
from granary.operators.operations import active_run_per_file
from granary.plans.registry import Tables, query
from granary.session import shared_folder

HITS = 12

TOKEN_SQL = "regexp_extract_all(lower(text), '[A-Za-zА-Яа-яЁё0-9_]+')"
POSTINGS_SQL = f"""tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKEN_SQL}) AS token FROM documents)
    WHERE length(token) >= 2 GROUP BY 1, 2),
  lens AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY 1),
  qt AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest({TOKEN_SQL}) AS token FROM benchmark)
    WHERE length(token) >= 2 GROUP BY 1, 2),
  df AS (SELECT token, count(*) AS df FROM tf WHERE token IN (SELECT token FROM qt) GROUP BY 1)"""


def lexical_sql(k: int = HITS) -> str:
    return f"""{POSTINGS_SQL}, scored AS (SELECT item_id, doc_id, round(sum((tf.tf / n) * ln(1.0 + ((SELECT count(*) FROM documents) - df + 0.5)
        / (df + 0.5)) * (1.0 + 0.2 * qtf)), 6) AS score FROM qt JOIN tf USING (token) JOIN df USING (token) JOIN lens USING (doc_id) GROUP BY 1, 2),
      lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored
        WHERE score > 0) WHERE rank <= {k})"""


#: Indexes of this session by application, kind and files indexed: questions after the first find the table's index.
INDEXES: dict[tuple, index.Index] = {}


def documents_index(t: Tables, how: index.Scorer) -> index.Index:
    """The stored index of the documents table; a table whose files changed gets a new one."""
    files = t.spark.read.format("binaryFile").load(f"{t.folder}/documents.parquet")  # lists them, reads no content
    state = files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()[0]
    key = (t.spark.sparkContext.applicationId, how.name, t.folder, state)
    if key not in INDEXES:
        INDEXES[key] = index.add_segment(t.documents, "doc_id", "text", how, shared_folder(t.spark, f"index-{how.name}"))
    return INDEXES[key]


def lexical_hits(t: Tables, k: int = HITS) -> DataFrame:
    stored = documents_index(t, index.LEXICAL)
    return index.search(stored, index.lexical_question(stored, t.benchmark, "item_id", "text"), "item_id", k).hits


def hits_of(t: Tables) -> DataFrame:
    """Lexical hits of every benchmark text with the fields of a chunk: file = source, sheet = lang."""
    docs = t.documents.select("doc_id", "source", "lang", "text", "n_chars")
    return lexical_hits(t).join(docs, "doc_id").select(
        "item_id",
        "rank",
        "score",
        "doc_id",
        F.col("source").alias("file_id"),
        F.col("source").alias("filename"),
        F.col("lang").alias("sheet_name"),
        F.col("doc_id").alias("chunk_index"),
        F.when(F.col("lang") == "de", "file_summary")
        .when(F.col("lang") == "fr", "sheet_summary")
        .when(F.col("lang") == "en", "row_group")
        .otherwise("chunk")
        .alias("chunk_type"),
        F.when(F.col("lang") == "en", F.col("doc_id")).alias("row_start"),
        F.when(F.col("lang") == "en", F.col("doc_id") + F.col("n_chars")).alias("row_end"),
        F.col("text").alias("content"),
    )


HITS_SQL = f"""{lexical_sql()}, hits AS (SELECT item_id, rank, score, doc_id, source AS file_id, source AS filename, lang AS sheet_name,
    doc_id AS chunk_index, CASE WHEN lang = 'en' THEN doc_id END AS row_start, CASE WHEN lang = 'en' THEN doc_id + n_chars END AS row_end,
    text AS content FROM lexical JOIN documents USING (doc_id))"""


def query_vectors(t: Tables) -> DataFrame:
    points = t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("point"), "label")
    return t.benchmark.select("item_id").join(points, "item_id")


def dense_hits(t: Tables, k: int, scope: str | None = None) -> DataFrame:
    return vectors.nearest(t.embeddings, "vec_id", "embedding", query_vectors(t), "item_id", "point", k, scope)


def dense_sql(k: int, scope: str = "true") -> str:
    return f"""dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, vec_id) AS rank FROM (
        SELECT q.vec_id AS item_id, e.vec_id, round(pow(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 2), 6) AS distance
        FROM embeddings q JOIN benchmark b ON q.vec_id = b.item_id JOIN embeddings e ON {scope})) WHERE rank <= {k})"""


@query("G01_dense_topk", f"WITH {dense_sql(10)} SELECT item_id, vec_id, distance, rank FROM dense")
def _(t):
    return dense_hits(t, 10)


def mean_point(t: Tables) -> list[float]:
    return list(vectors.mean_pool(t.embeddings, [], "embedding", 4).first()["vector"])


POINT_SQL = """point AS (SELECT list(m ORDER BY i) AS p FROM (SELECT i, round(avg(CAST(embedding[i] AS DOUBLE)), 4) AS m
    FROM embeddings, range(1, 65) AS s(i) GROUP BY 1)),
  far AS (SELECT vec_id, label, round(pow(list_distance(CAST(embedding AS DOUBLE[]), p), 2), 6) AS distance FROM embeddings, point)"""


@query(
    "G02_dense_similarity",
    f"WITH {POINT_SQL} SELECT vec_id, round(1.0 / (1.0 + distance), 6) AS similarity FROM far",
)
def _(t):
    scored = vectors.with_distance(t.embeddings, "embedding", mean_point(t))
    return scored.select("vec_id", F.round(vectors.similarity(F.col("distance")), 6).alias("similarity"))


@query(
    "G03_multi_collection_topk",
    f"""WITH {POINT_SQL} SELECT vec_id, label, distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS r
        FROM far) WHERE r <= 5 ORDER BY distance, vec_id LIMIT 20""",
)
def _(t):
    scored = vectors.with_distance(t.embeddings, "embedding", mean_point(t)).select("vec_id", "label", "distance")
    return vectors.multi_collection(scored, "label", "vec_id", 5, 20)


@query(
    "G04_filtered_fetch",
    f"""WITH {CHUNKS_SQL} SELECT source, file_id, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY file_id, chunk_index) AS r
        FROM chunks WHERE lang <> 'en') WHERE r <= 12""",
)
def _(t):
    fetched = vectors.filtered_fetch(chunks_of(t), F.col("lang") != "en", "source", ["file_id", "chunk_index"], 12)
    return fetched.select("source", "file_id", "chunk_index")


@query(
    "G05_tokenize",
    f"""SELECT doc_id, count(*) AS tokens, string_agg(token, ' ' ORDER BY i) AS joined FROM (SELECT doc_id,
          unnest({TOKEN_SQL}) AS token, generate_subscripts({TOKEN_SQL}, 1) AS i FROM documents) WHERE length(token) >= 2 GROUP BY 1""",
)
def _(t):
    tokens = t.documents.select("doc_id", rank.tokenize(F.col("text")).alias("_t"))
    return tokens.select("doc_id", F.size("_t").alias("tokens"), F.array_join("_t", " ").alias("joined")).filter("tokens > 0")


@query(
    "G06_lexical_score",
    f"""WITH {lexical_sql(40)} SELECT item_id, doc_id, round(score / max(score) OVER (PARTITION BY item_id), 6) AS score, rank FROM lexical""",
)
def _(t):
    return rank.relative(lexical_hits(t, 40), "item_id").withColumn("score", F.round("score", 6))


BM25_SQL = r"""w AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS token FROM documents)
    WHERE token <> '' GROUP BY 1, 2),
  wl AS (SELECT doc_id, sum(tf) AS n FROM w GROUP BY 1),
  c AS (SELECT (SELECT count(*) FROM documents) AS total, (SELECT sum(n) FROM wl) / (SELECT count(*) FROM documents) AS avgdl),
  idf0 AS (SELECT token, ln((total - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM w, c GROUP BY token, total),
  idf AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
  bq AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_split_to_array(text, '\s+')) AS token FROM benchmark)
    WHERE token <> '' GROUP BY 1, 2),
  bs AS (SELECT item_id, doc_id, round(sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avgdl))), 6) AS score
    FROM bq JOIN w USING (token) JOIN idf USING (token) JOIN wl USING (doc_id), c GROUP BY 1, 2),
  bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bs WHERE score > 0)"""


def bm25_hits(t: Tables, k: int) -> DataFrame:
    stored = documents_index(t, index.BM25)
    return index.search(stored, index.bm25_question(stored, t.benchmark, "item_id", "text"), "item_id", k).hits


@query("G07_bm25_topk", f"WITH {BM25_SQL} SELECT item_id, doc_id, score, rank FROM bm WHERE rank <= 48")
def _(t):
    return bm25_hits(t, max(6 * 8, 40))


@query(
    "G08_rank_fusion",
    f"""WITH {BM25_SQL}, {dense_sql(40)}, parts AS (SELECT item_id, vec_id AS id, 0.75 / (60 + rank) AS p FROM dense
          UNION ALL SELECT item_id, doc_id, 0.25 / (60 + rank) FROM bm WHERE rank <= 48),
        fused AS (SELECT item_id, id, round(sum(CAST(p AS DOUBLE)), 10) AS score FROM parts GROUP BY 1, 2)
        SELECT item_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank
          FROM fused) WHERE rank <= 24""",
)
def _(t):
    dense = dense_hits(t, 40).withColumnRenamed("vec_id", "id")
    lexical = bm25_hits(t, 48).withColumnRenamed("doc_id", "id")
    return rank.reciprocal_fusion(dense, lexical, "item_id", "id", 8)


HYBRID_SQL = f"""{lexical_sql(40)}, {dense_sql(40)}, rel AS (SELECT item_id, doc_id AS id, score / max(score) OVER (PARTITION BY item_id) AS lexical
    FROM lexical), merged AS (SELECT coalesce(d.item_id, r.item_id) AS item_id, coalesce(d.vec_id, r.id) AS id,
      coalesce(1.0 / (1.0 + distance), 0.0) AS dense_score, coalesce(lexical, 0.0) AS lexical_score
      FROM dense d FULL JOIN rel r ON d.item_id = r.item_id AND d.vec_id = r.id),
  hybrid AS (SELECT *, round(0.75 * dense_score + 0.25 * lexical_score, 8) AS hybrid_score FROM merged JOIN documents ON id = doc_id
    WHERE trim(text) <> '')"""


def hybrid_hits(t: Tables) -> DataFrame:
    dense = dense_hits(t, 40).withColumnRenamed("vec_id", "id")
    lexical = rank.relative(lexical_hits(t, 40), "item_id").withColumnRenamed("doc_id", "id")
    contents = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")
    return rank.hybrid_merge(dense, lexical, contents, "item_id", "id")


@query(
    "G09_hybrid_merge",
    f"WITH {HYBRID_SQL} SELECT item_id, id, round(dense_score, 6) AS dense_score, round(lexical_score, 6) AS lexical_score, hybrid_score FROM hybrid",
)
def _(t):
    parts = [F.round(c, 6).alias(c) for c in ("dense_score", "lexical_score")]
    return hybrid_hits(t).select("item_id", "id", *parts, "hybrid_score")


@query(
    "G10_score_threshold",
    f"""WITH {HYBRID_SQL} SELECT item_id, count(*) FILTER (WHERE hybrid_score >= 0.3) AS kept, count(*) FILTER (WHERE hybrid_score < 0.3) AS dropped
        FROM hybrid GROUP BY 1""",
)
def _(t):
    return rank.above(hybrid_hits(t), "item_id", "hybrid_score", 0.3)[1]


@query(
    "G11_coverage_selection",
    f"""WITH {HITS_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY item_id, file_id ORDER BY rank) AS fr,
          (SELECT count(DISTINCT file_id) FROM hits h WHERE h.item_id = hits.item_id) AS files FROM hits),
        o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN fr = 1 AND 8 >= files THEN 0 ELSE 1 END, rank) AS position FROM m)
        SELECT item_id, doc_id, file_id, rank, position FROM o WHERE position <= 8""",
)
def _(t):
    chosen = rank.coverage_selection(hits_of(t), "item_id", "file_id", 8)
    return chosen.select("item_id", "doc_id", "file_id", "rank", "position")


STAGED_SQL = """kinds AS (SELECT *, CASE lang WHEN 'de' THEN 'file_summary' WHEN 'fr' THEN 'sheet_summary' WHEN 'en' THEN 'row_group' ELSE 'chunk' END AS chunk_type
    FROM (SELECT *, sheet_name AS lang FROM hits)),
  types AS (SELECT *, row_number() OVER (PARTITION BY item_id, chunk_type ORDER BY rank) AS nth,
    bool_or(chunk_type <> 'chunk') OVER (PARTITION BY item_id) AS has_table FROM kinds),
  sheets AS (SELECT *, chunk_type = 'sheet_summary' AND rank = min(CASE WHEN chunk_type = 'sheet_summary' AND nth <= 4 THEN rank END)
    OVER (PARTITION BY item_id, file_id, sheet_name) AS heads FROM types),
  groups AS (SELECT *, count(*) FILTER (WHERE heads) OVER (PARTITION BY item_id, file_id, sheet_name) AS headed,
    count(*) FILTER (WHERE chunk_type = 'row_group') OVER (PARTITION BY item_id, file_id, sheet_name ORDER BY rank) AS place FROM sheets),
  staged AS (SELECT *, CASE WHEN NOT has_table OR chunk_type = 'chunk' THEN 3
    WHEN chunk_type = 'file_summary' THEN CASE WHEN nth <= 2 THEN 0 ELSE 4 END
    WHEN chunk_type = 'sheet_summary' THEN CASE WHEN heads THEN 1 ELSE 4 END
    WHEN place + headed <= 2 THEN 2 END AS stage FROM groups),
  chosen AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY stage, rank) AS position FROM staged WHERE stage IS NOT NULL)"""


@query(
    "G12_staged_selection",
    f"""WITH {HITS_SQL}, {STAGED_SQL} SELECT item_id, doc_id, chunk_type, rank, position FROM chosen
        WHERE position <= 8 OR NOT has_table""",
)
def _(t):
    return rank.staged_selection(hits_of(t), "item_id", 8).select("item_id", "doc_id", "chunk_type", "rank", "position")


@query(
    "G13_full_document_retrieval",
    f"""WITH {CHUNKS_SQL}, mine AS (SELECT * FROM chunks WHERE lang <> 'en'), n AS (SELECT count(*) AS n FROM mine)
        SELECT file_id, chunk_index, n >= 800 AS cap_reached, greatest(n - 800, 0) AS left_out FROM mine, n
        ORDER BY file_id, chunk_index LIMIT 800""",
)
def _(t):
    found = retrieve.full_document(chunks_of(t), F.col("lang") != "en")
    return found.select("file_id", "chunk_index", "cap_reached", "left_out")


def requests_of(t: Tables) -> DataFrame:
    """Every user turn and benchmark text as a request over the chunks of one source."""
    sizes = chunks_of(t).groupBy("source").agg(F.count("*").alias("expected_chunks"))
    sources = sizes.select((F.substring("source", 4, 9).cast("int")).alias("n"), "expected_chunks")
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "text")
    items = t.benchmark.select((-F.col("item_id") - 1).alias("request_id"), F.concat(F.lit("Overview: "), "text").alias("text"))
    mode = F.when(F.col("request_id") % 7 == 0, "full_file").otherwise("auto")
    asked = turns.unionByName(items).withColumns({"mode": mode, "requested_top_k": F.lit(5), "n": F.abs(F.col("request_id") % 20).cast("int")})
    return asked.join(sources, "n", "left").withColumn("expected_chunks", F.coalesce("expected_chunks", F.lit(0))).drop("n")


REQUESTS_SQL = f"""{CHUNKS_SQL}, sizes AS (SELECT CAST(substr(source, 4) AS INTEGER) AS n, count(*) AS expected_chunks FROM chunks GROUP BY 1),
  asked AS (SELECT conv_id * 1000 + turn AS request_id, text FROM conversations
    UNION ALL SELECT -item_id - 1, 'Overview: ' || text FROM benchmark),
  requests AS (SELECT request_id, text, CASE WHEN request_id % 7 = 0 THEN 'full_file' ELSE 'auto' END AS mode, coalesce(expected_chunks, 0) AS expected
    FROM asked LEFT JOIN sizes ON n = abs(request_id % 20)),
  profiled AS (SELECT *, CASE WHEN trim(text) = '' THEN 'fact'
      WHEN regexp_matches(lower(text), 'проанализ|анализ|свод|итог|обзор|сравн|тренд|динам|весь|все строки|по всему|analyze|analysis|summary|overview|compare|trend|entire|whole') THEN 'broad'
      WHEN len(regexp_extract_all(lower(trim(text)), '[A-Za-zА-Яа-яЁё0-9_]+')) <= 4 THEN 'short' ELSE 'fact' END AS query_profile FROM requests),
  budget AS (SELECT *, CASE query_profile WHEN 'short' THEN 20 WHEN 'broad' THEN 30 ELSE 10 END AS pct FROM profiled),
  plan AS (SELECT *, CAST(CASE WHEN mode = 'full_file' THEN least(greatest(expected, 5), 800)
      ELSE least(greatest(CASE WHEN expected > 0 THEN least(ceil(expected * pct / 100), expected) ELSE 5 END, 8, 5), 96) END AS BIGINT) AS effective_top_k
    FROM budget)"""


@query(
    "G15_dynamic_top_k",
    f"""WITH {REQUESTS_SQL} SELECT request_id, query_profile, effective_top_k, greatest(effective_top_k * 10, 40) AS fetch_k,
        least(greatest(greatest(effective_top_k * 10, 40) * 3, 120), 1200) AS lexical_pool,
        CASE WHEN mode = 'full_file' THEN 1.0 ELSE CAST(pct AS DOUBLE) / 100 END AS ratio FROM plan""",
)
def _(t):
    plan = retrieve.budget_plan(requests_of(t))
    return plan.select("request_id", "query_profile", "effective_top_k", "fetch_k", "lexical_pool", "ratio")


@query(
    "G16_escalation",
    f"""WITH {REQUESTS_SQL}, cov AS (SELECT *, CASE WHEN expected > 0 THEN round(effective_top_k / expected, 6) ELSE 0.0 END AS cover FROM plan),
        e AS (SELECT *, CASE WHEN mode <> 'full_file' AND expected > 0 AND cover < 0.35 AND mode = 'auto' AND expected <= 120 THEN 'full_file'
          WHEN mode <> 'full_file' AND expected > 0 AND cover < 0.35 AND least(effective_top_k * 2, 192, expected) > effective_top_k THEN 'increase_top_k'
          ELSE 'none' END AS escalation FROM cov)
        SELECT request_id, escalation, CASE WHEN escalation = 'full_file' THEN 'full_file' ELSE mode END AS next_mode,
          CASE escalation WHEN 'full_file' THEN least(expected, 800) WHEN 'increase_top_k' THEN least(effective_top_k * 2, 192, expected)
            ELSE effective_top_k END AS next_top_k FROM e""",
)
def _(t):
    plan = retrieve.budget_plan(requests_of(t))
    covered = F.when(F.col("expected_chunks") > 0, F.round(F.col("effective_top_k") / F.col("expected_chunks"), 6)).otherwise(0.0)
    return retrieve.escalation(plan.withColumn("coverage_ratio", covered)).select("request_id", "escalation", "next_mode", "next_top_k")


def row_groups_of(t: Tables) -> DataFrame:
    """Line items as row groups of a supplier's file, one sheet per return flag."""
    end = (F.col("l_orderkey") + F.col("l_quantity")).cast("long")
    return t.lineitem.select(
        F.col("l_suppkey").alias("file_id"),
        F.concat(F.lit("file"), F.col("l_suppkey")).alias("filename"),
        F.col("l_returnflag").alias("sheet_name"),
        F.col("l_orderkey").alias("row_start"),
        end.alias("row_end"),
        F.lit(15_000).cast("long").alias("total_rows"),
        F.col("l_linenumber").alias("chunk_index"),
        "l_partkey",
        "l_quantity",
    )


@query(
    "G17_row_coverage_repass",
    """SELECT l_suppkey AS file_id, l_returnflag AS sheet_name, l_orderkey AS row_start, CAST(l_orderkey + l_quantity AS BIGINT) AS row_end
       FROM lineitem ORDER BY l_suppkey, l_orderkey, l_returnflag, l_partkey, l_linenumber LIMIT 1600""",
)
def _(t):
    groups = row_groups_of(t).orderBy("file_id", "row_start", "sheet_name", "l_partkey", "chunk_index")
    return retrieve.with_row_repass(lambda cap: groups.limit(cap)).select("file_id", "sheet_name", "row_start", "row_end")


@query(
    "G18_grouped_retrieval",
    f"WITH {dense_sql(6, 'e.label = q.label')} SELECT item_id, vec_id, distance, rank FROM dense",
)
def _(t):
    return dense_hits(t, max(6, 4), "label")


@query(
    "G19_merge_context",
    f"""WITH {dense_sql(12, 'e.label = q.label')}, arrivals AS (SELECT item_id, vec_id % 30 AS chunk_id, vec_id, distance, rank AS arrival FROM dense),
        firsts AS (SELECT item_id, chunk_id, arg_min(vec_id, arrival) AS vec_id, arg_min(distance, arrival) AS distance, min(arrival) AS arrival
                   FROM arrivals GROUP BY 1, 2)
        SELECT * FROM (SELECT item_id, chunk_id, vec_id, row_number() OVER (PARTITION BY item_id ORDER BY -distance DESC, arrival) AS rank FROM firsts)
        WHERE rank <= 8""",
)
def _(t):
    hits = dense_hits(t, 12, "label").select(
        "item_id", (F.col("vec_id") % 30).alias("chunk_id"), "vec_id", F.col("rank").alias("arrival"), (-F.col("distance")).alias("score")
    )
    return rank.merge_context(hits, "item_id", "arrival", "score", 8).select("item_id", "chunk_id", "vec_id", "rank")


SCOPE_SQL = """f AS (SELECT item_id, file_id, max(score) AS best FROM hits GROUP BY 1, 2),
  s AS (SELECT item_id, file_id, sheet_name, max(score) AS best FROM hits GROUP BY 1, 2, 3),
  chosen AS (SELECT item_id, arg_min(file_id, (-best, file_id)) AS selected_file FROM f GROUP BY 1),
  scope AS (SELECT c.item_id, selected_file, arg_min(sheet_name, (-best, sheet_name)) AS selected_sheet
    FROM chosen c JOIN s ON s.item_id = c.item_id AND s.file_id = selected_file GROUP BY 1, 2)"""


@query("G20_scope_from_hits", f"WITH {HITS_SQL}, {SCOPE_SQL} SELECT * FROM scope")
def _(t):
    return rank.scope_from_hits(hits_of(t), "item_id", "score")


@query(
    "G21_combined_route",
    f"""WITH {HITS_SQL}, top AS (SELECT arg_min(file_id, (-best, file_id)) AS file FROM (SELECT file_id, max(score) AS best FROM hits GROUP BY 1))
        SELECT lang AS group_key, CAST(sum(n_chars) AS DOUBLE) AS value FROM documents, top WHERE source = file GROUP BY 1""",
)
def _(t):
    # The scope of all requests together: one row reaches the driver, then the table part runs on it.
    scope = rank.scope_from_hits(hits_of(t).withColumn("all", F.lit(1)), "all", "score").first()
    spec = aggregate.AggregateSpec("sum", "n_chars", dimension="lang", conditions=(("source", "eq", scope["selected_file"]),))
    return spec.run(t.documents)


@query(
    "G22_context_block",
    f"""WITH {HITS_SQL} SELECT item_id, string_agg('[' || rank || '] file=' || filename || ' chunk=' || chunk_index || ' score='
        || printf('%.4f', score) || chr(10) || trim(content), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
        FROM hits WHERE trim(content) <> '' GROUP BY 1""",
)
def _(t):
    return rank.context_block(hits_of(t), "item_id", "score")


@query(
    "G23_active_version_filter",
    f"""WITH {RUNS_SQL}, {ACTIVE_SQL} SELECT l_orderkey AS run_id, o_custkey AS file_id, l_linenumber, l_partkey FROM lineitem JOIN orders
        ON l_orderkey = o_orderkey WHERE l_orderkey IN (SELECT run_id FROM active)""",
)
def _(t):
    runs = runs_of(t)
    chunks = t.lineitem.select(F.col("l_orderkey").alias("run_id"), "l_linenumber", "l_partkey").join(
        runs.select("file_id", "run_id"), "run_id"
    )
    return retrieve.active_versions(chunks, active_run_per_file(runs)).select("run_id", "file_id", "l_linenumber", "l_partkey")
