"""Tagging of request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from granary.functions import cells
from granary.operators import joins, tagging
from granary.plans.a_sources import CATALOG_SQL, catalog_of
from granary.plans.d_joins import FOLD
from granary.plans.registry import Tables, query
from granary.plans.shapes import TABLE_COLUMNS

# What users ask, by kind of event; the numbers come from the log.
ASKED = {
    "click": "Show a chart of value by month for user {}",
    "view": "What columns are in table user_{}?",
    "purchase": "Total value per week and user {}",
    "error": "Compare errors of user {} over time",
    "signup": "Find rows where user id is {}",
}


def requests_of(t: Tables) -> DataFrame:
    """Every event as a typed request, every user turn as a free one."""
    text = None
    for kind, phrase in ASKED.items():
        head, tail = phrase.split("{}")
        made = F.concat(F.lit(head), F.col("user_id").cast("string"), F.lit(tail))
        text = F.when(F.col("event_type") == kind, made) if text is None else text.when(F.col("event_type") == kind, made)
    asked = t.events.select(F.col("event_id").alias("request_id"), text.alias("text"))
    free = t.conversations.filter("role = 'user'").select((-F.col("conv_id") * 1000 - F.col("turn") - 1).alias("request_id"), "text")
    return asked.unionByName(free)


REQUESTS_SQL = "requests AS (SELECT event_id AS request_id, CASE event_type " + " ".join(
    "WHEN '{}' THEN '{}' || user_id || '{}'".format(kind, *phrase.split("{}")) for kind, phrase in ASKED.items()
) + """ END AS text FROM events UNION ALL SELECT -conv_id * 1000 - turn - 1, text FROM conversations WHERE role = 'user'),
  plain AS (SELECT request_id, text, trim(regexp_replace(lower(text), '[^a-zа-яё0-9]+', ' ', 'g')) AS q,
    ' ' || """ + FOLD.format("text") + """ || ' ' AS w FROM requests)"""


def any_sql(column: str, hints) -> str:
    return f"regexp_matches({column}, '" + "|".join(hints) + "')"


GRAIN_SQL = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, ' ({'|'.join(w)}) ') THEN '{g}'" for g, w in tagging.GRAINS.items()) + " END"
NUMBERS = (*tagging.COUNT_SUPERLATIVE, *tagging.COUNT, *tagging.SUM, *tagging.AVERAGE, *tagging.MINIMUM, *tagging.MAXIMUM)
ROUTE_SQL = f"""CASE WHEN q = '' THEN 'unknown' WHEN {any_sql('q', tagging.OVERVIEW)} THEN 'overview'
  WHEN {any_sql('q', tagging.SCHEMA)} OR ({any_sql('q', tagging.FILE_WORDS)} AND {any_sql('q', tagging.SCHEMA_PHRASES)}
    AND (NOT {any_sql('q', tagging.CODING)} OR {any_sql('q', tagging.SCHEMA_TERMS)})) THEN 'schema_question'
  WHEN {any_sql('q', tagging.CHART)} THEN 'chart'
  WHEN ({GRAIN_SQL.format("' ' || q || ' '")} IS NOT NULL AND regexp_matches(' ' || q || ' ', 'group by| by | по | over time | динам'))
    OR {any_sql('q', tagging.TREND)} THEN 'trend'
  WHEN {any_sql('q', tagging.COMPARISON)} THEN 'comparison' WHEN {any_sql('q', tagging.FILTERING)} THEN 'filtering'
  WHEN {any_sql('q', NUMBERS)} THEN 'aggregation' ELSE 'unknown' END"""
OPERATION_SQL = f"""CASE WHEN {any_sql('q', tagging.SUM)} THEN 'sum' WHEN {any_sql('q', tagging.AVERAGE)} THEN 'avg'
  WHEN {any_sql('q', tagging.MINIMUM)} THEN 'min' WHEN {any_sql('q', tagging.MAXIMUM)} THEN 'max'
  WHEN {any_sql('q', (*tagging.COUNT, *tagging.COUNT_SUPERLATIVE))} THEN 'count' END"""


@query("J01_tag_route", f"WITH {REQUESTS_SQL} SELECT {ROUTE_SQL} AS route, count(*) AS requests FROM plain GROUP BY 1")
def _(t):
    return requests_of(t).groupBy(tagging.route(F.col("text")).alias("route")).agg(F.count("*").alias("requests"))


@query(
    "J02_tag_operation",
    f"WITH {REQUESTS_SQL} SELECT coalesce({OPERATION_SQL}, 'none') AS operation, count(*) AS requests FROM plain GROUP BY 1",
)
def _(t):
    kind = F.coalesce(tagging.operation(F.col("text")), F.lit("none"))
    return requests_of(t).groupBy(kind.alias("operation")).agg(F.count("*").alias("requests"))


@query(
    "J03_tag_time_grain",
    f"WITH {REQUESTS_SQL} SELECT coalesce({GRAIN_SQL.format('w')}, 'none') AS grain, count(*) AS requests FROM plain GROUP BY 1",
)
def _(t):
    grain = F.coalesce(tagging.time_grain(F.col("text")), F.lit("none"))
    return requests_of(t).groupBy(grain.alias("grain")).agg(F.count("*").alias("requests"))


CYRILLIC, LATIN = "len(regexp_extract_all({}, '[Ѐ-ӿ]'))", "len(regexp_extract_all({}, '[A-Za-z]'))"


def language_sql(column: str) -> str:
    c, n = CYRILLIC.format(column), LATIN.format(column)
    return f"""CASE WHEN {c} >= 2 AND ({n} = 0 OR {c} * 2 >= {n}) THEN 'ru' WHEN {n} >= 2 AND ({c} = 0 OR {n} >= {c} * 2) THEN 'en'
      WHEN {c} > 0 THEN 'ru' WHEN {n} > 0 THEN 'en' ELSE 'ru' END"""


MIXED_SQL = "CASE WHEN doc_id % 5 = 0 THEN replace(replace(text, 'e', 'е'), 'n', 'ну') ELSE text END"


def mixed_documents(t: Tables) -> DataFrame:
    """Documents, some with Cyrillic letters put in, because the given texts have none."""
    cyrillic = F.replace(F.replace("text", F.lit("e"), F.lit("е")), F.lit("n"), F.lit("ну"))
    return t.documents.withColumn("text", F.when(F.col("doc_id") % 5 == 0, cyrillic).otherwise(F.col("text")))


@query("J05_detect_language", f"SELECT doc_id, {language_sql('x')} AS language FROM (SELECT doc_id, {MIXED_SQL} AS x FROM documents)")
def _(t):
    return mixed_documents(t).select("doc_id", tagging.language(F.col("text")).alias("language"))


LATIN_LIST = "[" + ", ".join(f"'{w}'" for w in tagging.LATIN_IN_RUSSIAN) + "]"


@query(
    "J06_language_mismatch",
    f"""WITH d AS (SELECT doc_id, {MIXED_SQL} AS x, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'ru' END AS wanted FROM documents),
        n AS (SELECT *, {CYRILLIC.format('x')} AS c, {LATIN.format('x')} AS l,
          len(list_filter(regexp_extract_all(lower(x), '[a-z]{{3,}}'), lambda w: NOT list_contains({LATIN_LIST}, w))) AS foreign_words FROM d)
        SELECT doc_id, wanted, NOT CASE WHEN c + l = 0 THEN true WHEN wanted = 'en' THEN l >= c WHEN c = 0 THEN false WHEN l = 0 THEN true
          WHEN c < l THEN false ELSE NOT (foreign_words > 0 AND c < l * 3) END AS mismatch FROM n""",
)
def _(t):
    wanted = F.when(F.col("doc_id") % 2 == 0, "en").otherwise("ru").alias("wanted")
    asked = mixed_documents(t).select("doc_id", "text", wanted)
    return asked.select("doc_id", "wanted", (~tagging.matches_language(F.col("text"), F.col("wanted"))).alias("mismatch"))


# What each kind of request should give: the named table; the quoted workbook, unless its name holds a wildcard, and what of
# it could stand unquoted; the notes but no code and no attribute; the unquoted part of a name whose ending no list holds.
@query(
    "J07_file_mentions",
    """WITH p AS (SELECT page_id, page_id % 4 AS kind, string_split(url, '/')[-1] AS tail FROM pages),
       b AS (SELECT *, regexp_extract(tail, '[A-Za-z0-9._-]*$') AS bare FROM p),
       c AS (SELECT page_id, 'report_' || page_id || '.csv' AS candidate FROM b WHERE kind = 0
          UNION SELECT page_id, tail || '.XLSX' FROM b WHERE kind = 1 AND tail <> '' AND NOT contains(tail, '?')
          UNION SELECT page_id, bare || '.XLSX' FROM b WHERE kind = 1 AND bare <> ''
          UNION SELECT page_id, 'notes' || page_id || '.md' FROM b WHERE kind = 2
          UNION SELECT page_id, bare || '.v2' FROM b WHERE kind = 3 AND bare <> '')
       SELECT page_id, candidate, lower(candidate) AS name FROM c""",
)
def _(t):
    tail = F.element_at(F.split("url", "/"), -1)
    phrase = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("Open the file report_"), F.col("page_id"), F.lit(".csv, then run pandas.DataFrame")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("see `"), tail, F.lit(".XLSX` please")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("AttributeError in main.py and df.columns, also notes"), F.col("page_id"), F.lit(".md")))
        .otherwise(F.concat(F.lit("compare "), tail, F.lit(".v2 with a*.csv")))
    )
    requests = t.pages.select("page_id", phrase.alias("text"))
    attached = t.pages.select("page_id", joins.folded_file_name(F.concat(tail, F.lit(".v2"))).alias("name"))
    return tagging.file_mentions(requests, "page_id", "text", attached)


SALES = ("customer", "orders", "lineitem", "part", "supplier", "nation", "region")


def scoped_tables(t: Tables) -> DataFrame:
    sales = F.col("table_name").isin(*SALES)
    return catalog_of(t).select(
        F.lit(1).alias("scope_id"),
        F.when(sales, 1).otherwise(2).alias("file_id"),
        F.when(sales, "sales book.xlsx").otherwise("texts.xlsx").alias("file_name"),
        "table_name",
        F.concat(F.lit("Sheet "), F.col("table_name")).alias("sheet_name"),
        "columns",
        "row_count",
    )


NAME_LISTS = " ".join(
    "WHEN '{}' THEN [{}]".format(t, ", ".join("'" + c.replace("_", " ") + "'" for c in columns)) for t, columns in TABLE_COLUMNS.items()
)


def overlap_sql(name: str) -> str:
    shared = f"len(list_intersect(list_distinct(string_split(q, ' ')), list_distinct(string_split({name}, ' '))))"
    return f"""CASE WHEN q = '' OR {name} = '' THEN 0.0 WHEN q = {name} THEN 1.0 WHEN contains(' ' || q || ' ', ' ' || {name} || ' ') THEN 0.92
      ELSE CAST({shared} AS DOUBLE) / len(list_distinct(string_split({name}, ' '))) END"""


@query(
    "J10_select_scope",
    f"""WITH {REQUESTS_SQL}, {CATALOG_SQL}, asked AS (SELECT DISTINCT q FROM plain),
        tabs AS (SELECT CASE WHEN table_name IN {SALES} THEN 1 ELSE 2 END AS file_id, CASE WHEN table_name IN {SALES} THEN 'sales book xlsx' ELSE 'texts xlsx' END AS file_name,
          table_name, 'sheet ' || table_name AS sheet, row_count, CASE table_name {NAME_LISTS} END AS cols FROM catalog),
        sized AS (SELECT *, max(row_count) OVER (PARTITION BY file_id) AS fmax, max(row_count) OVER () AS smax FROM tabs),
        base AS (SELECT q, s.*, CAST(greatest({overlap_sql('table_name')}, {overlap_sql('sheet')}) * 1.4
            + least(1.0, 0.22 * least(4, len(list_filter(cols, lambda c: contains(' ' || q || ' ', ' ' || c || ' '))))) AS DOUBLE) AS b,
            CAST({overlap_sql('file_name')} AS DOUBLE) AS nm FROM asked, sized s),
        sc AS (SELECT *, round(b + least(0.16, CAST(row_count AS DOUBLE) / fmax * 0.16), 9) AS ts, round(b + least(0.16, CAST(row_count AS DOUBLE) / smax * 0.16), 9) AS fs FROM base),
        tr AS (SELECT *, row_number() OVER (PARTITION BY q, file_id ORDER BY ts DESC, sheet, table_name) AS r FROM sc),
        f AS (SELECT q, file_id, any_value(file_name) AS file_name, round(max(nm) * 2.2 + max(fs), 9) AS score, max(CASE WHEN r = 1 THEN table_name END) AS best,
          max(CASE WHEN r = 1 THEN ts END) AS t1, max(CASE WHEN r = 2 THEN ts END) AS t2 FROM tr GROUP BY 1, 2),
        fr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, file_name) AS r FROM f),
        d AS (SELECT a.q, a.file_id, a.best, CASE WHEN (a.score <= 0.1 AND b.score <= 0.1) OR round(a.score - b.score, 9) < 0.14 THEN 'ambiguous_file'
          WHEN (a.t1 <= 0.08 AND a.t2 <= 0.08) OR round(a.t1 - a.t2, 9) < 0.14 THEN 'ambiguous_table' ELSE 'selected' END AS status
          FROM fr a JOIN fr b ON a.q = b.q AND a.r = 1 AND b.r = 2)
        SELECT request_id, status, CASE WHEN status <> 'ambiguous_file' THEN file_id END AS selected_file,
          CASE WHEN status = 'selected' THEN best END AS selected_table FROM plain JOIN d USING (q)""",
)
def _(t):
    return tagging.select_scope(requests_of(t).withColumn("scope_id", F.lit(1)), scoped_tables(t))


def dialogue_of(t: Tables) -> DataFrame:
    """User turns of the given conversations; some get the words of a table request or of a refinement."""
    n = (F.col("conv_id") + F.expr("turn div 2")) % 4
    text = (
        F.when(n == 0, F.concat(F.lit("Show total value by month of "), F.col("text")))
        .when(n == 1, "group by week")
        .when(n == 2, "what about column user_id")
        .otherwise(F.col("text"))
    )
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", text.alias("text"))


def pattern_sql(words) -> str:
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")($|[^\p{L}\p{N}_])"


LOW = "lower(trim(text))"
WORDS_SQL = f"len(list_filter(string_split(replace({LOW}, chr(10), ' '), ' '), lambda x: trim(x) <> ''))"
REFINES_SQL = f"""({LOW} <> '' AND length({LOW}) <= 180 AND {WORDS_SQL} <= 20 AND NOT regexp_matches({LOW}, '{pattern_sql(tagging.CODING_CUES)}')
  AND (regexp_matches({LOW}, '^({"|".join(tagging.FOLLOWUP_PREFIXES)})') OR {any_sql(LOW, tagging.FOLLOWUP_PARTS)}
    OR ({WORDS_SQL} <= 16 AND (regexp_matches({LOW}, '{pattern_sql(tagging.DATA_CUES)}') OR regexp_matches({LOW}, 'столб|колонк|строк|запис|таблиц|лист|схем|распредел|описан')))
    OR ({WORDS_SQL} <= 12 AND regexp_matches({LOW}, '[a-z_][a-z0-9_]{{2,}}') AND {any_sql(LOW, tagging.REFINEMENT_MARKERS)})))"""


@query(
    "J13_followup_link",
    f"""WITH u AS (SELECT conv_id, turn, CASE (conv_id + turn // 2) % 4 WHEN 0 THEN 'Show total value by month of ' || text
          WHEN 1 THEN 'group by week' WHEN 2 THEN 'what about column user_id' ELSE text END AS text
          FROM conversations WHERE role = 'user'),
        p AS (SELECT *, trim(regexp_replace(lower(text), '[^a-zа-яё0-9]+', ' ', 'g')) AS q, ' ' || {FOLD.format('text')} || ' ' AS w FROM u WHERE trim(text) <> ''),
        f AS (SELECT conv_id, turn, text, {REFINES_SQL} AS refines,
          {ROUTE_SQL} <> 'unknown' OR {OPERATION_SQL} IS NOT NULL OR {GRAIN_SQL.format('w')} IS NOT NULL AS tab FROM p),
        a AS (SELECT *, lag(turn) OVER w AS p_turn, lag(text) OVER w AS p_text, lag(refines) OVER w AS p_ref, lag(tab) OVER w AS p_tab,
          last_value(CASE WHEN tab AND NOT refines THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f_turn
          FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        c AS (SELECT *, CASE WHEN p_ref THEN coalesce(f_turn, p_turn) ELSE p_turn END AS anchor FROM a),
        j AS (SELECT c.*, coalesce(b.tab AND c.refines, false) AS linked, b.text AS a_text FROM c LEFT JOIN f b ON b.conv_id = c.conv_id AND b.turn = c.anchor)
        SELECT conv_id, turn, linked AS is_followup, CASE WHEN linked THEN anchor END AS anchor, CASE WHEN linked THEN a_text
          || CASE WHEN anchor <> p_turn THEN chr(10) || 'Follow-up refinement: ' || p_text ELSE '' END || chr(10) || 'Follow-up refinement: ' || text ELSE text END AS effective_text FROM j""",
)
def _(t):
    return tagging.followup_links(dialogue_of(t), "conv_id", "turn", "text")


@query(
    "J14_history_window",
    """SELECT conv_id, turn, count(*) OVER w AS messages, CAST(coalesce(sum(length(substr(text, 1, 1500))) OVER w, 0) AS BIGINT) AS chars,
         coalesce(min(role) OVER w, '') AS first_role FROM conversations
       WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""",
)
def _(t):
    windows = tagging.history_windows(t.conversations, "conv_id", "turn")
    return windows.select(
        "conv_id",
        "turn",
        F.size("history").cast("long").alias("messages"),
        F.aggregate("history", F.lit(0).cast("long"), lambda n, m: n + F.length(m["text"])).alias("chars"),
        F.coalesce(F.array_min(F.transform("history", lambda m: m["role"])), F.lit("")).alias("first_role"),
    )


SECRET_SQL = r"(?i)(bearer\s+[a-z0-9._\-]+|sk-[a-z0-9]{8,}|ghp_[a-z0-9]{12,})"


@query(
    "J15_redact",
    f"""SELECT doc_id, CASE WHEN regexp_matches(text, '{SECRET_SQL}') THEN '<redacted>' ELSE text END AS text, '<redacted>' AS token,
        CASE WHEN doc_id % 3 = 0 THEN '<redacted>' ELSE source END AS note FROM documents""",
)
def _(t):
    note = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Bearer "), "source")).otherwise(F.col("source"))
    fields = F.create_map(F.lit("text"), "text", F.lit("Access_Token "), "lang", F.lit("note"), note)
    safe = t.documents.select("doc_id", tagging.redact_map(fields).alias("m"))
    return safe.select("doc_id", *[F.element_at("m", F.lit(k)).alias(n) for k, n in (("text", "text"), ("Access_Token ", "token"), ("note", "note"))])


def answers_of(t: Tables) -> DataFrame:
    """Each user turn with the message after it, worded as questions about files and refusals now and then."""
    asked = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    said = t.conversations.filter("role <> 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    n = F.col("conv_id") % 3
    question = F.when(n == 0, F.concat(F.lit("Which rows of the file match: "), "q")).when(n == 1, F.concat(F.lit("python code for "), "q"))
    refusal = F.concat(F.lit("Sorry, as an AI I cannot open files or read the data. "), "a")
    return asked.join(said, ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        question.otherwise(F.col("q")).alias("question"),
        F.when(F.col("turn") % 4 == 0, refusal).otherwise(F.col("a")).alias("answer"),
        (F.length("a") % 3).alias("hits"),
        (F.col("conv_id") % 7 == 0).alias("file_route"),
    )


ANSWERS_SQL = """answers AS (SELECT u.conv_id, u.turn, CASE u.conv_id % 3 WHEN 0 THEN 'Which rows of the file match: ' || u.text WHEN 1 THEN 'python code for ' || u.text
    ELSE u.text END AS question, CASE WHEN u.turn % 4 = 0 THEN 'Sorry, as an AI I cannot open files or read the data. ' || s.text ELSE s.text END AS answer,
    length(s.text) % 3 AS hits, u.conv_id % 7 = 0 AS file_route
  FROM conversations u JOIN conversations s ON u.conv_id = s.conv_id AND s.turn = u.turn + 1 AND u.role = 'user' AND s.role <> 'user')"""
NO_ACCESS_SQL = tagging.NO_ACCESS.replace("'", "''")


@query(
    "J16_evidence_flags",
    f"""WITH {ANSWERS_SQL}, f AS (SELECT *, lower(trim(question)) AS q, lower(trim(answer)) AS a FROM answers),
        s AS (SELECT *, regexp_matches(q, '{pattern_sql(tagging.FILE_CUES)}') OR regexp_matches(q, '{tagging.FILE_STEMS}') AS data,
          regexp_matches(q, '{pattern_sql(tagging.TABLE_CUES)}') OR regexp_matches(q, '{tagging.TABLE_STEMS}') AS tabular,
          regexp_matches(q, '{pattern_sql(tagging.QUESTION_CODING)}') OR regexp_matches(q, 'питон|код') AS coding, regexp_matches(a, '{NO_ACCESS_SQL}') AS claims FROM f),
        e AS (SELECT *, q <> '' AND NOT (coding AND NOT tabular AND NOT file_route) AND (data OR tabular OR file_route) AS aware FROM s)
        SELECT conv_id, turn, aware AS file_aware, hits > 0 AS evidence_available, claims AS claims_no_access, aware AND hits > 0 AND claims AS wrong_claim FROM e""",
)
def _(t):
    flags = tagging.evidence_flags(answers_of(t), "question", "answer", "hits", "file_route")
    return flags.select("conv_id", "turn", "file_aware", "evidence_available", "claims_no_access", "wrong_claim")


REPORT_PARTS = (
    "'# Overview' || chr(10) || 'rows and columns of the table, with lang and source' || chr(10) || '## Metrics' || chr(10) || text || chr(10) "
    "|| '## Relationships' || chr(10) || 'correlation of quality and size' || chr(10) || '## Charts' || chr(10) || '![plot](http://x/uploads/a.png)'"
)


@query(
    "J17_report_quality",
    f"""WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {REPORT_PARTS} WHEN 1 THEN text ELSE 'Request was processed. ' || text END AS a FROM documents),
        c AS (SELECT doc_id, length(trim(a)) >= 260 AS long_enough, NOT regexp_matches(lower(a), '{"|".join(tagging.WEAK_PHRASES)}') AS no_weak_phrase,
          len(regexp_extract_all(trim(a), '(?m)^\\s{{0,3}}#{{1,4}}\\s+\\S+')) >= 4 OR len(regexp_extract_all(trim(a), '(?m)^[A-Za-zА-Яа-я][^:\\n]{{3,80}}:\\s*$')) >= 4 AS sections,
          regexp_matches(lower(a), 'rows|columns|metric|statistic') AS metrics, contains(lower(a), 'lang') AND contains(lower(a), 'source') AS column_references,
          contains(a, '![') AND contains(a, '](') AND regexp_matches(lower(a), '/uploads/|http://|https://') AS visual,
          regexp_matches(lower(a), 'relationship|dependency|correlation|feature interaction') AS relationships FROM r)
        SELECT *, long_enough AND no_weak_phrase AND sections AND metrics AND column_references AND visual AND relationships AS sufficient FROM c""",
)
def _(t):
    report = F.concat(
        F.lit("# Overview\nrows and columns of the table, with lang and source\n## Metrics\n"),
        "text",
        F.lit("\n## Relationships\ncorrelation of quality and size\n## Charts\n![plot](http://x/uploads/a.png)"),
    )
    n = F.col("doc_id") % 3
    log = t.documents.select(
        "doc_id",
        F.lit("full analysis please").alias("q"),
        F.when(n == 0, report).when(n == 1, F.col("text")).otherwise(F.concat(F.lit("Request was processed. "), "text")).alias("a"),
        F.array(F.lit("lang"), F.lit("Source")).alias("cols"),
        F.lit(True).alias("has_artifacts"),
    )
    return tagging.report_quality(log, "q", "a", "cols", "has_artifacts").drop("q", "a", "cols", "has_artifacts", "in_language")


@query(
    "J18_embedding_identity",
    """SELECT mode, model, count(*) AS files FROM (SELECT CASE event_type WHEN 'click' THEN 'local' WHEN 'view' THEN 'aihub' WHEN 'purchase' THEN 'aihub' END AS mode,
         CASE event_type WHEN 'click' THEN 'm' || user_id WHEN 'view' THEN 'arctic:v2' WHEN 'purchase' THEN NULL WHEN 'error' THEN 'other:m1' ELSE NULL END AS model
         FROM events) GROUP BY 1, 2""",
)
def _(t):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", F.concat(F.lit(" Ollama:m"), F.col("user_id")))
        .when(kind == "view", "corporate: arctic:v2")
        .when(kind == "purchase", "AIHub:")
        .when(kind == "error", "other:m1")
    )
    mode, model = tagging.embedding_identity(raw)
    return t.events.groupBy(mode.alias("mode"), model.alias("model")).agg(F.count("*").alias("files"))


@query("J19_folded_text", f"SELECT doc_id, {FOLD.format('text')} AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", cells.folded_words(F.col("text")).alias("folded"))
