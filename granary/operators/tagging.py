"""Batch tagging of a request log: routes, operations, languages, files, scopes and follow-ups."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.functions import cells
from granary.operators.joins import folded_file_name
from granary.operators.ordering import PIECE, attach, carried, in_pieces, salted_join, with_position

# Words that reveal what a request wants.
OVERVIEW = (
    "overview", "summary", "summarize table", "full analysis", "full description", "description for each column",
    "show full description for each column", "analyze dataset", "column statistics", "per column", "each column",
    "each field", "dataset profile", "table summary", "dataset summary", "полное описание", "по каждому столб",
    "по каждой колон", "обзор", "общий анализ", "полный анализ", "покажи статистики", "покажи метрики",
)
SCHEMA = (
    "schema", "columns", "column names", "list columns", "what columns", "which fields are important",
    "what is in this file", "tell me about this file", "what can i analyze here", "which sheets", "what sheets",
    "sheets available", "which tables", "what tables", "tables available", "какие колонки", "какие столбцы",
    "какие поля", "список колонок", "список полей",
)
FILE_WORDS = ("file", "files", "dataset", "spreadsheet", "workbook", "sheet", "table", "csv", "tsv", "xlsx", "xls")
SCHEMA_PHRASES = (
    "what fields", "which fields", "what data in", "what data is in", "what data are in", "data in file", "data there",
    "show me the data there", "information about data", "information about the data", "get me information about data",
    "read the file and", "read this file and",
)
CODING = (
    "python", "pandas", "numpy", "matplotlib", "seaborn", "plotly", "code", "script", "function", "class",
    "attributeerror", "exception", "traceback",
)
SCHEMA_TERMS = ("schema", "column", "columns", "field", "fields", "sheet", "table")
CHART = ("chart", "graph", "plot", "histogram", "distribution", "диаграм", "график", "визуал", "распредел")
TREND = (
    "trend", "time series", "timeseries", "over time", "динам", "тренд", "по времени", "помесяч", "по месяц",
)
COMPARISON = ("compare", "comparison", "сравни", "сравнение", "сопостав")
FILTERING = (
    "where", "filter", "lookup", "find rows", "show rows", "show records", "где ", "фильтр", "найди строки",
    "покажи строки", "покажи записи",
)
COUNT = ("count", "how many", "сколько", "количество", "число")
SUM = (
    "sum", "total", "volume", "spend", "spending", "expense", "expenses", "revenue", "sales", "объем", "объём",
    "затрат", "расход", "трат", "стоим", "сумм", "итого",
)
AVERAGE = ("avg", "average", "mean", "средн")
MINIMUM = ("min", "миним")
MAXIMUM = ("max", "максим")
COUNT_SUPERLATIVE = (
    "most records", "most rows", "highest number of records", "largest number of records", "больше всего запис",
    "больше всего строк", "максимум запис", "максимум строк",
)
GRAINS = {
    "day": ("day", "days", "daily", "день", "дни", "дней", "дневн"),
    "week": ("week", "weeks", "weekly", "неделя", "недели", "недель", "еженедел"),
    "month": ("month", "months", "monthly", "месяц", "месяца", "месяцы", "месяцев", "месяцам", "помесяч"),
    "quarter": ("quarter", "quarters", "quarterly", "q1", "q2", "q3", "q4", "квартал", "кварталы", "поквартал"),
    "year": ("year", "years", "yearly", "annual", "annually", "год", "года", "годы", "годов", "ежегод"),
}
REFINEMENT = "follow-up refinement:"


def plain_request(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-zа-яё0-9]+", " "))


def has_any(text: Column, hints: Sequence[str]) -> Column:
    return text.rlike("|".join(re.escape(h).replace(r"\ ", " ") for h in hints))


def has_word(text: Column, words: Sequence[str]) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" ")).rlike(" (" + "|".join(words) + ") ")


def latest_refinement(text: Column) -> Column:
    """What the request asks last: the text after the last refinement mark, else all of it."""
    last = F.regexp_extract(text, r"(?is).*follow-up refinement:\s*([^\n]+)", 1)
    return F.when(last != "", last).otherwise(text)


def _route(q: Column) -> Column:
    asks_file = has_any(q, FILE_WORDS) & has_any(q, SCHEMA_PHRASES) & (~has_any(q, CODING) | has_any(q, SCHEMA_TERMS))
    padded = F.concat(F.lit(" "), q, F.lit(" "))
    grouped_time = _grain(q).isNotNull() & padded.rlike("group by| by | по | over time | динам")
    numbers = (*COUNT, *SUM, *AVERAGE, *MINIMUM, *MAXIMUM)
    return (
        F.when(q == "", "unknown")
        .when(has_any(q, OVERVIEW), "overview")
        .when(has_any(q, SCHEMA) | asks_file, "schema_question")
        .when(has_any(q, CHART), "chart")
        .when(grouped_time | has_any(q, TREND), "trend")
        .when(has_any(q, COMPARISON), "comparison")
        .when(has_any(q, FILTERING), "filtering")
        .when(has_any(q, (*COUNT_SUPERLATIVE, *numbers)), "aggregation")
        .otherwise("unknown")
    )


def route(text: Column) -> Column:
    focus, full = _route(plain_request(latest_refinement(text))), _route(plain_request(text))
    return F.when(focus != "unknown", focus).otherwise(full)


def _operation(q: Column) -> Column:
    return (
        F.when(has_any(q, SUM), "sum")
        .when(has_any(q, AVERAGE), "avg")
        .when(has_any(q, MINIMUM), "min")
        .when(has_any(q, MAXIMUM), "max")
        .when(has_any(q, (*COUNT, *COUNT_SUPERLATIVE)), "count")
    )


def operation(text: Column) -> Column:
    return F.coalesce(_operation(plain_request(latest_refinement(text))), _operation(plain_request(text)))


def _grain(q: Column) -> Column:
    out = None
    for grain, words in GRAINS.items():
        out = F.when(has_word(q, words), grain) if out is None else out.when(has_word(q, words), grain)
    return out


def time_grain(text: Column) -> Column:
    return _grain(cells.folded_words(text))


def letters(text: Column) -> tuple[Column, Column]:
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit("[Ѐ-ӿ]")), F.regexp_count(text, F.lit("[A-Za-z]"))


def language(text: Column) -> Column:
    cyrillic, latin = letters(text)
    return (
        F.when((cyrillic >= 2) & ((latin == 0) | (cyrillic * 2 >= latin)), "ru")
        .when((latin >= 2) & ((cyrillic == 0) | (latin >= cyrillic * 2)), "en")
        .when(cyrillic > 0, "ru")
        .when(latin > 0, "en")
        .otherwise("ru")
    )


# Latin words that may stand in a Russian answer.
LATIN_IN_RUSSIAN = (
    "api", "csv", "id", "json", "pdf", "sql", "tsv", "url", "uuid", "xlsx", "xls", "avg", "min", "max", "sum", "count",
    "table", "tables", "sheet", "sheets", "column", "columns", "row", "rows", "dataset", "created", "updated", "status",
    "amount", "total", "month", "week", "day", "year",
)


def matches_language(answer: Column, wanted: Column) -> Column:
    cyrillic, latin = letters(answer)
    foreign = F.size(
        F.array_except(
            F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit("[A-Za-z]{3,}"), F.lit(0)), F.lower),
            F.array(*[F.lit(w) for w in LATIN_IN_RUSSIAN]),
        )
    )
    russian = (
        F.when(cyrillic == 0, False)
        .when(latin == 0, True)
        .when(cyrillic < latin, False)
        .otherwise(~((foreign > 0) & (cyrillic < latin * 3)))
    )
    return F.when(cyrillic + latin == 0, True).when(wanted == "en", latin >= cyrillic).otherwise(russian)


# How file names look in a request, and the extensions that count.
QUOTED_FILE = r"[\"'`«]([^\"'`»]{1,220}\.[A-Za-z0-9]{1,16})[\"'`»]"
BARE_FILE = (
    r"(?<![A-Za-zА-Яа-яЁё0-9._\-])([A-Za-zА-Яа-яЁё0-9._\-\[\]()]{1,220}\.[A-Za-z0-9]{1,16})(?![A-Za-zА-Яа-яЁё0-9._\-])"
)
FILE_EXTENSIONS = (
    "csv", "tsv", "xlsx", "xls", "xlsm", "xlsb", "ods", "parquet", "txt", "md", "rst", "pdf", "doc", "docx", "rtf", "ppt",
    "pptx", "json", "jsonl", "yaml", "yml", "xml", "html", "htm", "log", "zip", "gz", "bz2", "7z", "tar", "png", "jpg",
    "jpeg", "gif", "bmp", "webp", "svg",
)
CODE_EXTENSIONS = (
    "py", "pyw", "ipynb", "js", "jsx", "ts", "tsx", "java", "kt", "scala", "go", "rs", "c", "h", "hpp", "cc", "cpp", "cs",
    "php", "rb", "pl", "r", "swift", "m", "mm", "sh", "bash", "zsh", "ps1", "bat", "cmd", "sql",
)
FILE_CONTEXT = (
    r"(?i)\b(file|files|filename|document|documents|dataset|spreadsheet|workbook|sheet|csv|tsv|xlsx|xls|parquet|pdf)\b"
    r"|\b(in|from|inside|within|about)\s+(the\s+)?(file|files|document|dataset|spreadsheet|sheet|table)\b"
    r"|(^|\s)(в|из|про)\s+(файл|документ|таблиц|датасет|лист)"
)
TECHNICAL_CONTEXT = (
    r"(?i)\b(python|pandas|numpy|matplotlib|seaborn|plotly|sklearn|scipy)\b"
    r"|\b(traceback|stack\s*trace|attributeerror|typeerror|nameerror|syntaxerror|importerror|exception|error)\b"
    r"|\b(object\s+has\s+no\s+attribute|module|class|method|function)\b|ошибк|трейсбек|исключени"
)


def file_mentions(requests: DataFrame, key: str, text: str, attached: DataFrame | None = None) -> DataFrame:
    """File-like tokens of each request that context and extension rules keep.

    ``attached`` holds (key, name) rows with the folded names of the files of a request; those are always kept.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(F.regexp_extract_all(body, F.lit(QUOTED_FILE), F.lit(1)), F.regexp_extract_all(body, F.lit(BARE_FILE), F.lit(1)))
    rows = requests.select(
        key,
        body.rlike(FILE_CONTEXT).alias("_file_context"),
        body.rlike(TECHNICAL_CONTEXT).alias("_technical"),
        F.posexplode(F.array_distinct(found)).alias("_at", "_raw"),
    )
    rows = rows.withColumn("candidate", F.regexp_replace(F.trim("_raw"), r"^[.,;:!?)\]}»]+|[.,;:!?)\]}»]+$", ""))
    rows = rows.withColumn("name", folded_file_name(F.col("candidate"))).filter("name <> ''")
    # of several spellings the first stays
    rows = rows.groupBy(key, "name").agg(F.min_by(F.struct("_file_context", "_technical", "candidate"), "_at").alias("_first"))
    rows = rows.select(key, "name", "_first.*")
    if attached is not None:
        known = attached.select(key, "name").distinct().withColumn("_known", F.lit(True))
        rows = rows.join(known, [key, "name"], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    else:
        rows = rows.withColumn("_known", F.lit(False))
    extension = F.when(F.col("name").contains("."), F.element_at(F.split("name", r"\."), -1)).otherwise("")
    sure, code = extension.isin(*FILE_EXTENSIONS), extension.isin(*CODE_EXTENSIONS)
    dotted = F.col("name").rlike(r"^\.*[A-Za-z_][A-Za-z0-9_]*(\.+[A-Za-z_][A-Za-z0-9_]*)+\.*$")
    path = F.col("candidate").rlike(r"[/\\]")
    technical = F.col("_technical")
    with_context = ~(dotted & ~sure & technical)
    without_context = ~path & ~code & sure
    keep = (
        ~F.col("name").rlike(r"[*?]")
        & (extension != "")
        & (F.col("_known") | (~extension.rlike("^[0-9]+$") & F.when(F.col("_file_context"), with_context).otherwise(without_context)))
    )
    return rows.filter(keep).select(key, "candidate", "name")


# Weights and margin of the scope choice.
FILE_WEIGHT, NAME_WEIGHT, COLUMN_WEIGHT, ROW_BONUS, SCOPE_MARGIN = 2.2, 1.4, 0.22, 0.16, 0.14


def name_overlap(request: Column, name: Column) -> Column:
    """1 for equal texts, 0.92 for a phrase inside the request, else the share of the name's words in it."""
    words = F.array_distinct(F.split(name, " "))
    shared = F.size(F.array_intersect(F.array_distinct(F.split(request, " ")), words))
    inside = F.concat(F.lit(" "), request, F.lit(" ")).contains(F.concat(F.lit(" "), name, F.lit(" ")))
    return F.when((name == "") | (request == ""), 0.0).when(request == name, 1.0).when(inside, 0.92).otherwise(shared / F.size(words))


def select_scope(requests: DataFrame, tables: DataFrame) -> DataFrame:
    """File and table each request means: selected, ambiguous_file or ambiguous_table.

    ``requests``: scope_id, request_id, text; ``tables``: scope_id, file_id, file_name, table_name,
    sheet_name, columns, row_count.  A request meets only the tables of its scope, and equal requests
    of a scope are scored once.
    """
    fold = lambda c: plain_request(F.coalesce(c, F.lit("")))
    asked = requests.select("scope_id", "request_id", fold(F.col("text")).alias("_q"))
    sizes = tables.groupBy("scope_id", "file_id").agg(F.max("row_count").alias("_file_max"), F.count("*").alias("_tables"))
    scopes = sizes.groupBy("scope_id").agg(F.max("_file_max").alias("_scope_max"), F.count("*").alias("_files"))
    named = tables.join(sizes, ["scope_id", "file_id"]).join(scopes, "scope_id").select(
        "scope_id", "file_id", "table_name", "sheet_name", "row_count", "_file_max", "_tables", "_scope_max", "_files",
        fold(F.col("file_name")).alias("_file"),
        fold(F.col("table_name")).alias("_table"),
        fold(F.col("sheet_name")).alias("_sheet"),
        F.transform("columns", fold).alias("_columns"),
    )
    q = F.col("_q")
    hits = F.least(F.lit(4), F.size(F.filter("_columns", lambda c: name_overlap(q, c) >= 0.9)))
    base = (
        F.greatest(name_overlap(q, F.col("_table")), name_overlap(q, F.col("_sheet"))) * NAME_WEIGHT
        + F.least(F.lit(1.0), hits * COLUMN_WEIGHT)
    )
    bonus = lambda top: F.when(F.col(top) > 0, F.least(F.lit(ROW_BONUS), F.col("row_count") / F.col(top) * ROW_BONUS)).otherwise(0.0)
    scored = salted_join(asked.select("scope_id", "_q").distinct(), named, ["scope_id"], "_q").select(
        "scope_id", "_q", "file_id", "table_name", "sheet_name", "_tables", "_files", "_file",
        F.round(base + bonus("_file_max"), 9).alias("_table_score"),
        F.round(base + bonus("_scope_max"), 9).alias("_for_file"),
        name_overlap(q, F.col("_file")).alias("_name"),
    )
    keys = ["scope_id", "_q"]
    in_file = Window.partitionBy(*keys, "file_id").orderBy(F.col("_table_score").desc(), F.lower("sheet_name"), F.lower("table_name"))
    ranked = scored.withColumn("_r", F.row_number().over(in_file))
    files = ranked.groupBy(*keys, "file_id").agg(
        F.round(F.max("_name") * FILE_WEIGHT + F.max("_for_file"), 9).alias("_score"),
        F.first("_file").alias("_file"),
        F.first("_tables").alias("_tables"),
        F.first("_files").alias("_files"),
        F.max(F.when(F.col("_r") == 1, F.col("table_name"))).alias("_best_table"),
        F.max(F.when(F.col("_r") == 1, F.col("_table_score"))).alias("_t1"),
        F.max(F.when(F.col("_r") == 2, F.col("_table_score"))).alias("_t2"),
    )
    order = Window.partitionBy(*keys).orderBy(F.col("_score").desc(), "_file", "file_id")
    top = files.withColumn("_r", F.row_number().over(order)).filter("_r <= 2")
    first, second = F.col("_r") == 1, F.col("_r") == 2
    one = lambda c: F.max(F.when(first, F.col(c))).alias(c)
    best = top.groupBy(*keys).agg(
        *[one(c) for c in ("file_id", "_score", "_files", "_tables", "_best_table", "_t1", "_t2")],
        F.max(F.when(second, F.col("_score"))).alias("_score2"),
    )

    def unclear(a: str, b: str, floor: float) -> Column:
        return F.col(b).isNotNull() & (((F.col(a) <= floor) & (F.col(b) <= floor)) | (F.round(F.col(a) - F.col(b), 9) < SCOPE_MARGIN))

    status = (
        F.when((F.col("_files") > 1) & unclear("_score", "_score2", 0.1), "ambiguous_file")
        .when((F.col("_tables") > 1) & unclear("_t1", "_t2", 0.08), "ambiguous_table")
        .otherwise("selected")
    )
    decided = best.withColumn("status", status)
    return asked.join(decided, keys).select(
        "request_id",
        "status",
        F.when(F.col("status") != "ambiguous_file", F.col("file_id")).alias("selected_file"),
        F.when(F.col("status") == "selected", F.col("_best_table")).alias("selected_table"),
    )


# How a short refinement begins or what it contains.
FOLLOWUP_PREFIXES = (
    "use ", "take ", "from ", "show ", "describe ", "explain ", "what about ", "how about ", "group by ", "yes", "да", "ага",
    "покажи", "объясни", "опиши", "что видно", "что значит", "из ", "по ", "месяц", "недел", "ден", "квартал", "год", "нарисуй",
    "month", "week", "day", "quarter", "year",
)
FOLLOWUP_PARTS = (
    "from date", "from dates", "from the date", "date column", "datetime column", "use created", "use date", "use month",
    "group by month", "group by week", "group by day", "group by quarter", "group by year", "distribution by", "split by",
    "breakdown by", "per column", "each column", "each field", "what does", "what is in column", "column ", "field ",
    "из дат", "из даты", "взять из дат", "выделив месяц", "нужно график", "по каждому столб", "по каждой колон",
    "что видно по", "что значит колонк", "объясни колонк", "сделай распредел",
)
DATA_CUES = (
    "column", "columns", "field", "fields", "row", "rows", "record", "records", "table", "sheet", "schema", "distribution",
    "breakdown",
)
CODING_CUES = (
    "python", "pandas", "numpy", "matplotlib", "seaborn", "plotly", "sql", "code", "snippet", "tutorial", "example", "api",
    "function", "class", "script", "код", "питон",
)
REFINEMENT_MARKERS = (" by ", " per ", "по ", "show ", "describe ", "explain ", "покажи", "объясни", "что ")


def whole_words(text: Column, words: Sequence[str]) -> Column:
    return text.rlike(r"(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")($|[^\p{L}\p{N}_])")


def is_refinement(text: Column) -> Column:
    """A short request that only makes sense after another one."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    words = F.size(F.filter(F.split(F.replace(t, F.lit("\n"), F.lit(" ")), " "), lambda w: F.trim(w) != ""))
    starts = t.rlike("^(" + "|".join(FOLLOWUP_PREFIXES) + ")")
    cue = (words <= 16) & (
        whole_words(t, DATA_CUES) | t.rlike("столб|колонк|строк|запис|таблиц|лист|схем|распредел|описан")
    )
    named = (words <= 12) & t.rlike(r"[a-z_][a-z0-9_]{2,}") & has_any(t, REFINEMENT_MARKERS)
    short = (t != "") & (F.length(t) <= 180) & (words <= 20) & ~whole_words(t, CODING_CUES)
    return short & (starts | has_any(t, FOLLOWUP_PARTS) | cue | named)


def is_table_request(text: Column) -> Column:
    return (route(text) != "unknown") | operation(text).isNotNull() | time_grain(text).isNotNull()


def followup_links(turns: DataFrame, conversation: str, order: str, text: str) -> DataFrame:
    """User turns with the request they refine: the previous one, or the last full request before a refinement.

    The last request and the last full one run along each conversation; pieces of a long conversation
    hand them on.
    """
    flagged = turns.filter(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0).select(
        conversation,
        order,
        text,
        is_refinement(F.col(text)).alias("_refines"),
        is_table_request(F.col(text)).alias("_about_table"),
    )
    pieces = in_pieces(flagged, [conversation], [order])
    turn = F.struct(order, text, "_refines", "_about_table")
    full = F.when(F.col("_about_table") & ~F.col("_refines"), turn)
    before = Window.partitionBy(conversation, PIECE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = pieces.withColumns({"_previous": F.max(turn).over(before), "_full": F.max(full).over(before)})
    handed = carried(pieces, [conversation], {"_p": F.max(turn), "_f": F.max(full)}, {"_cp": F.max("_p"), "_cf": F.max("_f")})
    joined = attach(local, handed, [conversation]).withColumns(
        {"_previous": F.coalesce("_previous", "_cp"), "_full": F.coalesce("_full", "_cf")}
    )
    anchor = F.when(F.col("_previous._refines"), F.coalesce("_full", "_previous")).otherwise(F.col("_previous"))
    chosen = joined.withColumn("_anchor", anchor)
    linked = F.coalesce(F.col("_anchor._about_table") & F.col("_refines"), F.lit(False))
    mark = F.lit("\nFollow-up refinement: ")
    effective = F.concat(
        F.col(f"_anchor.{text}"),
        F.when(F.col(f"_anchor.{order}") != F.col(f"_previous.{order}"), F.concat(mark, F.col(f"_previous.{text}"))).otherwise(""),
        mark,
        F.col(text),
    )
    return chosen.select(
        conversation,
        order,
        linked.alias("is_followup"),
        F.when(linked, F.col(f"_anchor.{order}")).alias("anchor"),
        F.when(linked, effective).otherwise(F.col(text)).alias("effective_text"),
    )


def history_windows(messages: DataFrame, conversation: str, order: str, n: int = 6, chars: int = 1500, with_assistant: bool = True) -> DataFrame:
    """For every message, the last n before it, each cut to 1500 characters.

    A message is sent to the n positions after it, so no window spans a whole conversation.
    """
    rows = messages if with_assistant else messages.filter(F.lower(F.trim("role")) != "assistant")
    placed = with_position(rows, [conversation], [order], "_at")
    ahead = placed.select(
        conversation,
        F.explode(F.sequence(F.col("_at") + 1, F.col("_at") + n)).alias("_at"),
        F.struct(F.col("_at").alias("at"), "role", F.substring("text", 1, chars).alias("text")).alias("_item"),
    )
    windows = ahead.groupBy(conversation, "_at").agg(F.sort_array(F.collect_list("_item")).alias("history"))
    joined = placed.join(windows, [conversation, "_at"], "left")
    empty = F.array().cast(windows.schema["history"].dataType)
    return joined.select(conversation, order, F.coalesce("history", empty).alias("history"))


# Keys and values that must not reach a log.
SENSITIVE_KEYS = (
    "authorization", "api_key", "apikey", "access_token", "refresh_token", "token", "password", "secret", "client_secret",
    "cookie", "set-cookie",
)
SENSITIVE_VALUE = r"(?i)(bearer\s+[a-z0-9._\-]+|sk-[a-z0-9]{8,}|ghp_[a-z0-9]{12,})"
REDACTED = "<redacted>"


def redact_value(value: Column) -> Column:
    return F.when(value.rlike(SENSITIVE_VALUE), REDACTED).otherwise(value)


def redact_map(fields: Column) -> Column:
    return F.transform_values(
        fields, lambda k, v: F.when(F.lower(F.trim(k)).isin(*SENSITIVE_KEYS), REDACTED).otherwise(redact_value(v))
    )


# Words about data in a question and claims of missing access in an answer.
FILE_CUES = (
    "file", "files", "dataset", "table", "tables", "sheet", "sheets", "schema", "column", "columns", "field", "fields", "rows",
    "records", "distribution", "breakdown",
)
TABLE_CUES = (
    "schema", "column", "columns", "field", "fields", "table", "tables", "sheet", "sheets", "row", "rows", "record", "records",
    "distribution", "breakdown", "group by", "filter",
)
FILE_STEMS = "файл|данн|таблиц|лист|схем|столб|колонк|строк|запис|распредел"
TABLE_STEMS = "схем|столб|колонк|таблиц|лист|строк|запис|распредел|групп"
QUESTION_CODING = (
    "python", "pandas", "numpy", "matplotlib", "seaborn", "plotly", "snippet", "tutorial", "example", "api", "function", "class",
    "code", "script",
)
NO_ACCESS = (
    r"(^|[^\p{L}\p{N}_])(i|we)($|[^\p{L}\p{N}_])[^.]{0,120}(cannot|can't|do not|don't)($|[^\p{L}\p{N}_])[^.]{0,120}"
    r"(access|open|read|view|see|analyze)($|[^\p{L}\p{N}_])[^.]{0,140}(files?|attachments?|attached|dataset|data)($|[^\p{L}\p{N}_])"
    r"|as an ai($|[^\p{L}\p{N}_])[^.]{0,200}(cannot|can't|do not|don't)($|[^\p{L}\p{N}_])[^.]{0,120}(access|open|read|view|see)"
    r"|не\s+имею\s+доступ|нет\s+доступа|не\s+могу\s+открыть[^.]{0,80}файл"
)


def evidence_flags(log: DataFrame, question: str, answer: str, hits: str, file_route: str) -> DataFrame:
    """File-aware request, evidence at hand, and an answer that wrongly claims to have no access."""
    q = F.lower(F.trim(F.coalesce(F.col(question), F.lit(""))))
    a = F.lower(F.trim(F.coalesce(F.col(answer), F.lit(""))))
    data = whole_words(q, FILE_CUES) | q.rlike(FILE_STEMS)
    tabular = whole_words(q, TABLE_CUES) | q.rlike(TABLE_STEMS)
    coding = whole_words(q, QUESTION_CODING) | q.rlike("питон|код")
    routed = F.col(file_route)
    only_coding = coding & ~tabular & ~routed
    aware = (q != "") & ~only_coding & (data | tabular | routed)
    evidence = F.coalesce(F.col(hits) > 0, F.lit(False))
    claims = a.rlike(NO_ACCESS)
    return log.withColumns(
        {
            "file_aware": aware,
            "evidence_available": evidence,
            "claims_no_access": claims,
            "wrong_claim": aware & evidence & claims,
        }
    )


# What a report must show.
REPORT_CHARS, REPORT_SECTIONS = 260, 4
WEAK_PHRASES = (
    "запрос был обработан", "сообщение об обработке запроса", "request was processed", "message about request processing",
    "practical recommendations and next steps", "deeper analysis",
)
METRIC_WORDS = ("rows", "columns", "metric", "statistic")
METRIC_WORDS_RU = ("строк", "колон", "метрик", "статист")
RELATION_WORDS = ("relationship", "dependency", "correlation", "feature interaction")
RELATION_WORDS_RU = ("связ", "завис", "коррел", "взаимосвяз")
VISUAL_WORDS = ("visual", "chart", "plot", "граф", "диаграм", "визуал")
BROAD_REQUEST = (
    "senior analytic", "senior analyst", "analyze file fully", "analyze this file fully", "full analysis", "complete analysis",
    "feature relationship", "feature relation", "statistics", "полный анализ", "полностью", "проанализируй файл полностью",
    "отнош", "связ", "статистик",
)


def report_quality(log: DataFrame, question: str, answer: str, columns: str, has_artifacts: str) -> DataFrame:
    """Checks of a written report, one column each, and their conjunction."""
    text = F.trim(F.coalesce(F.col(answer), F.lit("")))
    low, asked = F.lower(text), F.lower(F.coalesce(F.col(question), F.lit("")))
    russian = asked.rlike("[Ѐ-ӿ]")
    heads = F.regexp_count(text, F.lit(r"(?m)^\s{0,3}#{1,4}\s+\S+"))
    colons = F.regexp_count(text, F.lit(r"(?m)^[A-Za-zА-Яа-я][^:\n]{3,80}:\s*$"))
    names = F.array_distinct(F.filter(F.transform(columns, lambda c: F.lower(F.trim(c))), lambda c: c != ""))
    named = F.size(F.filter(names, lambda c: F.contains(low, c)))
    picture = text.contains("![") & text.contains("](") & low.rlike("/uploads/|http://|https://")
    letters_total = F.regexp_count(text, F.lit(r"\p{L}"))
    share = F.regexp_count(text, F.lit("[Ѐ-ӿ]")) / F.greatest(F.lit(1), letters_total)
    pick = lambda ru, en: F.when(russian, has_any(low, ru)).otherwise(has_any(low, en))
    checks = {
        "long_enough": F.length(text) >= REPORT_CHARS,
        "no_weak_phrase": ~has_any(low, WEAK_PHRASES),
        "sections": (heads >= REPORT_SECTIONS) | (colons >= REPORT_SECTIONS),
        "in_language": ~russian | (share >= 0.45),
        "metrics": pick(METRIC_WORDS_RU, METRIC_WORDS),
        "column_references": (F.size(names) == 0) | (named >= F.least(F.lit(2), F.size(names))),
        "visual": F.when(F.col(has_artifacts), picture).otherwise(has_any(low, VISUAL_WORDS)),
        "relationships": ~has_any(asked, BROAD_REQUEST) | pick(RELATION_WORDS_RU, RELATION_WORDS),
    }
    return log.withColumns({**checks, "sufficient": cells.all_of(list(checks.values()))})


def embedding_identity(value: Column) -> tuple[Column, Column]:
    """Mode and model of 'mode:model' text; other modes are part of the model name."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    mode = F.lower(F.trim(F.substring_index(raw, ":", 1)))
    folded = F.when(mode == "ollama", "local").when(mode == "corporate", "aihub").otherwise(mode)
    split = raw.contains(":") & folded.isin("local", "aihub")
    model = F.trim(F.substring(raw, F.locate(":", raw) + 1, F.length(raw)))
    return F.when(split, folded), F.nullif(F.when(split, model).otherwise(raw), F.lit(""))
