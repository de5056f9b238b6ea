"""Removal of passages of several lines that repeat across the corpus, in DataFrame operations only.

Blank lines aside, a document is a row of line hashes.  It is cut into chunks by content: where a rolling hash over the
hashes of two lines says so, so that an edit or a shift spoils one chunk and leaves the others; and between two lines
that do not always stand together, so that the edges of a shared passage are boundaries in every copy.  Stretches of
chunks that repeat and hold enough words are removed but for the first, after their bytes are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from granary.session import settle

#: Words of the least stretch that is removed.
MIN_WORDS = 40
BOUNDARY_ONE_IN = 8
#: Prime modulus and base of the rolling hash; products stay below 2 ** 63.
PRIME = 2147483647
BASE = 31
NO_ID = -(1 << 63)
KEY = ("_id", "_hash")

LINE_HASH = "cast(conv(substring(md5(x), 1, 15), 16, 10) as bigint)"
WORDS = "if(trim(x) = '', 0, length(trim(x)) - length(replace(trim(x), ' ', '')) + 1)"


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with the key that names a document: its id (a null has a number of its own) and the hash of its text."""
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_hash": F.xxhash64("text")})


def line_table(docs: DataFrame) -> DataFrame:
    """``(_id, _hash, h, w)``: hashes and word counts of the lines, blank ones aside, of each different document with a text."""
    rows = keyed(docs).where("text is not null").select(*KEY, F.split("text", "\n", -1).alias("lines"))
    hashed = rows.select(
        *KEY, F.expr(f"filter(transform(lines, x -> struct({LINE_HASH} as h, {WORDS} as w)), l -> l.w > 0)").alias("lines")
    )
    return hashed.groupBy(*KEY).agg(F.first("lines").alias("lines")).select(*KEY, "lines.h", "lines.w")


def runs(lines: DataFrame, min_words: int) -> DataFrame:
    """Maximal runs of lines that each stand twice or more, with ``min_words`` words or more: ``(key, at, h, w, known)``.

    ``known`` tells for each line what line always follows it, and what line it always follows, if it is one line.
    """
    beside = "transform(h, (x, i) -> struct(i as i, x as h, get(h, i + 1) as after, get(h, i - 1) as before))"
    every = lines.select(*KEY, F.explode(F.expr(beside)).alias("l")).select(*KEY, "l.*")

    def always(side: str):
        same = (F.count(side) == F.count("*")) & (F.min(side) == F.max(side))
        return F.when(same, F.min(side)).alias(f"always_{side}")

    # written, so that the join below is one of two plain sides, of which Spark can split a hot line's or send a small one
    repeated = settle(every.groupBy("h").agg(F.count("*").alias("n"), always("after"), always("before")).where("n > 1").drop("n"))
    known = every.select(*KEY, "i", "h").join(repeated, "h").groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("i", "always_after", "always_before"))).alias("k")
    )
    opens = "filter(sequence(0, size(k) - 1), p -> p = 0 or k[p].i <> k[p - 1].i + 1)"
    cut = (
        "transform(opens, (s, r) -> struct(k[s].i as at, coalesce(get(opens, r + 1), size(k)) - s as n, "
        "slice(k, s + 1, coalesce(get(opens, r + 1), size(k)) - s) as known))"
    )
    rows = lines.join(known, list(KEY)).withColumn("opens", F.expr(opens)).select(*KEY, "h", "w", F.explode(F.expr(cut)).alias("r"))
    rows = rows.select(
        *KEY, "r.at", F.expr("slice(h, r.at + 1, r.n)").alias("h"), F.expr("slice(w, r.at + 1, r.n)").alias("w"), "r.known"
    )
    return rows.where(F.expr(f"aggregate(w, 0L, (a, x) -> a + x) >= {min_words}"))


def stretches(lines: DataFrame, min_words: int = MIN_WORDS, one_in: int = BOUNDARY_ONE_IN) -> DataFrame:
    """The least stretches of whole chunks with ``min_words`` words, from each chunk on and back: ``(key, first, last, mark)``.

    first and last count lines that are not blank; mark hashes the stretch.  A chunk has a word at least, so a stretch
    has at most ``min_words`` chunks.
    """
    rolled = f"(pmod(h[i - 1], {PRIME}) * {BASE} + pmod(h[i], {PRIME})) % {PRIME}"
    tied = "coalesce(known[i - 1].always_after = h[i] and known[i].always_before = h[i - 1], false)"
    boundary = f"i = 0 or not {tied} or {rolled} % {one_in} = 0 or w[i - 1] >= {min_words} or w[i] >= {min_words}"
    rows = runs(lines, min_words).withColumn("opens", F.expr(f"filter(sequence(0, size(h) - 1), i -> {boundary})"))
    words = "transform(opens, (s, c) -> aggregate(slice(w, s + 1, coalesce(get(opens, c + 1), size(h)) - s), 0, (a, x) -> a + x))"
    rows = rows.withColumn("words", F.expr(words))
    add = f"named_struct('n', 0, 'words', 0), (a, x) -> if(a.words >= {min_words}, a, struct(a.n + 1 as n, a.words + x as words))"
    on = f"transform(words, (x, c) -> struct(c as c, aggregate(slice(words, c + 1, {min_words}), {add}) as r))"
    back = f"transform(words, (x, c) -> struct(c as c, aggregate(reverse(slice(words, greatest(c - {min_words - 1}, 0) + 1, least(c + 1, {min_words}))), {add}) as r))"
    whole = f"x -> x.r.words >= {min_words}"
    both = (
        f"concat(transform(filter({on}, {whole}), x -> struct(x.c as c, x.c + x.r.n as stop)), "
        f"transform(filter({back}, {whole}), x -> struct(x.c - x.r.n + 1 as c, x.c + 1 as stop)))"
    )
    lined = "transform(array_distinct(both), x -> struct(opens[x.c] as first, coalesce(get(opens, x.stop), size(h)) - 1 as last))"
    rows = rows.withColumn("both", F.expr(both)).withColumn("lined", F.expr(lined))
    marked = "transform(lined, x -> struct(at + x.first as first, at + x.last as last, xxhash64(slice(h, x.first + 1, x.last - x.first + 1)) as mark))"
    return rows.select(*KEY, F.explode(F.expr(marked)).alias("s")).select(*KEY, "s.*")


def joined(ranges: str, gap: int = 1) -> str:
    """SQL that joins ranges (``first, last``) which touch or overlap."""
    more = f"size(a) > 0 and r.first <= element_at(a, -1).last + {gap}"
    grown = "struct(element_at(a, -1).first as first, greatest(element_at(a, -1).last, r.last) as last)"
    empty = "cast(array() as array<struct<first: int, last: int>>)"
    return (
        f"aggregate(array_sort({ranges}), {empty}, (a, r) -> "
        f"if({more}, concat(slice(a, 1, size(a) - 1), array({grown})), concat(a, array(struct(r.first as first, r.last as last)))))"
    )


def with_lines(expression: str, text: str = "text") -> Column:
    """An expression over ``lines``, the text's lines, which are split once however often it names them."""
    return F.expr(f"transform(array(split({text}, '\\n', -1)), lines -> {expression})[0]")


#: Places of the lines that are not blank, and the text of such lines from the ``first`` to the ``last``.
FULL = "filter(sequence(0, size(lines) - 1), p -> trim(lines[p]) <> '')"


def passage(item: str) -> str:
    return f"array_join(transform(slice(full, {item}.first + 1, {item}.last - {item}.first + 1), p -> lines[p]), '\\n')"


def remove_repeated(docs: DataFrame, min_words: int = MIN_WORDS, one_in: int = BOUNDARY_ONE_IN) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and ``n_lines`` and ``n_removed`` (lines).

    A passage is a stretch of at least two lines, or one long line, with at least ``min_words`` words, that stands at
    two places or more, in one document or several, blank lines aside.  It stays at its first place, by doc_id
    (nulls first), text hash and line; a copy that overlaps that place stays with it.  What is
    left has no such stretch at two places but where removal brings lines together.  Lines are joined by ``\\n`` again, blank lines inside a
    removed passage go with it; a document all of whose lines go has the empty text and keeps its row.  Null texts
    stay null with 0 lines; repeated rows (same id and text) count as one document and are edited alike; other
    columns are passed on, and where they have the names of the counts the counts are left out.  An empty table
    gives an empty table.
    """
    lines = settle(line_table(docs))
    found = settle(stretches(lines, min_words, one_in))
    repeated = found.groupBy("mark").agg(F.count("*").alias("times"), F.min(F.struct(*KEY, "first", "last")).alias("origin"))
    repeated = settle(repeated.where("times > 1").select("mark", "origin"))  # written for the join, as above
    apart = (F.col("_id") != F.col("origin._id")) | (F.col("_hash") != F.col("origin._hash")) | (F.col("first") > F.col("origin.last"))
    later = found.join(repeated, "mark").where(apart).select(
        *KEY, "first", "last", F.col("origin._id").alias("from_id"), F.col("origin._hash").alias("from_hash"),
        (F.col("first") - F.col("origin.first")).alias("shift"),
    )
    # stretches that follow each other here as they do at the same earlier place are one passage
    ranges = later.groupBy(*KEY, "from_id", "from_hash", "shift").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    copies = ranges.select(*KEY, "from_id", "from_hash", "shift", F.explode(F.expr(joined("ranges"))).alias("r"))
    copies = settle(copies.select(
        *KEY, "from_id", "from_hash", "r.first", "r.last", F.expr("r.first - shift").alias("from_first"), F.expr("r.last - shift").alias("from_last")
    ))

    # both joins take whole rows by key, so that Spark shuffles the texts once and reads that shuffle twice
    rows = keyed(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")).select("_row", *KEY)
    asked = copies.groupBy(F.col("from_id").alias("_id"), F.col("from_hash").alias("_hash")).agg(
        F.collect_set(F.struct(F.col("from_first").alias("first"), F.col("from_last").alias("last"))).alias("at")
    )
    told = with_lines(f"transform(array({FULL}), full -> transform(at, c -> struct(c.first as first, c.last as last, {passage('c')} as passage)))[0]", "_row.text")
    # repeated rows tell the same; one of them counts
    owners = rows.join(asked, list(KEY)).groupBy(*KEY).agg(F.first(told).alias("told"))
    passages = owners.select(F.col("_id").alias("from_id"), F.col("_hash").alias("from_hash"), F.explode("told").alias("p")).select(
        "from_id", "from_hash", F.col("p.first").alias("from_first"), F.col("p.last").alias("from_last"), "p.passage"
    )
    same_place = ["from_id", "from_hash", "from_first", "from_last"]
    marks = copies.join(passages, same_place).groupBy(*KEY).agg(F.collect_list(F.struct("first", "last", "passage")).alias("at"))

    equal = f"filter(coalesce(at, array()), c -> {passage('c')} = c.passage)"
    placed = f"transform({equal}, c -> struct(full[c.first] as first, full[c.last] as last))"
    gone = f"transform({joined(placed)}, c -> struct(c.first as start, c.last - c.first + 1 as n))"
    edit = f"transform(array({FULL}), full -> {rest_of(gone)})[0]"
    edited = rows.join(marks, list(KEY), "left").select("_row", with_lines(edit, "_row.text").alias("_new"))
    kept = [F.col(f"_row.{c}").alias(c) if c != "text" else F.col("_new.text").alias("text") for c in docs.columns]
    counts = [F.coalesce(f"_new.{c}", F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_removed") if c not in docs.columns]
    return edited.select(*kept, *counts)


def rest_of(removed: str) -> str:
    """SQL of what is left of ``lines``: the stretches between the removed chunks, which stand in order."""
    begins = "concat(array(0), transform(gone, c -> c.start + c.n))"
    ends = "concat(transform(gone, c -> c.start), array(size(lines)))"
    kept = f"flatten(zip_with({begins}, {ends}, (b, e) -> slice(lines, b + 1, e - b)))"
    return (
        f"transform(array({removed}), gone -> struct(if(lines is null, null, array_join({kept}, '\\n')) as text, "
        "size(lines) as n_lines, aggregate(gone, 0, (a, c) -> a + c.n) as n_removed))[0]"
    )


SQL = f"""
WITH parts AS (
  SELECT doc_id, i - 1 AS pos, parts[i] AS line FROM
    (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) AS u(i)
), lines AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 15) AS BIGINT) AS h, length(trim(line)) - length(replace(trim(line), ' ', '')) + 1 AS w,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx
  FROM parts WHERE trim(line) <> ''
), beside AS (
  SELECT *, lag(line) OVER d AS before, lead(line) OVER d AS after, lag(h) OVER d AS h0, lag(w) OVER d AS w0
  FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY idx)
), kinds AS (
  SELECT line, CASE WHEN count(after) = count(*) AND min(after) = max(after) THEN min(after) END AS always_after,
         CASE WHEN count(before) = count(*) AND min(before) = max(before) THEN min(before) END AS always_before
  FROM beside GROUP BY line HAVING count(*) > 1
), known AS (
  SELECT b.*, always_after, always_before, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS run
  FROM beside b JOIN kinds USING (line)
), cut AS (
  SELECT *, coalesce(lag(always_after) OVER r = line AND always_before = before, false) IS FALSE OR row_number() OVER r = 1
         OR ((h0 % {PRIME}) * {BASE} + h % {PRIME}) % {PRIME} % {BOUNDARY_ONE_IN} = 0 OR w0 >= {MIN_WORDS} OR w >= {MIN_WORDS} AS opens
  FROM known WINDOW r AS (PARTITION BY doc_id, run ORDER BY idx)
), numbered AS (
  SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS c FROM cut
), chunks AS MATERIALIZED (
  SELECT doc_id, run, c, min(idx) AS first, max(idx) AS last, sum(w) AS words,
         sum(sum(w)) OVER (PARTITION BY doc_id, run ORDER BY c) AS upto
  FROM numbered GROUP BY doc_id, run, c
), pairs AS (
  SELECT a.doc_id, a.run, a.c AS s, b.c AS e, a.first, b.last FROM chunks a JOIN chunks b
    ON a.doc_id = b.doc_id AND a.run = b.run AND b.c BETWEEN a.c AND a.c + {MIN_WORDS - 1} AND b.upto - a.upto + a.words >= {MIN_WORDS}
), stretches AS (
  SELECT DISTINCT doc_id, first, last FROM (
    SELECT doc_id, first, min(last) AS last FROM pairs GROUP BY doc_id, run, s, first
    UNION ALL SELECT doc_id, max(first), last FROM pairs GROUP BY doc_id, run, e, last)
), texts AS (
  SELECT s.doc_id, s.first, s.last, string_agg(line, chr(10) ORDER BY idx) AS passage
  FROM stretches s JOIN lines l ON l.doc_id = s.doc_id AND l.idx BETWEEN s.first AND s.last GROUP BY ALL
), placed AS (
  SELECT *, first_value(doc_id) OVER p AS from_doc, first_value(last) OVER p AS from_last
  FROM texts WINDOW p AS (PARTITION BY passage ORDER BY doc_id, first, last)
), gone AS (
  SELECT DISTINCT p.doc_id, p.pos FROM placed x JOIN lines a ON a.doc_id = x.doc_id AND a.idx = x.first
    JOIN lines b ON b.doc_id = x.doc_id AND b.idx = x.last JOIN parts p ON p.doc_id = x.doc_id AND p.pos BETWEEN a.pos AND b.pos
  WHERE x.doc_id <> from_doc OR x.first > from_last
), rest AS (
  SELECT p.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(line, chr(10) ORDER BY p.pos) FILTER (WHERE g.pos IS NULL) AS text
  FROM parts p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(r.text, '') END AS text,
       CAST(coalesce(r.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN rest r ON d.doc_id = r.doc_id
"""
