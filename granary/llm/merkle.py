"""Merkle manifest of a dataset: a binary hash tree of which only every few levels are written.

A stored level holds one row per node.  Aligned subtrees between two stored levels are worked out when they are
needed, in one row per subtree: to find the next stored level, and again for proofs, which take from the regenerated
nodes the siblings of each path and let the rest go.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from granary.operators.ordering import with_position
from granary.session import settle

#: Levels between two stored ones; a subtree has at most 2 ** EVERY leaves.
EVERY = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for a null, else the value's length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """Digest of a record; ``changed`` stands in for fields of the row."""
    return F.sha2(F.concat(*[encoded(changed.get(f, F.col(f))) for f in FIELDS]), 256)


def height(n: str) -> Column:
    """Levels above ``n`` leaves: how often they can be halved, rounded up, until one is left."""
    return F.when(F.col(n) > 1, F.length(F.bin(F.col(n) - 1))).otherwise(0)


#: The levels of a subtree of members ``m`` over ``steps`` levels: an array of arrays of digests, lowest first.
UP = (
    "transform(sequence(0, (size(below) - 1) div 2), i -> sha2(concat(below[2 * i], coalesce(get(below, 2 * i + 1), '')), 256))"
)
LEVELS = (
    "aggregate(sequence(0, steps), array(transform(m, x -> x.h)), (a, s) -> if(s = 0, a, "
    f"concat(a, transform(array(a[s - 1]), below -> {UP}))))"
)
#: The path of member ``x``: per level the sibling's digest after L or R for its side, or the empty string.
PATH = (
    "transform(slice(sequence(0, steps), 1, steps), s -> transform(array(shiftright(cast(x.at % {width} as int), s)), own -> "
    "coalesce(if(own % 2 = 1, concat('L', get(levels[s], own - 1)), concat('R', get(levels[s], own + 1))), ''))[0])"
)


def subtrees(nodes: DataFrame, *more: str) -> DataFrame:
    """One row per aligned subtree: ``(tree, block, high, steps, m, levels)``; ``m`` are its lowest nodes in order.

    ``more`` are further columns of the nodes that ``m`` carries.  A subtree never spans more levels than its tree
    has left, so the lone node of a finished tree is its own root.
    """
    member = F.struct("at", "h", *more)
    rows = nodes.groupBy("tree", F.expr(f"at div {1 << EVERY}").alias("block")).agg(
        F.first("high").alias("high"), F.array_sort(F.collect_list(member)).alias("m")
    )
    rows = rows.withColumn("steps", F.least("high", F.lit(EVERY)))
    return rows.withColumn("levels", F.expr(LEVELS))


def stored(nodes: DataFrame) -> list[DataFrame]:
    """The written levels of every tree from ``nodes`` up: ``(tree, at, h, high)``, ``high`` levels below the root.

    The last table holds the roots, one row per tree.
    """
    levels = [nodes]
    highest = nodes.agg(F.max("high")).first()[0] or 0
    while highest > 0:
        above = subtrees(levels[-1].select("tree", "at", "h", "high")).select(
            "tree", F.col("block").alias("at"), F.expr("levels[steps][0]").alias("h"), (F.col("high") - F.col("steps")).alias("high")
        )
        levels.append(settle(above))
        highest -= EVERY
    return levels


def paths(levels: list[DataFrame], top: DataFrame, *more: str) -> DataFrame:
    """``(tree, at, path, ...)`` of every node of the lowest level, with ``more`` of its columns.

    ``top`` holds what each tree's root goes on with: ``tree, path`` and columns that all its nodes take over.  Each
    stored level is read once; its subtrees are regenerated, joined to the paths above by their root's place, and
    only the siblings stay.
    """
    found = top.withColumn("at", F.lit(0).cast("long"))
    kept = [c for c in top.columns if c not in ("tree", "path")]
    for depth, level in reversed(list(enumerate(levels[:-1]))):
        own = more if depth == 0 else ()
        above = found.select("tree", F.col("at").alias("block"), F.col("path").alias("_above"), *kept)
        rows = subtrees(level, *own).join(above, ["tree", "block"])
        siblings = F.expr(f"transform(m, x -> struct(x, {PATH.format(width=1 << EVERY)} as path))")
        rows = rows.select("tree", "_above", *kept, F.explode(siblings).alias("p"))
        found = rows.select(
            "tree", "p.x.at", F.concat("p.path", "_above").alias("path"), *kept, *[F.col(f"p.x.{c}").alias(c) for c in ("h", *own)]
        )
    if len(levels) == 1:
        found = levels[0].join(found.drop("at"), "tree").select("tree", "at", "path", *kept, "h", *more)
    return found


def fold(leaf: Column) -> Column:
    """The root that a leaf and the siblings of ``path`` lead to."""
    return F.aggregate(
        "path",
        leaf,
        lambda own, s: F.sha2(
            F.when(s.startswith("L"), F.concat(F.substring(s, 2, 64), own)).otherwise(F.concat(own, F.substring(s, 2, 64))), 256
        ),
    )


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the trees of all languages, and of the tree over their roots; ``root`` is None without rows."""

    languages: list[DataFrame]
    whole: list[DataFrame]
    root: str | None


def placed(leaves: DataFrame, tree: Column, order: list[str]) -> DataFrame:
    """``leaves`` with ``tree``, their place ``at`` in it and the levels ``high`` above them, written."""
    rows = with_position(leaves.withColumn("tree", tree), ["tree"], order, "_position")
    counts = rows.groupBy("tree").agg(F.max("_position").alias("_n")).withColumn("high", height("_n").cast("int")).drop("_n")
    return settle(rows.join(counts, "tree").withColumn("at", F.col("_position") - 1).drop("_position"))


def manifest(docs: DataFrame, *extra: Column) -> Manifest:
    """The hash tree of a documents table, one tree per language and one over their roots.

    Leaves stand in the order of doc_id (nulls first), rows that share an id in the order of their digests; repeated
    rows are leaves as often as they come.  Languages stand in the order of their UTF-8 bytes, null first.  Columns
    other than the five fields are ignored, but for ``extra``, named columns that the lowest level keeps.  An empty
    table has no root.
    """
    # a null language's tree is named '-', which comes before the colon of the others
    name = F.coalesce(F.concat(F.lit(":"), F.col("lang")), F.lit("-"))
    leaves = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("_tree"), leaf_of().alias("h"), *extra))
    leaves = leaves.withColumn("_named", F.col("doc_id").isNotNull())  # false comes first
    languages = stored(placed(leaves, F.col("_tree"), ["_named", "doc_id", "h"]).drop("_tree", "_named"))
    roots = languages[-1].select(F.col("tree").alias("lang"), F.col("h"))
    whole = stored(placed(roots, F.lit(""), ["lang"]))
    top = whole[-1].select("h").first()
    return Manifest(languages, whole, top["h"] if top else None)


def proofs(tree: Manifest, *more: str) -> DataFrame:
    """``(doc_id, leaf, subroot, path)`` per leaf, with ``more`` columns it keeps: the siblings up to the whole root."""
    start = tree.whole[0].select("tree").distinct().withColumn("path", F.array().cast("array<string>"))
    tops = paths(tree.whole, start, "lang").select(F.col("lang").alias("tree"), "path", F.col("h").alias("subroot"))
    return paths(tree.languages, settle(tops), "doc_id", *more).select("doc_id", F.col("h").alias("leaf"), "subroot", "path", *more)


def audited(docs: DataFrame, forged: Column) -> DataFrame:
    """Each document's proof, and whether a record with the digest ``forged`` (null: the record itself) still fits it.

    Columns: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.  Rows as in :func:`manifest`; null
    fields are hashed as ``-``, texts are hashed whole whatever their length.
    """
    tree = manifest(docs, forged.alias("forged"))
    found = proofs(tree, "forged").withColumn("root", F.lit(tree.root).cast("string"))
    siblings = F.array_join(F.transform("path", lambda s: F.substring(s, 2, 64)), "")
    return found.withColumn("folded_root", fold(F.coalesce("forged", "leaf"))).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def tampered() -> Column:
    """Digest of the record with one more in n_chars where 7 divides the checksum of its id, else null."""
    picked = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 == 0
    return F.when(picked, leaf_of(n_chars=F.col("n_chars") + 1))


def sql_leaf(chars: str = "n_chars") -> str:
    values = ["doc_id", "source", "lang", chars, "text"]
    parts = [f"coalesce(strlen(({v})::VARCHAR)::VARCHAR || ':' || ({v})::VARCHAR, '-')" for v in values]
    return f"sha256({' || '.join(parts)})"


# a checksum of the id's decimal digits, a bit at a time
CHECKSUM = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(list_filter(string_split(doc_id::VARCHAR, ''),
    lambda s: s <> ''), lambda s: ord(s)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(':' || lang, '-') AS tree, {sql_leaf()} AS h,
         CASE WHEN {CHECKSUM} % 7 = 0 THEN {sql_leaf("n_chars + 1")} END AS forged
  FROM documents
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
), nodes(level, tree, pos, h, n) AS (
  SELECT 0, tree, pos, h, n FROM placed
  UNION ALL
  SELECT level + 1, tree, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1
  GROUP BY level, tree, pos // 2, n
), roots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper(level, pos, h, n) AS (
  SELECT 0, pos, h, n FROM roots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, pos // 2, n
), folded(r, tree, level, pos, n, own, proof) AS (
  SELECT r, tree, 0, pos, n, coalesce(forged, h), '' FROM placed
  UNION ALL
  SELECT f.r, f.tree, f.level + 1, f.pos // 2, (f.n + 1) // 2,
         sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.own ELSE f.own || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
  FROM folded f LEFT JOIN nodes s ON s.tree = f.tree AND s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1
), joined(r, level, pos, n, own, proof) AS (
  SELECT f.r, 0, t.pos, t.n, f.own, f.proof FROM folded f JOIN roots t ON t.tree = f.tree WHERE f.n = 1
  UNION ALL
  SELECT f.r, f.level + 1, f.pos // 2, (f.n + 1) // 2,
         sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.own ELSE f.own || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
  FROM joined f LEFT JOIN upper s ON s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1
)
SELECT p.doc_id, p.h AS leaf, t.h AS subroot, u.h AS root, sha256(j.proof) AS proof_sha256, j.own AS folded_root, j.own = u.h AS verified
FROM placed p JOIN roots t ON t.tree = p.tree JOIN joined j ON j.r = p.r AND j.n = 1 JOIN upper u ON u.n = 1
"""
