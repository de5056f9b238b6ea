"""Mixing of sources by temperature, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.session import settle

MAX_REPETITION = 2.0
STEPS = 10
ROUNDS = 3
BLOCK_DIGITS = 3
SEED = 7


def text_tokens(text: str = "text") -> Column:
    """Tokens of a text without a tokenizer: one per four bytes of UTF-8, rounded up; null texts have none."""
    return F.coalesce(F.ceil(F.octet_length(F.col(text)) / 4), F.lit(0)).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    """``(source, total)``: tokens per source, aggregated before the shuffle."""
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("total")).where("total > 0")


def fitted_exponent(totals: DataFrame, max_repetition: float | None, target_entropy: float | None) -> float:
    """The exponent on source shares: 1 keeps them, 0 makes sources equal.

    Every source is taken once at least, so the source taken least is taken exactly once and another is repeated
    (share / largest share) ** (exponent - 1) times.  With ``target_entropy`` (bits) the largest exponent whose weights
    reach it, with ``max_repetition`` the smallest at which no source is repeated more often; the limit wins.  Both
    grow as the exponent falls, so each is bisected: a round evaluates all exponents that ten halvings could ask for in
    one aggregate over the sources, and ``ROUNDS`` rounds leave an interval of 2 ** -30.
    """
    chosen = 0.0
    if target_entropy is not None:
        chosen = bisect(totals, lambda row: row["entropy"] >= target_entropy, upper=False)
    if max_repetition is not None:
        chosen = max(chosen, bisect(totals, lambda row: row["repetition"] > max_repetition, upper=True))
    return chosen


def bisect(totals: DataFrame, holds, upper: bool, low: float = 0.0, high: float = 1.0) -> float:
    """Where ``holds``, true for small exponents, turns false: its last true or (``upper``) first false end."""
    width = 1 << STEPS
    largest = totals.agg(F.max("total").alias("largest"), F.sum("total").alias("all"))
    shares = totals.crossJoin(F.broadcast(largest))  # one row
    for _ in range(ROUNDS):
        step = (high - low) / width
        places = F.explode(F.sequence(F.lit(0), F.lit(width))).alias("place")
        at = F.lit(low) + F.lit(step) * F.col("place")
        weight = F.pow(F.col("total") / F.col("all"), at)
        rows = (
            shares.select("total", "largest", "all", places)
            .groupBy("place")
            .agg(
                F.sum(weight).alias("mass"),
                F.sum(weight * F.log(weight)).alias("log_mass"),
                F.max(F.pow(F.col("total") / F.col("largest"), at - 1)).alias("repetition"),
            )
            .orderBy("place")
            .collect()  # width + 1 rows, whatever the number of sources
        )
        if not rows:
            return 1.0
        seen = [r.asDict() | {"entropy": (math.log(r["mass"]) - r["log_mass"] / r["mass"]) / math.log(2)} for r in rows]
        left, right = 0, width
        while right - left > 1:
            middle = (left + right) // 2
            left, right = (middle, right) if holds(seen[middle]) else (left, middle)
        if left == 0 and not holds(seen[0]):
            right = 0
        low, high = low + step * left, low + step * right
        if low == high:
            return low
    return high if upper else low


def budgets(totals: DataFrame, exponent: float) -> DataFrame:
    """``(source, total, weight, budget)``: normalised weights and the tokens each source gives.

    The budget of the whole is the least at which the largest source, repeated least, is taken once.
    """
    largest = totals.agg(F.max("total").alias("largest"), F.sum(F.pow("total", F.lit(exponent))).alias("mass"))
    rows = totals.crossJoin(F.broadcast(largest))  # one row
    repeats = F.pow(F.col("total") / F.col("largest"), F.lit(exponent - 1))
    return rows.select(
        "source",
        "total",
        (F.pow("total", F.lit(exponent)) / F.col("mass")).alias("weight"),
        F.greatest(F.col("total"), F.floor(F.col("total") * repeats + F.lit(1e-6))).cast("long").alias("budget"),
    )


def permuted(docs: DataFrame, seed: int) -> DataFrame:
    """Each document's place in the permutation of an epoch: a hash of seed, epoch and ``name``, cut into blocks."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("name")))
    return docs.withColumn("_order", order).withColumn("block", F.substring("_order", 1, BLOCK_DIGITS))


def last_blocks(counted: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``(source, cut_block, before)``: the block in which a source's last pass ends, and the tokens of the blocks ahead.

    At most 16 ** 3 rows of a source meet in one window, whatever its size.
    """
    part = plan.where("rest > 0").select("source", F.col("full").alias("epoch"), "rest")
    light = permuted(counted.where("n_tokens > 0").select("source", "name", "n_tokens").join(part, "source"), seed)
    ahead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = light.groupBy("source", "rest", "block").agg(F.sum("n_tokens").alias("size"))
    sums = sizes.withColumn("before", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    return sums.where("before + size > rest").groupBy("source").agg(F.min("block").alias("cut_block"), F.min("before").alias("before"))


def mix(
    docs: DataFrame,
    max_repetition: float | None = MAX_REPETITION,
    target_entropy: float | None = None,
    seed: int = SEED,
    tokens: Column | None = None,
) -> DataFrame:
    """``docs`` taken as often as their sources' weights ask, with ``n_tokens, weight, epoch`` and ``block``.

    A source's budget is spent on whole passes (epochs 0, 1, ...) and one last pass in part, each a new permutation of
    its documents in 16 ** 3 blocks of hashed order.  Of the last pass, blocks are taken whole while they fit, and
    of the block that does not fit the documents, in order, whose running sum of tokens does.  That block is ordered in
    one task; it is a four-thousandth of the source unless rows share an id.  The rows come
    placed: range-partitioned and sorted by epoch, block and order, so that passes follow each other over all sources
    and the copies of a document lie a pass apart.

    A null source is a source of its own; documents without tokens, and so sources without any, are taken once (epoch
    0); null texts are allowed, rows without an id are ordered by their text; repeated rows are taken as often as they
    come.  Other columns are passed on.  An empty table gives an empty table.
    """
    names = docs.columns
    counted = docs.select(
        F.struct(*names).alias("_row"),
        # what the permutation is drawn by: rows without an id must not all fall in one block
        F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce("text", F.lit("")).cast("binary")))).alias("name"),
        F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string"))).alias("source"),
        (text_tokens() if tokens is None else tokens).alias("n_tokens"),
    )
    totals = settle(source_totals(counted))
    exponent = fitted_exponent(totals, max_repetition, target_entropy)
    plan = settle(budgets(totals, exponent).withColumns({"full": F.expr("budget div total"), "rest": F.expr("budget % total")}))

    # the last pass: tokens of each block, then per source the first block that does not fit whole
    plan = settle(plan.join(last_blocks(counted, plan, seed), "source", "left"))

    epochs = F.when(F.col("n_tokens") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.expr("sequence(0L, full)"))
    taken = counted.join(plan.drop("total", "budget"), "source", "left").select(
        "*", F.explode(F.coalesce(epochs, F.array(F.lit(0).cast("long")))).alias("epoch")
    )
    taken = permuted(taken, seed)
    last = (F.col("n_tokens") > 0) & (F.col("epoch") == F.col("full"))
    out = [F.col("_row"), F.col("n_tokens"), F.col("weight"), F.col("epoch"), F.col("block"), F.col("_order")]
    whole = taken.where(~F.coalesce(last, F.lit(False)) | (F.col("block") < F.col("cut_block"))).select(*out)
    order = Window.partitionBy("source").orderBy("_order", "name", "n_tokens", F.xxhash64("_row")).rowsBetween(Window.unboundedPreceding, 0)
    some = taken.where(last & (F.col("block") == F.col("cut_block"))).withColumn("_sum", F.sum("n_tokens").over(order))
    every = whole.unionByName(some.where("before + _sum <= rest").select(*out))
    place = ("epoch", "block", "_order")
    every = every.repartitionByRange(*place).sortWithinPartitions(*place)
    return every.select("_row.*", *[F.col(c).alias(c) for c in ("n_tokens", "weight", "epoch", "block") if c not in names])


SQL = f"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source, CAST(ceil(coalesce(strlen(text), 0) / 4.0) AS BIGINT) AS n_tokens,
         coalesce(CAST(doc_id AS VARCHAR), 'null ' || md5(coalesce(text, ''))) AS name FROM documents
), totals AS (
  SELECT source, sum(n_tokens)::BIGINT AS total FROM counted GROUP BY source HAVING sum(n_tokens) > 0
), ends AS (
  SELECT min(total) / max(total)::DOUBLE AS least, max(total)::DOUBLE AS largest FROM totals
), halving(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN pow(least, (lo + hi) / 2 - 1) > {MAX_REPETITION} THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN pow(least, (lo + hi) / 2 - 1) > {MAX_REPETITION} THEN hi ELSE (lo + hi) / 2 END
  FROM halving, ends WHERE i < {STEPS * ROUNDS}
), fitted AS (
  SELECT CASE WHEN pow(least, -1) > {MAX_REPETITION} THEN hi ELSE 0 END AS a FROM halving, ends WHERE i = {STEPS * ROUNDS}
), planned AS (
  SELECT source, total, pow(total, a) / sum(pow(total, a)) OVER () AS weight,
         greatest(total, CAST(floor(total * pow(total / largest, a - 1) + 1e-6) AS BIGINT)) AS budget
  FROM totals, fitted, ends
), passes AS (
  SELECT *, budget // total AS whole, budget % total AS rest FROM planned
), taken AS (
  SELECT c.*, p.weight, p.whole, p.rest, unnest(CASE WHEN n_tokens = 0 OR p.source IS NULL THEN [0] ELSE range(0, whole + 1) END) AS epoch
  FROM counted c LEFT JOIN passes p ON c.source IS NOT DISTINCT FROM p.source
), ordered AS (
  SELECT *, md5(concat_ws('|', '{SEED}', CAST(epoch AS VARCHAR), name)) AS place FROM taken
), summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY place, name ROWS UNBOUNDED PRECEDING) AS running FROM ordered
)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, CAST(epoch AS BIGINT) AS epoch, substr(place, 1, {BLOCK_DIGITS}) AS block
FROM summed WHERE n_tokens = 0 OR whole IS NULL OR epoch < whole OR running <= rest
"""
