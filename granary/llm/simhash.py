"""Near-duplicates by SimHash: deletion-variant signatures of two segments."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from granary.llm.batches import map_rows
from granary.llm.components import connected
from granary.session import settle

BITS = 64
SEGMENT = 32
MAX_DISTANCE = 3
BLOCK = 1 << 15
HOT_CLASS = 512
NO_ID = -(1 << 63)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 for a text without words.

    Words are runs of anything but ASCII white space, A-Z is lower-cased, shingles are joined by one space; a text
    of fewer words than ``width`` has one shingle.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    total, count = np.zeros(BITS, dtype=np.int64), len(words) - width + 1
    for start in range(0, count, BLOCK):
        stop = min(count, start + BLOCK)
        shifted = [words[start + i : stop + i] for i in range(width)]
        hashes = [xxhash.xxh64_intdigest(s, seed) for s in map(b" ".join, zip(*shifted, strict=True))]
        planes = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(planes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, bits)`` for every row of ``docs``; bits is the fingerprint as a signed 64-bit number.

    ``also`` names further columns of 64-bit numbers that are passed on.
    """
    passed = ("doc_id", *also)

    def make():
        def run(columns):
            prints = [fingerprint(t) for t in columns["text"]]
            bits = [p - (1 << 64) if p >> 63 else p for p in prints]
            return {c: columns[c] for c in passed} | {"bits": bits}

        return run

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), *also, F.col(text_column).alias("text"))
    return map_rows(narrow, make, ", ".join(f"{c} long" for c in (*passed, "bits")))


def as_hex(bits: str) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


# Two fingerprints within 3 bits differ in at most one bit on one half, since 3 bits fall on 2 halves.  A half is
# indexed whole (position 32) and once per position with that bit deleted.  Halves that are equal meet at
# position 32 only; halves that differ in one bit meet at that position only, a 0 on the left and a 1 on the right.


def variants(prints: DataFrame) -> DataFrame:
    """One row per fingerprint, half and deleted position: ``(key, position, bit, bits, other)``."""
    key = F.explode(F.sequence(F.lit(0), F.lit(2 * (SEGMENT + 1) - 1)))
    rows = prints.select("bits", key.alias("slot"))
    low = F.col("bits").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("bits", SEGMENT)
    first = F.col("slot") <= SEGMENT
    rows = rows.select(
        "bits",
        "slot",
        (F.col("slot") % (SEGMENT + 1)).alias("position"),
        F.when(first, low).otherwise(high).alias("half"),
        F.when(first, high).otherwise(low).alias("other"),
    )
    flag = F.expr("shiftleft(1L, position)")
    whole = F.col("position") == SEGMENT
    rest = F.when(whole, F.col("half")).otherwise(F.col("half").bitwiseAND(F.bitwise_not(flag)))
    return rows.select(
        (F.col("slot") * F.lit(1 << SEGMENT) + rest).alias("key"),
        "position",
        F.when(whole, F.lit(-1)).otherwise(F.expr("cast(shiftright(half, position) & 1 as int)")).alias("bit"),
        "bits",
        "other",
    )


def hot_keys(prints: DataFrame, limit: int) -> DataFrame:
    """Keys at which two sets of more than ``limit`` fingerprints each would meet, or one such set itself.

    A half held by few fingerprints makes few pairs however large the other side is, so only these keys could make
    pairs beyond ``limit`` per fingerprint.
    """
    halves = prints.select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("bits").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half")),
                F.struct(F.lit(1).alias("side"), F.shiftrightunsigned("bits", SEGMENT).alias("half")),
            )
        ).alias("at")
    ).select("at.*")
    large = halves.groupBy("side", "half").count().where(F.col("count") > limit)
    spread = large.select(
        "side", "half", F.explode(F.sequence(F.lit(0), F.lit(SEGMENT))).alias("position")
    ).select(
        "position",
        (
            (F.col("side") * (SEGMENT + 1) + F.col("position")) * F.lit(1 << SEGMENT)
            + F.expr("CASE WHEN position = 32 THEN half ELSE half & ~shiftleft(1L, position) END")
        ).alias("key"),
    )
    return spread.groupBy("key", "position").count().where("position = 32 OR count = 2").select("key")


def pairs(rows: DataFrame, distance: int) -> DataFrame:
    """Pairs of fingerprints that meet at a key and are within ``distance`` bits, each found once per half at most.

    Spark takes a side for as small as the fingerprints it was exploded from and would send it whole, so the join is by sorting.
    """
    left = rows.where("bit <= 0").select("key", "position", F.col("bits").alias("a"))
    right = rows.where("bit <> 0").select("key", F.col("bits").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return left.join(right.hint("merge"), "key").where(((F.col("position") < SEGMENT) | (F.col("a") < F.col("b"))) & near).select("a", "b")


def masks(spark, distance: int) -> DataFrame:
    """What may still differ on the other half: ``distance`` bits where halves are equal, else one bit less."""
    rows = []
    for whole, size in ((True, distance), (False, distance - 1)):
        for places in combinations(range(SEGMENT), size):
            rows.append((whole, sum(1 << p for p in places)))
    return spark.createDataFrame(rows, "whole boolean, mask long")


def stars(rows: DataFrame, distance: int) -> DataFrame:
    """Links inside hot keys without pairs.

    With every possible set of differing bits deleted, fingerprints that agree are within ``distance`` bits of each
    other, so each is linked to the smallest of them.  At most 2 ** distance different ones can agree.
    """
    choice = F.broadcast(masks(rows.sparkSession, distance))  # a fixed table of some thousand rows
    agreed = (
        rows.withColumn("whole", F.col("position") == SEGMENT)
        .join(choice, "whole")
        .groupBy("key", "mask", F.col("other").bitwiseAND(F.bitwise_not("mask")).alias("rest"))
        .agg(F.min("bits").alias("a"), F.collect_set("bits").alias("members"))
    )
    return agreed.where(F.size("members") > 1).select("a", F.explode("members").alias("b")).where("a <> b").distinct()


def links(prints: DataFrame, distance: int = MAX_DISTANCE, hot: int = HOT_CLASS) -> DataFrame:
    """``(a, b)``: links between different fingerprints that give the same components as all links would.

    ``prints`` has one row per fingerprint (``bits``).  Outside hot keys these are all links.  ``distance`` may be
    1 to 3.
    """
    crowded = settle(hot_keys(prints, hot))
    rows = variants(prints)
    calm = rows.join(crowded, "key", "left_anti")
    busy = rows.join(crowded, "key", "left_semi")
    return pairs(calm, distance).unionByName(stars(busy, distance))


def with_roots(classes: DataFrame, distance: int, hot: int) -> DataFrame:
    """``classes``, one row per fingerprint (``bits``), with the smallest fingerprint each reaches over links as ``root``."""
    roots = connected(links(classes.select("bits"), distance, hot))
    return classes.join(roots, classes["bits"] == roots["node"], "left").select(*classes.columns, F.coalesce("root", "bits").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE, hot: int = HOT_CLASS) -> DataFrame:
    """``(doc_id, bits, component_id)``: each row's fingerprint and the smallest doc_id it reaches over links.

    Two rows are linked when their fingerprints differ in at most ``distance`` bits.  Null and empty texts have
    fingerprint 0 and are linked like any other; a null doc_id keeps its row and takes part, but never names a
    component unless no row of it has an id (then component_id is null).  Repeated rows stay repeated.  An empty
    table gives an empty table; other columns are ignored.
    """
    prints = settle(with_fingerprints(docs))
    classes = settle(prints.groupBy("bits").agg(F.min("doc_id").alias("first_id")))
    rooted = with_roots(classes, distance, hot)
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = rooted.join(named, "root").select("bits", "component_id")
    return prints.join(placed, "bits").select("doc_id", "bits", "component_id")


def keep_one_per_group(docs: DataFrame, distance: int = MAX_DISTANCE, hot: int = HOT_CLASS) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group of near-duplicates does: that with the smallest id.

    Every group keeps exactly one row, whatever the ids: a row without an id only where no row of its group has one, and
    of rows that share the kept id within a group that with the smallest hash of text, then of the whole row.  One id
    over texts of several groups stays once in each of them that it is the smallest id of.  Columns are those of ``docs``.
    """
    names = docs.columns
    key = {
        "_own": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
        "_text": F.xxhash64("text"),
        "_whole": F.xxhash64(*names),
    }
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "_own", "_text", "_whole")
    keyed = docs.select("doc_id", "text", *[c.alias(k) for k, c in key.items()])
    # the first row of each fingerprint, then of each component, by key only; texts are met once, by the rows kept
    prints = with_fingerprints(keyed, also=tuple(key))
    classes = settle(prints.groupBy("bits").agg(F.min(order).alias("first")))
    firsts = with_roots(classes, distance, hot).groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    rows = docs.select(F.struct(*names).alias("_row"), *[c.alias(k) for k, c in key.items()])
    # as many keys as groups: met by sorting, since the rows are shuffled by key anyway and the driver need not hold the keys
    kept = rows.join(settle(firsts.drop("no_id")).hint("merge"), list(key), "left_semi")
    return kept.groupBy(*key).agg(F.first("_row").alias("_row")).select("_row.*")
