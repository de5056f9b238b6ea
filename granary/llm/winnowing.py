"""Benchmark passages in documents, found by winnowed fingerprints.

A window of ten words is fingerprinted by the smallest hash of its k-grams, so neighbouring windows share one and equal
windows have equal ones.  Fingerprints of the documents meet those of the benchmark's items; a match is extended to
the windows that chose it, which are compared word by word.  Every shared span of ten words is therefore found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from granary.llm.batches import pieces
from granary.session import settle, spread

WINDOW = 10
#: Words of a k-gram; a window of ten has six of them and keeps the smallest hash.
GRAM = 5
#: Bits of the filter that spares documents' fingerprints which no item has the way to the join; its size is fixed.
FILTER_BITS = 24
PIECE_BITS = 15

# fixed values: the bytes that words are made of, after A-Z are lower-cased; all bytes of other characters belong to words
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[ord("0") : ord("9") + 1] = IN_WORD[ord("a") : ord("z") + 1] = IN_WORD[128:] = True

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer: every bit of the input bears on every bit of the output."""
    x = (x ^ (x >> U(32))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Words:
    """The words of a text: where they stand in its lower-cased bytes, and a hash of each.

    The hash takes the length, the first sixteen and the last eight bytes, which is enough to choose candidates:
    windows are compared whole.
    """

    def __init__(self, text: bytes):
        self.low = LOWER[np.frombuffer(text, np.uint8)]
        inside = np.zeros(len(self.low) + 2, dtype=np.int8)
        inside[1:-1] = IN_WORD[self.low]
        turn = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.n = len(self.starts)

    def hashes(self) -> np.ndarray:
        held = np.concatenate([np.zeros(8, np.uint8), self.low, np.zeros(24, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(held[:8].view("<u8"), shape=(len(held) - 7,), strides=(1,))
        size = self.ends - self.starts

        def bytes_from(at: np.ndarray, count: np.ndarray) -> np.ndarray:
            count = np.clip(count, 0, 8).astype(U)
            word = eight[at + 8]
            return np.where(count == 8, word, word & ((U(1) << (U(8) * (count % U(8)))) - U(1)))

        first, second = bytes_from(self.starts, size), bytes_from(self.starts + 8, size - 8)
        last = np.where(size > 16, eight[self.ends], U(0))
        return mixed(mixed(mixed(first + U(1)) + second) + last + size.astype(U))

    def text(self, start: int, count: int) -> str:
        return b" ".join(
            self.low[a:b].tobytes() for a, b in zip(self.starts[start : start + count], self.ends[start : start + count])
        ).decode("utf-8", "replace")


def fingerprints(hashes: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of every window of ``length`` words: the smallest hash of its k-grams."""
    gram = min(GRAM, length)
    if len(hashes) < length:
        return np.zeros(0, dtype=U)
    grams = np.zeros(len(hashes) - gram + 1, dtype=U)
    for i in range(gram):
        grams = mixed(grams + hashes[i : len(hashes) - gram + 1 + i] + U(i))
    kept = length - gram + 1
    least = grams[: len(grams) - kept + 1].copy()
    for i in range(1, kept):
        np.minimum(least, grams[i : len(grams) - kept + 1 + i], out=least)
    return mixed(least + U(length))


WINDOWS = "item string, length int, print long, passage string"


def item_windows(items: DataFrame) -> DataFrame:
    """``(item, length, print, passage)``: the windows of every item; one with fewer words, but not none, is one window.

    An item without an id is named by the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                rows = []
                for item, text in zip(piece.column("item").to_pylist(), piece.column("text").to_pylist()):
                    words = Words(text or b"")
                    length = min(WINDOW, words.n)
                    if length:
                        prints = fingerprints(words.hashes(), length).view(np.int64).tolist()
                        rows += [(item, length, p, words.text(i, length)) for i, p in enumerate(prints)]
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "length", "print", "passage"])

    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    narrow = items.select(item.alias("item"), F.col("text").cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(run, WINDOWS)


def slots(prints: np.ndarray) -> np.ndarray:
    return (prints.view(U) >> U(64 - FILTER_BITS)).astype(np.int64)


def filter_of(windows: DataFrame) -> np.ndarray:
    """Bits of the slots that fingerprints of items fall in; its size does not depend on the number of items."""
    slot = F.shiftrightunsigned("print", 64 - FILTER_BITS)
    places = windows.select(F.shiftright(slot, PIECE_BITS).alias("piece"), (slot % (1 << PIECE_BITS)).cast("int").alias("at")).distinct()
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    for row in places.groupBy("piece").agg(F.collect_list("at").alias("at")).toLocalIterator():  # 512 rows of 32768 numbers at most
        bits[(row["piece"] << PIECE_BITS) + np.array(row["at"])] = True
    return np.packbits(bits)


READ = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "found",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("length", T.IntegerType()),
                        T.StructField("print", T.LongType()),
                        T.StructField("start", T.IntegerType()),
                        T.StructField("passages", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)
FOUND = pa.list_(
    pa.struct([("length", pa.int32()), ("print", pa.int64()), ("start", pa.int32()), ("passages", pa.list_(pa.string()))])
)


def candidates(text: bytes, lengths: list[int], has) -> tuple[int, list[dict]]:
    """Number of words, and the fingerprints that pass the filter with the windows that chose them.

    Windows in a row that share a fingerprint make one entry: ``length, print, start`` (of the first) and ``passages``.
    """
    words, out = Words(text), []
    if words.n < min(lengths, default=WINDOW):
        return words.n, out
    hashes = words.hashes()
    for length in lengths:
        prints = fingerprints(hashes, length).view(np.int64)
        at = np.flatnonzero(has(prints))
        if len(at):
            apart = np.flatnonzero((np.diff(at) != 1) | (np.diff(prints[at]) != 0)) + 1
            for group in np.split(at, apart):
                passages = [words.text(i, length) for i in group.tolist()]
                out.append({"length": length, "print": int(prints[group[0]]), "start": int(group[0]), "passages": passages})
    return words.n, out


def read_documents(docs: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """A written row per document: a number of its own, its id and words, and the fingerprints that items may share."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)  # 2 ** FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33

        def has(prints):
            slot = slots(prints)
            return (sent.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1

        for batch in batches:
            for piece in pieces(batch):
                ids, counts, found = piece.column("doc_id"), [], []
                for text in piece.column("text"):
                    n, own = candidates(text.as_py() or b"", lengths, has)
                    counts.append(n)
                    found.append(own)
                rows = pa.array(range(row, row + len(counts)), pa.int64())
                row += len(counts)
                yield pa.RecordBatch.from_arrays(
                    [rows, ids, pa.array(counts, pa.int64()), pa.array(found, FOUND)], names=["row", "doc_id", "n_words", "found"]
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return settle(spread(narrow).mapInArrow(run, READ))


def hits(read: DataFrame, windows: DataFrame) -> DataFrame:
    """``(row, start, length, window)``: fingerprints joined, and the windows that chose them compared whole."""
    own = read.select("row", F.explode("found").alias("f")).select("row", "f.length", "f.print", "f.start", F.posexplode("f.passages"))
    own = own.select("row", "length", "print", (F.col("start") + F.col("pos")).alias("start"), F.col("col").alias("passage"))
    known = windows.select("length", "print", "passage").distinct()
    return own.join(known, ["length", "print", "passage"]).select("row", "start", "length", F.md5("passage").alias("window"))


def covered(places: Column) -> Column:
    """Words in the union of ``(start, length)`` places, which are in order."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("until"))

    def add(state, place):
        begin, end = F.greatest(place["start"], state["until"]), place["start"] + place["length"]
        return F.struct((state["n"] + F.greatest(end - begin, F.lit(0))).alias("n"), F.greatest(end, state["until"]).alias("until"))

    return F.aggregate(places, zero, add)["n"]


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every row of ``docs``.

    A window is ten words in a row of an item, or all words of an item that has fewer; n_hit counts the document's
    words inside windows that occur in it, n_items the different ids of items with such a window, and the digest is
    that of those ids in string order, joined by commas.  Null and empty texts have no words; an item without an id
    counts as one named by the empty string.  Repeated rows, and rows without an id, keep a row each.  Either
    table may be empty; other columns are ignored.
    """
    windows = settle(item_windows(items).distinct())
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # 1 to WINDOW
    read = read_documents(docs, lengths, filter_of(windows))
    found = settle(hits(read, windows))
    per_row = found.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("places"), F.array_sort(F.collect_set("window")).alias("seen")
    )
    per_row = settle(
        per_row.select("row", covered(F.col("places")).alias("n_hit"), "seen", F.sha2(F.array_join("seen", ","), 256).alias("set"))
    )
    # documents with the same windows have the same items, which are gathered once
    holders = windows.select(F.md5("passage").alias("window"), "item").distinct()
    sets = per_row.groupBy("set").agg(F.first("seen").alias("seen")).select("set", F.explode("seen").alias("window"))
    names = sets.join(holders, "window").select("set", "item").distinct()
    names = settle(
        names.groupBy("set").agg(F.array_sort(F.collect_list("item")).alias("items"), F.count("*").alias("n_items"))
        .select("set", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    )
    told = per_row.select("row", "n_hit", "set").join(names, "set").drop("set")
    out = read.select("row", "doc_id", "n_words").join(told, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def sql_words(table: str, key: str) -> str:
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return (
        f"SELECT row_number() OVER () AS r, {key}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM " + table
    )


SQL = f"""
WITH item_words AS MATERIALIZED ({sql_words("benchmark", "item_id")}), doc_words AS MATERIALIZED ({sql_words("documents", "doc_id")}),
windows AS MATERIALIZED (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, least(len(w), {WINDOW}) AS length,
         array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS passage
  FROM item_words, unnest(range(1, greatest(len(w) - {WINDOW} + 1, least(len(w), 1)) + 1)) AS u(i)
), lengths AS (SELECT DISTINCT length FROM windows),
here AS (
  SELECT r, i AS start, length, array_to_string(w[i : i + length - 1], ' ') AS passage
  FROM (SELECT r, w, length, unnest(range(1, len(w) - length + 2)) AS i FROM doc_words, lengths)
), hits AS MATERIALIZED (
  SELECT r, start, length, item FROM here JOIN windows USING (length, passage)
), counts AS (
  SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(start, start + length)) AS i FROM hits) GROUP BY r
), names AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc_words LEFT JOIN counts USING (r) LEFT JOIN names USING (r)
"""
