"""The piecewise helpers against plain Python, with one key that holds most rows."""

import random

import pyarrow as pa
import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import splitting
from granary.operators import chunk, coverage, joins, packing, tagging
from granary.operators.ordering import with_position, with_running_sum


def skewed(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}", i, rng.randrange(1, 50)) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, i long, v long").repartition(8)


def grouped(rows):
    out = {}
    for k, i, v in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(k, []).append((i, v))
    return out


def test_positions_and_running_sums(spark):
    rows, df = skewed(spark)
    want_at, want_sum = {}, {}
    for k, items in grouped(rows).items():
        total = 0
        for at, (i, v) in enumerate(items, 1):
            total += v
            want_at[i], want_sum[i] = at, total
    assert {r["i"]: r["position"] for r in with_position(df, ["k"], ["i"]).collect()} == want_at
    assert {r["i"]: r["s"] for r in with_running_sum(df, ["k"], ["i"], "v", "s").collect()} == want_sum


@pytest.mark.parametrize("block", [12, 40, 1000])
def test_packing_equals_sequential_packing(spark, block):
    rows, df = skewed(spark, 900)

    def reach(v, start):
        size, at = 0, start
        while at < len(v["v"]) and at - start < 12 and (at == start or size + v["v"][at] <= 120):
            size += v["v"][at]
            at += 1
        return at

    want = {}
    for k, items in grouped(rows).items():
        pack = size = count = 0
        for n, (i, v) in enumerate(items):
            if n and (count >= 12 or size + v > 120):
                pack, size, count = pack + 1, 0, 0
            size, count = size + v, count + 1
            want[i] = pack
    got = packing.packed(df, ["k"], ["i"], ["v"], reach, 12, "pack", block).collect()
    assert {r["i"]: r["pack"] for r in got} == want


@pytest.mark.parametrize("block", [12, 40])
def test_packing_by_all_ends_at_once(spark, block):
    """Packs by a function that gives the ends of all starts of a block equal those by one start at a time."""
    _, df = skewed(spark, 300)

    def reach(v, start):
        size, at = 0, start
        while at < len(v["v"]) and at - start < 12 and (at == start or size + v["v"][at] <= 120):
            size += v["v"][at]
            at += 1
        return at

    def ends(v):
        return np.array([reach(v, start) for start in range(len(v["v"]))])

    one = packing.packed(df, ["k"], ["i"], ["v"], reach, 12, "pack", block).collect()
    all_ = packing.packed(df, ["k"], ["i"], ["v"], None, 12, "pack", block, ends=ends).collect()
    assert sorted(one) == sorted(all_) and len(one) == 300


@pytest.mark.parametrize("size, chars", [(3, 400), (40, 900), (2, 5000)])
def test_row_groups_end_where_they_would_line_by_line(spark, size, chars):
    rng = random.Random(size)
    rows = [(i, "ab " * rng.choice([0, 1, 9, 40, 90, 400]), "x" * rng.choice([0, 5, 300])) for i in range(160)]
    lines = chunk.table_lines(spark.createDataFrame(rows, "k long, v string, w string"), ["k"], ["v", "w"], F.lit("s"), chars)
    want, body, done = [], [], 0
    for r in sorted(lines.collect(), key=lambda r: (r["row_number"], r["line_number"])):
        used = len("\n".join(body))
        new = r["line_number"] == 0 and (done + 1 > size or used + r["row_chars"] > chars)
        if body and (new or used + len(r["line"]) + 1 > chars):
            want, body, done = [*want, "\n".join(body)], [], 0
        body.append(r["line"])
        done += r["is_last"]
    want.append("\n".join(body))
    got = sorted(chunk.row_group_chunks(lines, size, chars).collect(), key=lambda r: r["row_group_index"])
    assert [r["row_group_index"] for r in got] == list(range(len(want)))
    assert [r["content"].split("\n", 1)[1] for r in got] == want


def test_batches_are_bounded_and_ordered(spark):
    docs = spark.createDataFrame([("r", i, "x" * (i % 9 * 100)) for i in range(60)], "r string, i long, text string")
    rows = sorted(coverage.batch_context(docs, "r", ["i"], "text", 5, 1500).collect(), key=lambda r: r["i"])
    assert [r["batch"] for r in rows] == sorted(r["batch"] for r in rows)
    assert all(r["chars"] > 0 for r in rows) and len(rows) == sum(1 for i in range(60) if i % 9)


def test_merge_ranges(spark):
    rng = random.Random(3)
    rows = [("f", "s" if rng.random() < 0.8 else "t", a := rng.randrange(5000), a + rng.randrange(6)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "f string, s string, row_start long, row_end long").repartition(8)
    want = set()
    for sheet in ("s", "t"):
        current = None
        for _, _, a, b in sorted(r for r in rows if r[1] == sheet):
            if current and a <= current[1] + 1:
                current[1] = max(current[1], b)
            else:
                if current:
                    want.add((sheet, *current))
                current = [a, b]
        want.add((sheet, *current))
    got = {(r["s"], r["row_start"], r["row_end"]) for r in coverage.merge_ranges(df, ["f", "s"]).collect()}
    assert got == want


def test_known_ranges(spark):
    df = spark.createDataFrame([(1, 3), (4, 6), (10, 12), (15, 11)], "row_start long, row_end long").withColumn("k", F.lit(1))
    got = sorted((r["row_start"], r["row_end"]) for r in coverage.merge_ranges(df, ["k"]).collect())
    assert got == [(1, 6), (10, 15)]


def test_splitter_keeps_every_letter_and_the_size():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))) for _ in range(900)]
    text = "".join(w + rng.choice([" ", " ", ". ", "\n", "\n\n"]) for w in words)
    chunks = splitting.split_text(text, 200, 0)
    assert all(len(c) <= 200 for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    overlapping = splitting.split_text(text, 200, 60)
    assert len(overlapping) > len(chunks) and all(len(c) <= 200 for c in overlapping)
    assert splitting.limits(10, 90) == (50, 12)


def test_long_cells_and_long_rows(spark):
    df = spark.createDataFrame([(1, "a" * 5000, "b"), (2, "c", "")], "k long, x string, y string")
    short = df.select(chunk.row_parts(df, ["x", "y"], 800).alias("p")).collect()
    assert short[0]["p"] == ["x: " + "a" * 800 + "...", "y: b"] and short[1]["p"] == ["x: c"]
    lines = chunk.table_lines(df, ["k"], ["x", "y"], F.lit("s"), 1000).orderBy("row_number", "line_number").collect()
    assert all(len(r["line"]) <= 1000 for r in lines)
    first = [r["line"] for r in lines if r["row_number"] == 1]
    assert first[0].startswith("Row 1: ") and all(line.startswith("Row 1 (cont): ") for line in first[1:])
    assert sum(line.count("a") for line in first) == 2000


def test_row_groups_cover_all_rows(spark):
    df = spark.createDataFrame([(i, f"value {i}" * (1 + i % 7)) for i in range(308)], "k long, v string")
    groups = chunk.row_group_chunks(chunk.table_lines(df, ["k"], ["k", "v"], F.lit("s"), 1650), 40, 1650).collect()
    covered = [n for g in groups for n in range(g["row_start"], g["row_end"] + 1)]
    assert sorted(covered) == list(range(1, 309))
    assert all(len(g["content"].split("\n", 1)[1]) <= 1650 for g in groups)


def test_cap_keeps_summaries_first_and_last(spark):
    rows = [("f", "row_group", i, i) for i in range(500)] + [("f", "file_summary", 0, None), ("g", "row_group", 0, 0)]
    df = spark.createDataFrame(rows, "file_id string, chunk_type string, chunk_order long, row_group_index long")
    kept = chunk.cap_chunks(df, 64).filter("file_id = 'f'").collect()
    groups = sorted(r["row_group_index"] for r in kept if r["chunk_type"] == "row_group")
    assert len(kept) == 64 and groups[0] == 0 and groups[-1] == 499


def test_phrases(spark):
    texts = spark.createDataFrame([(1, "The total_price, by Day"), (2, "totally priced day")], "i long, text string")
    terms = spark.createDataFrame([("total price",), ("day",), ("price by day",)], "term string")
    got = sorted((r["i"], r["term"]) for r in joins.phrase_mentions(texts, "i", "text", terms, "term").collect())
    assert got == [(1, "day"), (1, "price by day"), (1, "total price"), (2, "day")]


def test_fields(spark):
    columns = spark.createDataFrame(
        [
            ("t", "created_at", "datetime", "created_at", ["created_at"], []),
            ("t", "amount_rub", "numeric", "Amount RUB", ["Amount RUB"], []),
            ("t", "status", "text", "status", ["status"], ["open"]),
        ],
        "table_name string, column_name string, dtype string, display_name string, aliases array<string>, sample_values array<string>",
    )
    asked = spark.createDataFrame([("t", "status"), ("t", "amount"), ("t", "statuss"), ("t", "nothing here")], "table_name string, requested string")
    got = {r["requested"]: (r["status"], r["matched_column"]) for r in joins.resolve_fields(asked, joins.column_variants(columns)).collect()}
    assert got["status"] == ("matched", "status") and got["amount"] == ("matched", "amount_rub")
    assert got["statuss"] == ("matched", "status") and got["nothing here"][0] == "no_match"


def test_followups_cross_pieces(spark):
    turns = [(1, 2 * i, "Show total by month") if i == 0 else (1, 2 * i, "group by week") for i in range(200)]
    df = spark.createDataFrame(turns, "c long, t long, text string").repartition(8)
    got = {r["t"]: r for r in tagging.followup_links(df, "c", "t", "text").collect()}
    assert not got[0]["is_followup"]
    # The first request has the form of a refinement itself, so every later one goes back one step.
    assert all(got[2 * i]["is_followup"] for i in range(1, 200))


def test_file_mentions(spark):
    rows = [
        (1, "look at report.csv and pandas.DataFrame"),
        (2, "error in main.py"),
        (3, "use the file data.v2"),
        (4, "see a*.csv"),
        (5, "open `My Sheet.xlsx`"),
    ]
    df = spark.createDataFrame(rows, "i long, text string")
    got = sorted((r["i"], r["name"]) for r in tagging.file_mentions(df, "i", "text").collect())
    assert (1, "report.csv") in got and (3, "data.v2") in got and (5, "my sheet.xlsx") in got
    assert not [g for g in got if g[0] in (2, 4)]


@pytest.mark.parametrize("cap", [1, 2, 3, 5, 64, 320])
def test_capped_files_keep_the_row_groups_at_even_steps(spark, cap):
    """Against the steps listed one by one; nothing is exploded, which Spark would take for small and send whole."""
    sizes = {"a": 0, "b": 1, "c": 63, "d": 318, "e": 319, "f": 777, "g": 2000}
    rows = [(f, "row_group", i, i) for f, n in sizes.items() for i in range(n)]
    rows += [(f, kind, i, None) for f in sizes for i, kind in enumerate(("file_summary", "sheet_summary"))] + [("f", "row_group", 5, 5)]
    df = spark.createDataFrame(rows, "file_id string, chunk_type string, chunk_order long, row_group_index long")
    capped = chunk.cap_chunks(df, cap)
    assert "Generate" not in capped._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for f, n in sizes.items():
        groups = list(range(n)) + ([5] if f == "f" else [])
        room = max(0, cap - 2)
        if len(groups) + 2 > cap:
            steps = {round((len(groups) - 1) / (room - 1) * i) for i in range(room)} if room > 1 else {0} if room == 1 else set()
            left = len(groups) + 2 - min(2, cap) - len(steps)
            kept = [(f, "row_group", i, left) for i in groups if i in steps]
            want += kept + [(f, k, None, left) for k in ("file_summary", "sheet_summary")[:cap]]
        else:
            want += [(f, "row_group", i, 0) for i in groups] + [(f, k, None, 0) for k in ("file_summary", "sheet_summary")]
    got = [(r["file_id"], r["chunk_type"], r["row_group_index"], r["left_out"]) for r in capped.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_texts_are_split_a_few_megabytes_at_a_time(spark):
    texts = ["x"] * 50 + ["word " * 60_000] * 20 + [None, "y" * (chunk.SLICE_BYTES * 2)] + ["z"] * 50
    parts = list(chunk.slices(pa.record_batch({"t": pa.array(texts)})))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or p.nbytes <= chunk.SLICE_BYTES for p in parts) and len(parts) > 3
    df = spark.createDataFrame([(i, t, "txt") for i, t in enumerate(texts[:70])] + [(None, "alone", None)], "i long, t string, k string")
    got = chunk.split_documents(df, "i", "t", "k").collect()
    want = [(i, n, c) for i, t in enumerate(texts[:70]) for n, c in enumerate(splitting.split_text(t, 2000, 400))] + [(None, 0, "alone")]
    assert sorted(((r["i"], r["chunk_index"], r["content"]) for r in got), key=repr) == sorted(want, key=repr)
