"""Delimited files with line breaks in quotes: equal to the reader that takes a file in one task, but split."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from granary.sources import files, quoted

PIECES = ["a", "Ж", "long words here", " ", "", "1.5", "x y"]


def made(rng, rows, strange):
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", lineterminator="\n")
    writer.writerow(["id", "name", "note"])
    for i in range(rows):
        note = "".join(rng.choice([*PIECES, ";", '"', "\n", '""', "\n\n", '";"']) for _ in range(rng.randrange(6)))
        name = rng.choice(PIECES) + (f"{'z' * 3000}\n" if strange and i % 97 == 5 else "")
        writer.writerow([i, name, note])
        if strange and i % 11 == 0:
            out.write(f'{i};five " inch;tail "quoted" end\n')
    return out.getvalue()


def one_task(spark, path):
    """What the reader gives that takes every file whole."""
    names = ["id", "name", "note"]
    schema = ", ".join(f"{n} string" for n in [*names, "more"])
    read = spark.read.options(sep=";", header=True, escape='"', multiLine=True, nullValue="\u0001", emptyValue="")
    return read.schema(schema).csv(path).where("more is null").select(*[F.trim(F.coalesce(n, F.lit(""))).alias(n) for n in names])


@pytest.fixture
def small_blocks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed, strange", [(1, False), (2, False), (3, True)])
def test_equals_the_one_task_reader(spark, tmp_path, small_blocks, seed, strange):
    rng = random.Random(seed)
    for part in range(3):
        (tmp_path / f"part-{part}.csv").write_text(made(rng, 300, strange))
    read = files.open_delimited(spark, str(tmp_path), ";")
    want = sorted(tuple(r) for r in one_task(spark, str(tmp_path)).collect())
    blank = [F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")).alias(c) for c in ("id", "name", "note")]
    got = sorted(tuple(r) for r in read.table.collect())
    trimmed = sorted(tuple(r) for r in spark.createDataFrame(want, "id string, name string, note string").select(*blank).collect())
    assert got == trimmed and len(got) == len(want) >= 900
    assert read.skipped.first()["skipped"] == 0
    assert read.table.rdd.getNumPartitions() > 20  # files of some 6 kB in blocks of 700 bytes


def test_block_inside_one_record(spark, tmp_path, small_blocks):
    text = "\n".join(f"line {i}" for i in range(600))
    (tmp_path / "a.csv").write_text(f'id;note\n1;"{text}"\n2;"b\nc"\n3;d\n')
    read = files.open_delimited(spark, str(tmp_path), ";")
    assert {r["id"]: r["note"] for r in read.table.collect()} == {"1": text, "2": "b\nc", "3": "d"}
    states = quoted.begin_states(quoted.block_states(quoted.lines_of(spark, str(tmp_path)), ";"))
    assert states.where("inside").count() >= 5


def test_quote_left_open_and_files_of_one_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;note\n1;"x\ny"\n2;"never closed\n3;z\n')
    (tmp_path / "b.csv").write_text("id;note\n")
    (tmp_path / "c.csv").write_text("")
    got = {r["id"]: r["note"] for r in files.open_delimited(spark, str(tmp_path), ";").table.collect()}
    assert got == {"1": "x\ny", "2": "never closed\n3;z"}


@pytest.mark.parametrize(
    "line, inside, after",
    [('a;b', False, False), ('a;b', True, True), ('a;"b', False, True), ('b";c', True, False), ('"a""b";"c', False, True),
     ('5" wide;x', False, False), ('"a"x"y;"b', False, True), ('""', False, False), ('""', True, True), ('";"', True, True)],
)
def test_state_of_a_line(line, inside, after):
    assert quoted.ends_inside(line.encode(), inside, b";") is after
