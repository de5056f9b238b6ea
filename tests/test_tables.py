"""Sources, normalisation, profiles and aggregates on literal tables."""

import pytest
from pyspark.errors import PySparkException

from granary.operators import aggregate, budget, chunk, filters, normalize, profile
from granary.session import shared_folder
from granary.sources import files


def folder(spark, tmp_path, name, data: bytes):
    path = tmp_path / name
    path.write_bytes(data)
    return f"file://{path}"


def test_cp1251_semicolon_file(spark, tmp_path):
    text = "клиент;категория;сумма\nИван;книги;100\nАнна;книги;200\n"
    df = files.read_delimited(spark, folder(spark, tmp_path, "a.csv", text.encode("cp1251")))
    assert df.columns == ["клиент", "категория", "сумма"]
    assert sorted(r["сумма"] for r in df.collect()) == ["100", "200"]


def test_ragged_rows_and_quoted_line_breaks(spark, tmp_path):
    data = 'id,name,note\n1,a\n2,"two\nlines",x\n3,b,y,extra\n4,c,\n5,d,z,\n6,\t e ,"q""q"\n'
    got = files.open_delimited(spark, folder(spark, tmp_path, "r.csv", data.encode()))
    rows = sorted(map(tuple, got.table.collect()))
    assert rows == [("1", "a", ""), ("2", "two\nlines", "x"), ("4", "c", ""), ("5", "d", "z"), ("6", "e", 'q"q')]
    assert got.skipped.first()[0] == 1


def test_encoding_is_judged_by_the_whole_file(spark, tmp_path):
    head = "id,name\n" + "".join(f"{i},plain{i}\n" for i in range(20_000))
    for tail, charset in (("Анна", "cp1251"), ("Анна", "utf-8"), ("caf\u00e9 \u0098", "latin-1")):
        data = (head + f"99999,{tail}\n").encode(charset)
        got = files.open_delimited(spark, folder(spark, tmp_path, f"{charset}.csv", data))
        assert got.dialect.encoding == charset
        assert got.table.where("id = '99999'").first()["name"] == tail.strip()


def test_doubles_keep_their_digits(spark):
    values = [1e-7, 2e-7, 1.0, 100.25, -1.5e-5, 12345678.9, 1e23, 1.5e300, float("nan"), 9007199254740993.0, -3e10, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double")
    got = [r["v"] for r in normalize.normalize_cells(df).orderBy(df["k"]).collect()]
    assert got[0] == "0.0000001" and got[1] == "0.0000002" and got[2] == "1" and len(got[6]) in (23, 24) and got[8] == "NaN" and got[11] == ""
    assert all(float(t) == v and "E" not in t and not t.endswith(".0") for t, v in zip(got, values) if v is not None and v == v)


def test_headerless_pipe_file(spark, tmp_path):
    df = files.read_delimited(spark, folder(spark, tmp_path, "b.csv", b"1|2|3\n4|5|6\n"))
    assert df.columns == ["col_1", "col_2", "col_3"] and df.count() == 2


def test_forced_delimiter(spark, tmp_path):
    df = files.read_delimited(spark, folder(spark, tmp_path, "c.tsv", b"name\tvalue\naa\t10\nbb\t20\ncc\t30\n"), "\t")
    assert sorted(map(tuple, df.collect())) == [("aa", "10"), ("bb", "20"), ("cc", "30")]


def test_json_bad_line_fails_and_is_named(spark, tmp_path):
    path = folder(spark, tmp_path, "g.jsonl", b'{"id": "a"}\nnot json\n')
    with pytest.raises(Exception, match="g.jsonl"):
        files.read_json(spark, path, "id string").collect()
    assert [r["value"] for r in files.bad_json_lines(spark, path).collect()] == ["not json"]


def test_text_encodings(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("привет".encode("cp1251"))
    (tmp_path / "t" / "b.md").write_bytes("héllo".encode())
    (tmp_path / "t" / "c.txt").write_bytes(b"  ")
    got = sorted(r["text"] for r in files.read_text(spark, f"file://{tmp_path}/t").collect())
    assert got == ["héllo", "привет"]


def test_headers():
    names, aliases = normalize.normal_headers(["Sum, RUB", "", "2024", "sum rub", "sum_rub"])
    assert names == ["sum_rub", "col_2", "t_2024", "sum_rub_2", "sum_rub_3"]
    assert aliases["sum_rub_2"] == "sum rub"


def test_kinds(spark):
    rows = [(i, str(i % 2), str(i), f"{i},5", f"2024-01-{i % 28 + 1:02d}", "w", "") for i in range(30)]
    df = spark.createDataFrame(rows, "k int, flag string, whole string, part string, day string, word string, none string")
    kinds = {r["column_name"]: r["kind"] for r in normalize.column_kinds(df, "k").collect()}
    assert kinds == {
        "k": "integer", "flag": "boolean", "whole": "integer", "part": "number", "day": "datetime_like", "word": "text", "none": "empty",
    }


@pytest.fixture
def sales(spark):
    rows = [("north", "100.5"), ("south", "200"), ("west", "50,25"), ("north", " 80.5 "), ("", " ")]
    return spark.createDataFrame(rows, "region string, revenue string")


def test_golden_aggregates(sales):
    assert aggregate.scalar(sales, "sum", "revenue").first()["value"] == 431.25
    assert aggregate.scalar(sales, "avg", "revenue").first()["value"] == 107.8125
    assert aggregate.scalar(sales, "count").first()["value"] == 5
    top = aggregate.grouped(sales, "region", "sum", "revenue").first()
    assert (top["group_key"], top["value"]) == ("south", 200.0)


def test_bad_number_raises_in_aggregates_but_not_in_filters(spark):
    df = spark.createDataFrame([("x",), ("5",)], "v string")
    assert df.filter(filters.in_range(df, "v", "gt", "1")).count() == 1
    with pytest.raises(PySparkException):
        aggregate.scalar(df, "sum", "v").collect()


def test_spending_by_month(spark):
    rows = [("2026-01-05", "100"), ("2026-01-20", "150"), ("2026-02-03", "240"), ("2026-02-09", "180"), ("2026-03-01", "300"), ("2026-03-18", "120")]
    df = spark.createDataFrame(rows, "created_at string, amount string")
    got = [tuple(r) for r in aggregate.trend(df, "created_at", "month", "sum", "amount").collect()]
    assert got == [("2026-01", 250.0), ("2026-02", 420.0), ("2026-03", 420.0)]


def test_budgets(spark):
    assert budget.row_verdict(spark.range(5), 4).first()["over_limit"]
    with pytest.raises(budget.BudgetExceeded):
        budget.bounded_rows(spark.range(5), 4)
    assert len(budget.bounded_rows(spark.range(4), 4)) == 4


def test_percentile_with_one_hot_value(spark):
    rows = [("a", 1.0)] * 500 + [("a", float(i)) for i in range(2, 300)] + [("b", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    import numpy as np

    got = {r["g"]: r["p"] for r in profile.percentiles(df, ["g"], "v", 0.9, "p").collect()}
    assert got == {"a": pytest.approx(np.percentile([v for g, v in rows if g == "a"], 90)), "b": 7.0}


def test_wide_table_keeps_the_fullest_columns(spark):
    df = spark.createDataFrame([("a", "", "x", None), ("b", "c", "", None)], "p string, q string, r string, s string")
    kept, pruned = chunk.fullest_columns(df, 2)
    assert kept == ["p", "q"] and pruned == ["r", "s"]


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_near_empty_files(spark):
    pages = [("scan", "p. 1"), ("scan", "  "), ("scan", "p. 3"), ("blank", " "), ("text", "x" * 24), ("many", "y" * 23), ("many", "z" * 23)]
    got = {r["file"]: (r["pages"], r["near_empty"]) for r in chunk.near_empty(spark.createDataFrame(pages, "file string, text string"), "file", "text").collect()}
    assert got == {"scan": (2, True), "blank": (0, True), "text": (1, False), "many": (2, False)}


def test_first_values_of_mostly_empty_columns(spark):
    rows = [(i, f"v{i}", "late" if i in (900, 950) else None, None) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, often string, seldom string, never string")
    got = {}
    for r in normalize.first_values(df, df.columns, "k", 3).orderBy("position").collect():
        got.setdefault(r["column_name"], []).append(r["value"])
    assert got == {"k": ["0", "1", "2"], "often": ["v0", "v1", "v2"], "seldom": ["late", "late"]}
    assert {r["column_name"] for r in normalize.first_values(df, ["seldom", "never"], "k", 3).collect()} == {"seldom"}
    assert normalize.first_values(df.limit(0), ["often"], "k", 3).count() == 0


def test_metadata_samples_by_first_place(spark):
    """Samples differ without case and beyond their head, in order of the first key; all values count as unique."""
    long = "y" * 79 + " "
    cells = ["b  B", None, "B b", long + "tail", long, (long + "other").upper(), " a", "A", "c", "d", "e", "f", "K\u0130" * 45]
    rows = [(100 - i, text, i % 3) for i, text in enumerate(cells)]
    df = spark.createDataFrame(rows, "k long, v string, n int").repartition(5)
    got = {r["normalized_name"]: r for r in normalize.column_metadata(df, "k").collect()}
    assert got["v"]["sample_values"] == [("K\u0130" * 45)[:80], "f", "e", "d", "c"]
    assert got["n"]["sample_values"] == ["0", "2", "1"] and got["n"]["cardinality_hint"] == "low"
    few = normalize.column_metadata(df.where("k >= 93"), "k", ["v"]).first()
    assert few["sample_values"] == ["A", "Y" * 79, "B b"]
    assert normalize.column_metadata(df.where("k > 200"), "k", ["v"]).first()["sample_values"] == []


def test_metadata_ranks_no_whole_column(spark, capsys):
    """Only the first values of a column are put in order, and its values are not shuffled a second time."""
    df = spark.range(2000).selectExpr("id AS k", "'Value ' || id AS v")
    normalize.column_metadata(df, "k").explain()
    text = capsys.readouterr().out
    assert "min_by" not in text and "Window" not in text
