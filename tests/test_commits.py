"""Dataset versions: commits that readers see whole or not at all, and cleanup of what no version names."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from granary.session import shared_folder
from granary.sources import commits


@pytest.fixture
def root(spark):
    return shared_folder(spark, "commits")


def publish(spark, root, dataset, rows=3, name="numbers"):
    return commits.publish(root, dataset, {name: spark.range(rows)}, "2024-01-01")


def files_below(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path.removeprefix("file:")) for f in names if f.endswith(".parquet"))


def test_writers_at_one_time_get_versions_of_their_own(spark, root):
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda n: publish(spark, root, "a/b *", n + 1), range(6)))
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    rows = {r["version"]: r for r in commits.versions(spark, root).collect()}
    assert {v: r["row_count"] for v, r in rows.items()} == {v: n + 1 for n, v in enumerate(got)}
    assert len({r["provenance_id"] for r in rows.values()}) == 6
    assert all(commits.open_table(spark, root, "a/b *", "numbers", v).count() == r["row_count"] for v, r in rows.items())


def test_a_taken_number_is_not_written_over(spark, root, monkeypatch):
    assert publish(spark, root, "d") == 1
    monkeypatch.setattr(commits, "last_number", lambda *_: 0)  # a writer that looked before the first commit
    assert publish(spark, root, "d", 5) == 2
    assert commits.open_table(spark, root, "d", "numbers", 1).count() == 3
    assert commits.open_table(spark, root, "d", "numbers").count() == 5


def test_half_a_write_is_invisible(spark, root):
    assert commits.versions(spark, root).count() == 0
    publish(spark, root, "d")
    spark.range(9).write.parquet(f"{root}/d/data/dead/numbers.parquet")  # a writer that died before its commit
    for number, text in ((2, ""), (3, '{"dataset_id": "d", "version": 3, "kind": "tab')):
        assert commits.put_once(spark, f"{root}/d/log/{number:012d}.json", text)
    assert [r["version"] for r in commits.versions(spark, root).collect()] == [1]
    assert publish(spark, root, "d", 4) == 4
    before = files_below(root)
    assert commits.vacuum(spark, root) == 0 and files_below(root) == before  # within the grace
    assert commits.vacuum(spark, root, grace_seconds=-60) == 1
    assert files_below(root) == [f for f in before if "/dead/" not in f]
    assert commits.open_table(spark, root, "d", "numbers", 1).count() == 3


def test_cleanup_removes_tables_and_counts_them(spark, root):
    for dataset in ("gone", "kept", "gone"):
        publish(spark, root, dataset)
    commits.publish(root, "gone", {"x": spark.range(1), "ä y": spark.range(2)}, "2024-01-02")
    counts = {r["dataset_id"]: tuple(r)[1:] for r in commits.cleanup(spark, root, ["gone", "never"]).collect()}
    assert counts == {"gone": (3, 4, 4), "never": (0, 0, 0)}
    assert [r["dataset_id"] for r in commits.versions(spark, root).collect()] == ["kept"]
    assert files_below(root) and all("/kept/" in f for f in files_below(root))
    with pytest.raises(LookupError):
        commits.open_table(spark, root, "gone", "numbers")
    assert commits.cleanup(spark, root, ["gone"]).first()["paths_deleted"] == 0
    assert publish(spark, root, "gone", 7) == 5  # numbers are not used again
    assert commits.open_table(spark, root, "gone", "numbers").count() == 7


def test_a_cleanup_cut_short_is_ended_by_vacuum(spark, root):
    publish(spark, root, "gone"), publish(spark, root, "kept")
    commits.append(spark, root, "gone", {"kind": commits.REMOVAL})
    assert commits.vacuum(spark, root, grace_seconds=-60) == 1
    assert all("/kept/" in f for f in files_below(root))
