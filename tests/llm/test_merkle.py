"""The Merkle manifest against a plain version: every height, several languages, odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from granary.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, add=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + add, row["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([sha("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return out


def siblings(levels, at):
    """``(whether left, digest)`` from the lowest level up; None where a run has no other."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append((other < at, level[other]) if other < len(level) else None)
        at //= 2
    return out


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {}
    for lang in order:
        trees[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        built[lang] = levels_of([leaf(r) for r in trees[lang]])
    whole = levels_of([built[k][-1][0] for k in order])
    out = []
    for lang in order:
        for at, r in enumerate(trees[lang]):
            path = siblings(built[lang], at) + siblings(whole, order.index(lang))
            forged = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            own = leaf(r, int(forged))
            for step in path:
                own = sha(own) if step is None else sha(step[1] + own) if step[0] else sha(own + step[1])
            proof = sha("".join(s[1] for s in path if s))
            out.append((r["doc_id"], leaf(r), built[lang][-1][0], whole[-1][0], proof, own, own == whole[-1][0]))
    return sorted(out, key=repr)


def got(docs):
    return sorted((tuple(r) for r in merkle.audited(docs, merkle.tampered()).collect()), key=repr)


def check(docs):
    want = plain([r.asDict() for r in docs.collect()])
    assert got(docs) == want
    return want


def spread_over(documents, counts):
    rows, at = [], 0
    for lang, n in counts.items():
        for _ in range(n):
            rows.append((at * 3, f"text {at}", "s", lang))
            at += 1
    return documents(rows)


@pytest.mark.parametrize("counts", [{"en": 1}, {"en": 2, "de": 1}, {"en": 33, "de": 32, None: 31, "é": 5}, {f"l{i}": 1 + i % 3 for i in range(70)}])
def test_equals_plain_version(documents, counts):
    want = check(spread_over(documents, counts))
    assert any(not r[-1] for r in want) or len(want) < 7


def test_more_than_two_stored_levels(documents):
    docs = spread_over(documents, {"en": 1100, "fr": 65})
    want = check(docs)
    tree = merkle.manifest(docs)
    assert [level.count() for level in tree.languages] == [1165, 35 + 3, 2 + 1, 2]
    assert sum(not r[-1] for r in want) > 100


def test_odd_rows(odd):
    want = check(odd)
    assert all(r[-1] for r in want if r[0] is None)
    changed = odd.withColumn("n_chars", F.lit(None).cast("long"))
    assert all(r[-1] for r in check(changed))  # tampering leaves nulls alone


def test_empty(none):
    assert got(none) == []
    assert merkle.manifest(none).root is None
