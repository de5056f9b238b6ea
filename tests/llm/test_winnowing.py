"""Decontamination against a plain search for every window of every item."""

import hashlib
import random
import re

from hypothesis import given, settings, strategies as st

from granary.llm import winnowing

NOT_IN_WORDS = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in NOT_IN_WORDS.split(low) if w]


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(docs, items):
    return sorted((tuple(r) for r in winnowing.contaminated(docs, items).collect()), key=repr)


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, "r", 5) for i, t in rows], "item_id long, text string, row string, print int")


def prose(rng, n, vocabulary=30):
    return " ".join(f"{'äß字'[rng.randrange(3)] if rng.random() < 0.1 else ''}w{rng.randrange(vocabulary)}" for _ in range(n))


def test_equals_plain_version(spark, documents):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.choice([1, 2, 4, 6, 9, 10, 11, 30]), 60)) for i in range(40)]
    items += [(100, items[7][1]), (100, items[8][1]), (None, items[9][1]), (101, None), (102, " ..."), (9, items[20][1])]
    docs = [(i, prose(rng, rng.randrange(0, 80), 60)) for i in range(60)]
    for i in range(60):  # whole items and parts, in other case and punctuation
        text = rng.choice(items[:40])[1].split(" ")
        part = text[rng.randrange(0, 3) :]
        docs.append((100 + i, prose(rng, rng.randrange(0, 9)) + "; " + ", ".join(part).upper() + "\n" + prose(rng, 5)))
    rows = [(d, t) for d, t in docs] + [(101, docs[70][1])]
    want = plain(rows, items)
    assert got(documents(rows), benchmark(spark, items)) == want
    assert sum(r[-1] for r in want) > 40 and any(not r[-1] for r in want)


def test_no_shared_span_of_ten_words_is_missed(spark, documents):
    rng = random.Random(9)
    items = [(i, prose(rng, 14, 1000)) for i in range(20)]
    docs = []
    for i, text in items:  # every stretch of ten words, and of nine, in strange surroundings
        for at in range(5):
            docs.append((1000 * i + at, f"x{i} " + " ".join(text.split(" ")[at : at + 10]) + " y"))
            docs.append((1000 * i + 10 + at, f"x{i} " + " ".join(text.split(" ")[at : at + 9]) + " y"))
    rows = got(documents(docs), benchmark(spark, items))
    assert {r[0] % 1000 < 10: None for r in rows if r[-1]} == {True: None} and sum(r[-1] for r in rows) == 100
    assert {r[2] for r in rows} == {0, 10}


def test_odd_rows(spark, odd):
    items = [(1, "one"), (2, "SAME text in two"), (3, "line 5 of a very long text with the number 25"), (4, "a" * 200_000), (5, "")]
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd, benchmark(spark, items)) == plain(texts, items)


def test_common_passage(spark, documents):
    passage = "the same ten words stand in very many documents of this table"
    docs = documents([(i, f"{i} {passage}") for i in range(600)])
    items = [(i, passage) for i in range(50)] + [(900, f"0 {passage}")]
    rows = winnowing.contaminated(docs, benchmark(spark, items)).collect()
    assert {r["n_items"] for r in rows} == {51} and {r["n_hit"] for r in rows if r["doc_id"]} == {12}


def test_empty(spark, none, odd):
    assert got(none, benchmark(spark, [(1, "one")])) == []
    assert {r[-1] for r in got(odd, benchmark(spark, []))} == {False}


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=st.sampled_from("aZ09 .-\x7f\x00é字\n "), max_size=60))
def test_words(text):
    found = winnowing.Words(text.encode())
    assert [found.text(i, 1) for i in range(found.n)] == words(text)
    apart = found.hashes().tolist()
    assert len(set(apart)) == len(set(words(text)))
