"""Shared passages: against brute force and on odd rows."""

import random

import brute

from granary.llm import line_dedup
from granary.llm.batches import read


def sentence(n, random_):
    return " ".join(f"w{random_.randrange(5000)}" for _ in range(n))


def corpus(seed):
    r = random.Random(seed)
    shared = [[sentence(12, r) for _ in range(k)] for k in (4, 5, 9, 30)] + [[sentence(60, r)]]
    docs = {}
    for d in range(60):
        lines = [sentence(r.randint(1, 30), r) for _ in range(r.randint(0, 6))]
        for _ in range(r.randint(0, 3)):
            passage = list(r.choice(shared))
            if r.random() < 0.3:
                passage[r.randrange(len(passage))] = sentence(9, r)
            at = r.randint(0, len(lines))
            lines[at:at] = passage
        if r.random() < 0.2:
            lines += ["", ""]
        docs[d] = "\n".join(lines)
    docs[60] = docs[61] = docs[5]
    docs[62] = None
    return docs


def test_matches_brute_force(documents):
    for seed in (1, 2):
        docs = corpus(seed)
        got = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated(documents(list(docs.items()))).collect()}
        assert got == brute.dedup_lines(docs)
        assert sum(len(t or "") for t in got.values()) < 0.7 * sum(len(t or "") for t in docs.values())


def test_passages_go_wherever_they_stand(documents):
    r = random.Random(9)
    passage = [sentence(15, r) for _ in range(5)]
    docs = [(d, "\n".join([sentence(8, r) for _ in range(d)] + passage + [sentence(8, r) for _ in range(5 - d)])) for d in range(5)]
    got = {x["doc_id"]: x for x in line_dedup.remove_repeated(documents(docs)).select("doc_id", "text").collect()}
    assert "\n".join(passage) in got[0]["text"]
    for d in range(1, 5):
        assert not any(line in got[d]["text"] for line in passage)
        assert got[d]["text"].count("\n") == 4


def test_neighbours_that_repeat_elsewhere_do_not_hide_a_passage(documents):
    r = random.Random(4)
    passage = [sentence(15, r) for _ in range(4)]
    before, after = [sentence(7, r) for _ in range(3)], [sentence(7, r) for _ in range(3)]
    docs = [(0, [before[0], *passage, after[0]]), (1, [before[1], "", *passage, after[1]]), (2, [before[0], "x"]), (3, ["y", after[1]])]
    docs += [(4, [before[1], *passage[:2], "", *passage[2:], after[2]]), (5, [before[2], passage[0], "z"]), (6, [passage[3], after[0]])]
    texts = [(d, "\n".join(t)) for d, t in docs]
    got = {x["doc_id"]: x["text"] for x in line_dedup.remove_repeated(documents(texts)).select("doc_id", "text").collect()}
    assert got[0] == texts[0][1] and got[1] == f"{before[1]}\n\n{after[1]}"
    assert got[4] == after[2]  # blank lines aside, the line before the passage stands before it in document 1 as well
    assert all(got[d] == texts[d][1] for d in (2, 3, 5, 6))


def test_periodic_document_keeps_its_first_passage(documents):
    lines = [f"{'lorem ' * 8}{i}" for i in range(3)]
    text = "\n".join(lines * 20)
    got = line_dedup.remove_repeated(documents([(1, text)])).first()["text"].split("\n")
    assert got[:5] == (lines * 2)[:5] and len(got) < 12


def test_nothing_of_forty_words_stands_twice(spark):
    docs = {r["doc_id"]: r["text"] for r in read(spark, "/root/testdata/sf0.01", "documents").collect()}
    frame = line_dedup.remove_repeated(read(spark, "/root/testdata/sf0.01", "documents"))
    got = {r["doc_id"]: r["text"] for r in frame.collect()}
    gone = brute.repeated_lines(docs)
    assert sum(map(len, gone.values())) > 100
    for d, text in docs.items():  # only lines of passages that stand elsewhere go
        kept = iter(text.split("\n"))
        left = got[d].split("\n") if got[d] else []
        assert all(line in kept for line in left)
        assert len(text.split("\n")) - len(left) <= len(gone[d]) or not left
    assert not any(brute.repeated_lines(got).values())


def test_short_or_lone_lines_stay(documents):
    docs = [(d, f"own line number {d}\nshort shared line\nanother own line {d}") for d in range(20)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated(documents(docs)).collect()}
    assert got == dict(docs)


def test_odd_rows(odd, none):
    got = line_dedup.remove_repeated(odd)
    assert got.columns == [*odd.columns, "n_lines"]  # n_removed is a column of the table
    before = sorted(map(tuple, odd.collect()), key=repr)
    assert sorted((tuple(r)[:-1] for r in got.collect()), key=repr) == before
    assert line_dedup.remove_repeated(none).count() == 0


def test_repeated_rows_are_one_document(documents):
    text = "\n".join(f"{i} " + "word " * 14 + "end" for i in range(4))
    got = line_dedup.remove_repeated(documents([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, text), (1, text), (2, "")]
