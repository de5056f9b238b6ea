"""Tokens: the fast way against the library, exact packing and attribution by offsets."""

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from granary.llm import packing, spans
from granary.llm.queries import vocabulary
from granary.llm.tokens import encoder

TEXTS = [
    "",
    "plain text, twice  spaced\n\n\nand\tmore",
    "<|endoftext|> in the middle<|endoftext|>",
    "漢字 und Größe 🙂🙂 é    '",
    "it's we'll I'd they're 123 4567 !!! ... \r\n x",
    "a" * 5000,
    " " * 3000 + "x",
]


def library():
    return Tokenizer.from_file(vocabulary())


def test_fast_ids_are_the_library_s():
    own, theirs = encoder(vocabulary()), library()
    assert own.fast
    for text in [*TEXTS, " " * 1_200_000]:  # the last one makes the fast way give up
        assert own.ids(text) == theirs.encode(text, add_special_tokens=False).ids


def check_packing(rows, docs, length, end=0):
    theirs, by_doc, by_sequence = library(), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    total = 0
    for doc, text in docs.items():
        ids = theirs.encode(text or "", add_special_tokens=False).ids + [end]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            own = np.frombuffer(r["ids"], dtype="<u4").tolist()
            assert (r["start"], r["doc_tokens"], own) == (at, len(ids), ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
        total += at
    assert sorted(by_sequence) == list(range(-(-total // length)))
    for number, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        full = number < total // length
        assert at == (length if full else total % length)
        padded = length if full else 1 << (at - 1).bit_length()
        assert {r["padded"] for r in pieces} == {padded}


def test_packing_round_trip(documents):
    docs = {i: t for i, t in enumerate([*TEXTS, None, "one", "word " * 700])}
    for length in (16, 1024):
        frame = documents(list(docs.items())).repartition(3)
        check_packing(packing.pack(frame, vocabulary(), length).collect(), docs, length)


def test_boundary_records(documents):
    cut = packing.pack(documents([(1, "word " * 40), (2, "more " * 40)]).coalesce(1), vocabulary(), 16)
    records = {r["sequence_id"]: r for r in packing.boundaries(cut).collect()}
    assert not records[0]["opens_inside"] and records[0]["ends_inside"] and records[1]["opens_inside"]
    assert all(r["filled"] == 16 == r["padded"] for s, r in records.items() if s < len(records) - 1)


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack(odd, vocabulary()).collect()
    ids = [r["doc_id"] for r in rows if r["start"] == 0]
    assert len(ids) == odd.count() and ids.count(4) == 2 and ids.count(None) == 1
    assert packing.pack(none, vocabulary()).count() == 0
    crc = {r["doc_id"]: zlib.crc32(r["ids"]) for r in rows if r["length"] == r["doc_tokens"]}
    assert crc[1] == crc[2] == zlib.crc32(b"\0\0\0\0")


def plain_attribution(text, bounds, rule):
    """Counts by looking at every byte of every token."""
    own = encoder(vocabulary())
    offsets = [len(text[:b].encode()) for b in bounds]
    part_of = [max(p for p in range(len(bounds) - 1) if offsets[p] <= b) for b in range(len(text.encode()))]
    counts, at = [0.0] * (len(bounds) - 1), 0
    for token in own.ids(text):
        held = part_of[at : at + len(own.token_bytes(token))]
        at += len(held)
        if rule == spans.FIRST:
            counts[held[0]] += 1
        elif rule == spans.MOST:
            counts[max(sorted(set(held)), key=held.count)] += 1
        else:
            for p in held:
                counts[p] += 1 / len(held)
    return counts


def test_attribution_matches_bytes(spark):
    texts = [t for t in TEXTS if "<|" not in t][1:] + ["a b c d e f", "émile était là"]
    rows = [(i, t, sorted({0, *range(3, len(t), 4)})) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, at array<int>")
    for rule in (spans.FIRST, spans.MOST, spans.SHARED):
        got = defaultdict(list)
        for r in spans.attributed(frame, vocabulary(), "at", rule).orderBy("doc_id", "part").collect():
            got[r["doc_id"]].append(r["n_tokens"])
        for i, text, starts in rows:
            want = plain_attribution(text, [*starts, len(text)], rule)
            assert np.allclose(got[i], want), (rule, text[:40])


def test_fields_and_odd_rows(odd, none):
    rows = spans.attributed_fields(odd, vocabulary(), ["lang", "source", "text"]).collect()
    assert len(rows) == 3 * odd.count()
    sums = defaultdict(float)
    for r in rows:
        sums[r["doc_id"]] += r["n_tokens"]
    whole = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert all(abs(sums[d] - whole[d] * (2 if d == 4 else 1)) < 1e-6 for d in whole)
    lines = spans.attributed(odd, vocabulary())
    assert lines.where("doc_id = 5").count() == 6000 and lines.where("doc_id in (1, 2)").count() == 2
    assert spans.attributed(none, vocabulary()).count() == 0
