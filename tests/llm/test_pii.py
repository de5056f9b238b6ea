"""Personal data: patterns against the plain regular expressions, disclosure against counts by hand."""

import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from granary.llm import pii


def plain_spans(text):
    """The base kinds by the patterns as they are stated."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
        if 12 <= len(digits) <= 19 and (sum(digits[::-2]) + sum(doubled)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(pii.KINDS[k], s, e) for s, k, e in sorted(out)]


def test_patterns_on_random_text():
    random.seed(1)
    bits = ["@", ".", "a", "b-c", "1", "255", "256", "007", "+", "(", ")", " ", "-", "x@y.z", "4111 1111 1111 1111", "é", "\n", "+1 (255) 555-8013", "1.2.3.4", "@a.b", "١"]
    for _ in range(4000):
        text = "".join(random.choices(bits, k=random.randint(1, 25)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a." * 150_000 + "@", "+1" + " " * 300_000, "1 " * 150_000):
        pii.base_spans(text)


def letters(number):
    return "abcdefgh"[number // 8 % 8] + "stuvwxyz"[number % 8]


def told(doc, name):
    words = " ".join(f"plain{letters((doc * 7 + i) % 40)}" for i in range(30))
    return f"{words} the zorblat of {name} met us today"


def lowered(together, texts, different, caution):
    """Bits left by the lower root of Wilson's equation, size * (share - p)^2 = caution^2 * p * (1 - p), found by halving."""
    share = together / texts
    size, low, high = different / share, 0.0, share
    for _ in range(200):
        p = (low + high) / 2
        if size * (share - p) ** 2 > caution**2 * p * (1 - p):
            low = p
        else:
            high = p
    return round(-math.log2(high), 9)


def test_disclosing_terms(documents):
    mail = "ann@corp.example.com"
    docs = [(d, told(d, mail)) for d in range(5)] + [(10 + d, told(d, "nobody")) for d in range(2)]
    docs = [(d, t.replace("zorblat", "other") if d >= 10 else t) for d, t in docs]
    docs += [(20 + d, "the of met us today " * 3 + f"x{d}") for d in range(30)]
    rules = pii.Disclosure(window=4, caution=1.5)
    rows = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["bits"]) for s in r["spans"]] for r in pii.find(documents(docs), rules).collect()}
    texts = dict(docs)
    for d in range(5):
        marked = {texts[d][s:e]: b for k, s, e, b in rows[d] if k == "term"}
        assert marked == {"zorblat": lowered(5, 5, 5, 1.5)}, marked
        assert [k for k, *_ in rows[d] if k != "term"] == ["email"]
    assert all(not rows[d] for d in rows if d >= 10)
    # copies of one text are no evidence
    same = [(d, told(0, mail)) for d in range(5)]
    assert not any(s["kind"] == "term" for r in pii.find(documents(same), rules).collect() for s in r["spans"])


def test_terms_far_from_the_mention_are_counted_and_marked(documents):
    mail = "ann@corp.example.com"
    filler = "the met us today " * 10
    docs = {d: f"own{letters(d)} the zorblat of {mail} {filler}then Zorblat again" for d in range(3)}
    docs |= {3 + d: f"zorblat {filler} other{letters(d)} {mail}" for d in range(2)}
    docs |= {20 + d: f"{filler}x{letters(d)} then again" for d in range(30)}
    rules = pii.Disclosure(window=4, caution=1.5)
    rows = {r["doc_id"]: r["spans"] for r in pii.find(documents(list(docs.items())), rules).collect()}
    for d in range(5):
        marked = [(docs[d][s["start"] : s["end"]], s["bits"]) for s in rows[d] if s["kind"] == "term"]
        bits = lowered(5, 5, 5, 1.5)  # far from the mention in two of five texts, counted in all
        assert marked == ([("zorblat", bits), ("Zorblat", bits)] if d < 3 else [("zorblat", bits)]), marked
    assert not any(rows[d] for d in docs if d >= 20)


def brute_disclosure(docs, rules):
    """Spans of terms by counting pairs in dictionaries."""
    free, met, holds, mentions = {}, set(), defaultdict(list), defaultdict(set)
    for d, text in docs.items():
        for word in {w.lower() for w in pii.WORD.findall(text) if len(w) >= rules.min_chars}:
            holds[word].append(d)
        spans = plain_spans(text)
        mentions[d] = {pii.entity(k, text[s:e]) for k, s, e in spans}
        blocked = [(s, e) for _, s, e in spans]
        free[d] = [m for m in pii.WORD.finditer(text) if len(m[0]) >= rules.min_chars and not any(s < m.end() and m.start() < e for s, e in blocked)]
        for kind, s, e in spans:
            before = [m for m in free[d] if m.end() <= s][-rules.window :]
            after = [m for m in free[d] if m.start() >= e][: rules.window]
            met |= {(pii.entity(kind, text[s:e]), m[0].lower()) for m in before + after}
    shown = set()
    for name, word in met:
        both = [d for d in holds[word] if name in mentions[d] and any(m[0].lower() == word for m in free[d])]
        if lowered(len(both), len(holds[word]), len({docs[d] for d in both}), rules.caution) <= rules.generalise_bits:
            shown.add((name, word))
    return {d: sorted((m.start(), m.end()) for m in free[d] if any((n, m[0].lower()) in shown for n in mentions[d])) for d in docs}


def test_matches_brute_force(documents):
    random.seed(4)
    mails = [f"p{i}@mail.example.org" for i in range(6)] + ["+1 (255) 555-8013", "10.0.0.1"]
    docs = {}
    for d in range(120):
        words = random.choices([f"common{letters(i)}" for i in range(60)], k=25)
        for m in random.sample(mails, random.randint(0, 2)):
            words[random.randrange(25)] = f"Rare{letters(mails.index(m))} said {m}"
        docs[d] = " ".join(words)
    rules = pii.Disclosure(window=3)
    found = pii.find(documents(list(docs.items())), rules)
    got = {r["doc_id"]: sorted((s["start"], s["end"]) for s in r["spans"] if s["kind"] == "term") for r in found.collect()}
    want = brute_disclosure(docs, rules)
    assert got == want and any(want.values())
    marked = documents(list(docs.items())).select("doc_id", "text").join(found.select("doc_id", "spans"), "doc_id")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(marked).collect()}
    assert not any("@" in t or "555" in t for t in clean.values()) and all(docs[d] == t for d, t in clean.items() if not plain_spans(docs[d]))


def test_one_text_says_less_than_many(documents):
    """With the production rules a term of one text is generalised, one of three is removed, one met elsewhere stays."""
    mail = "ann@corp.example.com"
    docs = {d: f"the own{letters(d)} zorblat met {mail} today" for d in range(3)}
    docs |= {20 + d: f"the met today x{letters(d)}" for d in range(30)}
    docs |= {60 + d: docs[0] for d in range(4)}  # copies are one text
    found = pii.find(documents(list(docs.items())))
    clean = {r["doc_id"]: r for r in pii.sanitise(found).collect()}
    assert len(clean) == len(docs)
    for d in (*range(3), *range(60, 64)):
        assert clean[d]["text"] == "the [WORD]  met [EMAIL] today", clean[d]
        assert clean[d]["text_sha256"] == hashlib.sha256(clean[d]["text"].encode()).hexdigest()
    assert all(clean[d]["text"] is None and clean[d]["text_sha256"] == hashlib.sha256(docs[d].encode()).hexdigest() for d in range(20, 50))
    strict = pii.find(documents(list(docs.items())), pii.Disclosure(caution=1.5))
    assert {docs[r["doc_id"]][s["start"] : s["end"]] for r in strict.collect() for s in r["spans"] if s["kind"] == "term"} == {"zorblat"}


def test_terms_of_the_given_documents_match_counts(spark):
    """The registered rules mark terms on the small given table, and the same ones as counts in dictionaries."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "term"] for r in pii.find(table).collect()}
    want = brute_disclosure(docs, pii.Disclosure())
    assert got == want and any(want.values())


def test_odd_rows_and_digest(odd, none):
    rows = pii.find(odd).select("doc_id", pii.digest(F.col("spans")).alias("spans"), F.sha2(pii.digest(F.col("spans")), 256).alias("sha"), pii.count_of("card").alias("n")).collect()
    assert len(rows) == odd.count()
    assert {r["spans"] for r in rows if r["doc_id"] in (1, 2, 3)} == {""}
    assert next(r["sha"] for r in rows if r["doc_id"] == 2) == hashlib.sha256(b"").hexdigest()
    assert pii.find(none).count() == 0


def test_sanitised_overlaps(spark):
    spans = [("phone", 0, 5, None), ("term", 3, 8, 0.0), ("term", 9, 12, 0.8)]
    frame = spark.createDataFrame(
        [(1, "abcdefgh Ijk", spans), (2, None, []), (3, "kept", None)],
        "doc_id long, text string, spans array<struct<kind:string,start:bigint,end:bigint,bits:double>>",
    )
    assert [r["text"] for r in pii.sanitised(frame).orderBy("doc_id").collect()] == ["[PHONE] [NAME]", None, "kept"]
