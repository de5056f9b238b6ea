"""Personal data: patterns, and terms that would give a redacted entity away by what the corpus says about them.

A term t near mentions of an entity e leaves -log2 P(e | t) bits of e unknown: the information content of e less the
pointwise mutual information of the two, both counted over the corpus.  P(e | t) is not taken at its face value but at
the lower end of its confidence interval, so a term that was met once says less than one that was met ten times and
always with e.  Where an entity is redacted, terms that leave too few bits are redacted as well, or generalised to
their class.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from granary.llm.batches import map_rows
from granary.session import settle

# fixed values: the kinds in their order and what may stand in them
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits does: what fails from there fails from inside the run too
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
# a term is a run of letters and digits, so that keys and numbers of no base kind are terms too
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


@dataclass(frozen=True)
class Disclosure:
    """What is protected and when a term discloses it."""

    #: Words on either side of a mention among which terms are sought; what is found is counted and marked in whole documents.
    window: int = 20
    #: Standard errors by which P(e | t) is lowered.  At 1 a term of a single text that mentions e leaves 1 bit, and one of
    #: three such texts 0.42; from 1.1 a single text discloses nothing.  Copies of a text are no further evidence.
    caution: float = 1.0
    #: A term that leaves at most so many bits of an entity unknown is generalised, and removed from ``remove_bits`` down.
    generalise_bits: float = 1.0
    remove_bits: float = 0.5
    #: Characters a term has at least.
    min_chars: int = 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of the address pattern: from each at sign back to the end of the last match or the first other character."""
    last = 0
    for domain in DOMAIN.finditer(text):
        start = domain.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < domain.start():
            yield start, domain.end()
            last = domain.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by start, then kind in the fixed order; positions are code points."""
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = (p.lstrip("0") for p in m[0].split("."))
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def entity(kind: str, mention: str) -> str:
    """One name for an entity however it is written: lower case for addresses, digits only for numbers."""
    return f"{kind}:" + (mention.lower() if kind in ("email", "ip") else "".join(filter(str.isdigit, mention)))


def free_words(text: str, spans: list[tuple[str, int, int]], rules: Disclosure) -> list[re.Match]:
    """The words of a text with mentions, those inside mentions left out."""
    if not spans:
        return []
    merged = sorted((s, e) for _, s, e in spans)
    free, at, reach = [], 0, 0
    for word in WORD.finditer(text):
        if word.end() - word.start() < rules.min_chars:
            continue
        while at < len(merged) and merged[at][0] < word.end():
            reach = max(reach, merged[at][1])
            at += 1
        if word.start() >= reach:
            free.append(word)
    return free


def terms_near(text: str, spans: list[tuple[str, int, int]], free: list[re.Match], rules: Disclosure) -> set[tuple[str, str]]:
    """``(entity, term)`` for the words around each mention."""
    starts, ends = [w.start() for w in free], [w.end() for w in free]
    near = set()
    for kind, s, e in spans:
        name = entity(kind, text[s:e])
        left, right = bisect_right(ends, s), bisect_left(starts, e)
        for word in free[max(0, left - rules.window) : left] + free[right : right + rules.window]:
            near.add((name, word[0].lower()))
    return near


def key(*parts: str) -> int:
    """64-bit name of an entity or a term, so that pairs are counted over numbers."""
    digest = hashlib.blake2b("\0".join(parts).encode("utf-8"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


SCAN = (
    "doc_id long, row long, copy long, kinds array<int>, starts array<long>, ends array<long>, "
    "mentioned array<long>, entities array<long>, terms array<long>, "
    "words array<long>, word_starts array<long>, word_ends array<long>, text string, text_sha256 string"
)


def scan(docs: DataFrame, rules: Disclosure) -> DataFrame:
    """Base spans of every text and the terms near them, one row per document.

    Texts with spans come with all their words and the text itself, others with the hash of their text (null: none).
    """

    def make():
        from pyspark import TaskContext

        state = {"row": TaskContext.get().partitionId() << 33}

        def run(columns):
            out = {name.split(" ")[0]: [] for name in SCAN.split(", ")}
            for doc, given in zip(columns["doc_id"], columns["text"]):
                text = given or ""
                spans = base_spans(text)
                out["text"].append(text if spans else None)
                out["text_sha256"].append(None if spans or given is None else sha256(text))
                free = free_words(text, spans, rules)
                near = terms_near(text, spans, free, rules)
                out["doc_id"].append(doc)
                out["row"].append(state["row"])
                out["copy"].append(key(text) if spans else 0)
                out["kinds"].append([KINDS.index(k) for k, _, _ in spans])
                out["starts"].append([s for _, s, _ in spans])
                out["ends"].append([e for _, _, e in spans])
                out["mentioned"].append([key(n) for n in {entity(k, text[s:e]) for k, s, e in spans}])
                out["entities"].append([key(n) for n, _ in near])
                out["terms"].append([key(t) for _, t in near])
                names = {w: key(w) for w in {m[0].lower() for m in free}}
                out["words"].append([names[m[0].lower()] for m in free])
                out["word_starts"].append([m.start() for m in free])
                out["word_ends"].append([m.end() for m in free])
                state["row"] += 1
            return out

        return run

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(narrow, make, SCAN)


def term_counts(docs: DataFrame, rules: Disclosure) -> DataFrame:
    """``(term, texts)``: in how many documents each term of the corpus stands; counted per task before the shuffle."""
    schema = "term long, texts long"

    def make():
        def run(columns):
            counts = Counter()
            for text in columns["text"]:
                if text:
                    counts.update({w.lower() for w in set(WORD.findall(text)) if len(w) >= rules.min_chars})
            return {"term": [key(t) for t in counts], "texts": list(counts.values())}

        return run

    return map_rows(docs.select(F.col("text").cast("string").alias("text")), make, schema).groupBy("term").agg(F.sum("texts").alias("texts"))


def mentions(scanned: DataFrame) -> DataFrame:
    """``(row, entity)``: what each document mentions."""
    return scanned.where("size(mentioned) > 0").select("row", F.explode("mentioned").alias("entity"))


def bits_left(together: Column, texts: Column, different: Column, caution: float) -> Column:
    """-log2 of the lower end of Wilson's interval for P(e | t): ``together`` of the ``texts`` that hold t mention e.

    The interval is as wide as ``different`` texts that hold both allow, so copies raise the share but not the trust in it.
    """
    share = together / texts
    size, square = different / share, caution * caution
    middle = share + square / (2 * size)
    width = caution * F.sqrt(share * (1 - share) / size + square / (4 * size * size))
    return F.round(-F.log2((middle - width) / (1 + square / size)), 9)


def disclosing(scanned: DataFrame, docs: DataFrame, rules: Disclosure) -> DataFrame:
    """``(entity, term, bits)``: pairs that leave few bits of the entity unknown.

    Pairs meet within the window; bits compare documents that hold both anywhere with documents that hold the term.
    """
    pairs = scanned.where("size(entities) > 0").select(F.explode(F.array_distinct(F.arrays_zip("entities", "terms"))).alias("p"))
    met = settle(pairs.select(F.col("p.entities").alias("entity"), F.col("p.terms").alias("term")).distinct())
    wanted = met.select("term").distinct()
    counts = term_counts(docs, rules).join(wanted, "term", "left_semi")
    # no more documents can hold both than mention the entity, so common words go before pairs are looked up
    most = mentions(scanned).groupBy("entity").agg(F.count("*").alias("most"))
    able = F.log2(F.col("texts") / F.col("most")) <= rules.generalise_bits
    likely = settle(met.join(counts, "term").join(most, "entity").where(able).select("entity", "term", "texts"))
    words = scanned.where("size(words) > 0").select("row", "copy", F.explode(F.array_distinct("words")).alias("term"))
    together = (
        words.join(likely, "term").join(mentions(scanned), ["row", "entity"])
        .groupBy("entity", "term", "texts")
        .agg(F.count("*").alias("together"), F.count_distinct("copy").alias("different"))
    )
    bits = bits_left(F.col("together"), F.col("texts"), F.col("different"), rules.caution)
    return together.select("entity", "term", bits.alias("bits")).where(F.col("bits") <= rules.generalise_bits)


def find(docs: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:
    """``(doc_id, row, spans, text, text_sha256)``: all spans of every document, as structs ``kind, start, end, bits``.

    Kinds are the base kinds and ``term``; bits is set for terms.  Spans are in order of start, then kind.  A term is
    marked wherever it stands in a document that mentions an entity it discloses, so documents without personal data
    have no spans.  Documents with spans come with their text, others with its hash.  Null and empty texts have no spans,
    and null texts no hash; very long texts are read whole; repeated rows and null ids keep a row each; other columns are
    ignored; an empty table gives an empty table.
    """
    scanned = settle(scan(docs, rules))
    known = settle(disclosing(scanned, docs, rules))
    shown = settle(mentions(scanned).join(known, "entity").groupBy("row", "term").agg(F.min("bits").alias("bits")))
    words = scanned.where("size(words) > 0").select(
        "row", F.explode(F.arrays_zip("words", "word_starts", "word_ends")).alias("t")
    )
    marked = (
        words.select("row", F.col("t.words").alias("term"), F.col("t.word_starts").alias("start"), F.col("t.word_ends").alias("end"))
        .join(shown, ["row", "term"])
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end", "bits")).alias("more"))
    )
    base = F.transform(
        F.arrays_zip("starts", "kinds", "ends"),
        lambda s: F.struct(s["starts"].alias("start"), s["kinds"].alias("kind"), s["ends"].alias("end"), F.lit(None).cast("double").alias("bits")),
    )
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    every = F.array_sort(F.concat(base, F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,bits:double>>"))))
    return scanned.join(marked, "row", "left").select(
        "doc_id",
        "row",
        F.transform(
            every,
            lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["bits"].alias("bits")),
        ).alias("spans"),
        "text",
        "text_sha256",
    )


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replacement(kind: str, mention: str, bits: float | None, rules: Disclosure) -> str:
    """Nothing for a term that leaves hardly a bit unknown, else the name of its class."""
    if kind != "term":
        return f"[{kind.upper()}]"
    if bits <= rules.remove_bits:
        return ""
    return "[NAME]" if mention[:1].isupper() else "[WORD]"


def cleaned(text: str, spans: list[dict], rules: Disclosure) -> str:
    """The text with spans replaced; of spans that overlap the one that starts first and reaches farthest counts."""
    parts, at = [], 0
    for start, end, kind, bits in sorted((s["start"], -s["end"], s["kind"], s["bits"]) for s in spans or []):
        end = -end
        if start >= at:
            parts += [text[at:start], replacement(kind, text[start:end], bits, rules)]
            at = end
        elif end > at:
            at = end
    return "".join(parts) + text[at:]


def sanitised(texts: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:
    """``(doc_id, text)`` with spans replaced; ``texts`` has ``doc_id, text, spans``.

    Where spans overlap, the one that starts first and reaches farthest is replaced and the others with it.  Null
    texts stay null.
    """

    def make():
        def run(columns):
            out = [None if t is None else cleaned(t, s, rules) for t, s in zip(columns["text"], columns["spans"])]
            return {"doc_id": columns["doc_id"], "text": out}

        return run

    return map_rows(texts.select("doc_id", "text", "spans"), make, "doc_id long, text string")


def sanitise(found: DataFrame, rules: Disclosure = Disclosure(), keep: str = "") -> DataFrame:
    """``(doc_id, row, text, text_sha256)`` of what :func:`find` gave: texts it changed, and the hash of every text as it is now.

    Texts without spans stay as they were and come as their hash alone; null texts have neither.  ``keep`` names columns
    that pass through, with their types.
    """
    schema = "doc_id long, row long, text string, text_sha256 string" + (f", {keep}" if keep else "")
    passed = [part.split()[0] for part in keep.split(",")] if keep else []

    def make():
        def run(columns):
            out = {name: columns[name] for name in ("doc_id", "row", *passed)} | {"text": [], "text_sha256": []}
            for text, spans, known in zip(columns["text"], columns["spans"], columns["text_sha256"]):
                now = None if text is None else cleaned(text, spans, rules)
                out["text"].append(now)
                out["text_sha256"].append(known if now is None else sha256(now))
            return out

        return run

    return map_rows(found.select("doc_id", "row", "text", "spans", "text_sha256", *passed), make, schema)
