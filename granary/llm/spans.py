"""Token counts of a document's parts: whole texts are encoded once and tokens fall to parts by their offsets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from granary.llm.batches import map_rows
from granary.llm.tokens import Encoder, encoder

#: Who gets a token that crosses a boundary: the part with its first byte, the part with most of its bytes (the earlier
#: on a tie), or every part in proportion to its bytes.
FIRST, MOST, SHARED = "first", "most", "shared"


def token_ends(encode: Encoder, text: str, lengths: np.ndarray) -> np.ndarray:
    """Byte offset at which each token of a text ends: byte-level tokens tile the UTF-8 of the text."""
    ids = np.array(encode.ids(text), dtype=np.int64)
    return np.cumsum(lengths[ids])


def token_lengths(encode: Encoder) -> np.ndarray:
    """Bytes of each token id."""
    size = encode.slow.get_vocab_size(with_added_tokens=True)
    special = {i: len(mark.encode("utf-8")) for mark, i in encode.special.items()}
    return np.array([special.get(i) or len(encode.token_bytes(i)) for i in range(size)], dtype=np.int64)


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each part.

    ``ends``: byte ends of the tokens; ``bounds``: byte bounds of the parts, which tile the text (first 0, last its
    length).  Both are in order, so the two sets of intervals meet by binary search.  Parts without bytes get nothing.
    """
    parts = len(bounds) - 1
    if not len(ends):
        return np.zeros(parts), np.zeros(parts, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends, side="left") - 1
    inside = first == last
    counts = np.bincount(first[inside], minlength=parts).astype(np.float64)
    crossing = np.zeros(parts, dtype=np.int64)
    for token in np.where(~inside)[0]:
        touched = np.arange(first[token], last[token] + 1)
        held = np.minimum(ends[token], bounds[touched + 1]) - np.maximum(starts[token], bounds[touched])
        crossing[touched[held > 0]] += 1
        if rule == FIRST:
            counts[touched[0]] += 1
        elif rule == MOST:
            counts[touched[int(np.argmax(held))]] += 1
        else:
            counts[touched] += held / held.sum()
    return counts, crossing


def line_parts(text: str) -> list[int]:
    """Code point bounds of the lines of a text, each with its line end; an empty text has one empty part."""
    bounds, at = [0], text.find("\n")
    while at >= 0:
        bounds.append(at + 1)
        at = text.find("\n", at + 1)
    if bounds[-1] < len(text) or len(bounds) == 1:
        bounds.append(len(text))
    return bounds


OUT = "doc_id long, part int, start long, end long, n_tokens double, n_crossing long, doc_tokens long"


def attributed(docs: DataFrame, tokenizer: str, parts: str | None = None, rule: str = MOST) -> DataFrame:
    """One row per part of each document: its code point span, the tokens it gets and how many cross its bounds.

    Parts are the lines, or are given by the column ``parts`` as the array of their starts in code points.  The first
    start counts as 0, starts are sorted and cut to the text, and parts may be empty.  Every text is encoded whole,
    so counts add up to ``doc_tokens``, which they would not if parts were encoded one by one.  ``rule`` allocates tokens
    that cross a boundary.  A null or empty text has one empty part; repeated rows and null ids keep rows of their
    own; an empty table gives none; other columns are ignored.
    """

    def make():
        encode = encoder(tokenizer)
        lengths = token_lengths(encode)

        def run(columns):
            out = {name.split(" ")[0]: [] for name in OUT.split(", ")}
            for doc, text, given in zip(columns["doc_id"], columns["text"], columns["parts"]):
                text = text or ""
                bounds = line_parts(text) if given is None else given_parts(given, len(text))
                raw = text.encode("utf-8")
                byte_bounds = np.array(bounds) if len(raw) == len(text) else byte_offsets(raw)[bounds]
                ends = token_ends(encode, text, lengths)
                counts, crossing = attribute(ends, byte_bounds, rule)
                n = len(bounds) - 1
                out["doc_id"] += [doc] * n
                out["part"] += range(n)
                out["start"] += bounds[:-1]
                out["end"] += bounds[1:]
                out["n_tokens"] += counts.tolist()
                out["n_crossing"] += crossing.tolist()
                out["doc_tokens"] += [len(ends)] * n
            return out

        return run

    given = F.col(parts).cast("array<int>") if parts else F.lit(None).cast("array<int>")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), given.alias("parts")
    )
    return map_rows(narrow, make, OUT)


def given_parts(starts: list, size: int) -> list[int]:
    return [0, *sorted(min(max(s, 0), size) for s in starts[1:] if s is not None), size]


def byte_offsets(raw: bytes) -> np.ndarray:
    """Byte offset of every code point, and of the end."""
    data = np.frombuffer(raw, dtype=np.uint8)
    return np.append(np.where((data & 0xC0) != 0x80)[0], len(raw))


def attributed_fields(docs: DataFrame, tokenizer: str, fields: list[str], joint: str = " ", rule: str = MOST) -> DataFrame:
    """Token counts of the fields of a record that is encoded as one text: ``(doc_id, field, n_tokens, n_crossing, doc_tokens)``.

    Fields are joined by ``joint``, which belongs to the field before it, so a token that begins with the joint and goes
    on with the next field crosses.  Null fields are empty and get no token but of their joint.
    """
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    starts, at = [], F.lit(0)
    for text in texts:
        starts.append(at)
        at = at + F.length(text) + len(joint)
    records = docs.select("doc_id", F.concat_ws(joint, *texts).alias("text"), F.array(*starts).alias("starts"))
    names = F.array(*[F.lit(f) for f in fields])
    rows = attributed(records, tokenizer, "starts", rule)
    return rows.select("doc_id", F.get(names, F.col("part")).alias("field"), "n_tokens", "n_crossing", "doc_tokens")
