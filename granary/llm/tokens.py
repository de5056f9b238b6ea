"""Token ids of a byte-level BPE vocabulary, worked out by the faster of two libraries that agree."""

from __future__ import annotations

import json
import re
from array import array
from functools import cached_property, lru_cache

import tiktoken
from tokenizers import Tokenizer

# fixed values: the printable stand-ins of bytes in byte-level vocabularies, and the pattern such files split by
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_RUN = 50_000
BLANKS = re.compile(r"\s{%d}" % LONG_RUN)


def stand_ins() -> dict[str, int]:
    """Byte of each stand-in: printable bytes stand for themselves, the others follow from U+0100 on."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    A vocabulary whose ids follow its merges in order can also be run by tiktoken, which is several times faster;
    other vocabularies, and texts with runs of white space longer than tiktoken's pattern matcher bears, go to
    tokenizers.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = ordered_ranks(spec)
        self.fast = ranks and tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)

    @cached_property
    def slow(self) -> Tokenizer:
        """The general library's tokenizer, built when a text first needs it."""
        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        if self.fast and not (len(text) >= LONG_RUN and BLANKS.search(text)):
            if any(mark in text for mark in self.special):
                return self.fast.encode(text, allowed_special="all")
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def token_bytes(self, token: int) -> bytes:
        """The bytes a token stands for; a vocabulary without ordered ranks is an error."""
        if not self.fast:
            raise ValueError(f"{self.path}: ids do not follow the merges, so tokens have no plain bytes")
        return self.fast.decode_single_token_bytes(token)


def ordered_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks by token bytes if the file is plain byte-level BPE and a token's id is its rank, else None."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    odd = spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges")
    odd = odd or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
    marks = [t for t in spec.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
    if model.get("type") != "BPE" or not plain or odd or marks:
        return None
    to_byte, special = stand_ins(), {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(to_byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    last = 255
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        rank = model["vocab"].get(left + right, -1)
        if rank <= last:
            return None
        last = rank
    return ranks if len(ranks) == 256 + len(model["merges"]) else None


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)


def packed(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit little-endian numbers."""
    out = array("I", ids)
    if out.itemsize != 4:
        out = array("L", ids)
    return out.tobytes()
