"""Line-first cleaning: lines that fail a rule go, then documents that lose too much go."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from granary.llm.batches import map_rows

# fixed values: characters counted as symbols, words of navigation and phrases of boilerplate
SYMBOLS = "#*$%&|<>"
NAVIGATION = (
    "home about contact login logout register search menu next previous back top subscribe share follow help sitemap "
    "faq cart checkout"
).split()
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "accept cookies",
    "enable javascript",
    "javascript is disabled",
    "click here",
    "read more",
    "sign up for our newsletter",
    "skip to content",
    "lorem ipsum",
)
ENDS = ".!?…;:,\"'”’»)]。！？"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules, all shares between 0 and 1."""

    #: A line longer than this many words must hold a mark that ends or parts a sentence.
    unpunctuated_words: int = 40
    #: Of a line's characters without white space, how many may be symbols.
    symbol_share: float = 0.1
    #: Words in upper case, for a line of at least ``shout_words`` words with letters.
    shout_share: float = 0.6
    shout_words: int = 5
    #: Exclamation marks per word, for a line of at least ``shout_words`` words.
    exclaim_share: float = 0.5
    #: Cells parted by a bar, counted as a menu line from this many bars on.
    bars: int = 3
    #: Navigation words in a line of at most ``menu_words`` words.
    navigation_share: float = 0.6
    menu_words: int = 12
    #: Words equal to the word before them.
    stutter_share: float = 0.3
    boilerplate: tuple[str, ...] = BOILERPLATE
    navigation: frozenset[str] = field(default_factory=lambda: frozenset(NAVIGATION))
    #: Of the characters in words, how many a kept document may lose with its failing lines.
    lost_share: float = 0.5


RULES = ("symbols", "menu", "navigation", "boilerplate", "shouting", "stutter", "unpunctuated")
ODD = re.compile(f"[{re.escape(SYMBOLS)}]")


def failed_rule(line: str, rules: LineRules) -> str | None:
    """Name of the first rule a line fails; blank lines fail none."""
    words = line.split()
    if not words:
        return None
    chars, n = sum(map(len, words)), len(words)
    odd = len(ODD.findall(line))
    if odd and line.count("|") >= rules.bars:
        return "menu"
    if odd > rules.symbol_share * chars:
        return "symbols"
    if n <= rules.menu_words:
        hits = sum(w.strip(ENDS + SYMBOLS + "-").lower() in rules.navigation for w in words)
        if hits >= 2 and hits >= rules.navigation_share * n:
            return "navigation"
    lower = line.lower()
    if any(phrase in lower for phrase in rules.boilerplate):
        return "boilerplate"
    if n >= rules.shout_words:
        if line.count("!") >= rules.exclaim_share * n:
            return "shouting"
        loud = sum(map(str.isupper, words))
        if loud >= rules.shout_share * rules.shout_words:
            lettered = sum(w.lower() != w.upper() for w in words)
            if lettered >= rules.shout_words and loud >= rules.shout_share * lettered:
                return "shouting"
        if sum(a == b for a, b in zip(words, words[1:])) > rules.stutter_share * n:
            return "stutter"
    if n > rules.unpunctuated_words and not any(w[-1] in ENDS for w in words):
        return "unpunctuated"
    return None


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text.

    Words are runs of anything but ASCII white space.  Repeated words are those in any window of three words that
    stands at two places or more.
    """
    raw = text.encode("utf-8")
    words = raw.split()
    chars = sum(map(len, words)) if len(raw) == len(text) else len(b"".join(words).decode("utf-8"))
    seen, duplicates = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            duplicates += bool(line.split())
        else:
            seen.add(line)
    return len(words), chars, len(ODD.findall(text)), duplicates, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, reach = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + 3 - max(at, reach)
            reach = at + 3
    return covered


OUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, lost_chars long, lines_removed long, rules array<string>, clean_text string"
)


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), min_words: int = 50, repeat_share: float = 0.5) -> DataFrame:
    """One row per document: counts of the whole text, the verdict and the text without failing lines.

    A document fails the base rule with fewer than ``min_words`` words, or if more than ``repeat_share`` of them
    stand in repeated windows.  It is kept if it passes that and its failing lines hold at most ``lost_share`` of its
    word characters.  Null texts are empty: 0 words, so not kept; their clean text is null.  Repeated rows and null ids
    give a row each; an empty table gives none; other columns are ignored.  ``rules`` names the failed rule of each
    removed line, in order.
    """

    def make():
        def run(columns):
            out = {name.split(" ")[0]: [] for name in OUT.split(", ")}
            for doc, text in zip(columns["doc_id"], columns["text"]):
                n, chars, symbols, duplicates, repeats = base_counts(text or "")
                lost, gone, kept_lines = 0, [], []
                for line in (text or "").split("\n"):
                    rule = failed_rule(line, rules)
                    if rule:
                        gone.append(rule)
                        lost += sum(map(len, line.split()))
                    else:
                        kept_lines.append(line)
                failed = n < min_words or repeats > repeat_share * n
                kept = not failed and lost <= rules.lost_share * chars
                clean = None if text is None else "\n".join(kept_lines)
                row = (doc, n, chars, symbols, duplicates, repeats, failed, kept, lost, len(gone), gone, clean)
                for column, value in zip(out.values(), row):
                    column.append(value)
            return out

        return run

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(narrow, make, OUT)
