"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import xxhash

MIN_WORDS = 40


def words_in(line):
    return 0 if not line.strip(" ") else line.strip(" ").count(" ") + 1


def least_stretches(lines):
    """``(first, last)`` of the least stretches of MIN_WORDS words from each line that is not blank, on and back, by line number."""
    full = [i for i, x in enumerate(lines) if words_in(x)]
    words = [words_in(lines[i]) for i in full]
    out = set()
    for start in range(len(full)):
        for step in (1, -1):
            at, total = start, words[start]
            while total < MIN_WORDS and 0 <= at + step < len(full):
                at += step
                total += words[at]
            if total >= MIN_WORDS:
                out.add((full[min(start, at)], full[max(start, at)]))
    return out


def text_of(lines, first, last):
    return tuple(x for x in lines[first : last + 1] if words_in(x))


def repeated_lines(docs):
    """Line numbers by id that stand in a stretch of MIN_WORDS words whose first copy is elsewhere and does not overlap it."""
    lines = {d: t.split("\n") for d, t in docs.items() if t is not None}
    places = defaultdict(list)
    for d, ls in lines.items():
        for first, last in least_stretches(ls):
            places[text_of(ls, first, last)].append((d, first, last))
    gone = defaultdict(set)
    for copies in places.values():
        origin, *others = sorted(copies)
        for d, first, last in others:
            if d != origin[0] or first > origin[2]:
                gone[d] |= set(range(first, last + 1))
    return gone


def dedup_lines(docs):
    """Texts by id after the removal of passages that stand elsewhere already; ``docs``: id to text, None allowed."""
    gone = repeated_lines(docs)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs.items()}


def simhash(text, width=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance=3):
    """Smallest id reachable for each id; ``prints``: id to fingerprint."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def mixed(docs, limit=2.0, seed=7, halvings=30):
    """(id, epoch) pairs taken; ``docs``: (id, source, tokens)."""
    total = defaultdict(int)
    for _, s, n in docs:
        total[s] += n
    total = {s: n for s, n in total.items() if n}
    if not total:
        return sorted((d, 0) for d, _, _ in docs)
    largest, least = max(total.values()), min(total.values()) / max(total.values())
    low, high = 0.0, 1.0
    for _ in range(halvings):
        middle = (low + high) / 2
        low, high = (middle, high) if least ** (middle - 1) > limit else (low, middle)
    a = high if least**-1 > limit else 0.0
    out = []
    for s, n in total.items():
        budget = max(n, int(n * (n / largest) ** (a - 1) + 1e-6))
        full, rest = divmod(budget, n)
        own = [(d, t) for d, q, t in docs if q == s and t]
        out += [(d, e) for d, _ in own for e in range(full)]
        key = lambda d: hashlib.md5(f"{seed}|{full}|{d}".encode()).hexdigest()  # noqa: B023, E731
        running = 0
        for d, t in sorted(own, key=lambda x: key(x[0])):
            running += t
            if running <= rest:
                out.append((d, full))
    return sorted(out + [(d, 0) for d, _, n in docs if not n])
