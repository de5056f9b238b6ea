"""Recursive splitting of one text by a list of separators."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

# Separators from coarse to fine, by kind of file.
TEXT_SEPARATORS = ("\n\n", "\n", ". ", " ", "")
TABLE_SEPARATORS = ("\n" + "=" * 70, "\n" + "-" * 70, "\n\n", "\n")
JSON_SEPARATORS = ("\n\n", "\n", ",", " ")
MARKDOWN_SEPARATORS = ("\n## ", "\n### ", "\n\n", "\n", ". ", " ")
TABLE_OVERLAP = 100
MIN_SIZE = 50


def limits(size: int, overlap: int) -> tuple[int, int]:
    size = max(size, MIN_SIZE)
    return size, (size // 4 if overlap >= size else overlap)


def separators_for(kind: str | None) -> Sequence[str]:
    return {
        "csv": TABLE_SEPARATORS,
        "xlsx": TABLE_SEPARATORS,
        "xls": TABLE_SEPARATORS,
        "json": JSON_SEPARATORS,
        "md": MARKDOWN_SEPARATORS,
    }.get((kind or "").lower(), TEXT_SEPARATORS)


def cut(text: str, separator: str) -> list[str]:
    """Pieces of the text; each but the first starts with the separator, and nothing is lost."""
    if not separator:
        return list(text)
    head, *tail = text.split(separator)
    return [piece for piece in (head, *(separator + piece for piece in tail)) if piece]


def gather(pieces: Iterable[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbours up to the size; the next chunk starts with up to ``overlap`` characters of the last."""
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        if window and held + len(piece) > size:
            yield "".join(window).strip()
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    if window:
        yield "".join(window).strip()


def split_text(text: str, size: int, overlap: int, separators: Sequence[str] = TEXT_SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters where a separator allows it."""
    if not text or not text.strip():
        return []
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    finer = separators[level + 1 :] if separators[level] else ()
    out: list[str] = []
    small: list[str] = []
    for piece in cut(text, separators[level]):
        if len(piece) < size:
            small.append(piece)
            continue
        out.extend(gather(small, size, overlap))
        small = []
        out.extend(split_text(piece, size, overlap, finer) if finer else [piece])
    out.extend(gather(small, size, overlap))
    return [chunk for chunk in out if chunk]
