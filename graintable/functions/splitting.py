"""Recursive character splitting, as a small helper that runs inside tasks, a document at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column

from .slices import sliced

# fixed values: separators, strongest first
DEFAULT_SEPARATORS = ("\n\n", "\n", " ", "")
MARKDOWN_SEPARATORS = ("\n\n", "\n", ".", "。", "，", ",")


def _pieces(text: str, separator: str) -> list[str]:
    """The text cut before each separator, which stays at the head of the piece that follows."""
    if not separator:
        return list(text)
    marks = [m.start() for m in re.finditer(re.escape(separator), text)]
    bounds = [0, *marks, len(text)]
    return [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False) if b > a]


def _merged(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring pieces joined up to ``size``; each chunk begins with as many of the last one's pieces as ``overlap`` holds."""
    window: list[str] = []
    length = 0
    for piece in pieces:
        if window and length + len(piece) > size:
            yield "".join(window)
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.pop(0))
        window.append(piece)
        length += len(piece)
    if window:
        yield "".join(window)


def recursive_split(text: str | None, size: int = 500, overlap: int = 50, separators: Sequence[str] = DEFAULT_SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, stripped, unless a piece can't be cut by any separator.

    The first separator that occurs in the text is used (else the last of the list); pieces that are still too long are cut by the
    weaker ones.
    """
    text = text or ""
    at = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    weaker, out, short = separators[at + 1 :], [], []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            short.append(piece)
            continue
        out += _merged(short, size, overlap)
        short = []
        out += recursive_split(piece, size, overlap, weaker) if weaker else [piece]
    out += _merged(short, size, overlap)
    return [s for s in (c.strip() for c in out) if s]


def split_column(text: Column, size: int = 500, overlap: int = 50, separators: Sequence[str] = DEFAULT_SEPARATORS) -> Column:
    """The chunks of a text column as an array; a document stays in its row, so nothing is shuffled."""
    separators = tuple(separators)

    return sliced(lambda t: recursive_split(t, size, overlap, separators), "array<string>")(text)
