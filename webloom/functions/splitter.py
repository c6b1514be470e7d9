"""Recursive character splitting of one text (a per-row helper).

Algorithm (public, recursive-character family): pick the first separator that
occurs in the text (the empty separator always does), cut the text before each
occurrence so the separator starts the next piece, and walk the pieces: short
pieces are gathered and merged into windows of at most ``chunk_size``
characters that overlap by up to ``chunk_overlap``; a piece that is too long
is split again with the remaining separators.  Output pieces are stripped and
empty ones dropped.
"""
from __future__ import annotations

import re
from collections import deque

from .. import constants as C


def _cut(text: str, sep: str) -> list[str]:
    if sep == "":
        return list(text)
    parts = re.split(f"({re.escape(sep)})", text)
    out = [parts[0]] + [parts[i] + parts[i + 1] for i in range(1, len(parts) - 1, 2)]
    if len(parts) % 2 == 0:
        out.append(parts[-1])
    return [p for p in out if p != ""]


def _merge(pieces: list[str], size: int, overlap: int, out: list[str]) -> None:
    window: deque[str] = deque()
    total = 0
    for piece in pieces:
        n = len(piece)
        if total + n > size and window:
            text = "".join(window).strip()
            if text:
                out.append(text)
            while window and (total > overlap or (total + n > size and total > 0)):
                total -= len(window.popleft())
        window.append(piece)
        total += n
    text = "".join(window).strip()
    if text:
        out.append(text)


def _split(text: str, seps: list[str], size: int, overlap: int, out: list[str]) -> None:
    sep, rest = seps[-1], []
    for i, s in enumerate(seps):
        if s == "":
            sep = s
            break
        if s in text:
            sep, rest = s, seps[i + 1:]
            break
    gathered: list[str] = []
    for piece in _cut(text, sep):
        if len(piece) < size:
            gathered.append(piece)
            continue
        if gathered:
            _merge(gathered, size, overlap, out)
            gathered = []
        if rest:
            _split(piece, rest, size, overlap, out)
        else:
            out.append(piece)
    if gathered:
        _merge(gathered, size, overlap, out)


def split_text(text: str | None, chunk_size: int = C.CHUNK_SIZE,
               chunk_overlap: int = C.CHUNK_OVERLAP,
               separators: list[str] | None = None) -> list[str]:
    if not text:
        return []
    out: list[str] = []
    _split(text, list(separators or C.SPLIT_SEPARATORS), chunk_size, chunk_overlap, out)
    return out
