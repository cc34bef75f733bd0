"""Recursive text splitting, one small helper per row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Parts of the text; each part after the first starts with the separator."""
    if not separator:
        return list(text)
    head, *tail = text.split(separator)
    return [p for p in (head, *(separator + t for t in tail)) if p]


def _merge(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Pack parts into chunks of at most ``size``; up to ``overlap`` is repeated."""
    window: list[str] = []
    length = 0
    for part in parts:
        if window and length + len(part) > size:
            yield "".join(window)
            drop = 0
            while length > overlap or (length + len(part) > size and length > 0):
                length -= len(window[drop])
                drop += 1
            del window[:drop]
        window.append(part)
        length += len(part)
    if window:
        yield "".join(window)


def split(
    text: str, size: int = 1000, overlap: int = 200, separators: Sequence[str] = SEPARATORS
) -> list[str]:
    """Chunks cut at the coarsest separator that keeps them within ``size``."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    finer = separators[at + 1 :]
    out: list[str] = []
    small: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        out.extend(_merge(small, size, overlap))
        small = []
        out.extend(split(piece, size, overlap, finer) if finer else [piece])
    out.extend(_merge(small, size, overlap))
    return [c for c in (chunk.strip() for chunk in out) if c]
