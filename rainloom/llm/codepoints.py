"""Texts as arrays of code points, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points that are worked on at once.
BLOCK = 1 << 18


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def blocks(texts: list[str], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, starts, owners) of runs of texts, each followed by a zero; a text over BLOCK comes in pieces that
    overlap, so that every window of overlap + 1 code points is in exactly one piece."""
    parts: list[np.ndarray] = []
    owners: list[int] = []
    size = 0
    zero = np.zeros(1, np.uint32)

    def packed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        return np.concatenate([x for p in parts for x in (p, zero)]), starts, np.array(owners)

    for k, text in enumerate(texts):
        codes = code_points(text)
        at = 0
        while at < len(codes):
            piece = codes[at : at + BLOCK]
            if size and size + len(piece) > BLOCK:
                yield packed()
                parts, owners, size = [], [], 0
            parts.append(piece)
            owners.append(k)
            size += len(piece) + 1
            if at + BLOCK >= len(codes):
                break
            at += BLOCK - overlap
    if parts:
        yield packed()
