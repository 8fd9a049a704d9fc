"""Long texts in pieces that a tokenizer encodes apart with the same ids."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Characters in a piece, where the text has places to cut; bounds what a library holds at once.
PIECE = 50_000
#: A place to cut: before one space between printable characters of ASCII. No tokenizer here joins text across its begin.
_PLACE = re.compile(r"(?<=[!-~]) (?=[!-~])")


def pieces(text: str, size: int = PIECE) -> list[str]:
    """text in pieces of about size characters; all but the first begin with a space. Without a place to cut a piece is longer."""
    out, at = [], 0
    while len(text) - at > size:
        place = _PLACE.search(text, at + size)
        if place is None:
            break
        out.append(text[at : place.start()])
        at = place.start()
    out.append(text[at:])
    return out


def ids_of(texts: list[str], encode: Callable[[list[str]], list[list[int]]], size: int = PIECE, batch: int = 250_000) -> list[np.ndarray]:
    """32-bit ids of each text, encoded in pieces; about ``batch`` characters are encoded at once."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    waiting: list[tuple[int, str]] = []
    chars = 0

    def flush() -> None:
        for (k, _), ids in zip(waiting, encode([p for _, p in waiting]), strict=True):
            found[k].append(np.array(ids, np.int32))

    for k, text in enumerate(texts):
        for piece in pieces(text, size):
            waiting.append((k, piece))
            chars += len(piece)
            if chars > batch:
                flush()
                waiting, chars = [], 0
    flush()
    return [f[0] if len(f) == 1 else np.concatenate(f) for f in found]
