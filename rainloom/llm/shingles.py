"""Word shingles as 64-bit hashes, for many texts at once in NumPy.

Words are maximal runs of bytes other than space and 0x09-0x0D, after lower-casing A-Z. A shingle is five
consecutive words; a text with fewer words has one shingle of all of them, one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

WORDS = 5
#: Bytes that are hashed in one go; bounds the working memory for texts of any length.
BLOCK = 1 << 18
_SEED = 0x5EED


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    values = rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
    values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 2**64)
    n = 2 * BLOCK + 1
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
        inverses = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, inverse, np.uint64)]))
    steps = rng.integers(1, 2**63, WORDS, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    return values, space, powers, inverses, steps


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of at most 2 * BLOCK bytes."""
    values, space, powers, inverses, _ = _constants()
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~space[raw], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * powers[: len(raw)], dtype=np.uint64)])
        words = (sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64)
    return starts, mixed(words)


def _long_words(data: bytes) -> np.ndarray:
    """Hashes of the words of a text of any length, cut only between words; a word over a block's length is hashed in parts."""
    space = _constants()[1]
    out, at = [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):
            gap = np.flatnonzero(space[np.frombuffer(data, np.uint8, min(BLOCK, len(data) - end), end)])
            end = end + int(gap[0]) if len(gap) else min(end + BLOCK, len(data))
        out.append(_hashed_words(data[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _combined(words: np.ndarray) -> np.ndarray:
    steps = _constants()[4]
    n = len(words) - WORDS + 1
    with np.errstate(over="ignore"):
        total = words[:n] * steps[0]
        for j in range(1, WORDS):
            total = total + words[j : n + j] * steps[j]
    return mixed(total)


def _few(words: np.ndarray) -> np.ndarray:
    steps = _constants()[4]
    with np.errstate(over="ignore"):
        return mixed(np.array([(words * steps[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))], np.uint64))


def _set(words: np.ndarray) -> np.ndarray:
    if len(words) >= WORDS:
        return np.unique(_combined(words))
    return _few(words) if len(words) else np.zeros(0, np.uint64)


def shingle_sets(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, ascending."""
    waiting: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if not waiting:
            return
        offsets = np.cumsum([0, *(len(t) + 1 for t in waiting)])
        starts, words = _hashed_words(b"\n".join(waiting))
        cuts = np.searchsorted(starts, offsets)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield _set(words[a:b])

    for text in texts:
        text = text or b""
        if size + len(text) + 1 > BLOCK:
            yield from flush()
            waiting, size = [], 0
        if len(text) >= BLOCK:
            yield _set(_long_words(text))
        else:
            waiting.append(text)
            size += len(text) + 1
    yield from flush()
