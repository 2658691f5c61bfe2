"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

SHINGLE = 5
BLOCK_BYTES = 1 << 20  # texts are hashed in blocks of about so many bytes, which end between words

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_PLACE = _random.integers(1, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as far as they have been asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
        return cls.up[:n], cls.down[:n]


def _blocks(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = at + BLOCK_BYTES
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, A-Z lower-cased, in order."""
    parts = [np.zeros(0, np.uint64)]
    for block in _blocks(text.encode("utf-8", "surrogatepass")):
        b = np.frombuffer(block, np.uint8)
        edge = np.diff(np.concatenate([[True], _IS_SPACE[b], [True]]).astype(np.int8))
        first, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        if len(first):
            up, down = _Powers.of(len(b) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)])
            parts.append(mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)))
    return np.concatenate(parts)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of SHINGLE words, sorted; of fewer words their whole sequence; of none nothing."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    n = len(words)
    if not n:
        return words
    width = min(n, SHINGLE)
    sums = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        sums += words[k : n - width + 1 + k] * _PLACE[k]
    return np.unique(mix(sums))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) else 0
