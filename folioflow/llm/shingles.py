"""64-bit hashes of word shingles, vectorised over the bytes of a text.

A word's hash is a polynomial over its bytes modulo 2^64, taken from one running
sum over the text; a shingle's hash mixes those of its words. All constants come
from a fixed seed, so every executor and every run agrees.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20_240_607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_SLOT = _rng.integers(1, 2**63, 64, dtype=_U) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that nearby values spread over all bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]), 1 << 14)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every word in the bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_WHITE[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for every word, in order."""
    raw = np.frombuffer(data, np.uint8)
    start, end = word_bounds(raw)
    if not len(start):
        return np.zeros(0, _U)
    up, down = _power_table(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of ``size`` words; all words as one run if there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, _U(size), _U)
    for i in range(size):
        total += mix(words[i : len(words) - size + 1 + i] * _SLOT[i % 64] + _U(i))
    return mix(total)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased; empty without words."""
    return np.unique(gram_hashes(word_hashes((text or "").encode().translate(LOWER)), size))
