"""Sets of hashed word shingles, on whole texts."""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: Bytes hashed at once; longer texts go in stretches that end at a word's end.
STRETCH = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i up to n at least."""
    if _POWERS.get("n", -1) < n:
        size = max(n + 1, 1 << 14)
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS.update(n=size - 1, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _POWERS["up"], _POWERS["down"]


def _hashed(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    word = ~((a == 32) | ((a >= 9) & (a <= 13)))
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    first, end = edge[::2], edge[1::2]
    up, down = powers(len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=total[1:])
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A hash for each run of anything but ASCII white space, A-Z as a-z."""
    data = text.encode().lower()
    if len(data) <= STRETCH:
        return _hashed(data)
    parts, at = [], 0
    while at < len(data):
        end = at + STRETCH
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        parts.append(_hashed(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashed shingles, ascending; fewer than WIDTH words are one shingle, none is none."""
    w = word_hashes(text or "")
    if len(w) == 0:
        return w
    if len(w) < WIDTH:
        w = np.concatenate([w, np.zeros(WIDTH - len(w), np.uint64)])
    n = len(w) - WIDTH + 1
    h = w[:n]
    for k in range(1, WIDTH):
        h = mix(h + w[k : n + k] * np.uint64(2 * k + 1))
    return np.unique(h)
