"""Word and shingle hashes of batches of texts, in numpy."""

from __future__ import annotations

import numpy as np

from cohortspark.llm.common import RELEASE

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []
RELEASE["shingles"] = _POWERS.clear
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASK = (1 << 64) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 18)
        out = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, offsets: words of texts[i] are offsets[i]:offsets[i+1]).

    A-Z are lower-cased; words are runs of bytes that ``space`` does not mark.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts).lower() + b" ", dtype=np.uint8)
    gap = space[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(data))
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    words = mix((total[ends - 1] - before) * inverse[starts])
    text_start = np.cumsum([0] + [len(p) + 1 for p in parts])
    return words, np.searchsorted(starts, text_start)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes (uint64) of the k-word shingles of each text; a
    shorter text's whole word sequence is its only shingle."""
    words, offsets = word_hashes(texts)
    weights = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) | 1) for j in range(k)]
    n = len(words) - k + 1
    if n > 0:
        rolled = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            rolled += words[j:n + j] * weights[j]
        rolled = mix(rolled, 1)
    out = []
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        size = hi - lo
        if size >= k:
            s = np.sort(rolled[lo:hi - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif size > 0:
            whole = np.array([size], dtype=np.uint64)
            for j in range(size):
                whole += words[lo + j:lo + j + 1] * weights[j]
            out.append(mix(whole, 2))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def bitmap(hashes: np.ndarray) -> bytes:
    """One bit per hash by its low bits; a power of two of bits, at least as many as hashes."""
    bits = 64
    while bits < len(hashes):
        bits *= 2
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()
