"""Words of a batch of texts as numpy arrays: 64-bit hashes, places, and hashes of word sequences."""

from __future__ import annotations

import numpy as np

from cohortspark.llm.common import RELEASE
from cohortspark.llm.shingles import mix

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_TABLES: dict[int, list[np.ndarray]] = {}
RELEASE["words"] = _TABLES.clear


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64, at least n of each."""
    if base not in _TABLES or len(_TABLES[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1 << 18), b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _TABLES[base] = out
    return _TABLES[base][0], _TABLES[base][1]


class Sums:
    """Prefix sums of values times powers: the hash of any stretch in constant time."""

    def __init__(self, values: np.ndarray, base: int):
        power, self.inverse = _powers(base, len(values) + 1)
        self.total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * power[:len(values)], dtype=np.uint64, out=self.total[1:])

    def hashes(self, lo: np.ndarray, hi: np.ndarray, seed: int) -> np.ndarray:
        """A hash of values[lo:hi] for each pair of bounds; equal stretches have equal hashes wherever they stand."""
        return mix((self.total[hi] - self.total[lo]) * self.inverse[lo], seed)

    def all_of(self, size: int, seed: int) -> np.ndarray:
        """Hashes of all stretches of ``size`` values, by their start."""
        n = len(self.total) - 1 - size + 1
        return self.hashes(np.arange(n), np.arange(size, n + size), seed) if n > 0 else np.zeros(0, dtype=np.uint64)


class Words:
    """The words (runs of bytes other than ASCII white space, unchanged) of some texts, text after text."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.parts = parts
        data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data])).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        self.hashes = Sums(data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15).hashes(starts, ends, 3)
        at = np.cumsum([0] + [len(p) + 1 for p in parts])
        #: words of texts[i] are hashes[offsets[i]:offsets[i + 1]]
        self.offsets = np.searchsorted(starts, at)

    def sequence(self) -> Sums:
        return Sums(self.hashes, 0xD6E8FEB86659FD93)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(x[i:i + width]); doubling, so some log2(width) passes."""
    out, size = x, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out
