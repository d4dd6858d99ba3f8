"""Word-shingle sets of texts as sorted 64-bit hashes, computed a batch at a time."""

from __future__ import annotations

import numpy as np

from .common import byte_slices

_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser: a permutation of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLDEN)
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.ones(size, np.uint64)
            k, step = 1, base
            while k < size:
                table[k : 2 * k] = table[:k] * np.uint64(step)
                k, step = 2 * k, step * step % (1 << 64)
            _powers.append(table)
    return _powers[0], _powers[1]


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+``, and of each text the number of its first word (one more at the end)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    if lower:
        buf = _LOWER[buf]
    sep = _SEPARATOR[buf]
    starts = np.flatnonzero(~sep & np.concatenate(([True], sep[:-1])))
    ends = np.flatnonzero(sep & np.concatenate(([False], ~sep[:-1])))
    power, inverse = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    return h, np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-word shingles.

    A text of fewer words gives one hash of the whole sequence; a null text or one without words gives an empty set.
    """
    factors = mix((np.arange(n, dtype=np.uint64) + np.uint64(101)) * _GOLDEN) | np.uint64(1)
    out: list[np.ndarray] = []
    for i, j in byte_slices(texts):
        h, first = word_hashes(texts[i:j])
        full = len(h) - n + 1
        s = np.zeros(0, np.uint64)
        if full > 0:
            s = h[:full] * factors[0]
            for k in range(1, n):
                s = s + h[k : k + full] * factors[k]
            s = mix(s)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(s[a : b - n + 1]))
            elif b > a:
                whole = (h[a:b] * factors[: b - a]).sum(dtype=np.uint64)
                out.append(mix(np.array([whole + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
