"""Word shingles of texts as 64-bit hashes, computed over whole batches of bytes.

A-Z are lower-cased, words are runs of bytes other than space and the controls
9 to 13. A word's hash is a polynomial over its bytes taken from one running
sum per chunk of texts; a shingle's hash is a mixed linear form of its words'.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quarry.llm.common import byte_view

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_WORD = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts are hashed together up to so many bytes at a time.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2 ** 64; kept up to the chunk's size."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) <= n:
        kept = np.full(n + 1, base, np.uint64)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        if n <= 2 * CHUNK:
            _powers[int(base)] = kept
    return kept


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and n + 1 offsets of each text's words."""
    space = _SPACE[data]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word ends where its text does
    inside = ~space
    starts = np.flatnonzero(inside & (np.concatenate([[True], space[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([space[1:], [True]]) | edge[1:])) + 1
    n = len(data)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power(_BASE, max(n, CHUNK))[:n])])
    hashes = mix((total[ends] - total[starts]) * _power(_BACK, max(n, CHUNK))[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles of ``words`` words; all words as one if there are fewer."""
    data, offsets = byte_view(column)
    out: list[np.ndarray] = []
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        hashes, at = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if len(hashes) >= words:
            rolled = hashes[: len(hashes) - words + 1] * _WORD[0]
            for k in range(1, words):
                rolled = rolled + hashes[k : len(hashes) - words + 1 + k] * _WORD[k]
            rolled = mix(rolled)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                short = (hashes[a:b] * _WORD[32 : 32 + b - a]).sum(keepdims=True) + np.uint64(b - a)
                out.append(mix(short))
            else:
                out.append(np.zeros(0, np.uint64))
        lo = hi
    return out
