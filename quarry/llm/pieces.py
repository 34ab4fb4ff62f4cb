"""Token ids of pre-tokens, remembered by number.

Pieces are numbered as they first come, new ones of a batch are encoded
together, and the ids of a text are gathered from one flat array by the numbers
of its pieces. Memory is bounded: at ``kept`` pieces or ``kept_chars``
characters everything is forgotten and learned anew.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Codes(dict):
    """Numbers for pieces, given as they first come; ``fresh`` holds those without ids yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = code = len(self)
        self.fresh.append(piece)
        return code


class PieceTable:
    """``learn`` maps a list of pieces to their ids laid end to end and the number of ids of each."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype, kept: int, kept_chars: int = 20_000_000):
        self.learn, self.dtype, self.kept, self.kept_chars = learn, np.dtype(dtype), kept, kept_chars
        self.forget()

    def forget(self) -> None:
        self.codes, self.chars = Codes(), 0
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self) -> None:
        new = self.codes.fresh
        if not new:
            return
        ids, n = self.learn(new)
        first, last = len(self.codes) - len(new), len(self.codes)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.start) < last:
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[first:last] = self.used + np.cumsum(n) - n
        self.length[first:last] = n
        self.used += len(ids)
        self.chars += sum(map(len, new))
        self.codes.fresh = []

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The ids of each list of pieces."""
        if len(self.codes) > self.kept or self.chars > self.kept_chars:
            self.forget()
        codes: list[int] = []
        bounds = [0]
        for pieces in texts:
            codes.extend(map(self.codes.__getitem__, pieces))
            bounds.append(len(codes))
        self._learn()
        code = np.array(codes, np.int64)
        n = self.length[code]
        ends = np.cumsum(n)
        out = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[code] - (ends - n), n)]
        return np.split(out, np.concatenate([[0], ends])[bounds[1:-1]]) if texts else []
