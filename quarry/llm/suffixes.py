"""Blockwise suffix sorting with a difference cover, in numpy.

Suffixes are compared on their first ``depth`` bytes. The ranks of the *cover
sample*, the suffixes whose start modulo ``V`` is in a difference cover, are
computed first. Suffixes are then sorted one bucket at a time: buckets are
ranges of the first eight bytes, so only one bucket's keys are in memory.
Within a bucket suffixes are sorted by their first V bytes, and those that tie
are resolved by sample ranks: for any two starts i and j there is a shift below
V that takes both into the sample, and as the first V bytes are equal, the
ranks of the shifted suffixes decide.
"""

from __future__ import annotations

import numpy as np

#: Colbourn and Ling's difference cover for r = 1: 10 residues cover all differences modulo 73.
_R = 1
V = 24 * _R * _R + 36 * _R + 13


def difference_cover(r: int = _R) -> np.ndarray:
    """Residues whose pairwise differences are all residues modulo 24r^2 + 36r + 13."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return np.concatenate([[0], np.cumsum(steps)])


COVER = difference_cover()


def _shift_table() -> np.ndarray:
    """[a, b]: the least shift that takes the residues a and b into the cover."""
    inside = np.zeros(V, bool)
    inside[COVER] = True
    table = np.full((V, V), -1, np.int16)
    residues = np.arange(V)
    for shift in range(V - 1, -1, -1):
        hit = inside[(residues + shift) % V]
        table[np.ix_(hit, hit)] = shift
    return table


SHIFT = _shift_table()
#: Suffixes sorted at a time.
BUCKET = 1 << 17


def _words(text: np.ndarray, at: np.ndarray, start: int, count: int) -> list[np.ndarray]:
    """``count`` big-endian words of eight bytes of each suffix from byte ``start`` on; text is padded far enough."""
    view = np.lib.stride_tricks.sliding_window_view(text, 8)
    return [np.ascontiguousarray(view[at + start + 8 * k]).view(">u8")[:, 0].astype(np.uint64) for k in range(count)]


def _ordered(text: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``depth`` bytes, and where an element differs from the one before."""
    full, rest = divmod(depth, 8)
    keys = _words(text, at, 0, full + (rest > 0))
    if rest:
        keys[-1] >>= np.uint64(64 - 8 * rest)
    order = np.argsort(keys[0], kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = keys[0][order][1:] != keys[0][order][:-1]
    for key in keys[1:]:
        # only the places that still tie with a neighbour are sorted further
        tie = ~new
        tie[:-1] |= ~new[1:]
        where = np.flatnonzero(tie)
        if not len(where):
            break
        group = np.cumsum(new)[where]
        some = order[where]
        again = np.lexsort((key[some], group))
        order[where] = some[again]
        value = key[order[where]]
        fresh = np.ones(len(where), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        new[where] |= fresh
    return order, new


def sample_ranks(text: np.ndarray, n: int, depth: int) -> np.ndarray:
    """For each start below n in the cover sample, its rank by ``depth`` bytes; 0 elsewhere."""
    at = (np.arange(0, n, V)[:, None] + COVER).ravel()
    at = at[at < n]
    order, new = _ordered(text, at, depth)
    ranks = np.zeros(len(text), np.int32)
    ranks[at[order]] = np.cumsum(new)
    return ranks


def _resolved(order: np.ndarray, new: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Order within the runs of suffixes that share their first V bytes, by sample ranks.

    Every run is split around its first suffix, all runs at once, until each part equals its pivot.
    """
    tie = ~new
    tie[:-1] |= ~new[1:]
    where = np.flatnonzero(tie)
    group = np.cumsum(new)[where]
    while len(where):
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([starts, [len(where)]]))
        some = at[order[where]]
        pivot = np.repeat(some[starts], size)
        shift = SHIFT[some % V, pivot % V]
        side = np.sign(ranks[some + shift] - ranks[pivot + shift])
        if not side.any():
            break
        key = group.astype(np.int64) * 3 + side + 1
        again = np.argsort(key, kind="stable")
        order[where] = order[where][again]
        key = key[again]
        # parts equal to their pivot are done; parts of one suffix too
        edge = np.concatenate([[True], key[1:] != key[:-1]])
        part = np.cumsum(edge)
        alone = np.bincount(part)[part] == 1
        left = ~alone & (key % 3 != 1)
        where, group = where[left], part[left]
    return order


def sorted_blocks(text: np.ndarray, starts: np.ndarray, depth: int, bucket: int = BUCKET):
    """Yields the suffixes ``starts`` (n of them, each with ``depth`` bytes inside the text) in order, one bucket at a time.

    Suffixes that share their first ``depth`` bytes are neighbours in one bucket.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 2 * V + 16, np.uint8)])
    ranks = sample_ranks(padded, n + V, depth)
    if len(starts) <= bucket:
        cuts = [starts]
    else:
        lead = _words(padded, starts, 0, 1)[0]
        marks = np.unique(np.sort(lead[:: max(1, len(lead) // 4096)])[:: max(1, 4096 * bucket // (2 * len(lead)))])
        which = np.searchsorted(marks, lead, "right")
        by = np.argsort(which, kind="stable")
        cuts = np.split(starts[by], np.flatnonzero(np.diff(which[by])) + 1)
    for at in cuts:
        order, new = _ordered(padded, at, min(V, depth))
        if depth > V:
            order = _resolved(order, new, at, ranks)
        yield at[order]


def repeats(text: np.ndarray, starts: np.ndarray, depth: int, priority: np.ndarray, bucket: int = BUCKET) -> np.ndarray:
    """For each start, whether its ``depth`` bytes also stand at a start of smaller ``priority`` (a row per start)."""
    later = np.zeros(len(text) + 1, bool)
    rank = np.zeros(len(text) + 1, np.int64)
    rank[starts] = priority
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    for block in sorted_blocks(text, starts, depth, bucket):
        if len(block) < 2:
            continue
        # neighbours that agree on all depth bytes
        same = np.ones(len(block) - 1, bool)
        for k in range(0, depth, 8):
            k = min(k, depth - 8)
            live = np.flatnonzero(same)
            if not len(live):
                break
            a, b = _words(padded, block[live], k, 1)[0], _words(padded, block[live + 1], k, 1)[0]
            same[live] = a == b
        run = np.cumsum(np.concatenate([[True], ~same])) - 1
        least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, run, rank[block])
        later[block] = rank[block] > least[run]
    return later[starts]
