"""Suffix array of many short strings by two-stage sorting, in numpy.

The strings are the rows of a byte matrix. A suffix ends with its row. Stage one sorts only the suffixes that are smaller than
their successors (the same suffix without its first byte). Stage two induces the others: the suffixes are scanned in order, bucket by bucket of first
bytes, and each passes the suffix one byte longer, if that one is larger than it, to the end of its bucket's front part. A scan handles a bucket at once; only
runs of one byte need a further turn.
"""

from __future__ import annotations

import numpy as np


def smaller_than_next(rows: np.ndarray) -> np.ndarray:
    """For each place of each row: whether the suffix there is smaller than the one after it; the end of a row is smaller than all."""
    out = np.zeros(rows.shape, bool)
    for i in range(rows.shape[1] - 2, -1, -1):
        out[:, i] = (rows[:, i] < rows[:, i + 1]) | ((rows[:, i] == rows[:, i + 1]) & out[:, i + 1])
    return out


def words_at(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that compares like them; zeros follow the end."""
    w = np.concatenate([flat, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        w = (w[:-step] << np.uint64(8 * step)) | w[step:]
    return w[:len(flat)]


def sort_suffixes(places: np.ndarray, words: np.ndarray, stops: np.ndarray, depth: int) -> np.ndarray:
    """``places`` ordered by their first ``depth`` bytes up to their rows' ends; only places that still tie are compared further."""
    def word(at: np.ndarray, k: int) -> np.ndarray:
        left = np.clip(stops[at] - (at + 8 * k), 0, 8)
        w = words[np.minimum(at + 8 * k, len(words) - 1)]
        return np.where(left >= 8, w, np.where(left > 0, w >> (np.uint64(8) * (8 - np.maximum(left, 1)).astype(np.uint64)) << (np.uint64(8) * (8 - np.maximum(left, 1)).astype(np.uint64)), np.uint64(0)))

    first = word(places, 0)
    order = np.argsort(first, kind="stable")
    places, first = places[order], first[order]
    new = np.concatenate([[True], first[1:] != first[:-1]]) if len(places) else np.zeros(0, bool)
    for k in range(1, -(-depth // 8)):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.nonzero(tied)[0]  # whole groups of ties, in place
        if not len(at):
            break
        group = np.cumsum(new)[at]
        w = word(places[at], k)
        order = np.lexsort((w, group))
        places[at] = places[at][order]
        group, w = group[order], w[order]
        new[at[1:]] |= (group[1:] == group[:-1]) & (w[1:] != w[:-1])
    return places


def asked_for(direct: np.ndarray, starts: int) -> np.ndarray:
    """Of each row the places before ``starts``, and the ones after them that a suffix there is induced from: up to the first that is sorted in stage one."""
    out = np.zeros(direct.shape, bool)
    out[:, :starts] = True
    for i in range(max(starts, 1), direct.shape[1]):
        out[:, i] = out[:, i - 1] & ~direct[:, i - 1]
    return out


def suffix_array(rows: np.ndarray, depth: int, starts: int | None = None) -> np.ndarray:
    """Places of the flattened ``rows`` in the order of their suffixes, exact to ``depth`` bytes and more: all, or those before ``starts`` in their rows and
    what they are induced from."""
    n, width = rows.shape
    flat = np.ascontiguousarray(rows).reshape(-1)
    size = n * width
    direct = smaller_than_next(rows)
    wanted = asked_for(direct, width if starts is None else starts).reshape(-1)
    direct = direct.reshape(-1)
    stops = (np.arange(size, dtype=np.int64) // max(width, 1) + 1) * width
    chosen = sort_suffixes(np.nonzero(direct & wanted)[0], words_at(flat), stops, depth)
    cuts = np.searchsorted(flat[chosen], np.arange(257))
    fronts: list[list[np.ndarray]] = [[] for _ in range(256)]

    def pass_on(sources: np.ndarray) -> None:
        """Give the longer suffixes of ``sources`` to the buckets of their first bytes, in order."""
        if not len(sources):
            return
        letters = flat[sources]
        order = np.argsort(letters, kind="stable")
        ends = np.searchsorted(letters[order], np.arange(257))
        for c in np.unique(letters).tolist():
            fronts[c].append(sources[order[ends[c]:ends[c + 1]]])

    ends = np.arange(width - 1, size, width)
    pass_on(ends[wanted[ends]])  # the ends of the rows come first of all
    out = []
    for c in range(256):
        front, turn = [], np.concatenate(fronts[c]) if fronts[c] else np.zeros(0, np.int64)
        while len(turn):
            front.append(turn)
            before = turn[turn % width > 0] - 1
            turn = before[(flat[before] == c) & ~direct[before]]
        bucket = np.concatenate([*front, chosen[cuts[c]:cuts[c + 1]]])
        out.append(bucket)
        before = bucket[bucket % width > 0] - 1
        pass_on(before[(flat[before] > c) & ~direct[before]])
        fronts[c] = []
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefix(a: np.ndarray, b: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at ``a`` and ``b`` are equal (length of 8 or more)."""
    same = np.ones(len(a), bool)
    for k in [*range(0, length - 8, 8), length - 8]:
        same &= words[a + k] == words[b + k]
    return same
