"""A run-length index: the Burrows-Wheeler transform of a set of strings, kept as runs with sampled ends.

Suffixes in order, each with the letter before it, make the transform; equal letters in a row are one
run. Of each run only the places of its first and last suffix are kept, and how far its last suffix agrees with
the first of the next run. Within a run, neighbours stay neighbours one place earlier in their strings
and agree there by one letter more. So the matching statistics of the strings (at each place, the longest
string that begins there and elsewhere too) follow from the run ends alone, streamed in text order: known
at a sampled place, and one less from each place to the next. Strings that repeat much make few runs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from longitrack.llm.rolling import sums, windows_hash

#: Letters of a suffix that the first sort compares; a byte more tells how many there are.
_FIRST = 7


class RunIndex(NamedTuple):
    """letters: of the runs, -1 where a string begins; first, last: places sampled at their ends;
    common: letters on which the last suffix of a run and the first of the next agree; n: letters in all."""

    letters: np.ndarray
    first: np.ndarray
    last: np.ndarray
    common: np.ndarray
    n: int

    def statistics(self) -> np.ndarray:
        """At each place of the strings, laid end to end, the length of the longest string that begins there and elsewhere too."""
        place = np.arange(self.n)
        out = np.zeros(self.n, np.int64)
        for at, agree in ((self.first[1:], self.common), (self.last[:-1], self.common)):
            upto = np.zeros(self.n, np.int64)  # where the agreement ends that was last known
            upto[at] = at + agree
            out = np.maximum(out, np.maximum.accumulate(upto) - place)
        return out


def suffix_order(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places in the order of the suffixes that begin there and end with their string, `left` letters on; of equal ones the first comes first.

    By prefix doubling: only what is still tied is sorted again.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(_FIRST, np.uint8)))
    v = np.minimum(left, _FIRST).astype(np.uint64)
    for j in range(_FIRST):
        v |= np.where(left > j, padded[j : j + n], 0).astype(np.uint64) << np.uint64(8 * (_FIRST - j))
    order = np.argsort(v, kind="stable")
    heads = np.concatenate(([True], np.diff(v[order]) != 0))
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(heads)[np.cumsum(heads) - 1]
    tied, known, longest = np.arange(n), _FIRST, int(left.max(initial=0))
    while known < longest:
        # rows of groups with several members, as far as any goes on
        tied = tied[_several(heads[tied])]
        if not len(tied):
            break
        at = order[tied]
        then = np.where(left[at] > known, rank[np.minimum(at + known, n - 1)] + 1, 0)
        key = (rank[at] << np.int64(31)) | then
        again = np.argsort(key, kind="stable")
        at, key = at[again], key[again]
        order[tied] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        heads[tied] = new
        rank[at] = tied[new][np.cumsum(new) - 1]
        known *= 2
    return order


def _several(heads: np.ndarray) -> np.ndarray:
    """Which rows belong to groups of several, by where groups begin."""
    return ~(heads & np.concatenate((heads[1:], [True])))


def agreement(data: np.ndarray, left: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """On how many letters the suffixes at x and at y agree, by hashes of their beginnings."""
    hashes = sums(data)
    low, high = np.zeros(len(x), np.int64), np.minimum(left[x], left[y])
    while (open_ := low < high).any():
        i = np.flatnonzero(open_)
        middle = (low[i] + high[i] + 1) // 2
        same = windows_hash(hashes, x[i], x[i] + middle) == windows_hash(hashes, y[i], y[i] + middle)
        low[i] = np.where(same, middle, low[i])
        high[i] = np.where(same, high[i], middle - 1)
    return low


def build(strings: list[np.ndarray]) -> RunIndex:
    """The index of some strings of bytes; each ends for itself, so no match crosses from one to the next."""
    sizes = np.array([len(x) for x in strings], np.int64)
    data = np.concatenate([*strings, np.zeros(0, np.uint8)])
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return RunIndex(none, none, none, none, 0)
    sizes = sizes[sizes > 0]
    begins = np.cumsum(sizes) - sizes
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    order = suffix_order(data, left)
    before = np.concatenate(([-1], data[:-1].astype(np.int64)))
    before[begins] = -1
    letters = before[order]
    heads = np.flatnonzero(np.concatenate(([True], (letters[1:] != letters[:-1]) | (letters[1:] < 0))))
    tails = np.concatenate((heads[1:], [n])) - 1
    first, last = order[heads], order[tails]
    return RunIndex(letters[heads], first, last, agreement(data, left, last[:-1], first[1:]), n)
