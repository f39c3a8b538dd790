"""Suffix arrays of many short sequences at once: Larsson-Sadakane refinement and Kasai's common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

#: Positions in one array: rank, next rank and position are packed in one sorted 64-bit word.
MOST = (1 << 20) - 2
_BITS, _MASK = 20, (1 << 20) - 1


def _heads(changed: np.ndarray) -> np.ndarray:
    """For each place, the last place up to it where `changed` holds."""
    return np.maximum.accumulate(np.where(changed, np.arange(len(changed)), 0))


def suffix_array(first: np.ndarray, ends: np.ndarray, known: int) -> np.ndarray:
    """Positions in the order of their suffixes.

    first: for each position a number that orders suffixes by their first `known` symbols (under 2**44).
    ends: for each position the end of its own sequence; a suffix stops there, and sorts before longer ones.
    Equal suffixes of two sequences stand in the order of their positions.
    Only groups that are still tied are sorted again, with the rank `known` further on, which doubles each time.
    """
    n = len(first)
    assert n <= MOST
    if not n:
        return np.zeros(0, np.int64)
    key = first.astype(np.int64) << _BITS | np.arange(n)
    key.sort()
    tied = key & _MASK
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(key[1:] >> _BITS, key[:-1] >> _BITS, out=new[1:])
    head = _heads(new)
    rank = np.empty(n, np.int64)
    rank[tied] = head
    while True:
        several = ~(new & np.append(new[1:], True))
        tied = tied[several]
        if not len(tied):
            break
        further = tied + known
        inside = further < ends[tied]
        if not inside.any():
            break
        after = np.where(inside, rank[np.where(inside, further, 0)] + 1, 0)
        key = rank[tied] << 2 * _BITS | after << _BITS | np.arange(len(tied))
        key.sort()
        tied = tied[key & _MASK]
        old, both = key >> 2 * _BITS, key >> _BITS
        new = np.empty(len(key), bool)
        new[0] = True
        fresh = new.copy()
        np.not_equal(both[1:], both[:-1], out=new[1:])
        np.not_equal(old[1:], old[:-1], out=fresh[1:])
        rank[tied] = old + _heads(new) - _heads(fresh)
        known *= 2
    key = rank << _BITS | np.arange(n)
    key.sort()
    return key & _MASK


def common_prefixes(symbols: np.ndarray, ends: np.ndarray, order: np.ndarray, cap: int, stride: int = 64, alike: np.ndarray | None = None) -> np.ndarray:
    """For each position, the symbols (up to cap) it shares with the suffix before it in the order.

    Kasai's bound, that the prefix at i + s is at most s shorter than the one at i, holds for any step: positions
    a stride apart are compared first, then those between them, from what the bound leaves to compare.
    alike: only neighbours with equal values in it are compared, the others share nothing.
    """
    n = len(symbols)
    shared = np.zeros(n, np.int64)
    if n < 2:
        return shared
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    most = np.where(before >= 0, np.minimum(np.minimum(ends - np.arange(n), ends[before] - before), cap), 0)
    if alike is not None:
        most[alike != alike[before]] = 0
    top = True
    while stride:
        at = np.arange(0, n, stride) if top else np.arange(stride, n, 2 * stride)
        if top or not len(at):
            length = np.zeros(len(at), np.int64)
        else:
            same = ends[at - stride] == ends[at]
            length = np.where(same, np.maximum(shared[at - stride] - stride, 0), 0)
            length = np.minimum(length, most[at])
        top = False
        live = np.flatnonzero(length < most[at])
        while len(live):
            p, done = at[live], length[live]
            equal = symbols[p + done] == symbols[before[p] + done]
            live = live[equal]
            length[live] += 1
            live = live[length[live] < most[at[live]]]
        shared[at] = length
        stride //= 2
    return shared


def neighbours(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each position, the longest prefix it shares with any other suffix (up to the cap)."""
    best = shared.copy()
    if len(order) > 1:
        best[order[:-1]] = np.maximum(best[order[:-1]], shared[order[1:]])
    return best
