"""Suffix arrays by linear grouping (after Baier's GSACA), for many small sets of strings side by side.

A suffix belongs to the group of its Lyndon prefix, the part before the next smaller suffix. The groups of a set are processed in descending
order. A processed suffix leaves the list of open ones; its open predecessor is its previous smaller suffix. That one's
Lyndon prefix grows by the processed group, so it rises within its own group; several such steps count. In the end every
group is in place, and suffixes of one group are emitted in the order of what follows their Lyndon prefix, which is a smaller suffix and
has been emitted before. Nothing is renamed, and no set is sorted recursively.

Sets are independent, so each step processes the next group of all sets at once.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given sizes."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def _groups(data: np.ndarray, offsets: np.ndarray, set_offsets: np.ndarray):
    """Start of each suffix's group in the order, its previous smaller and its next smaller suffix (len(data): none)."""
    n, none = len(data), len(data)
    sets = np.repeat(np.arange(len(set_offsets) - 1), np.diff(set_offsets))
    key = sets * 256 + data
    held = np.argsort(key, kind="stable")  # suffixes, those of a group side by side
    place = np.empty(n, dtype=np.int64)
    place[held] = np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], key[held[1:]] != key[held[:-1]]]))
    group = np.empty(n, dtype=np.int64)
    group[held] = np.repeat(first, np.diff(np.append(first, n)))
    start_of, end_of = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    start_of[np.append(first[1:], n)] = first
    end_of[first] = np.append(first[1:], n)
    # The list of open suffixes of each string.
    left, right = np.arange(-1, n, dtype=np.int64), np.arange(1, n + 2, dtype=np.int64)
    full = np.diff(offsets) > 0
    left[offsets[:-1][full]] = none
    right[offsets[1:][full] - 1] = none
    left[n] = right[n] = none
    gone, moves = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
    smaller, following = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    begin, end = set_offsets[:-1], set_offsets[1:].copy()
    open_sets = np.flatnonzero(end > begin)
    while len(open_sets):
        upper = end[open_sets]
        lower = start_of[upper]
        now = held[_ranges(lower, upper - lower)]
        following[now] = right[now]
        gone[now] = True
        before, after = left[now], right[now]
        while True:
            passed = np.flatnonzero(gone[before])
            if not len(passed):
                break
            before[passed] = left[before[passed]]
        while True:
            passed = np.flatnonzero(gone[after])
            if not len(passed):
                break
            after[passed] = right[after[passed]]
        smaller[now] = before
        right[before] = after
        left[after] = before
        left[n] = right[n] = none
        end[open_sets] = lower
        open_sets = open_sets[lower > begin[open_sets]]
        rising, times = np.unique(before[before != none], return_counts=True)
        if not len(rising):
            continue
        own = group[rising]
        order = np.lexsort((times, own))
        rising, times, own = rising[order], times[order], own[order]
        new_own = np.concatenate([[True], own[1:] != own[:-1]])
        at = np.flatnonzero(new_own)
        size = np.diff(np.append(at, len(own)))
        top = end_of[own[at]] - size
        targets = _ranges(top, size)
        # Those that rise change places with those above.
        moves[rising] = True
        here = held[targets]
        down = here[~moves[here]]
        moves[rising] = False
        vacated = place[rising]
        vacated = vacated[vacated < np.repeat(top, size)]
        held[vacated] = down
        place[down] = vacated
        held[targets] = rising
        place[rising] = targets
        end_of[own[at]] = top
        rest = top > own[at]
        start_of[top[rest]] = own[at][rest]
        part = np.flatnonzero(new_own | np.concatenate([[True], times[1:] != times[:-1]]))
        part_size = np.diff(np.append(part, len(own)))
        lowest = targets[part]
        group[rising] = np.repeat(lowest, part_size)
        start_of[lowest + part_size] = lowest
        end_of[lowest] = lowest + part_size
    return group, smaller, following


def suffix_orders(data: np.ndarray, offsets: np.ndarray, set_offsets: np.ndarray) -> np.ndarray:
    """The suffixes of each set of strings in ascending order, as positions of ``data``.

    String i is data[offsets[i]:offsets[i + 1]]; the strings of a set lie side by side, and set s is the part of ``data`` from
    set_offsets[s] to set_offsets[s + 1]. A suffix ends with its string; of equal suffixes that of the earlier string comes first.
    """
    n, none = len(data), len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    group, smaller, following = _groups(data, offsets, set_offsets)
    out = np.full(n, none, dtype=np.int64)
    free = np.arange(n + 1, dtype=np.int64)
    string_start = np.zeros(n + 1, dtype=bool)
    string_start[offsets[:-1]] = True

    def emit(last: np.ndarray, after: np.ndarray) -> None:
        """What ends right before ``after``, from the suffix ``last`` on, in each of some sets."""
        while True:
            fits = np.flatnonzero(last != none)
            fits = fits[following[last[fits]] == after[fits]]
            if not len(fits):
                return
            last, after = last[fits], after[fits]
            own = group[last]
            out[free[own]] = last
            free[own] += 1
            last = smaller[last]

    # The ends of the strings first, one string of each set at a time.
    full = np.flatnonzero(np.diff(offsets) > 0)
    sets = np.searchsorted(set_offsets, offsets[:-1][full], side="right") - 1
    number = np.arange(len(full)) - np.searchsorted(sets, sets)
    for k in range(int(number.max(initial=-1)) + 1):
        ends = offsets[1:][full[number == k]]
        emit(ends - 1, np.full(len(ends), none))
    begin, size = set_offsets[:-1], np.diff(set_offsets)
    longest_first = np.argsort(-size, kind="stable")
    begin, size = begin[longest_first], size[longest_first]
    for k in range(int(size.max(initial=0))):
        now = out[begin[: np.searchsorted(-size, -k, side="left")] + k]
        emit(np.where(string_start[now], none, now - 1), now)
    return out
