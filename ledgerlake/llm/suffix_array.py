"""Suffix arrays of byte blocks by induced sorting, and their permuted common prefixes, over numpy arrays.

Leftmost-smaller substrings are sorted by inducing; where some are equal, the string of their names is
sorted by the same function, down to a string whose names all differ.

A block is several strings, each ended by a separator: symbol 0, while byte b is symbol b + 1. All
separators count as different symbols, the earlier the smaller, so no common prefix crosses one.
"""

from __future__ import annotations

import numpy as np

#: Positions whose symbols are scanned together. A symbol that has more, or stands in runs, is scanned alone.
RANGE = 1 << 14
#: Rounds after which a range of symbols is scanned in narrower ones.
ROUNDS = 8
NONE = np.zeros(0, np.int32)


def smaller_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that starts at the next symbol; the last one counts as such."""
    n = len(s)
    ends = np.flatnonzero(s[1:] != s[:-1])
    out = np.empty(n, bool)
    last = len(s) - 1 if not len(ends) else ends[-1] + 1
    out[last:] = True
    if len(ends):
        out[: ends[-1] + 1] = np.repeat(s[ends] < s[ends + 1], np.diff(np.concatenate(([-1], ends))))
    return out


def leftmost_smaller(smaller: np.ndarray) -> np.ndarray:
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1


def narrow(s: np.ndarray) -> np.ndarray:
    """s in 16 bits if they hold it: stable sorting goes by digits there, by comparing in wider ones."""
    return s.astype(np.uint16) if int(s.max()) < 1 << 16 else s


def _cat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else NONE


def _deal(pending: list[list[np.ndarray]], at: np.ndarray, ranges: np.ndarray) -> None:
    """Appends positions to the lists of their ranges, in order."""
    if len(at):
        order = np.argsort(ranges, kind="stable")
        at, ranges = at[order], ranges[order]
        cuts = np.concatenate(([0], np.flatnonzero(ranges[1:] != ranges[:-1]) + 1, [len(at)])).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            pending[ranges[a]].append(at[a:b])


def _scan_range(key: np.ndarray, wanted: np.ndarray, base: np.ndarray, given: np.ndarray, low: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(placed, all, outside) of the symbols low to stop - 1: base are the positions that earlier ranges have
    placed, in order; outside are those to be placed in later ranges."""

    def before(at: np.ndarray) -> np.ndarray:
        at = at[at > 0] - 1
        return at[wanted[at]]

    if stop - low == 1:  # what a symbol adds to itself is moved as whole arrays
        batch, done, out = base, [], []
        while len(batch):
            done.append(batch)
            found = before(batch)
            same = key[found] == low
            out.append(found[~same])
            batch = found[same]
        placed = _cat(done)
        return placed, np.concatenate((placed, given)), np.concatenate((*out, before(given)))
    inside = NONE
    for _ in range(ROUNDS):
        # what each round adds is ordered by what the round before has placed
        placed = np.concatenate((base, inside))
        placed = placed[np.argsort(key[placed], kind="stable")]
        whole = np.concatenate((placed, given))
        whole = whole[np.argsort(key[whole], kind="stable")]
        found = before(whole)
        mine = key[found] < stop
        if np.count_nonzero(mine) == len(inside):
            return placed, whole, found[~mine]
        inside = found[mine]
    cuts = np.unique(np.linspace(low, stop, 17).astype(np.int64))
    pending: list[list[np.ndarray]] = [[] for _ in cuts[1:]]
    within = lambda at: np.searchsorted(cuts, key[at], side="right") - 1
    _deal(pending, base, within(base))
    share = np.searchsorted(within(given), np.arange(len(cuts)))
    parts = []
    for k in range(len(cuts) - 1):
        placed, whole, out = _scan_range(key, wanted, _cat(pending[k]), given[share[k] : share[k + 1]], int(cuts[k]), int(cuts[k + 1]))
        mine = key[out] < stop
        _deal(pending, out[mine], within(out[mine]))
        parts.append((placed, whole, out[~mine]))
    return tuple(_cat(list(x)) for x in zip(*parts))


def scan(key: np.ndarray, wanted: np.ndarray, given: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(placed, all) in order of key: one scan upwards meets the given and the placed positions, the placed before
    the given of the same symbol, and places what stands before each if it is wanted. first are placed from the start."""
    sizes = np.bincount(key)
    start = np.cumsum(sizes) - sizes
    large = sizes > RANGE
    large[key[3:][(key[3:] == key[2:-1]) & (key[2:-1] == key[1:-2]) & (key[1:-2] == key[:-3])]] = True  # runs go with their symbol
    fresh = np.concatenate(([True], (start[1:] // RANGE != start[:-1] // RANGE) | large[1:] | large[:-1]))
    lows = np.flatnonzero(fresh)
    number = np.cumsum(fresh) - 1
    pending: list[list[np.ndarray]] = [[] for _ in lows]
    _deal(pending, first, number[key[first]])
    share = np.searchsorted(number[key[given]], np.arange(len(lows) + 1))
    parts = []
    for k, (low, stop) in enumerate(zip(lows.tolist(), [*lows[1:].tolist(), len(sizes)])):
        placed, whole, out = _scan_range(key, wanted, _cat(pending[k]), given[share[k] : share[k + 1]], low, stop)
        pending[k] = []
        _deal(pending, out, number[key[out]])
        parts.append((placed, whole))
    return tuple(_cat(list(x)) for x in zip(*parts))


def induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones, which are in order as far as they are known to
    be: a scan upwards places the larger suffixes, one downwards the smaller ones. No suffix is compared with
    another; the symbols may be any numbers, since a scan goes by ranges of them."""
    seeds = seeds[np.argsort(s[seeds], kind="stable")]
    larger, _ = scan(s, ~smaller, seeds, NONE)
    zeros = seeds[: np.count_nonzero(s[seeds] == 0)]  # separators, in the order of the seeds
    _, down = scan(s.max() - s, smaller & (s > 0), larger[::-1], zeros[::-1])
    return down[::-1]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of s in order, as 32-bit numbers. s is unsigned and ends with its
    only zeros' last one; every zero is a separator and follows another symbol."""
    smaller = smaller_types(s)
    lms = leftmost_smaller(smaller)
    if not len(lms):
        return np.zeros(len(s), np.int32) if len(s) <= 1 else induce(s, smaller, lms)
    some = induce(s, smaller, lms)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    some = some[is_lms[some]]
    number = np.empty(len(s), np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    length = np.diff(np.concatenate((lms, [len(s) - 1]))) + 1
    a, b = some[:-1], some[1:]
    la, lb = length[number[a]], length[number[b]]
    equal = (la == lb) & (s[a] != 0)
    todo, k = np.flatnonzero(equal), 0
    while len(todo):
        same = (s[a[todo] + k] == s[b[todo] + k]) & (smaller[a[todo] + k] == smaller[b[todo] + k])
        equal[todo[~same]] = False
        k += 1
        todo = todo[same]
        todo = todo[la[todo] > k]
    names = np.empty(len(lms), np.int32)
    names[number[some]] = np.concatenate(([0], np.cumsum(~equal)))
    if int(names.max()) + 1 == len(lms):
        order = np.argsort(names)
    else:  # separators have names of their own, so the reduced string has one end, its smallest symbol
        order = suffix_array(narrow(np.concatenate((names + 1, np.zeros(1, np.int32)))))[1:]
    return induce(s, smaller, lms[order])


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, the length of the prefix that its suffix has in common with the one before it
    in the suffix array. Only where the symbols before the two differ is a prefix measured; anywhere
    else it is one shorter than at the position before. s is of bytes; ends: the separators' positions."""
    n = len(s)
    other = np.empty(n, np.int32)
    other[sa[1:]] = sa[:-1]
    other[sa[0]] = n
    at = np.arange(n, dtype=np.int32)
    before = np.concatenate((np.zeros(1, s.dtype), s))  # before[i] is what stands before i
    alone = (before[at] != before[other]) | (before[at] == 0) | (other == n) | (other == 0)
    todo = np.flatnonzero(alone).astype(np.int32)
    partner = other[todo]
    padded = np.concatenate((s, np.zeros(16, np.uint8)))
    words = np.ndarray((n + 8,), "<u8", buffer=padded.data, strides=(1,))
    left = (ends - np.concatenate(([-1], ends[:-1]))).astype(np.int64)
    room = (np.repeat(ends, left) - at)[todo]  # up to the separator
    length = np.zeros(len(todo), np.int32)
    live = np.flatnonzero(partner < n)
    k = 0
    while len(live):
        x = words[todo[live] + k] ^ words[partner[live] + k]
        zero = (np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int32)
        length[live] = np.minimum(k + zero, room[live])
        k += 8
        live = live[(x == 0) & (room[live] > k) & (partner[live] < n - k)]
    start = np.maximum.accumulate(np.where(alone, at, 0))
    spread = np.zeros(n, np.int32)
    spread[todo] = length
    return spread[start] - (at - start)


def repeated_starts(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, group): for each position of each string with `length` bytes from there on, the
    string's number, the position in it, and the number of its class of equal `length`-byte strings.
    The classes are the runs of the suffix array whose common prefixes are long enough."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.cumsum(sizes + 1) - 1
    s = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)
    sa = suffix_array(s)
    plcp = permuted_common_prefixes(s, sa, ends)
    group = np.cumsum(plcp[sa] < length)
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), sizes + 1)[sa]
    fits = ends[owner] - sa >= length
    sa, owner, group = sa[fits], owner[fits], group[fits]
    return owner, (sa - (ends - sizes)[owner]).astype(np.int32), np.unique(group, return_inverse=True)[1]
