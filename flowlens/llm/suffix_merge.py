"""Repeated strings of a collection from Burrows-Wheeler transforms of its shards, merged by interleave refinement."""

from __future__ import annotations

import numpy as np


class Shard:
    """The Burrows-Wheeler transform of some strings, each ended by a sentinel below every symbol.

    before: the symbol before each suffix in sorted order, 0 where a string begins; back: the place of the suffix that
    starts one symbol earlier; suffix: where each suffix starts in the joined symbols.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        ends = np.cumsum(lengths + 1) - 1
        n = int(lengths.sum() + len(lengths))
        joined = np.zeros(n, symbols.dtype)
        is_symbol = np.ones(n, bool)
        is_symbol[ends] = False
        joined[is_symbol] = symbols
        left = np.repeat(ends, lengths + 1) - np.arange(n)
        self.suffix = _sorted_suffixes(joined, left)
        place = np.empty(n, np.int32)
        place[self.suffix] = np.arange(n, dtype=np.int32)
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[ends[:-1] + 1] = True
        earlier = np.maximum(self.suffix - 1, 0)
        self.before = np.where(starts[self.suffix], 0, joined[earlier]).astype(symbols.dtype)
        self.back = place[earlier]


def _sorted_suffixes(joined: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order up to their sentinel, equal ones in order of their string; by doubling among those still tied."""
    n, width = len(joined), joined.dtype.itemsize * 8
    k = 64 // width
    padded = np.concatenate([joined, np.zeros(k, joined.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(k):
        key |= np.where(left > j, padded[j : j + n], 0) << np.uint64(width * (k - 1 - j))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    slots = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    longest = int(left.max(initial=0))
    while k <= longest:
        head = np.flatnonzero(new)
        tied = np.repeat(np.diff(np.concatenate([head, [n]])) > 1, np.diff(np.concatenate([head, [n]])))
        at = slots[tied]
        if not len(at):
            break
        own = order[at]
        more = left[own] >= k
        after = np.zeros(len(own), np.int64)
        after[more] = rank[own[more] + k] + 1
        pair = rank[own] << 32 | after
        by = np.argsort(pair, kind="stable")
        order[at] = own[by]
        pair = pair[by]
        changed = np.concatenate([[True], pair[1:] != pair[:-1]])
        new[at] = changed
        rank[order[at]] = np.maximum.accumulate(np.where(changed, at, 0))
        k *= 2
    return order


def repeated(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, suffix, interval) of every suffix whose first `depth` symbols occur again in the collection.

    The interleave of the shards' sorted suffixes starts as their plain sequence. A round takes the suffixes in their
    present order, stably sorts the symbols before them, and so puts the suffixes that start one symbol earlier in the
    order of one symbol more; no suffix is compared. Neighbours whose symbols or whose intervals differ get a border
    between them, so after round d intervals are the sets of suffixes with a common prefix of length d. A suffix alone
    in its interval stays alone, and so do those before it; it is left out of later rounds.
    """
    sizes = np.array([len(s.suffix) for s in shards])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    before = np.concatenate([s.before for s in shards])
    back = np.concatenate([s.back + np.int32(f) for s, f in zip(shards, first)])
    order, interval = np.arange(int(sizes.sum()), dtype=np.int32), np.zeros(int(sizes.sum()), np.int32)
    for _ in range(depth):
        symbol = before[order]
        on = symbol != 0
        order, symbol, interval = order[on], symbol[on], interval[on]
        by = np.argsort(symbol, kind="stable")
        order, symbol, interval = back[order[by]], symbol[by], interval[by]
        border = np.ones(len(order) + 1, bool)
        border[1:-1] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        together = ~(border[:-1] & border[1:])
        interval = np.cumsum(border[:-1], dtype=np.int32)[together]
        order = order[together]
        if not len(order):
            break
    shard = np.searchsorted(first, order, "right") - 1
    suffix = np.concatenate([s.suffix for s in shards])[order]
    return shard, suffix, interval


def least_of_windows(strings: list[bytes], least: np.ndarray, depth: int, shards: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, value): windows of `depth` bytes that occur in a string with a smaller value than their own.

    shards: the shard of each string; strings of one shard follow each other.
    """
    empty = np.zeros(0, np.int64)
    if len(strings) < 2:
        return empty, empty, empty
    raw = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    used = np.zeros(256, bool)
    used[raw] = True
    code = np.cumsum(used).astype(np.uint8 if used.sum() < 256 else np.uint16)
    ends = np.cumsum(lengths)
    bounds = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1], [True]]))
    made, starts, firsts = [], [], []
    for a, b in zip(bounds, bounds[1:]):
        begin = ends[a] - lengths[a]
        made.append(Shard(code[raw[begin : ends[b - 1]]], lengths[a:b]))
        starts.append(np.concatenate([[0], np.cumsum(lengths[a:b] + 1)[:-1]]))
        firsts.append(a)
    shard, suffix, interval = repeated(made, depth)
    if not len(shard):
        return empty, empty, empty
    string, offset = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64)
    for k in range(len(made)):
        own = shard == k
        at = np.searchsorted(starts[k], suffix[own], "right") - 1
        string[own], offset[own] = at + firsts[k], suffix[own] - starts[k][at]
    heads = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    low = np.repeat(np.minimum.reduceat(least[string], heads), np.diff(np.concatenate([heads, [len(interval)]])))
    smaller = low < least[string]
    return string[smaller], offset[smaller], low[smaller]
