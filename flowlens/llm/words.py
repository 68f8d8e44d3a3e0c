"""Words of many texts at once, as arrays over one joined buffer."""

from __future__ import annotations

import numpy as np

#: Each byte's folded form: a-z and all bytes beyond ASCII stay, A-Z become a-z, everything else is a space.
FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)
_ODD = 0x9E3779B97F4A7C15


class Words:
    """Folded bytes with a space before, between and after the texts; starts and ends of words; the text of each word."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        self.bytes = FOLD[raw]
        letters = np.concatenate([[False], self.bytes != 0x20, [False]])
        edge = np.flatnonzero(letters[1:] != letters[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        first = 1 + np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
        self.texts = np.searchsorted(first, self.starts, "right") - 1
        self.n = np.bincount(self.texts, minlength=len(texts))


def _powers(n: int, odd: int = _ODD) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(odd, -1, 2**64)
    out = []
    for x in (odd, inverse):
        p = np.empty(n, np.uint64)
        p[0] = 1
        have = 1
        while have < n:
            step = np.uint64(pow(x, have, 2**64))
            more = min(have, n - have)
            p[have : have + more] = p[:more] * step
            have += more
        out.append(p)
    return out[0], out[1]


class WordHashes:
    """64-bit hashes of byte ranges, from one running sum over the buffer."""

    def __init__(self, words: Words):
        n = len(words.bytes) + 1
        forward, self.back = _powers(n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((words.bytes.astype(np.uint64) + np.uint64(1)) * forward[: n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.back[starts] + np.uint64(salt)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def slices(lengths: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive texts with about `most` bytes each."""
    out, a, size = [], 0, 0
    for k, n in enumerate(lengths):
        size += n
        if size >= most or k == len(lengths) - 1:
            out.append((a, k + 1))
            a, size = k + 1, 0
    return out
