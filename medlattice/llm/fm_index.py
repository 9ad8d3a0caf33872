"""A compressed FM-index over words, with matching statistics of many patterns at once.

The Burrows-Wheeler transform of the indexed passages lies in a wavelet matrix
of packed bits with block counts. Patterns are searched backwards in lock-step,
one word of each per step. Where a word can't extend a match, the match is cut
on the right to the longest that it can extend (the longest common prefix with
the nearest row that the word precedes), so every word costs one step and not
one search. Matches are held at ``length`` words: rows that agree so far form a
class, and a class knows the smallest owner of its passages.
"""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Wavelet matrix: rank of a symbol in a prefix, for arrays of symbols and prefixes."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, now = [], symbols
        for b in range(bits - 1, -1, -1):
            bit = (now >> b) & 1
            n = len(now)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            p = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(p)] = p
            words = packed.view(np.uint64)
            count = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=count[1:])
            zeros = int(n - bit.sum())
            self.levels.append((b, words, count.astype(np.int32), zeros))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        every = np.arange(1 << bits)  # at most twice the words of one index
        self.base = self._descend(every, np.zeros(len(every), np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, words, count, zeros in self.levels:
            at = i >> 6
            ones = count[at] + np.bitwise_count(words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((c >> b) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._descend(c, i) - self.base[c]


class FMIndex:
    """Index of passages (arrays of word hashes), each with an owner."""

    def __init__(self, passages: list[np.ndarray], owners: list[int], length: int):
        self.length = length
        sizes = np.array([len(p) for p in passages])
        words = np.concatenate(passages)
        self.vocabulary, code = np.unique(words, return_inverse=True)
        n = len(words) + len(passages)
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[ends] = False
        text[inner] = code + 1  # 0 ends a passage
        owner = np.repeat(np.array(owners, np.int64), sizes + 1)

        # suffix array by doubling; every end is a symbol of its own, so ranks part at the longest passage
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))
        rank = np.unique(rank, return_inverse=True)[1]
        self_levels, h = [rank], 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: n - h] = rank[h:] + 1
            key = rank * (n + 1) + ahead
            sa = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[sa] = np.cumsum(np.append(False, key[sa[1:]] != key[sa[:-1]]))
            rank, h = new, h * 2
            if new[sa[-1]] == n - 1 or h >= n:
                break
            self_levels.append(rank)
        lcp = np.zeros(n + 1, np.int32)
        a, b, common = sa[:-1].copy(), sa[1:].copy(), np.zeros(n - 1, np.int32)
        for k in range(len(self_levels) - 1, -1, -1):
            r = np.append(self_levels[k], [-1])
            x, y = np.minimum(a, n), np.minimum(b, n)
            same = (r[x] == r[y]) & (x < n) & (y < n)
            step = same.astype(np.int64) << k
            common += step.astype(np.int32)
            a += step
            b += step
        lcp[1:n] = common
        self.n = n
        bwt = text[sa - 1]
        bits = max(1, int(len(self.vocabulary)).bit_length())
        self.wavelet = Wavelet(bwt, bits)
        self.before = np.zeros(len(self.vocabulary) + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=len(self.vocabulary) + 1), out=self.before[1:])
        self.next_row = np.empty(n, np.int32)  # row of the suffix one word shorter
        self.next_row[:] = rank[(sa + 1) % n]
        table = [lcp]
        while (1 << len(table)) <= n:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][: len(table[-1]) - half], table[-1][half:]))
        self.lows = table
        cut = lcp[:n] < length
        cut[0] = True
        self.class_of = np.cumsum(cut) - 1
        self.class_begin = np.append(np.flatnonzero(cut), n)
        self.class_owner = np.minimum.reduceat(owner[sa], self.class_begin[:-1])

    def _low(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Smallest common-prefix length at rows a to b, both included."""
        k = np.frexp((b - a + 1).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for x in np.unique(k):
            m = k == x
            t = self.lows[x]
            out[m] = np.minimum(t[a[m]], t[b[m] - (1 << int(x)) + 1])
        return out

    def _around(self, row: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that share their first ``length`` words with ``row``."""
        lo, hi = row.copy(), row + 1
        for k in range(len(self.lows) - 1, -1, -1):
            t, w = self.lows[k], 1 << k
            c = lo - w
            ok = c >= 0
            ok[ok] = t[c[ok] + 1] >= length[ok]
            lo[ok] -= w
            ok = hi + w <= self.n
            ok[ok] = t[hi[ok]] >= length[ok]
            hi[ok] += w
        return lo, hi

    def smallest_owners(self, patterns: list[np.ndarray]) -> list[np.ndarray]:
        """For each position of each pattern: the smallest owner of the ``length`` words from there, or a huge value."""
        none = np.iinfo(np.int64).max
        sizes = np.array([len(p) for p in patterns])
        flat = np.concatenate(patterns)
        code = np.searchsorted(self.vocabulary, flat)
        code[code == len(self.vocabulary)] = 0
        code = np.where(self.vocabulary[code] == flat, code + 1, 0)
        begin = np.cumsum(sizes) - sizes
        found = np.full(len(flat), none)
        order = np.argsort(-sizes, kind="stable")
        lo, hi, size = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64), np.zeros(len(order), np.int64)
        ordered, first = sizes[order], begin[order]
        live = len(order)
        for t in range(int(sizes.max())):
            while live and ordered[live - 1] <= t:
                live -= 1
            at = first[:live] + ordered[:live] - 1 - t
            c, a, b, k = code[at], lo[:live], hi[:live], size[:live]
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([a, b]))
            ra, rb = both[:live], both[live:]
            base = self.before[c]
            grows = (ra < rb) & (c > 0)
            na, nb, nk = np.where(grows, base + ra, 0), np.where(grows, base + rb, self.n), np.where(grows, k + 1, 0)
            fail = np.flatnonzero(~grows & (c > 0))
            if len(fail):
                cf, r, base_f = c[fail], ra[fail], base[fail]
                total = self.before[cf + 1] - base_f
                left, right = r > 0, r < total
                l1, l2 = np.full(len(fail), -1), np.full(len(fail), -1)
                p = self.next_row[base_f[left] + r[left] - 1].astype(np.int64)
                l1[left] = self._low(p + 1, a[fail][left])
                p = self.next_row[base_f[right] + r[right]].astype(np.int64)
                l2[right] = self._low(b[fail][right], p)
                row = np.where(l1 >= l2, base_f + r - 1, base_f + r)
                length = np.minimum(k[fail], np.maximum(l1, l2)) + 1
                na[fail], nb[fail] = self._around(row, length)
                nk[fail] = length
            full = np.flatnonzero(nk >= self.length)
            if len(full):
                cls = self.class_of[na[full]]
                na[full], nb[full], nk[full] = self.class_begin[cls], self.class_begin[cls + 1], self.length
                found[at[full]] = self.class_owner[cls]
            lo[:live], hi[:live], size[:live] = na, nb, nk
        return [found[a : a + n] for a, n in zip(begin, sizes, strict=True)]
