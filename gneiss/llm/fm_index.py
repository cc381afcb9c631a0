"""FM-index of a shard of word sequences: wavelet matrix over the Burrows-Wheeler transform, backward search in lockstep.

The shard holds sequences of word numbers.  Each sequence belongs to one owner
(a document), or to several (flagged ``many``).  ``matching_statistics`` walks
all sequences at once from their ends towards their starts and keeps, for each
position, the longest match, cut at ``depth`` words, that another owner holds as
well.  Where a backward step would leave no other owner, the interval widens to
its parent in the LCP-interval tree until the step succeeds.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_ONE = U64(1)


class WaveletMatrix:
    """Rank over a sequence of symbols with one packed bit vector a level."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.n, self.levels = len(symbols), max(1, int(sigma - 1).bit_length())
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(np.uint8)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(U64)
            counts = np.bitwise_count(words)
            self.bits.append(words)
            self.before.append(np.concatenate(([0], np.cumsum(counts[:-1], dtype=np.int64))))
            one = bit.astype(bool)
            self.zeros.append(self.n - int(one.sum()))
            symbols = np.concatenate((symbols[~one], symbols[one]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Position that ``place`` maps to among the sorted symbols; less the symbol's own first position it is the rank."""
        for depth in range(self.levels):
            block = place >> 6
            part = self.bits[depth][block] & ((_ONE << (place & 63).astype(U64)) - _ONE)
            ones = self.before[depth][block] + np.bitwise_count(part)
            up = (symbol >> (self.levels - 1 - depth)) & 1
            place = np.where(up == 1, self.zeros[depth] + ones, place - ones)
        return place


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse by prefix doubling; only groups that are still equal are sorted again."""
    n = len(text)
    sa = np.argsort(text, kind="stable")
    value = text[sa]
    head = np.empty(n, bool)
    head[:1] = True
    head[1:] = value[1:] != value[:-1]
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, place, 0))
    tied = ~head
    tied[:-1] |= ~head[1:]
    open_ = np.flatnonzero(tied)
    h = 1
    while len(open_):
        at = sa[open_]
        nxt = at + h
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[open_] = at
        new = np.empty(len(key), bool)
        new[:1] = True
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        still = ~new
        still[:-1] |= ~new[1:]
        open_ = open_[still]
        h *= 2
    return sa, rank


class FMIndex:
    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, owner: np.ndarray, many: np.ndarray, depth: int) -> None:
        """tokens: the sequences one after another, as hashes; owner and many: of each sequence."""
        self.depth, self.lengths, m = depth, lengths, len(lengths)
        self.owner = owner
        alphabet, symbol = np.unique(tokens, return_inverse=True)
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int64)
        n = int(lengths.sum()) + m
        ends = self.starts + lengths
        text = np.empty(n, np.int64)
        body = np.ones(n, bool)
        body[ends] = False
        text[body] = symbol + m
        text[ends] = np.arange(m)
        sa, _ = suffix_array(text)
        self.text = np.zeros(n, np.int64)  # 0 ends a sequence, words are from 1
        self.text[body] = symbol + 1
        sequence = np.repeat(np.arange(m), lengths + 1)
        of = sequence[sa]
        bwt = self.text[sa - 1]
        self.sigma = len(alphabet) + 1
        self.wavelet = WaveletMatrix(bwt, self.sigma)
        every = np.arange(self.sigma)
        counts = np.bincount(self.text, minlength=self.sigma)
        self.shift = np.concatenate(([0], np.cumsum(counts)[:-1])) - self.wavelet.rank(every, np.zeros(self.sigma, np.int64))
        lcp = self._lcp(text, sa)
        self.lcp = np.concatenate((lcp, [0]))
        self.previous, self.following = self._parents(self.lcp)
        lone = ~many[of]
        same = np.zeros(n, bool)  # of the same single owner as the next
        same[:-1] = lone[:-1] & lone[1:] & (owner[of][:-1] == owner[of][1:])
        change = np.where(same, n, np.arange(n) + 1)
        self.other = np.minimum.accumulate(change[::-1])[::-1]
        self.other[~lone] = np.flatnonzero(~lone)  # a sequence of many owners is a match by itself
        cut = np.flatnonzero(self.lcp[:n] < depth)
        self.least = np.repeat(np.minimum.reduceat(owner[of], cut), np.diff(np.append(cut, n)))
        short = np.flatnonzero(self.lcp < depth - 1)
        group = np.searchsorted(short, np.arange(n), "right") - 1
        self.short_from, self.short_to = short[group], short[group + 1]

    def _lcp(self, text: np.ndarray, sa: np.ndarray) -> np.ndarray:
        n = len(text)
        lcp = np.zeros(n, np.int64)
        live = np.arange(1, n)
        a, b = sa[:-1], sa[1:]
        for _ in range(self.depth):
            fits = (a < n) & (b < n)
            fits[fits] = text[a[fits]] == text[b[fits]]
            live, a, b = live[fits], a[fits] + 1, b[fits] + 1
            if not len(live):
                break
            lcp[live] += 1
        return lcp

    def _parents(self, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each index the nearest ones before and after it with a lesser LCP."""
        n = len(lcp)
        previous, following = np.zeros(n, np.int64), np.full(n, n - 1)
        small = lcp.astype(np.uint16)
        order = np.argsort(small, kind="stable")
        sizes = np.bincount(small, minlength=self.depth + 1)
        ends = np.cumsum(sizes)
        for d in range(1, self.depth + 1):
            if not sizes[d]:
                continue
            at = order[ends[d - 1] : ends[d]]
            lesser = np.flatnonzero(small < d)
            i = np.searchsorted(lesser, at)
            previous[at], following[at] = lesser[i - 1], lesser[np.minimum(i, len(lesser) - 1)]
        return previous, following

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, position, least owner) of every match of ``depth`` words that two owners hold."""
        n, depth = len(self.text), self.depth
        order = np.argsort(-self.lengths, kind="stable")
        starts, lengths = self.starts[order], self.lengths[order]
        m = len(order)
        left, right, size = np.zeros(m, np.int64), np.full(m, n), np.zeros(m, np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(int(lengths[0]) if m else 0):
            live = int(np.searchsorted(-lengths, -step, "left"))  # lengths > step
            place = lengths[:live] - 1 - step
            symbol = self.text[starts[:live] + place]
            lo, hi, d = left[:live].copy(), right[:live].copy(), size[:live].copy()
            full = d == depth
            lo[full], hi[full], d[full] = self.short_from[lo[full]], self.short_to[lo[full]], depth - 1
            todo = np.arange(live)
            while len(todo):
                c = symbol[todo]
                both = self.wavelet.rank(np.concatenate((c, c)), np.concatenate((lo[todo], hi[todo]))) + np.tile(self.shift[c], 2)
                a, b = both[: len(todo)], both[len(todo) :]
                good = (a < b) & (self.other[np.minimum(a, n - 1)] < b)
                ok = todo[good]
                lo[ok], hi[ok], d[ok] = a[good], b[good], d[ok] + 1
                todo = todo[~good]
                root = todo[d[todo] == 0]
                lo[root], hi[root] = 0, n
                todo = todo[d[todo] > 0]
                if len(todo):
                    at_lo, at_hi = self.lcp[lo[todo]], self.lcp[hi[todo]]
                    k = np.where(at_lo >= at_hi, lo[todo], hi[todo])
                    d[todo] = np.maximum(at_lo, at_hi)
                    up = d[todo] > 0
                    lo[todo] = np.where(up, self.previous[k], 0)
                    hi[todo] = np.where(up, self.following[k], n)
            left[:live], right[:live], size[:live] = lo, hi, d
            hit = np.flatnonzero(d == depth)
            if len(hit):
                found.append((order[hit], place[hit], self.least[lo[hit]]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
