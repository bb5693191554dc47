"""Compressed FM-index over a shard: wavelet matrix, backward search, matching statistics.

The index holds texts with owners. ``statistics`` streams texts right to left through
it, many at a time, and gives for each place the length of the longest match that a
text of another owner has there. The match is an interval of suffixes: each character
costs one backward step (two rank queries per level of the wavelet matrix); when the
longer match has no second owner, the interval is widened to its parent, the next
shorter match, and the step is tried again.

Suffixes are sorted by doubling up to the longest text, and common prefixes of
neighbours come from the ranks of those rounds, so building takes a number of rounds
that follows the longest text, however repetitive the texts are.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Bit-packed sequence over 0 .. 2^levels - 1 with vectorised rank."""

    def __init__(self, sequence: np.ndarray, levels: int) -> None:
        self.levels, self.words, self.counts, self.zeros = levels, [], [], []
        for level in range(levels - 1, -1, -1):
            bits = ((sequence >> level) & 1).astype(bool)
            padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(len(bits) - int(bits.sum()))
            sequence = np.concatenate([sequence[~bits], sequence[bits]])

    def descend(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Place of prefix ``at`` among the symbols equal to ``symbol``, in the last order."""
        one = np.uint64(1)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            below = (one << (at & 63).astype(np.uint64)) - one
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & below)
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.empty(len(key), bool)
    first[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(first) - 1
    return order, rank


def _pairs(rank: np.ndarray, shift: int) -> np.ndarray:
    """Rank of i together with that of i + shift; beyond the end is below everything."""
    key = rank * (len(rank) + 1)
    if shift < len(rank):
        key[: len(rank) - shift] += rank[shift:] + 1
    return key


def _common_prefixes(order: np.ndarray, codes: np.ndarray, rounds: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``; -1 at both ends."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    size = np.zeros(n - 1, np.int32)
    for width, rank in [*reversed(rounds), *[(1, codes)] * (rounds[0][0] - 1)]:
        same = np.flatnonzero(rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        same = same[(a[same] < n) & (b[same] < n)]
        size[same] += width
        a[same] += width
        b[same] += width
    return np.concatenate([[-1], size, [-1]]).astype(np.int32)


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place with a value of 0 or more, the last place before it with a smaller one."""
    at = np.arange(len(values), dtype=np.int64) - 1
    open_ = np.flatnonzero(values >= 0)
    while len(open_):
        open_ = open_[values[at[open_]] >= values[open_]]
        at[open_] = at[at[open_]]
    return at


class FMIndex:
    """Index of ``codes``: texts of symbols >= 1, each followed by a 0, owned by ``owner``."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray) -> None:
        n = self.length = len(codes)
        ends = np.flatnonzero(codes == 0)
        longest = int(np.diff(np.concatenate([[-1], ends])).max())
        bits = max(1, int(codes.max()).bit_length())
        width = max(1, 62 // bits)
        packed = np.zeros(n, np.int64)
        for j in range(width):
            packed <<= bits
            packed[: max(n - j, 0)] |= codes[j:]
        order, rank = _ranks(packed)
        rounds = [(width, rank.astype(np.int32))]
        while width < longest and int(rank.max()) < n - 1:
            order, rank = _ranks(_pairs(rank, width))
            width *= 2
            rounds.append((width, rank.astype(np.int32)))
        self.common = _common_prefixes(order, codes, rounds)
        self.before = _smaller_before(self.common).astype(np.int32)
        self.after = (n - _smaller_before(self.common[::-1])[::-1]).astype(np.int32)
        # end of the run of one owner that a place in suffix order lies in
        owners = owner[order]
        changes = np.append(np.flatnonzero(owners[1:] != owners[:-1]) + 1, n)
        self.run_end = changes[np.searchsorted(changes, np.arange(n), side="right")].astype(np.int32)
        self.matrix = WaveletMatrix(codes[order - 1], bits)
        sizes = np.bincount(codes, minlength=1 << bits)
        symbols = np.arange(1 << bits)
        self.shift = np.concatenate([[0], np.cumsum(sizes)[:-1]]) - self.matrix.descend(np.zeros(1 << bits, np.int64), symbols)

    def backward(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of symbol + match from the interval of the match."""
        both = self.matrix.descend(np.concatenate([lo, hi]), np.concatenate([symbol, symbol]))
        both += np.concatenate([self.shift[symbol]] * 2)
        return both[: len(lo)], both[len(lo) :]

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lo, hi, length) of the longest shorter match whose interval is a larger one."""
        edge = np.where(self.common[lo] >= self.common[hi], lo, hi)
        size = np.maximum(self.common[edge], 0)
        some = size > 0
        return np.where(some, self.before[edge], 0), np.where(some, self.after[edge], self.length), size

    def statistics(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each place of ``codes``, the length of the longest string from it on that
        stands in the index under two owners at least.

        ``start``, ``end`` bound the streamed texts, which are texts of the index, so that
        their own owner is always one of those found and an interval never runs empty.
        """
        found = np.zeros(len(codes), np.int32)
        sizes = end - start
        order = np.argsort(-sizes, kind="stable")
        end, sizes = end[order], sizes[order]
        active = len(order)
        lo, hi, size = np.zeros(active, np.int64), np.full(active, self.length, np.int64), np.zeros(active, np.int64)
        for step in range(int(sizes[0]) if active else 0):
            active = int(np.searchsorted(-sizes, -step, side="left"))
            lo, hi, size = lo[:active], hi[:active], size[:active]
            at = end[:active] - 1 - step
            symbol = codes[at]
            new_lo, new_hi = self.backward(lo, hi, symbol)
            short = np.flatnonzero(self.run_end[new_lo] >= new_hi)
            size += 1
            while len(short):
                # one owner only: the match before this character is shortened, if there is one
                ended = size[short] == 1
                gone = short[ended]
                new_lo[gone], new_hi[gone], size[gone] = 0, self.length, 0
                short = short[~ended]
                lo[short], hi[short], size[short] = self.parent(lo[short], hi[short])
                new_lo[short], new_hi[short] = self.backward(lo[short], hi[short], symbol[short])
                size[short] += 1
                short = short[self.run_end[new_lo[short]] >= new_hi[short]]
            lo, hi = new_lo, new_hi
            found[at] = size
        return found


def matching_statistics(texts: list[str], owners: np.ndarray, asked: np.ndarray) -> list[np.ndarray]:
    """For each text of ``asked`` (numbers of texts), the lengths of the longest matches from
    each of its characters on that a text of another owner has as well."""
    raw = np.frombuffer("\0".join(texts).encode("utf-32-le") + b"\0\0\0\0", np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(sizes + 1) - 1
    start = end - sizes
    ends = np.zeros(len(raw), bool)
    ends[end] = True
    # dense symbols; a NUL inside a text is a symbol like any other
    _, codes = np.unique(np.where(ends, 0, raw.astype(np.int64) + 1), return_inverse=True)
    codes = codes.astype(np.int64)
    lengths = FMIndex(codes, np.repeat(owners, sizes + 1)).statistics(codes, start[asked], end[asked])
    return [lengths[a:b] for a, b in zip(start[asked], end[asked], strict=True)]


def intervals(lengths: np.ndarray, threshold: int) -> list[tuple[int, int, int]]:
    """(first, last, longest) of the runs of places whose match reaches the threshold."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (lengths >= threshold).view(np.int8), [0]])))
    return [(int(a), int(b) - 1, int(lengths[a:b].max())) for a, b in zip(edge[::2], edge[1::2], strict=True)]
