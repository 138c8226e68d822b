"""A run-length index of many short texts, and matching statistics against it.

The index holds the Burrows-Wheeler transform of all texts (each ends with a terminator below every symbol), stored
as runs of equal symbols, with the suffix-array entries of both ends of each run. A pattern is read from its last
symbol to its first: while the symbol before the matched suffix is the run's symbol, one step of the run mapping
moves on; else the nearest run of that symbol above or below takes over, the one whose sampled suffix shares more with
the pattern, and the match shrinks to what they share. So every position of the pattern gets the length of its longest
match (up to a limit) and a place where it occurs, and only runs and samples are read. All patterns go step by step
side by side.

Symbols are bytes plus one; the terminator is 0. Seven symbols are packed into one word, so suffixes are sorted and
compared by words. An index holds less than `MAX_SYMBOLS` symbols, so that a suffix' rank, the rank of what follows and
its position sort as one number.
"""

from __future__ import annotations

import numpy as np

PACK = 7
MAX_SYMBOLS = 1 << 21


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts with a terminator after each, and the positions of the terminators."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(np.array([len(t) for t in texts], np.int64) + 1) - 1
    data[ends] = 0
    return data, ends


def packed(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of each position, its next seven symbols as one word, 0 from the terminator on."""
    out = np.zeros(len(symbols), np.int64)
    for k in range(PACK):
        out <<= 9
        n = max(0, len(symbols) - k)
        out[:n] += np.where(left[:n] > k, symbols[k:], 0)
    return out


def _to_end(ends: np.ndarray, n: int) -> np.ndarray:
    """Symbols from each position to its text's terminator."""
    sizes = np.diff(np.concatenate([[-1], ends]))
    return np.repeat(ends, sizes) - np.arange(n)


def _places(keys: np.ndarray) -> np.ndarray:
    """For each of some sorted keys, the place of the first that equals it."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def suffix_order(words: np.ndarray, left: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order (equal ones by position), and a class of each position: its next `width` symbols.

    A suffix' rank is the place of the first suffix that shares the symbols seen so far; these are doubled, and only
    suffixes that still share their rank are sorted again. `width` is `PACK` at least.
    """
    n, reach, first = len(words), PACK, True
    order = np.argsort(words)
    rank = np.empty(n, np.int64)
    rank[order] = _places(words[order])
    longest, classes = int(left.max(initial=0)) + 1, None
    while True:
        if classes is None and 2 * reach >= width:
            # the first and the last `reach` symbols of `width` tell all of them
            further = np.minimum(np.arange(n) + (width - reach), n - 1)
            classes = rank * (n + 1) + np.where(left > width - reach, rank[further] + 1, 0)
        sorted_rank = rank[order]
        tied = np.zeros(n, bool)
        tied[1:] = sorted_rank[1:] == sorted_rank[:-1]
        tied[:-1] |= tied[1:]
        spots = np.flatnonzero(tied)
        if classes is not None and (reach >= longest and not first or not len(spots)):
            return order, classes
        some = order[spots]
        behind = np.where(left[some] > reach, rank[np.minimum(some + reach, n - 1)] + 1, 0)
        key = np.sort((rank[some] << 42) + (behind << 21) + some)
        some, key = key & (MAX_SYMBOLS - 1), key >> 21
        order[spots] = some
        rank[some] = spots[_places(key)]
        reach, first = 2 * reach, False


class RunIndex:
    """Runs, samples and the earliest holder of every `width`-symbol string of some texts."""

    def __init__(self, texts: list[bytes], holders: np.ndarray, width: int):
        self.width = width
        symbols, ends = joined(texts)
        n = len(symbols)
        if n >= MAX_SYMBOLS:
            raise ValueError(f"{n} symbols in one index; less than {MAX_SYMBOLS} are handled")
        self.ends = ends
        left = _to_end(ends, n)
        self.words = packed(symbols, left)
        order, classes = suffix_order(self.words, left, width)
        before = np.where(np.isin(order, np.concatenate([[0], ends[:-1] + 1])), 0, symbols[order - 1])
        new = np.ones(n, bool)
        new[1:] = before[1:] != before[:-1]
        self.head = np.flatnonzero(new)
        self.size = n
        # marks of run heads, 64 in a word, and the heads before each word: a place's run by counting bits
        marks = np.zeros(-(-n // 64) * 64, np.uint8)
        marks[self.head] = 1
        self.marks = np.packbits(marks, bitorder="little").view(np.uint64)
        count = np.bitwise_count(self.marks).astype(np.int64)
        self.heads = np.cumsum(count) - count
        last = np.concatenate([self.head[1:], [n]]) - 1
        self.symbol = before[self.head]
        self.top, self.bottom = order[self.head], order[last]  # sampled run ends
        self.last = last
        length = last - self.head + 1
        runs = np.argsort(self.symbol, kind="stable")
        self.by_symbol = runs
        self.keys = self.symbol[runs] * (len(runs) + 1) + runs
        total = np.cumsum(length[runs]) - length[runs]
        # symbols below, plus equal symbols in runs above: where the run's first symbol leads
        self.leads = np.empty(len(runs), np.int64)
        self.leads[runs] = total
        # earliest holder of the string at each place of the texts, as runs along the texts
        owner = np.asarray(holders, np.int64)[np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[-1], ends])))]
        earliest = np.full(n, np.iinfo(np.int64).max)
        long = order[left[order] >= width]
        if len(long):
            cut = np.ones(len(long), bool)
            cut[1:] = classes[long[1:]] != classes[long[:-1]]
            starts = np.flatnonzero(cut)
            earliest[long] = np.minimum.reduceat(owner[long], starts)[np.cumsum(cut) - 1]
        changed = np.ones(n, bool)
        changed[1:] = earliest[1:] != earliest[:-1]
        self.change = np.flatnonzero(changed)
        self.first = earliest[self.change]

    @property
    def runs(self) -> int:
        return len(self.head)

    def earliest(self, place: np.ndarray) -> np.ndarray:
        """The smallest holder of the string that begins at each place."""
        return self.first[np.searchsorted(self.change, place, side="right") - 1]

    def run_of(self, row: np.ndarray) -> np.ndarray:
        """The run that holds each place of the transform."""
        word, bit = row >> 6, (row & 63).astype(np.uint64)
        upto = self.marks[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
        return self.heads[word] + np.bitwise_count(upto) - 1

    def _shared(self, words: np.ndarray, left: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many symbols pattern suffixes at `at` and text suffixes at `place` share, up to the width."""
        share = np.zeros(len(at), np.int64)
        on = np.arange(len(at))
        for k in range(0, self.width, PACK):
            differ = words[np.minimum(at[on] + k, len(words) - 1)] ^ self.words[np.minimum(place[on] + k, self.size - 1)]
            # the first of seven nine-bit symbols that differs, by the highest bit
            _, top = np.frexp((differ & ~(differ >> 1)).astype(np.float64))
            same = np.where(differ == 0, PACK, (63 - top) // 9)
            share[on] += same
            on = on[(same == PACK) & (left[at[on]] > k + PACK)]
            if not len(on):
                break
        return np.minimum(np.minimum(share, left[at]), self.width)

    def statistics(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every symbol of the patterns (joined, with terminators): match length up to the width, place; and the terminators."""
        symbols, ends = joined(texts)
        left = _to_end(ends, len(symbols))
        words = packed(symbols, left)
        length, place = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        sizes = np.diff(np.concatenate([[-1], ends])) - 1
        by_size = np.argsort(-sizes, kind="stable")
        row = np.zeros(len(texts), np.int64)  # place in the transform
        spot = np.full(len(texts), self.bottom[-1] if self.runs else 0)
        row[:] = self.size - 1
        matched = np.zeros(len(texts), np.int64)
        alive = int((sizes > 0).sum())
        step = 0
        r = len(self.by_symbol) + 1
        while alive:
            who = by_size[:alive]
            at = ends[who] - 1 - step
            c = symbols[at]
            j, p, m = row[who], spot[who], matched[who]
            run = self.run_of(j)
            miss = np.flatnonzero(self.symbol[run] != c)
            if len(miss):
                q = np.searchsorted(self.keys, c[miss] * r + run[miss])
                high = np.minimum(q, len(self.keys) - 1)
                low = np.maximum(q - 1, 0)
                below, above = self.by_symbol[high], self.by_symbol[low]
                has_below = (q < len(self.keys)) & (self.symbol[below] == c[miss])
                has_above = (q > 0) & (self.symbol[above] == c[miss])
                behind = at[miss] + 1
                share = self._shared(words, left, np.concatenate([behind, behind]), np.concatenate([self.top[below], self.bottom[above]]))
                share_below, share_above = np.where(has_below, share[: len(miss)], -1), np.where(has_above, share[len(miss) :], -1)
                take = share_below >= share_above
                best = np.maximum(share_below, share_above)
                found = best >= 0
                new_run = np.where(take, below, above)
                run[miss] = np.where(found, new_run, run[miss])
                j[miss] = np.where(found, np.where(take, self.head[below], self.last[above]), j[miss])
                p[miss] = np.where(found, np.where(take, self.top[below], self.bottom[above]), p[miss])
                m[miss] = np.where(found, np.minimum(m[miss], best), -1)
            ok = m >= 0
            m = np.where(ok, np.minimum(m + 1, self.width), 0)
            row[who] = np.where(ok, self.leads[run] + j - self.head[run], self.size - 1)
            spot[who] = np.where(ok, p - 1, self.bottom[-1])
            matched[who] = m
            length[at], place[at] = m, spot[who]
            step += 1
            alive = int(np.searchsorted(-sizes[by_size], -step, side="left"))
        return length, place, ends
