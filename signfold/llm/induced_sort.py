"""External suffix sorting by induction, with longest common prefixes.

Suffixes are L-type (greater than the next suffix) or S-type. Sorted leftmost-S suffixes (LMS) induce the L-type
ones in one ascending pass over the symbols, and those the S-type ones in one descending pass. A pass is driven by a
monotone priority queue of tuples (symbol, arrival, suffix, common prefix): what a popped suffix induces has a symbol
that is not passed yet, and arrives in sorted order within it. The number of tuples of each symbol is known from the
start, so the queue is a file with a stretch for every symbol, filled and read in ascending order; only queues within
the budget stay in memory.

The common prefix of a tuple is that with the tuple before it under the same symbol. It is carried, not compared:
what two suffixes induce has one symbol more in common than they have, and they have the smallest of the common
prefixes that were popped from the one to the other. Only where induced and given suffixes of a symbol meet are two
suffixes compared, once a symbol. Common prefixes are exact up to a limit.

LMS substrings are sorted by the same two passes and named; if names repeat, the string of names is sorted by
recursion, whatever its alphabet. Its common prefixes, counted in names, come back as numbers of symbols, and what
is left of the first names that differ is compared.

Tuples are popped a batch at a time: the symbols of a batch are those that no suffix of the batch induces into, so
its order is that of one tuple after the other. Where batches would be of few tuples, as among names that induce into
their neighbours, tuples are popped one by one for a stretch. Text, types and names are arrays in memory.
"""

from __future__ import annotations

import tempfile
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np

QUEUE_BYTES = 4 << 20
#: Most tuples of a batch.
BATCH = 1 << 16
#: Fewest tuples of a batch that a look ahead allows for.
LOOK = 64
#: A batch of fewer tuples takes longer than popping them one by one.
FEW = 128
#: Tuples that are popped one by one after a look ahead that found few, at first and at most.
STRETCH = (256, 4096)
#: Symbols that are compared at a time, after a first look at fewer.
STRIDE = 16


class TupleQueue:
    """Tuples by symbol, first in first out within a symbol. sizes: how many each symbol will get."""

    def __init__(self, sizes: np.ndarray, kind: type, budget: int):
        self.begin = np.concatenate(([0], np.cumsum(sizes)))
        self.end = self.begin[:-1].copy()
        n = int(self.begin[-1])
        self.on_disk = n * (4 + np.dtype(kind).itemsize) > budget
        self.suffix, self.common = (self._room(n, k) for k in (np.int32, kind))

    def _room(self, n: int, kind: type) -> np.ndarray:
        if not self.on_disk:
            return np.empty(n, dtype=kind)
        with tempfile.TemporaryFile() as f:
            return np.memmap(f, dtype=kind, mode="w+", shape=(n,))

    def push(self, symbols: np.ndarray, heads: np.ndarray, suffixes: np.ndarray, commons: np.ndarray) -> None:
        """Tuples sorted by symbol; heads: where each symbol's begin."""
        counts = np.diff(np.append(heads, len(symbols)))
        slots = np.arange(len(symbols)) + np.repeat(self.end[symbols[heads]] - heads, counts)
        self.suffix[slots], self.common[slots] = suffixes, commons
        self.end[symbols[heads]] += counts


def s_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is S-type; the empty suffix after the end counts as smallest, so the last one is L-type."""
    n = len(t)
    out = np.zeros(n, dtype=bool)
    if n > 1:
        rises, falls = t[:-1] < t[1:], t[:-1] > t[1:]
        decided = np.append(rises | falls, True)
        value = np.append(rises, False)
        # A tie has the type of the next position that is decided.
        at = np.where(decided, np.arange(n, dtype=np.int32), np.int32(n))
        at = np.minimum.accumulate(at[::-1])[::-1]
        out = value[at]
    return out


def compared(t: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, limit: int) -> np.ndarray:
    """Common prefixes of the suffixes a and b (pairwise different), of which `known` symbols are known, up to the limit."""
    out, n = np.minimum(known, limit).astype(np.int64), len(t)
    live, width = np.flatnonzero(out < limit), 4
    while len(live):
        step = np.arange(width)
        x, y = (p[live].astype(np.int64) + out[live] for p in (a, b))
        inside = n - np.maximum(x, y)
        x, y = (np.minimum(p[:, None] + step, n - 1) for p in (x, y))
        same = t[x] == t[y]
        more = np.minimum(np.where(same.all(axis=1), width, same.argmin(axis=1)), inside)
        out[live] = np.minimum(out[live] + more, limit)
        live = live[(more == width) & (out[live] < limit)]
        width = STRIDE
    return out


def range_minima(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest of x[lo..hi], ends included."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out, table = np.empty(len(lo), dtype=x.dtype), x
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[lo[here]], table[hi[here] - (1 << k) + 1])
    return out


class Pass:
    """One pass over the symbols of t in ascending order: under each symbol the suffixes that were induced, then the given ones."""

    def __init__(self, t: np.ndarray, wants: np.ndarray, sizes: np.ndarray, given: np.ndarray, given_commons: np.ndarray, limit: int, carry: bool, budget: int):
        """wants: suffixes whose predecessor is induced. given: in order, by symbol; their common prefixes are with the one before under the same symbol, 0 for the first."""
        self.t, self.wants, self.given, self.given_commons, self.limit, self.carry = t, wants, given, given_commons, limit, carry
        self.kind = np.uint8 if limit < 255 else np.uint32
        self.top = np.iinfo(self.kind).max
        self.queue = TupleQueue(sizes, self.kind, budget)
        self.given_begin = np.concatenate(([0], np.cumsum(np.bincount(t[given], minlength=len(sizes))))) if len(given) else np.zeros(len(sizes) + 1, np.int64)
        #: Tuples popped so far, and when the one was popped that pushed last under each symbol.
        self.popped, self.pushed = 0, np.full(len(sizes) if carry else 0, -1, dtype=np.int32)
        #: Popped common prefixes that no later one is as small as, ascending, and when they were popped.
        self.lows: list[int] = []
        self.low_times: list[int] = []
        self.rows = np.diff(self.queue.begin) + np.diff(self.given_begin)

    def begin(self, suffix: int) -> None:
        self.queue.push(self.t[suffix : suffix + 1], np.zeros(1, np.int64), np.array([suffix], np.int32), np.zeros(1, self.kind))

    def _seam(self, last: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Common prefixes of the last induced and the first given suffix of a symbol."""
        return compared(self.t, last, first, np.ones(len(last), np.int64), self.limit).astype(self.kind) if self.carry else np.zeros(len(last), self.kind)

    def _note(self, commons: np.ndarray) -> None:
        """Commons have been popped."""
        if self.carry and len(commons):
            rest = np.append(np.minimum.accumulate(commons[::-1])[::-1], self.kind(self.top))
            keep = bisect_left(self.lows, int(rest[0]))
            at = np.flatnonzero(rest[:-1] < rest[1:])
            self.lows[keep:], self.low_times[keep:] = rest[at].tolist(), (at + self.popped).tolist()
        self.popped += len(commons)

    def _induce(self, suffixes: np.ndarray, commons: np.ndarray) -> None:
        at = np.flatnonzero(self.wants[suffixes])
        if len(at):
            symbols = self.t[suffixes[at] - 1]
            order = np.argsort(symbols, kind="stable")
            at, symbols = at[order], symbols[order]
            new = np.ones(len(at), dtype=bool)
            new[1:] = symbols[1:] != symbols[:-1]
            heads = np.flatnonzero(new)
            carried = np.zeros(len(at), dtype=self.kind)
            if self.carry:
                lo = np.empty(len(at), dtype=np.int64)
                lo[1:] = at[:-1] + 1
                lo[heads] = 0
                carried = range_minima(commons, lo, at)
                first = symbols[heads]
                # The smallest common prefix popped since the last push under a symbol.
                since = np.array([*self.lows, self.top], dtype=self.kind)[np.searchsorted(np.array(self.low_times, dtype=np.int64), self.pushed[first], side="right")]
                carried[heads] = np.minimum(carried[heads], since)
                carried = np.minimum(carried, self.limit - 1) + self.kind(1)
                carried[heads[self.queue.end[first] == self.queue.begin[first]]] = 0
                self.pushed[first] = at[np.append(heads[1:], len(at)) - 1] + self.popped
            self.queue.push(symbols, heads, suffixes[at] - 1, carried)
        self._note(commons)

    def _singly(self, live: np.ndarray, k: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The symbols from live[k] on, tuple by tuple, for about `most` tuples or up to a symbol of more than FEW: their suffixes, common prefixes and the place of the first symbol that is left."""
        t, n, limit, carry, wants = memoryview(self.t), len(self.t), self.limit, self.carry, memoryview(self.wants)
        queued, shared, begin, end = (memoryview(x) for x in (self.queue.suffix, self.queue.common, self.queue.begin, self.queue.end))
        pushed, lows, times, now = memoryview(self.pushed), self.lows, self.low_times, self.popped
        suffixes: list[int] = []
        commons: list[int] = []

        def pop(x: int, common: int) -> None:
            nonlocal now
            suffixes.append(x)
            commons.append(common)
            if carry:
                while lows and lows[-1] >= common:
                    lows.pop()
                    times.pop()
                lows.append(common)
                times.append(now)
            if wants[x]:
                c, carried = t[x - 1], 0
                slot = end[c]
                if carry:
                    if slot > begin[c]:
                        carried = min(lows[bisect_right(times, pushed[c])], limit - 1) + 1
                    pushed[c] = now
                queued[slot], shared[slot] = x - 1, carried
                end[c] = slot + 1
            now += 1

        upto = min(len(live), k + most)
        symbols, rows = live[k:upto].tolist(), self.rows[live[k:upto]].tolist()
        for c, size in zip(symbols, rows):
            if size > FEW or len(suffixes) >= most:
                break
            at = begin[c]
            while at < end[c]:
                pop(queued[at], shared[at])
                at += 1
            g, stop = int(self.given_begin[c]), int(self.given_begin[c + 1])
            if g < stop:
                given, given_commons = self.given[g:stop].tolist(), self.given_commons[g:stop].tolist()
                if at > begin[c] and carry:
                    a, b, same = suffixes[-1], given[0], 1
                    room = min(limit, n - max(a, b))
                    while same < room and t[a + same] == t[b + same]:
                        same += 1
                    given_commons[0] = min(same, limit)
                for x, common in zip(given, given_commons):
                    pop(x, common)
            k += 1
        self.popped = now
        return np.array(suffixes, dtype=np.int32), np.array(commons, dtype=self.kind), k

    def _one(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All of one symbol, what it induces under itself included."""
        q, at, last = self.queue, int(self.queue.begin[c]), None
        while at < q.end[c]:
            to = min(int(q.end[c]), at + BATCH)
            batch = np.array(q.suffix[at:to]), np.array(q.common[at:to])
            last, at = batch[0][-1:], to
            yield batch
            self._induce(*batch)
        for a in range(int(self.given_begin[c]), int(self.given_begin[c + 1]), BATCH):
            to = min(a + BATCH, int(self.given_begin[c + 1]))
            batch = np.array(self.given[a:to]), np.array(self.given_commons[a:to], dtype=self.kind)
            if a == self.given_begin[c] and last is not None:
                batch[1][:1] = self._seam(last, batch[0][:1])
            yield batch
            self._induce(*batch)

    def _several(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Of the symbols lo <= c < hi as many as no suffix of theirs induces into: their suffixes, common prefixes and the first symbol that is left."""
        q, (a, b) = self.queue, (int(self.queue.begin[x]) for x in (lo, hi))
        filled = np.arange(a, b) < np.repeat(q.end[lo:hi], np.diff(q.begin[lo : hi + 1]))
        g = slice(int(self.given_begin[lo]), int(self.given_begin[hi]))
        induced, given = q.suffix[a:b][filled], self.given[g]
        suffixes = np.concatenate((induced, given))
        commons = np.concatenate((q.common[a:b][filled], self.given_commons[g].astype(self.kind)))
        symbols, kinds = self.t[suffixes].astype(np.int64), np.arange(len(suffixes)) >= len(induced)
        order = np.argsort(symbols * 2 + kinds, kind="stable")
        suffixes, commons, symbols, kinds = suffixes[order], commons[order], symbols[order], kinds[order]
        into = np.full(len(suffixes), hi, dtype=np.int64)
        some = self.wants[suffixes]
        into[some] = np.minimum(self.t[suffixes[some] - 1], hi)
        least = np.minimum.accumulate(into)
        late = np.flatnonzero(symbols >= least)
        stop = (least[-1] if len(least) else hi) if not len(late) else min(symbols[late[0]], least[late[0] - 1] if late[0] else hi)
        n = int(np.searchsorted(symbols, stop))
        suffixes, commons, symbols, kinds = suffixes[:n], commons[:n], symbols[:n], kinds[:n]
        seam = np.flatnonzero(kinds[1:] & ~kinds[:-1] & (symbols[1:] == symbols[:-1])) + 1
        commons[seam] = self._seam(suffixes[seam - 1], suffixes[seam])
        return suffixes, commons, int(stop)

    def run(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(suffixes, their common prefixes with the suffix before) in batches, in order."""
        live = np.flatnonzero(self.rows)
        ends, k, width, stretch = np.cumsum(self.rows[live]), 0, BATCH, STRETCH[0]
        while k < len(live):
            past, at = int(ends[k - 1]) if k else 0, k
            to = int(np.searchsorted(ends, past + width, side="right"))
            found = 0
            if to > k + 1:
                suffixes, commons, stop = self._several(int(live[k]), int(live[to - 1]) + 1)
                found = len(suffixes)
                # What one look finds is about what the next will: looks much wider than that are wasted.
                width = min(BATCH, 4 * max(found, LOOK))
                if stop > live[k]:
                    if found:
                        yield suffixes, commons
                        self._induce(suffixes, commons)
                    k = int(np.searchsorted(live, stop))
            if found >= max(FEW, 1):
                stretch = STRETCH[0]
            elif k < len(live) and self.rows[live[k]] <= FEW:
                suffixes, commons, k = self._singly(live, k, stretch)
                yield suffixes, commons
                stretch = min(2 * stretch, STRETCH[1])
            elif k == at:
                yield from self._one(int(live[k]))
                k, width = k + 1, max(width, 4 * LOOK)


def induced(t: np.ndarray, s: np.ndarray, seeds: np.ndarray, commons: np.ndarray, limit: int, carry: bool, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, in batches with the common prefix of each with the greater one before, from LMS suffixes in ascending order and theirs with the one before."""
    top = int(t.max())
    order = np.argsort(t[seeds], kind="stable")
    before = np.append(False, s[:-1])
    up = Pass(t, np.append(False, ~s[:-1]), np.bincount(t[~s], minlength=top + 1), seeds[order], commons[order], limit, carry, budget)
    up.begin(len(t) - 1)
    for _ in up.run():
        pass
    down = (top - t.astype(np.int64)).astype(t.dtype)
    with_next = np.append(up.queue.common[1:], np.zeros(1, up.kind))[::-1] if len(up.queue.common) else up.queue.common
    yield from Pass(down, before, np.bincount(down[s], minlength=top + 1), up.queue.suffix[::-1], with_next, limit, carry, budget).run()


def lms_order(t: np.ndarray, s: np.ndarray, lms: np.ndarray, limit: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """LMS suffixes in ascending order, and the common prefix of each with the one before."""
    n = len(t)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    # LMS substrings in order: the same passes, seeded by position.
    found = np.concatenate([x[is_lms[x]] for x, _ in induced(t, s, lms, np.zeros(len(lms), np.uint8), limit, False, budget)])[::-1]
    length = np.diff(np.append(lms, n))
    number = np.full(n, -1, dtype=np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    a, b = found[:-1], found[1:]
    la, lb = length[number[a]], length[number[b]]
    # An LMS substring reaches to the next one's first symbol, that included; the last ends with the string.
    same = (la == lb) & (a + la < n) & (b + lb < n)
    reach = int(la[same].max(initial=0)) + 1
    same[same] = compared(t, a[same], b[same], np.zeros(int(same.sum()), np.int64), reach) > la[same]
    names = np.empty(len(lms), dtype=np.int32)
    names[number[found]] = np.cumsum(np.append(0, ~same))
    if int(names.max()) + 1 == len(lms):
        order, shared = number[found], np.zeros(len(lms), np.int64)
    else:
        runs = list(suffix_runs(names, limit, budget))
        order = np.concatenate([x for x, _ in runs])[::-1]
        # Each one's common prefix is with the greater one before it; turned round, with the smaller one.
        shared = np.append(0, np.concatenate([c for _, c in runs])[:0:-1].astype(np.int64))
    ends, before = np.append(lms, n), np.append(order[:1], order[:-1])
    known = ends[np.minimum(before + shared, len(lms))] - lms[before]
    commons = compared(t, lms[before][1:], lms[order][1:], known[1:], limit)
    # Under another symbol nothing is shared, so that a pass finds 0 for the first of each.
    return lms[order], np.append(0, commons)


def suffix_runs(t: np.ndarray, limit: int = 200, budget: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of an integer string of less than 2**31 symbols in descending order, in batches; and the symbols, up to the limit, that each has in common with the suffix before it (0 for the first)."""
    t, budget = np.asarray(t), QUEUE_BYTES if budget is None else budget
    if not len(t):
        return
    s = s_types(t)
    lms = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)
    order, commons = (lms, np.zeros(len(lms), np.int64)) if len(lms) < 2 else lms_order(t, s, lms, limit, budget)
    yield from induced(t, s, order, commons, limit, True, budget)


def suffix_array(t: np.ndarray, limit: int = 200, budget: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in ascending order, and the common prefix of each but the first with the one before."""
    runs = list(suffix_runs(np.asarray(t), limit, budget))
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, commons = (np.concatenate(x) for x in zip(*runs))
    return order[::-1], commons[:0:-1].astype(np.int64)
