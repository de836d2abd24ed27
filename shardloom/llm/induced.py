"""External suffix sorting by induction, with common-prefix values.

A text of any size is sorted with a bounded amount of memory. What is proportional to the
text lies in arrays that are scratch files beyond a size (``Scratch``; unlinked files of the
task, as any operator's spill), and in disk-backed priority queues (``InductionQueue``).
A queue holds tuples of a suffix's position, the symbols before it, and its common prefix
with the tuple pushed before it to the same place. Tuples are pushed in the order of the
suffixes that induce them, so that a first-in first-out run for each range of symbols,
drained in the order of ranges, is a priority queue over (symbol, rank of the successor).

One level, after Karkkainen-Sanders, Nong-Zhang-Chan and Bingmann-Fischer-Osipov:

1. left-most S-type suffixes (LMS) are found; substrings from each to the next are sorted by
   words of a few symbols (distributed to runs that fit in memory) and named by rank;
2. unless all names differ, the string of names is sorted in the same way (recursion);
3. the order and the common prefixes (in names) of its suffixes give those of the LMS
   suffixes: the names in common are so many symbols, and only what follows is compared;
4. from them all L-type and from these all S-type suffixes are induced. The common prefix
   of two neighbours that were induced is one more than the least common prefix between
   those that induced them.

Symbols carried in a tuple spare the text: it is read in ascending order of positions, once
for several steps. Ranges of one symbol are drained in chunks; ranges of several symbols
(names) are closed under induction first and ordered as a whole, by doubling along the
chains inside. Common prefixes are exact up to ``cap`` and never above it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Symbols of the first level: 0 the end (once), 1 a separator, 2.. the bytes, and from
#: ``BYTES`` on those that no byte has; 511 fills words up.
BYTES, SYMBOLS = 258, 511
MEMORY = 48 << 20
#: Tuples handled at once.
CHUNK = 1 << 18
_BLOCK = 1 << 20


class Scratch:
    """Arrays in memory, or beyond an eighth of the budget in unlinked files."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.spilled = memory, 0

    def empty(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if size <= self.memory // 8:
            return np.empty(n, dtype=dtype)
        self.spilled += size
        with tempfile.TemporaryFile() as file:
            file.truncate(size)
            return np.memmap(file, dtype=dtype, mode="r+", shape=(n,))


def _take(array: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``array[at]``; a file is read in ascending order."""
    if not isinstance(array, np.memmap) or len(at) < 2:
        return np.asarray(array[at])
    order = np.argsort(at)
    out = np.empty(len(at), dtype=array.dtype)
    out[order] = array[at[order]]
    return out


def _put(array: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    if isinstance(array, np.memmap):
        order = np.argsort(at)
        at, values = at[order], values[order]
    array[at] = values


class InductionQueue:
    """Tuples (pos, pack, lcp) in first-in first-out order for each range of symbols; beyond
    a budget of memory all of them go to a scratch file, as one run for each range."""

    def __init__(self, ranges: int, dtype, memory: int):
        self.kinds = (np.dtype(dtype), np.dtype(np.uint64), np.dtype(np.uint16))
        self.most, self.held, self.file, self.spills = memory, 0, None, 0
        self.runs: list[list] = [[] for _ in range(ranges)]

    def push(self, at: int, pos: np.ndarray, pack: np.ndarray, lcp: np.ndarray) -> None:
        self.runs[at].append((pos, pack, lcp))
        self.held += 14 * len(pos)
        if self.held > self.most:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        self.spills += 1
        for runs in self.runs:
            first = next((i for i, r in enumerate(runs) if isinstance(r, tuple)), len(runs))
            if first == len(runs):
                continue
            columns = [np.concatenate(c) for c in zip(*runs[first:])]
            places = []
            for column, kind in zip(columns, self.kinds):
                places.append(self.file.tell())
                self.file.write(np.ascontiguousarray(column, dtype=kind).data)
            runs[first:] = [[places, 0, len(columns[0])]]
        self.held = 0

    def pop(self, at: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The first tuples of a range, ``most`` at most; None where it is empty."""
        runs, got, n = self.runs[at], [], 0
        while runs and n < most:
            run, left = runs[0], most - n
            if isinstance(run, tuple):
                size = len(run[0])
                got.append(tuple(c[:left] for c in run))
                if size > left:
                    runs[0] = tuple(c[left:] for c in run)
                else:
                    runs.pop(0)
                self.held -= 14 * min(size, left)
            else:
                places, a, b = run
                size, to = b - a, min(b, a + left)
                columns = []
                for place, kind in zip(places, self.kinds):
                    self.file.seek(place + a * kind.itemsize)
                    columns.append(np.frombuffer(self.file.read((to - a) * kind.itemsize), dtype=kind))
                got.append(tuple(columns))
                if to < b:
                    run[1] = to
                else:
                    runs.pop(0)
            n += min(size, left)
        if not got:
            return None
        return got[0] if len(got) == 1 else tuple(np.concatenate(c) for c in zip(*got))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Minima:
    """Least values of ranges of an array."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of values[low:high] for each pair; no range is empty."""
        out = np.empty(len(low), dtype=np.uint16)
        power = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in range(int(power.max(initial=-1)) + 1):
            if k:
                last = self.rows[k - 1]
                if len(self.rows) == k:
                    self.rows.append(np.minimum(last[: -(1 << (k - 1))], last[1 << (k - 1) :]))
            at = np.flatnonzero(power == k)
            if len(at):
                row = self.rows[k]
                out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out


class _Carry:
    """For the chunks of one symbol: the least common prefix since the last push to a place."""

    def __init__(self) -> None:
        self.symbols = np.zeros(0, dtype=np.int64)
        self.least = np.zeros(0, dtype=np.uint16)

    def before(self, symbols: np.ndarray) -> np.ndarray:
        out = np.zeros(len(symbols), dtype=np.uint16)  # another symbol came first: nothing in common
        if len(self.symbols):
            at = np.minimum(np.searchsorted(self.symbols, symbols), len(self.symbols) - 1)
            known = self.symbols[at] == symbols
            out[known] = self.least[at[known]]
        return out

    def turn(self, chunk_least: int, symbols: np.ndarray, least: np.ndarray) -> None:
        np.minimum(self.least, np.uint16(chunk_least), out=self.least)
        if not len(symbols):
            return
        at = np.searchsorted(self.symbols, symbols)
        known = np.zeros(len(symbols), dtype=bool)
        inside = at < len(self.symbols)
        known[inside] = self.symbols[at[inside]] == symbols[inside]
        self.least[at[known]] = least[known]
        if not known.all():
            merged = np.concatenate([self.symbols, symbols[~known]])
            order = np.argsort(merged)
            self.symbols, self.least = merged[order], np.concatenate([self.least, least[~known]])[order]


class Level:
    """A string of symbols that ends with its only 0, and the ranges its symbols are dealt to:
    ``bounds`` has the first symbol of each, and one past the last symbol at the end."""

    def __init__(self, text: np.ndarray, bits: int, bounds: np.ndarray, cap: int, scratch: Scratch, chunk: int):
        self.text, self.bits, self.bounds, self.cap = text, bits, bounds, cap
        self.scratch, self.chunk = scratch, chunk
        self.block = min(_BLOCK, max(256, 4 * chunk))  # symbols that are scanned at once
        self.n, self.depth = len(text), 63 // bits
        self.index = np.dtype(np.int32 if self.n < 1 << 31 else np.int64)
        self.pad = (1 << bits) - 1

    # -- reading the text

    def packs(self, pos: np.ndarray) -> np.ndarray:
        """The symbols before each position, the nearest in the lowest bits, below a mark. A
        position of 0 has the symbol 0 before it, past which nobody looks."""
        order = np.argsort(pos) if isinstance(self.text, np.memmap) and len(pos) > 1 else slice(None)
        at = pos[order].astype(np.int64)
        found = np.full(len(at), 1, dtype=np.uint64)
        for k in range(self.depth, 0, -1):
            found = found << np.uint64(self.bits) | self.text[np.maximum(at - k, -1)].astype(np.uint64)
        out = np.empty_like(found)
        out[order] = found
        return out

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
        """Symbols that the suffixes at ``a`` and ``b`` have in common, ``most`` at most."""
        out = np.zeros(len(a), dtype=np.int64)
        most = np.broadcast_to(most, len(a))
        alive, k = np.arange(len(a)), 0
        while len(alive):
            alive = alive[most[alive] > k]
            same = _take(self.text, a[alive] + k) == _take(self.text, b[alive] + k)
            out[alive[~same]] = k
            alive, k = alive[same], k + 1
            reached = most[alive] <= k
            out[alive[reached]] = most[alive[reached]]
            alive = alive[~reached]
        return out

    def lms(self) -> np.ndarray:
        """Ascending positions of left-most S-type suffixes; the last is that of the end."""
        found = self.scratch.empty(self.n // 2 + 1, self.index)
        at, later_symbol, later_s = len(found), -1, True
        carry_lms = None  # whether the first position of the block to the right is S-type
        for a in range((self.n - 1) // self.block * self.block, -1, -self.block):
            part = np.asarray(self.text[a : a + self.block]).astype(np.int64)
            following = np.append(part[1:], later_symbol)
            m = len(part)
            turn = np.where(following != part, np.arange(m), m)
            turn = np.minimum.accumulate(turn[::-1])[::-1]
            inside = turn < m
            is_s = np.full(m, later_s)
            is_s[inside] = following[turn[inside]] > part[turn[inside]]
            if carry_lms is None:
                is_s[-1] = True
                # positions that equal the end don't exist: the end is the only 0
            here = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
            if carry_lms and not is_s[-1]:
                here = np.append(here, m)
            at -= len(here)
            found[at : at + len(here)] = here + a
            later_symbol, later_s, carry_lms = int(part[0]), bool(is_s[0]), bool(is_s[0])
        return found[at:]

    # -- naming

    def _words(self, lms: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """The ``step``-th word of each LMS substring, filled with the largest symbol."""
        order = np.argsort(j) if isinstance(self.text, np.memmap) and len(j) > 1 else slice(None)
        some = j[order]
        end = np.asarray(lms[np.minimum(some + 1, len(lms) - 1)]).astype(np.int64)
        at = np.asarray(lms[some]).astype(np.int64) + step * self.depth
        found = np.zeros(len(some), dtype=np.uint64)
        for k in range(self.depth):
            symbol = np.where(at + k <= end, self.text[np.minimum(at + k, end)], self.pad)
            found = found << np.uint64(self.bits) | symbol.astype(np.uint64)
        out = np.empty_like(found)
        out[order] = found
        return out

    def _ended(self, words: np.ndarray) -> np.ndarray:
        return words & np.uint64(self.pad) == self.pad

    def _sort_run(self, lms: np.ndarray, words: np.ndarray, j: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """A run that fits in memory: j in order, and where another substring begins."""
        order = np.argsort(words)
        j, words = j[order], words[order]
        fresh = np.r_[True, words[1:] != words[:-1]]
        at = np.arange(len(j))
        while True:
            several = ~(fresh[at] & np.r_[fresh, True][at + 1])
            keep = several & ~self._ended(words)
            at = at[keep]
            if not len(at):
                return j, fresh
            step += 1
            group = np.cumsum(fresh)[at]
            words = self._words(lms, j[at], step)
            order = np.lexsort((words, group))
            j[at], words = j[at][order], words[order]
            fresh[at[1:]] |= (group[1:] == group[:-1]) & (words[1:] != words[:-1])

    def _sorted(self, lms: np.ndarray, words: np.ndarray, j: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of LMS numbers in order, of the substrings that agree up to word ``step``."""
        most = 2 * self.chunk
        if len(j) <= most:
            if len(j):
                yield self._sort_run(lms, np.array(words), np.array(j), step)
            return
        pick = np.random.default_rng(len(j)).integers(0, len(j), 4096)
        sample = np.sort(np.asarray(words[np.sort(pick)]))
        splits = np.unique(sample[:: max(1, 4096 * self.chunk // len(j))])
        bucket_of = lambda w: np.searchsorted(splits, w, "left") + np.searchsorted(splits, w, "right")
        blocks = [slice(a, a + self.block) for a in range(0, len(j), self.block)]
        sizes = sum(np.bincount(bucket_of(words[b]), minlength=2 * len(splits) + 1) for b in blocks)
        ends = np.cumsum(sizes)
        fill = (ends - sizes).tolist()
        dealt, owner = self.scratch.empty(len(j), np.uint64), self.scratch.empty(len(j), j.dtype)
        for b in blocks:
            at = bucket_of(words[b])
            order = np.argsort(at, kind="stable")
            w, x, at = np.asarray(words[b])[order], np.asarray(j[b])[order], at[order]
            cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]).tolist()
            for a, z in zip(cuts, cuts[1:]):
                to = fill[at[a]]
                dealt[to : to + z - a], owner[to : to + z - a] = w[a:z], x[a:z]
                fill[at[a]] = to + z - a
        for bucket, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
            w, x = dealt[end - size : end], owner[end - size : end]
            if not size:
                continue
            if bucket % 2 == 0 or size == 1:
                yield from self._sorted(lms, w, x, step)
            elif self._ended(w[:1])[0]:  # one name, however many
                for a in range(0, size, self.chunk):
                    some = np.array(x[a : a + self.chunk])
                    yield some, np.arange(a, a + len(some)) == 0
            else:
                yield from self._sorted(lms, self._all_words(lms, x, step + 1), x, step + 1)

    def _all_words(self, lms: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        out = self.scratch.empty(len(j), np.uint64)
        for a in range(0, len(j), self.chunk):
            out[a : a + self.chunk] = self._words(lms, np.asarray(j[a : a + self.chunk]), step)
        return out

    def names(self, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """The name of each LMS substring in text order, bounds of ranges of names, and the
        order of the LMS suffixes if all names differ."""
        k = len(lms)
        names, order, starts = (self.scratch.empty(k, self.index) for _ in range(3))
        j = self.scratch.empty(k, self.index)
        for a in range(0, k, self.block):
            j[a : a + self.block] = np.arange(a, min(k, a + self.block))
        done = name = 0
        for some, fresh in self._sorted(lms, self._all_words(lms, j, 0), j, 0):
            number = name - 1 + np.cumsum(fresh)
            _put(names, some, number.astype(self.index))
            order[done : done + len(some)] = some
            at = np.flatnonzero(fresh)
            starts[name : name + len(at)] = at + done
            name, done = name + len(at), done + len(some)
        if name == k:
            return names, np.zeros(0, dtype=np.int64), order
        bounds = [np.zeros(1, dtype=np.int64)]
        for a in range(0, name, self.block):
            begin = np.asarray(starts[max(a - 1, 0) : min(name, a + self.block)]).astype(np.int64)
            after = int(starts[a + self.block]) if a + self.block < name else k
            heavy = np.diff(np.append(begin, after)) * 2 >= self.chunk
            turns = begin // self.chunk
            cut = np.flatnonzero((turns[1:] != turns[:-1]) | heavy[1:] | heavy[:-1]) + 1
            bounds.append(cut + max(a - 1, 0))
        bounds.append(np.array([name]))
        return names, np.unique(np.concatenate(bounds)), None

    # -- induction

    def _push(self, queue: InductionQueue, pos, pack, lcp, meant, carry: _Carry | None) -> None:
        """Push the predecessors of the items ``meant`` (their places) of a chunk."""
        symbols = (pack[meant] & np.uint64(self.pad)).astype(np.uint16 if self.bits <= 16 else np.int64)
        first = np.zeros(0, dtype=np.int64)
        if len(meant):
            order = np.argsort(symbols, kind="stable")
            symbols, meant = symbols[order], meant[order]
            fresh = np.r_[True, symbols[1:] != symbols[:-1]]
            first = np.flatnonzero(fresh)
            before = np.empty(len(meant), dtype=np.uint16)
            later = np.flatnonzero(~fresh)
            if len(later):
                before[later] = _Minima(lcp)(meant[later - 1] + 1, meant[later] + 1)
            low = np.minimum.accumulate(lcp)
            known = carry.before(symbols[first].astype(np.int64)) if carry else np.uint16(0)
            before[first] = np.minimum(low[meant[first]], known)
            before = np.minimum(before.astype(np.int64) + 1, self.cap).astype(np.uint16)
            new_pos, new_pack = pos[meant] - self.index.type(1), pack[meant] >> np.uint64(self.bits)
            home = np.searchsorted(self.bounds, symbols[first], "right") - 1
            ends = np.append(first[1:], len(meant))
            cuts = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
            for at, a, z in zip(home[cuts].tolist(), first[cuts].tolist(), [*first[cuts[1:]].tolist(), len(meant)]):
                queue.push(at, new_pos[a:z], new_pack[a:z], before[a:z])
        if carry is not None:
            rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint16(self.cap))
            last = meant[ends - 1] if len(first) else first
            carry.turn(int(rest[0]), symbols[first].astype(np.int64), rest[last + 1])

    def _refill(self, pos: np.ndarray, pack: np.ndarray) -> np.ndarray:
        spent = np.flatnonzero(pack == 1)
        if len(spent):
            pack = pack.copy()
            pack[spent] = self.packs(pos[spent])
        return pack

    def induce(self, seeds, forward: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """Chunks (pos, pack, lcp, own, range) of the suffixes in order, ascending from LMS
        suffixes to L-type ones (``forward``), or descending from L-type to S-type ones.
        ``seeds(r)`` gives chunks (pos, pack, lcp) of those of a range in this order."""
        n_ranges = len(self.bounds) - 1
        queue = InductionQueue(n_ranges, self.index, self.scratch.memory // 4)
        for r in range(n_ranges) if forward else range(n_ranges - 1, -1, -1):
            low, high = int(self.bounds[r]), int(self.bounds[r + 1])
            if high - low == 1:
                yield from self._one_symbol(queue, seeds(r), low, r, forward)
            else:
                yield from self._many_symbols(queue, list(seeds(r)), low, high, r, forward)
        queue.close()

    def _one_symbol(self, queue: InductionQueue, seeds, symbol: int, r: int, forward: bool):
        carry, last = _Carry(), -1
        while (got := queue.pop(r, self.chunk)) is not None:
            pos, pack, lcp = got
            pack, lcp = self._refill(pos, pack), np.array(lcp)
            if last < 0:
                lcp[0] = 0
            before = pack & np.uint64(self.pad)
            meant = np.flatnonzero(before >= symbol if forward else (before <= symbol) & (before > 0))
            self._push(queue, pos, pack, lcp, meant, carry)
            last = int(pos[-1])
            yield pos, pack, lcp, np.ones(len(pos), dtype=bool), r
        first = True
        for pos, pack, lcp in seeds:
            if not len(pos):
                continue
            lcp = np.array(lcp)
            if first:
                lcp[0] = self.common(np.array([last]), pos[:1].astype(np.int64), self.cap)[0] if last >= 0 else 0
            before = pack & np.uint64(self.pad)
            meant = np.flatnonzero(before > symbol if forward else (before < symbol) & (before > 0))
            self._push(queue, pos, pack, lcp, meant, carry)
            first = False
            yield pos, pack, lcp, np.zeros(len(pos), dtype=bool), r

    def _many_symbols(self, queue: InductionQueue, seeds: list, low: int, high: int, r: int, forward: bool):
        parts = [(*got, True) for got in [queue.pop(r, 1 << 62)] if got is not None] + [(*s, False) for s in seeds]
        if not parts:
            return
        pos, pack, f = (np.concatenate([p[i] for p in parts]) for i in range(3))
        own = np.concatenate([np.full(len(p[0]), p[3]) for p in parts])
        pack = self._refill(pos, pack)
        rank = lambda s: s - low if forward else high - 1 - s
        place = 2 * rank(_take(self.text, pos).astype(np.int64)) + ~own
        order = np.argsort(place, kind="stable")
        pos, pack, f, own, place = pos[order], pack[order], f[order], own[order], place[order]
        f[np.r_[True, place[1:] != place[:-1]]] = 0
        n0 = len(pos)
        # everything that these induce inside the range
        all_pos, all_pack, all_place, parent = [pos], [pack], [place], [np.full(n0, -1)]
        base, now = 0, (pos, pack, place, own)
        while True:
            now_pos, now_pack, now_place, now_own = now
            before = (now_pack & np.uint64(self.pad)).astype(np.int64)
            own_rank, new_rank = now_place >> 1, rank(before)
            meant = np.flatnonzero((before > 0) & (before >= low) & (before < high) & ((new_rank > own_rank) | now_own & (new_rank == own_rank)))
            if not len(meant):
                break
            new_pos = now_pos[meant] - self.index.type(1)
            new_pack = self._refill(new_pos, now_pack[meant] >> np.uint64(self.bits))
            parent.append(meant + base)
            base += len(now_pos)
            now = new_pos, new_pack, 2 * new_rank[meant], np.ones(len(meant), dtype=bool)
            for have, x in zip((all_pos, all_pack, all_place), now):
                have.append(x)
        lcp = f
        if len(all_pos) > 1:
            pos, pack, place, parent_of = (np.concatenate(x) for x in (all_pos, all_pack, all_place, parent))
            own = np.concatenate([own, np.ones(len(pos) - n0, dtype=bool)])
            order = self._order(place, parent_of, n0, len(all_pos))
            lcp = self._prefixes(pos, place, parent_of, n0, f, order)
            pos, pack, own, place = pos[order], pack[order], own[order], place[order]
        before = (pack & np.uint64(self.pad)).astype(np.int64)
        meant = np.flatnonzero(before >= high if forward else (before < low) & (before > 0))
        self._push(queue, pos, pack, lcp, meant, None)
        for a in range(0, len(pos), self.chunk):
            b = slice(a, a + self.chunk)
            yield pos[b], pack[b], lcp[b], own[b], r

    @staticmethod
    def _order(place: np.ndarray, parent: np.ndarray, n0: int, depth: int) -> np.ndarray:
        """The order of items by the places along their chains of parents, at the end of which
        stands the number of the item that has none; such an end comes before any place."""
        n = len(place)
        # letters: an end's number below n0, a place above; nodes: items, and their ends
        letter = np.concatenate([place + n0, np.arange(n0)])
        following = np.concatenate([np.where(parent >= 0, parent, n + np.arange(n)), n + np.arange(n0)])
        size, names = 1, letter
        while True:
            key = names[:n].astype(np.uint64) << np.uint64(22) | names[following[:n]].astype(np.uint64)
            order = np.argsort(key)
            size *= 2
            if size >= depth + 1:
                return order
            ordered = key[order]
            names = names.copy()
            names[order] = n0 + np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
            following = following[following]

    def _prefixes(self, pos, place, parent, n0: int, f: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The common prefix of each item with the one before it in ``order``."""
        out = np.zeros(len(order), dtype=np.int64)
        a, b = order[:-1], order[1:]
        at = np.flatnonzero(place[a] >> 1 == place[b] >> 1)
        a, b, steps = a[at], b[at], 0
        minima = _Minima(f)
        while len(at):
            seam = place[a] != place[b]  # one symbol, but one is a seed and the other is not
            if seam.any():
                out[at[seam] + 1] = steps + self.common(pos[a[seam]].astype(np.int64), pos[b[seam]].astype(np.int64), self.cap)
            ends_a, ends_b = parent[a] < 0, parent[b] < 0
            both = ends_a & ends_b & ~seam
            if both.any():
                out[at[both] + 1] = steps + minima(a[both] + 1, b[both] + 1)
            one = (ends_a ^ ends_b) & ~seam
            out[at[one] + 1] = steps + 1
            more = ~(ends_a | ends_b | seam)
            at, a, b, steps = at[more], parent[a[more]], parent[b[more]], steps + 1
            differ = place[a] >> 1 != place[b] >> 1
            out[at[differ] + 1] = steps
            at, a, b = at[~differ], a[~differ], b[~differ]
        return np.minimum(out, self.cap).astype(np.uint16)

    # -- a level as a whole

    def _lms_order(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of LMS suffixes in order, and their common prefixes."""
        lms = self.lms()
        names, bounds, order = self.names(lms)
        shared = None
        if order is None:
            deeper = Level(names, 31 if len(names) < 1 << 31 else 62, bounds, self.cap, self.scratch, self.chunk)
            order, shared = deeper.sort()
        found, lcp = self.scratch.empty(len(lms), self.index), self.scratch.empty(len(lms), np.uint16)
        for a in range(0, len(lms), self.chunk):
            now = np.asarray(order[a : a + self.chunk]).astype(np.int64)
            last = np.append(int(order[a - 1]) if a else int(now[0]), now[:-1])
            same = np.asarray(shared[a : a + self.chunk]).astype(np.int64) if shared is not None else np.zeros(len(now), dtype=np.int64)
            own, begin = _take(lms, now).astype(np.int64), _take(lms, last).astype(np.int64)
            go = _take(lms, last + same).astype(np.int64)
            known = np.minimum(go - begin, self.cap)
            left = self.cap - known
            if not a:
                left[0] = 0  # nothing stands before the first
            value = known + self.common(go, _take(lms, now + same).astype(np.int64), left)
            found[a : a + self.chunk], lcp[a : a + self.chunk] = own, value
        return found, lcp

    def descending(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks (pos, lcp) of all suffixes but the end, from the last to the first; lcp is
        what each has in common with the one before it here."""
        lms, lms_lcp = self._lms_order()
        ends, at = [0], 0
        for bound in self.bounds[1:].tolist():  # the first LMS suffix of the next range
            low, high = at, len(lms)
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if int(self.text[int(lms[mid])]) < bound else (low, mid)
            at = low
            ends.append(at)
        del bound

        def lms_seeds(r: int):
            for a in range(ends[r], ends[r + 1], self.chunk):
                b = slice(a, min(ends[r + 1], a + self.chunk))
                pos = np.asarray(lms[b])
                yield pos, self.packs(pos), np.asarray(lms_lcp[b])

        n_l = self.n  # as many L-type suffixes at most
        l_pos, l_pack, l_lcp = (self.scratch.empty(n_l, kind) for kind in (self.index, np.uint64, np.uint16))
        l_ends, done = np.zeros(len(self.bounds), dtype=np.int64), 0
        for pos, pack, lcp, own, r in self.induce(lms_seeds, True):
            at = np.flatnonzero(own)
            b = slice(done, done + len(at))
            l_pos[b], l_pack[b], l_lcp[b] = pos[at], pack[at], lcp[at]
            done += len(at)
            l_ends[r + 1] = done
        l_ends = np.maximum.accumulate(l_ends)

        def l_seeds(r: int):
            first, end = int(l_ends[r]), int(l_ends[r + 1])
            for z in range(end, first, -self.chunk):
                a = max(first, z - self.chunk)
                # in this direction an item's prefix is that of the one after it
                lcp = np.append(np.asarray(l_lcp[a + 1 : z]), l_lcp[z] if z < end else np.uint16(0))[::-1]
                yield np.asarray(l_pos[a:z])[::-1], np.asarray(l_pack[a:z])[::-1], lcp

        for pos, _, lcp, _, _ in self.induce(l_seeds, False):
            yield pos, lcp

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in ascending order, and what each has in common with the one before."""
        order, lcp = self.scratch.empty(self.n, self.index), self.scratch.empty(self.n + 1, np.uint16)
        at = self.n
        for pos, shared in self.descending():
            order[at - len(pos) : at] = pos[::-1]
            lcp[at - len(pos) + 1 : at + 1] = shared[::-1]
            at -= len(pos)
        order[0] = self.n - 1
        lcp[:2] = 0
        return order, lcp[: self.n]


def repeated_starts(text: np.ndarray, length: int, memory: int = MEMORY, chunk: int = CHUNK) -> np.ndarray:
    """Where ``text`` (uint16 symbols from 1, then one 0 at the end) has a run of ``length``
    symbols that also begins anywhere else: a mask, on disk beyond a part of ``memory``."""
    scratch = Scratch(memory)
    found = scratch.empty(len(text), bool)
    for a in range(0, len(text), _BLOCK):
        found[a : a + _BLOCK] = False
    if len(text) < 2:
        return found
    level = Level(text, 9, np.arange(SYMBOLS + 1), length, scratch, chunk)
    last = 0
    for pos, lcp in level.descending():
        same = np.flatnonzero(lcp >= length)
        before = np.append(last, pos[:-1])[same]
        _put(found, before, np.ones(len(same), dtype=bool))
        _put(found, pos[same], np.ones(len(same), dtype=bool))
        last = pos[-1]
    return found
