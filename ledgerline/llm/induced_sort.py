"""Suffix array and common prefixes of one shard by induced sorting in bulk.

Suffixes are induced in the order of the classic two passes: from the sorted
leftmost-S suffixes all L-type ones, upwards, then from these all S-type ones,
downwards.  The suffixes that wait for their turn are in a priority queue keyed
by (first character, rank of the next suffix).  As they arrive in rank order,
the queue keeps one first-in-first-out file per character; arrays beyond a
memory budget go to disk.  A queue entry is a suffix and the length of its
common prefix with the entry before it in its bucket, which is one more than
the smallest common prefix between the two suffixes that induced them.  All
that waits for a character is induced from at once, up to ``CHUNK`` entries.

The leftmost-S substrings are sorted by their characters, a word of 64 bits at
a time, and named; if names repeat, the string of names is sorted by prefix
doubling.  The ranks of its rounds also tell how many names two neighbours
share, which gives their common prefix.

A character is a byte + 2; 1 ends a string, and a single 0 ends the shard.
Common prefixes are counted up to ``CAP``.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

CAP = 250
CHUNK = 1 << 20                  # entries that are induced from at a time
QUEUE_BYTES = 256 << 20          # queued entries in memory


class DiskQueue:
    """One first-in-first-out queue of (suffix, common prefix) per character."""

    def __init__(self, characters: int, budget: int, kind: type = np.int64):
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(characters)]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(characters)]
        self.budget, self.bytes, self.file, self.kind = budget, 0, None, np.dtype(kind)

    def push(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.held[c].append((pos, lcp))
        self.bytes += pos.nbytes + lcp.nbytes
        if self.bytes > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()         # the task's own scratch; a lost task starts anew
        self.file.seek(0, os.SEEK_END)
        for c, parts in enumerate(self.held):
            for pos, lcp in parts:
                self.spilled[c].append((self.file.tell(), len(pos)))
                self.file.write(pos.tobytes())
                self.file.write(lcp.tobytes())
            parts.clear()
        self.bytes = 0

    def pop(self, c: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The oldest arrays of a character's queue: one, and more up to ``CHUNK`` entries."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        have = taken = 0
        for at, n in self.spilled[c]:
            if out and have + n > CHUNK:
                break
            self.file.seek(at)
            out.append((np.frombuffer(self.file.read(self.kind.itemsize * n), self.kind), np.frombuffer(self.file.read(n), np.uint8)))
            have += n
        taken = len(out)
        if taken == len(self.spilled[c]):                  # what is held came later
            for pos, lcp in self.held[c]:
                if out and have + len(pos) > CHUNK:
                    break
                out.append((pos, lcp))
                have += len(pos)
                self.bytes -= pos.nbytes + lcp.nbytes
            del self.held[c][:len(out) - taken]
        del self.spilled[c][:taken]
        if len(out) < 2:
            return out[0] if out else None
        return np.concatenate([pos for pos, _ in out]), np.concatenate([lcp for _, lcp in out])


class Shard:
    def __init__(self, text: np.ndarray, budget: int = QUEUE_BYTES):
        """``text``: characters as unsigned 16-bit numbers, the only 0 at the end."""
        self.n, self.budget = len(text), budget
        self.characters = 258
        self.kind = np.int32 if self.n < 1 << 31 else np.int64
        # the text in its smallest type, whose largest number isn't a character
        self.t = t = text.astype(np.uint8 if int(text.max()) < 255 else np.uint16)
        self.none = np.iinfo(t.dtype).max
        self.per = 8 // t.itemsize                         # characters of a word
        raw = np.zeros(self.n + 2 * self.per, t.dtype.newbyteorder(">"))
        raw[:self.n] = t
        self.words = np.ndarray(self.n + self.per, ">u8", raw, strides=(t.itemsize,))
        # type of each suffix: S where the next different character is larger
        differs = np.flatnonzero(t[:-1] != t[1:])          # the end differs from what stands before it
        s = np.ones(self.n, bool)
        s[:-1] = np.repeat(t[differs] < t[differs + 1], np.diff(np.concatenate([[-1], differs])))
        self.s = s
        self.lms = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(self.kind)
        self.bucket = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=self.characters))])

    def word(self, at: np.ndarray) -> np.ndarray:
        """The next characters of the suffixes, in an order-preserving number."""
        return self.words[at].astype(np.uint64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Characters that the different suffixes at a and b share, up to ``CAP``; a word at a time."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        k = 0
        while len(live):
            x = self.word(a[live] + k) ^ self.word(b[live] + k)
            same = np.zeros(len(live), np.int64)
            for j in range(self.per):
                same += x < np.uint64(1 << 64 - (j + 1) * (64 // self.per))
            out[live] = k + same
            k += self.per
            live = live[(same == self.per) & (k < CAP)]
        return np.minimum(out, CAP)

    def _scan(self, pos: np.ndarray, lcp: np.ndarray, queue: DiskQueue, pend: np.ndarray, before: np.ndarray) -> None:
        """Queue the suffixes that stand before those at ``pos``; ``before``
        tells their first characters, or ``none`` if they aren't of the induced type."""
        for at in range(0, len(pos), CHUNK):
            p, low = pos[at:at + CHUNK], lcp[at:at + CHUNK]
            char = before[p]
            where = np.flatnonzero(char != self.none)
            char = char[where]
            least = np.minimum(pend, low.min())
            if len(where):
                by = np.argsort(char, kind="stable")
                where = where[by]
                counts = np.bincount(char, minlength=self.characters)
                kinds = np.flatnonzero(counts)
                ends = np.cumsum(counts[kinds])
                first = ends - counts[kinds]
                since = np.empty(len(where), np.int64)     # after the entry of the same character before
                since[1:] = where[:-1] + 1
                since[first] = 0
                value = _range_min(low, since, where)
                value[first] = np.minimum(value[first], pend[kinds])
                value = np.minimum(value, CAP - 1) + np.uint8(1)
                tail = np.append(np.minimum.accumulate(low[::-1])[::-1], np.uint8(CAP))
                least[kinds] = tail[where[ends - 1] + 1]
                ready = p[where] - self.kind(1)
                for c, a, b in zip(kinds.tolist(), first.tolist(), ends.tolist(), strict=True):
                    queue.push(c, ready[a:b], value[a:b])
            pend[:] = least

    def induce(self, seeds: np.ndarray, seed_lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order from the sorted leftmost-S ones, and each
        one's common prefix with the one before."""
        sa, out = np.empty(self.n, self.kind), np.zeros(self.n, np.uint8)
        seed_at = np.concatenate([[0], np.cumsum(np.bincount(self.t[seeds], minlength=self.characters))])
        large = np.bincount(self.t[~self.s], minlength=self.characters)
        before = np.full(self.n, self.none, self.t.dtype)
        # upwards: L-type suffixes
        before[1:] = np.where(self.s[:-1], self.none, self.t[:-1])
        queue, pend = DiskQueue(self.characters, self.budget, self.kind), np.zeros(self.characters, np.uint8)
        for c in range(self.characters):
            at, last = int(self.bucket[c]), -1
            while (entry := queue.pop(c)) is not None:
                pos, lcp = entry
                if last < 0:
                    lcp = lcp.copy()
                    lcp[0] = 0                             # the first of its bucket
                sa[at:at + len(pos)], out[at:at + len(pos)] = pos, lcp
                at, last = at + len(pos), int(pos[-1])
                self._scan(pos, lcp, queue, pend, before)
            a, b = int(seed_at[c]), int(seed_at[c + 1])
            if a < b:
                lcp = seed_lcp[a:b].copy()
                lcp[0] = 0 if last < 0 else self.common(np.array([last]), seeds[a:a + 1])[0]
                self._scan(seeds[a:b], lcp, queue, pend, before)
        # downwards: S-type suffixes; the common prefix of an entry is that with the one above it
        before[1:] = np.where(self.s[:-1], self.t[:-1], self.none)
        queue, pend = DiskQueue(self.characters, self.budget, self.kind), np.zeros(self.characters, np.uint8)
        for c in range(self.characters - 1, -1, -1):
            low, high = int(self.bucket[c]), int(self.bucket[c + 1])
            at, last = high, -1
            if c == 0:                                     # the end alone is the smallest suffix
                sa[0] = self.n - 1
            while (entry := queue.pop(c)) is not None:
                pos, lcp = entry
                if last < 0:
                    lcp = lcp.copy()
                    lcp[0] = 0
                m = len(pos)
                sa[at - m:at] = pos[::-1]
                # entry j's value belongs to the suffix above it
                out[at - m + 1:min(at + 1, high)] = lcp[::-1][:m if at < high else m - 1]
                at, last = at - m, int(pos[-1])
                self._scan(pos, lcp, queue, pend, before)
            m = int(large[c])
            if m:
                pos = sa[low:low + m][::-1]
                # going down, an entry's common prefix is with the entry just seen: the value of the one above
                lcp = np.zeros(m, np.uint8)
                lcp[1:] = out[low + 1:low + m][::-1]
                if last >= 0:
                    lcp[0] = self.common(np.array([last]), pos[:1])[0]
                    out[low + m] = lcp[0]
                self._scan(pos, lcp, queue, pend, before)
        return sa, out

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Order of the leftmost-S substrings, and for each in this order
        whether it differs from the one before.  What is compared ends with
        the first character of the next one; where one ends and another goes
        on, the latter goes on with an L-type suffix and is the smaller."""
        lms = self.lms
        length = np.append(np.diff(lms) + 1, 1)

        def word(i: np.ndarray, k: int) -> np.ndarray:
            left = np.minimum(length[i] - k, self.per)
            beyond = np.append(~np.uint64(0) >> (np.arange(self.per) * (64 // self.per)).astype(np.uint64), np.uint64(0))
            return self.word(lms[i] + self.kind(k)) | beyond[left]

        w = word(np.arange(len(lms)), 0)
        order = np.argsort(w)
        w = w[order]
        fresh = np.append(True, w[1:] != w[:-1])
        k = self.per
        while True:
            # equal so far; one that has just ended may still stand beside longer ones
            live = np.flatnonzero(~(fresh & np.append(fresh[1:], True)) & (length[order] >= k))
            if not len(live):
                return order, fresh
            i, group = order[live], np.cumsum(fresh)[live]
            w = word(i, k)
            by = np.lexsort((w, group))
            order[live], w, group = i[by], w[by], group[by]
            fresh[live[1:]] |= (group[1:] == group[:-1]) & (w[1:] != w[:-1])
            k += self.per

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffix array, common prefix with the suffix before, up to CAP)."""
        lms = self.lms
        if not len(lms):
            return self.induce(lms, np.zeros(0, np.uint8))
        order, ranks = _doubling(*self.names(), self.kind)
        # neighbours share the names up to their first different one, and some characters from there
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):
            same = np.flatnonzero(ranks[k][a] == ranks[k][b])
            a[same] += 1 << k
            b[same] += 1 << k
        lcp = np.zeros(len(order), np.uint8)
        whole = lms[a] - lms[order[:-1]]
        open_ = np.flatnonzero(whole < CAP)
        whole[open_] += self.common(lms[a[open_]], lms[b[open_]])
        lcp[1:] = np.minimum(whole, CAP)
        return self.induce(lms[order], lcp)


def _range_min(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest of ``low[a]`` to ``low[b]`` for each pair, from the minima of
    all stretches whose lengths are powers of two."""
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    table = np.empty((int(level.max()) + 1, len(low)), low.dtype)
    table[0] = low
    for k in range(1, len(table)):
        half = 1 << (k - 1)
        table[k] = table[k - 1]
        np.minimum(table[k - 1][:-half], table[k - 1][half:], out=table[k][:-half])
    flat, row = table.reshape(-1), level * len(low)
    return np.minimum(flat[row + a], flat[row + b - (1 << level) + 1])


def _doubling(order: np.ndarray, fresh: np.ndarray, kind: type = np.int64) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the suffixes of a string of names, whose last name is unique,
    from that of the names (``fresh``: whether a name differs from the one
    before in the order); and the ranks by 1, 2, 4, ... names.  A rank is the
    first place of its group, so only the groups of two or more are sorted."""
    n, step = len(order), 1
    order = order.astype(kind)
    rank = np.empty(n, kind)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    ranks = [rank]
    live = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while len(live):
        i = order[live]
        pair = rank[i].astype(np.int64) * n + rank[i + step]   # the last name is unique, so a group's have another name there
        by = np.argsort(pair)                              # ties share a rank, so their order doesn't matter
        order[live], pair = i[by], pair[by]
        fresh = np.append(True, pair[1:] != pair[:-1])
        rank = rank.copy()
        rank[order[live]] = np.maximum.accumulate(np.where(fresh, live, 0))
        ranks.append(rank)
        live = live[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return order, ranks
