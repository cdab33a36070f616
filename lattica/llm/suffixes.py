"""Suffix arrays by induced sorting in bulk, with bucket queues that spill to disk.

Induction visits the buckets of the first byte in order. All that a bucket holds is worked
on at once: the positions before its suffixes go, in order, to the queues of their own
bytes, so a priority queue by ``(byte, order of arrival)`` is a queue for each byte. A queue
set keeps ``memory`` bytes and appends the rest to a file. Sorted substrings between local
minima get names; if names repeat, the string of names is sorted first: by induction again
while its alphabet is small, else by doubling the compared length.
"""

from __future__ import annotations

import tempfile

import numpy as np

SPILL_BYTES = 64 << 20
SMALL_ALPHABET = 4096


class BucketQueues:
    """FIFO queues of positions by first symbol, together at most ``memory`` bytes in memory."""

    def __init__(self, buckets: int, memory: int = SPILL_BYTES):
        self.held: list[list] = [[] for _ in range(buckets)]
        self.memory, self.size, self.file = memory, 0, None

    def push(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        if not len(positions):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, positions = symbols[order], positions[order]
        edges = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            self.held[symbols[a]].append(positions[a:b].copy())
        self.size += positions.nbytes
        if self.size > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.held:
            for i, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    at = self.file.tell()
                    self.file.write(part.tobytes())
                    parts[i] = (at, len(part), part.dtype)
        self.size = 0

    def pop(self, bucket: int) -> np.ndarray | None:
        """All that waits in a bucket, in order of arrival."""
        parts, self.held[bucket] = self.held[bucket], []
        out = []
        for part in parts:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                out.append(np.frombuffer(self.file.read(part[1] * part[2].itemsize), part[2]))
            else:
                self.size -= part.nbytes
                out.append(part)
        return np.concatenate(out) if out else None

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is the unique smallest."""
    n = len(t)
    differs = np.append(np.flatnonzero(t[1:] != t[:-1]) + 1, n - 1)
    ahead = differs[np.searchsorted(differs, np.arange(n), "right").clip(max=len(differs) - 1)]
    small = t[ahead] > t
    small[n - 1] = True
    return small


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, buckets: int, memory: int) -> np.ndarray:
    """The suffix order that follows from the order of ``seeds`` (left-most small suffixes)."""
    n = len(t)
    larger, smaller = BucketQueues(buckets, memory), BucketQueues(buckets, memory)
    starts = BucketQueues(buckets, memory)
    starts.push(t[seeds], seeds)
    done: list[np.ndarray] = []  # the large suffixes of each bucket, in order
    by_bucket: list[list[np.ndarray]] = []
    for c in range(buckets):
        mine = []
        while (now := larger.pop(c)) is not None:
            mine.append(now)
            before = now[now > 0] - 1
            before = before[~small[before]]
            larger.push(t[before], before)
        now = starts.pop(c)
        if now is not None:
            before = now[now > 0] - 1
            before = before[~small[before]]
            larger.push(t[before], before)
        by_bucket.append(mine)
    starts.close()
    larger.close()
    for c in range(buckets - 1, -1, -1):
        taken = []
        while (now := smaller.pop(c)) is not None:
            taken.append(now)
            before = now[now > 0] - 1
            before = before[small[before]]
            smaller.push(t[before], before)
        for mine in reversed(by_bucket[c]):
            now = mine[::-1]
            before = now[now > 0] - 1
            before = before[small[before]]
            smaller.push(t[before], before)
        done += [x for x in taken] + [x[::-1] for x in reversed(by_bucket[c])]
        by_bucket[c] = []
    smaller.close()
    out = np.concatenate(done)[::-1] if done else np.zeros(0, np.int64)
    # The last symbol is a suffix on its own that nothing precedes.
    return np.concatenate(([n - 1], out[out != n - 1]))


def _doubling(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order by doubling, as far as ``depth`` symbols."""
    rank = np.unique(t, return_inverse=True)[1].ravel().astype(np.int64)
    n, step = len(t), 1
    order = np.argsort(rank, kind="stable")
    while step < depth and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))
        step *= 2
    return order


def suffix_order(t: np.ndarray, buckets: int, depth: int, memory: int = SPILL_BYTES) -> np.ndarray:
    """Positions in the order of their suffixes (those equal for ``depth`` symbols in any order)."""
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) <= 1:
        return _induce(t, small, lms, buckets, memory)
    first = _induce(t, small, lms, buckets, memory)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = first[is_lms[first]]
    end = np.empty(n, np.int64)
    end[lms] = np.append(lms[1:], n - 1)
    length = end[ranked] - ranked + 1
    # Equal neighbours among the sorted substrings get one name.
    same = length[1:] == length[:-1]
    live = np.flatnonzero(same)
    a, b, left, k = ranked[:-1][live], ranked[1:][live], length[1:][live], 0
    while len(live):
        bad = (t[a + k] != t[b + k]) | (small[a + k] != small[b + k])
        same[live[bad]] = False
        k += 1
        go = ~bad & (left > k)
        live, a, b, left = live[go], a[go], b[go], left[go]
    names = np.concatenate(([0], np.cumsum(~same)))
    if names[-1] + 1 < len(lms):
        reduced = np.empty(n, np.int64)
        reduced[ranked] = names
        reduced = reduced[lms]
        kinds = int(names[-1]) + 1
        inner = suffix_order(reduced, kinds, depth, memory) if kinds <= SMALL_ALPHABET else _doubling(reduced, depth)
        ranked = lms[inner]
    return _induce(t, small, ranked, buckets, memory)


def repeated_starts(segments: list[bytes], length: int, memory: int = SPILL_BYTES) -> list[np.ndarray]:
    """Of each segment the offsets at which a string of ``length`` bytes starts that starts at another place in them as well."""
    sizes = np.array([len(s) for s in segments])
    text = np.frombuffer(b"".join(s + b"\0" for s in segments), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    dtype = np.int32 if len(text) < 2**31 - 2 else np.int64
    t = np.empty(len(text) + 1, np.int16)
    t[:-1] = text
    t[:-1] += 2
    t[ends] = 1  # between segments
    t[-1] = 0
    begin = ends - sizes
    fits = np.zeros(len(t) + 1, np.int32)
    full = sizes >= length
    np.add.at(fits, begin[full], 1)
    np.add.at(fits, ends[full] - length + 1, -1)
    fits = np.cumsum(fits)[: len(t)] > 0
    order = suffix_order(t, 258, length, memory)
    order = order[fits[order]].astype(dtype)
    if len(order) < 2:
        return [np.zeros(0, np.int64) for _ in segments]
    # Common prefixes of neighbours, as far as they matter.
    same = np.ones(len(order) - 1, bool)
    live = np.arange(len(order) - 1)
    words = np.ndarray((len(text) - 7,), "<u8", text.tobytes(), 0, (1,))
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    for k in steps:
        bad = words[order[live] + k] != words[order[live + 1] + k]
        same[live[bad]] = False
        live = live[~bad]
    marked = np.zeros(len(t), bool)
    marked[order[:-1][same]] = True
    marked[order[1:][same]] = True
    where = np.flatnonzero(marked)
    owner = np.searchsorted(ends, where)
    cuts = np.searchsorted(owner, np.arange(len(segments) + 1))
    return [where[cuts[i] : cuts[i + 1]] - begin[i] for i in range(len(segments))]
