"""Words and shingles of many texts at once with numpy, straight from Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import map_batches

#: Bytes of text worked on at once (a longer text is worked on alone).
SLICE_BYTES = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of rows; nulls are empty."""
    n = len(column)
    if not n:
        return
    wide = column.type in (pa.large_binary(), pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words, and where each text's words begin; A-Z count as a-z."""
    texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
    inside = ~separator[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, np.zeros(texts + 1, np.int64)
    length = np.add.reduceat(inside, starts, dtype=np.int64)
    ends = starts + length
    at = np.flatnonzero(inside)
    place = np.arange(len(at), dtype=np.int64)
    first = np.cumsum(length) - length
    place -= np.repeat(first, length)
    values = _BYTE[LOWER[data[at]]] * _power_table(int(length.max()))[place]
    hashes = mix64(np.add.reduceat(values, first) + length.astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted distinct 64-bit hashes of its k-word shingles)``; fewer words make one shingle, none an empty set."""
    for first, end, data, offsets in slices(column):
        hashes, _, _, where = words(data, offsets)
        n = len(hashes)
        if n >= k:
            all_ = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                all_ += hashes[j : n - k + 1 + j] * _MIX[j]
            all_ = mix64(all_)
        for i in range(end - first):
            a, b = where[i], where[i + 1]
            if b - a >= k:
                found = np.sort(all_[a : b - k + 1])
                yield first + i, found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif b > a:
                h = hashes[a:b] * _MIX[k : k + (b - a)]
                yield first + i, mix64(h.sum(dtype=np.uint64, keepdims=True) + _MIX[63:] * np.uint64(b - a))
            else:
                yield first + i, np.zeros(0, np.uint64)


class IdFilter:
    """A set of integer ids as bits of a fixed number, for broadcast: it may admit others, never loses one."""

    MAX_BITS = 28

    def __init__(self, bits: int, table: bytes):
        self.bits, self.table = bits, np.frombuffer(table, np.uint8)

    def __contains__(self, ids) -> bool:
        raise TypeError("use admit()")

    def admit(self, ids: np.ndarray) -> np.ndarray:
        at = mix64(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - self.bits)
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def id_filter(ids, column: str, count: int):
    """Broadcast :class:`IdFilter` data of ``ids[column]``: at most 32 MB whatever the number of ids."""
    bits = min(IdFilter.MAX_BITS, max(16, (16 * max(1, count)).bit_length()))

    def local(batches):
        packed = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            got = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = mix64(got) >> np.uint64(64 - bits)
            np.bitwise_or.at(packed, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        step = min(len(packed), 1 << 15)
        blocks = packed.reshape(-1, step)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([blocks[i].tobytes() for i in used], pa.binary())], names=["block", "table"])

    def merge(batches):
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, table in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(table, np.uint8)
                tables[block] = tables[block] | got if block in tables else got
        yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int32()), pa.array([t.tobytes() for t in tables.values()], pa.binary())], names=["block", "table"])

    schema = "block int, table binary"
    merged = map_batches(map_batches(ids.select(column), local, schema).repartition("block"), merge, schema)
    step = min(1 << (bits - 3), 1 << 15)
    table = bytearray(1 << (bits - 3))
    for row in merged.toLocalIterator():  # the table has a fixed size
        table[row["block"] * step : row["block"] * step + len(row["table"])] = row["table"]
    return ids.sparkSession.sparkContext.broadcast((bits, bytes(table)))
