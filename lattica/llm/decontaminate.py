"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ten consecutive words of a benchmark item (an item of fewer words
is one pattern). Patterns of one length share a table of shifts by the hash of two-word
blocks, so that most positions of a document are skipped; where the shift is zero, the
bucket of the block's hash, in order of the windows' hashes, selects the patterns, and they
are compared word by word, byte by byte. Many stretches of text are searched in step, each
with its own position, so a step is a few array operations.

The tables are arrays of about 50 bytes for a word of the benchmark, built once for a shard
of bounded size and broadcast. A benchmark of one shard needs one pass over the documents
with no shuffle; a larger one has a pass for each shard, whose broadcast goes before the
next comes, and the hits meet by row number at the end.

Defined cases: null or wordless texts have no words and no hits; items that are null, have
a null id or no words take no part; repeated items count once; document rows stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, map_batches, replace_columns, with_text
from .textnp import mix64, slices, words

#: Letters, digits and all bytes of non-ASCII characters make words; the rest separates them.
_SEPARATOR = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
#: Text bytes of the benchmark in one broadcast shard.
SHARD_BYTES = 16 << 20
#: Words of a stretch that is searched on its own.
STRETCH = 512
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _blocks(hashes: np.ndarray) -> np.ndarray:
    """Hash of each word with the one before it."""
    before = np.concatenate((np.zeros(1, np.uint64), hashes[:-1])) if len(hashes) else hashes
    return mix64(before * _LEFT + hashes * _RIGHT)


def _windows(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows that begin at ``starts``."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(length):
        out = mix64(out * np.uint64(3) + hashes[starts + j])
    return out


class WuManber:
    """Patterns of ``length`` words, given by where they begin among all words of the shard."""

    def __init__(self, length: int, hashes: np.ndarray, begins: np.ndarray, items: np.ndarray):
        self.length = length
        ends = hashes if length == 1 else _blocks(hashes)  # a block is as long as the pattern allows
        block = min(2, length)
        self.bits = int(min(24, max(10, 2 + (4 * len(begins)).bit_length())))
        self.shift = np.full(1 << self.bits, length - block + 1, np.uint8 if length < 255 else np.int32)
        for end in range(block, length + 1):
            np.minimum.at(self.shift, self._slot(ends[begins + end - 1]), length - end)
        # One key for a bucket and the window in it; equal windows of many items are one pattern.
        keys = self._keys(ends[begins + length - 1], _windows(hashes, begins, length))
        order = np.lexsort((items, keys))
        keys, begins, items = keys[order], begins[order], items[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        again = np.concatenate(([False], (~new[1:]) & (items[1:] == items[:-1])))
        self.keys, self.first = keys[new], begins[new]
        # Windows whose keys agree by chance are kept apart by what follows.
        same = _windows(hashes, begins, length) == np.repeat(_windows(hashes, self.first, length), np.diff(np.append(np.flatnonzero(new), len(keys))))
        keep = same & ~again
        self.item, self.item_at = items[keep], np.searchsorted(np.cumsum(new)[keep], np.arange(1, len(self.keys) + 2))
        self.others = [(k, int(b), int(i)) for k, b, i in zip(keys[~same].tolist(), begins[~same], items[~same], strict=True)]

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _keys(block: np.ndarray, window: np.ndarray) -> np.ndarray:
        return (block & _HIGH) | (window >> np.uint64(32))

    def candidates(self, hashes: np.ndarray, blocks: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Last words of the windows at which the shift is zero; ``where`` has the first word of each text."""
        first = where[:-1] + self.length - 1
        parts = np.maximum(0, -(-(where[1:] - first) // STRETCH))
        at = np.repeat(first, parts) + STRETCH * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
        stop = np.minimum(at + STRETCH, np.repeat(where[1:], parts))
        slots = self._slot(hashes if self.length == 1 else blocks)
        found = []
        while len(at):
            step = self.shift[slots[at]]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray, blocks: np.ndarray, where: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """``(first word, pattern's first word in the shard, items)`` of what is to be compared."""
        last = self.candidates(hashes, blocks, where)
        ends = hashes if self.length == 1 else blocks
        start = last - self.length + 1
        keys = self._keys(ends[last], _windows(hashes, start, self.length))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        for i in np.flatnonzero(self.keys[at] == keys).tolist():
            p = int(at[i])
            yield int(start[i]), int(self.first[p]), self.item[self.item_at[p] : self.item_at[p + 1]]
        for key, begin, item in self.others:
            for i in np.flatnonzero(keys == np.uint64(key)).tolist():
                yield int(start[i]), begin, np.array([item])


class Shard:
    """Items of a bounded part of the benchmark: their words' bytes, and a table for each length of pattern."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.names = [name for name, _ in items]
        column = pa.array([text for _, text in items], pa.large_binary())
        parts = [words(data, offsets, _SEPARATOR) + (data,) for _, _, data, offsets in slices(column, 1 << 62)]
        hashes, starts, ends, where, data = parts[0] if parts else (*(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64)), np.zeros(1, np.int64), np.zeros(0, np.uint8))
        self.starts, self.ends, self.data = starts, ends, data.copy()
        n = np.diff(where)
        self.tables = []
        for length in sorted({int(x) for x in np.minimum(n, window) if x}):
            mine = np.flatnonzero(np.minimum(n, window) == length)
            times = n[mine] - length + 1
            begins = np.repeat(where[:-1][mine], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            self.tables.append(WuManber(length, hashes, begins, np.repeat(mine, times).astype(np.int32)))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes().lower()

    def search(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
        """Numbers of words of some texts, and of those with hits the spans of words and the items."""
        hashes, starts, ends, where = words(data, offsets, _SEPARATOR)
        blocks = _blocks(hashes)
        hits: dict[int, tuple[list, set]] = {}
        for table in self.tables:
            for first, pattern, items in table.find(hashes, blocks, where):
                # bytes.lower() changes A-Z only
                if all(data[starts[first + j] : ends[first + j]].tobytes().lower() == self.word(pattern + j) for j in range(table.length)):
                    text = int(np.searchsorted(where, first, "right")) - 1
                    spans, got = hits.setdefault(text, ([], set()))
                    begin = first - int(where[text])
                    spans.append((begin, begin + table.length))
                    got.update(items.tolist())
        return np.diff(where), hits


def _shards(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """Parts of the benchmark of bounded size, one after another."""
    shard, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).toLocalIterator():
        shard.append((row[0], bytes(row[1])))
        size += len(row[1]) + 64
        if size >= SHARD_BYTES:
            yield shard
            shard, size = [], 0
    if shard:
        yield shard


def _searcher(shared, keep: int, text_at: int, only_hits: bool):
    """The first ``keep`` columns with n_words, hit_spans and hit_items, of all rows or of those with hits."""

    def search(batches):
        shard = shared.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for first, end, data, offsets in slices(batch.column(text_at)):
                n, hits = shard.search(data, offsets)
                n_words += n.tolist()
                for i in range(end - first):
                    found = hits.get(i)
                    spans.append(_merged(found[0]) if found else [])
                    items.append(sorted({shard.names[x] for x in found[1]}) if found else [])
            out = pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=[*batch.schema.names[:keep], "w_n", "w_spans", "w_items"])
            yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if only_hits else out

    return search


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text: str, keep: tuple) -> DataFrame:
    """``in_NAME`` of the columns ``keep``, ``w_n long, w_spans array<int>, w_items array<string>``."""
    spark = docs.sparkSession
    found = "w_n long, w_spans array<int>, w_items array<string>"
    shards = _shards(benchmark, item_col, item_text)
    now, then = next(shards, []), next(shards, None)
    rows, at = with_text(docs, keep, text_col)
    types = ", ".join(f"`in_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    if then is None:
        return map_batches(rows, _searcher(spark.sparkContext.broadcast(Shard(now, window)), len(keep), at, False), f"{types}, {found}" if types else found)
    # Several shards: rows get numbers in a written table, and each pass writes its hits.
    whole = cut(rows.withColumn("w_row", F.monotonically_increasing_id()), "overlap-rows")
    text = whole.select("w_row", F.col(f"`{whole.columns[at]}`"))
    passes = []
    while now is not None:
        shared = spark.sparkContext.broadcast(Shard(now, window))
        passes.append(cut(map_batches(text, _searcher(shared, 1, 1, bool(passes)), f"w_row long, {found}"), "overlap-hits"))
        shared.destroy()
        now, then = then, next(shards, None)
    both = passes[0]
    for other in passes[1:]:
        both = both.unionByName(other)
    sums = both.groupBy("w_row").agg(F.max("w_n").alias("w_n"), F.flatten(F.collect_list("w_spans")).alias("w_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("w_items")))).alias("w_items"))
    sums = cut(sums.withColumn("w_spans", _merged_column(F.col("w_spans"))), "overlap-sums")
    for table in passes:
        forget(table)
    return whole.join(sums, "w_row").select(*[f"`in_{c}`" for c in keep], "w_n", "w_spans", "w_items")


def _merged_column(spans):
    """Spans of several passes as one list in which none touch."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(spans) / 2 - 1).cast("int")), lambda i: F.struct(F.get(spans, (2 * i).cast("int")).alias("a"), F.get(spans, (2 * i + 1).cast("int")).alias("b"))))
    touches = lambda acc, p: F.element_at(acc, -1) >= p["a"]

    def add(acc, p):
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), p["b"])))
        return F.when((F.size(acc) > 0) & touches(acc, p), longer).otherwise(F.concat(acc, F.array(p["a"], p["b"])))

    none = F.array().cast("array<int>")
    return F.when(F.size(spans) == 0, none).otherwise(F.aggregate(pairs, none, add))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: tuple | None = None) -> DataFrame:
    """``docs`` with ``n_words long, hit_spans array<int> (first, end, first, end, ... of hit words), hit_items array<string>``."""
    keep = tuple(docs.columns) if keep is None else keep
    done = _searched(docs, benchmark, window, text_col, item_col, item_text, keep).select(*[F.col(f"`in_{c}`").alias(c) for c in keep], "w_n", "w_spans", "w_items")
    return replace_columns(done, {"n_words": F.col("w_n"), "hit_spans": F.col("w_spans"), "hit_items": F.col("w_items")}).drop("w_n", "w_spans", "w_items")


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def items_digest(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_overlaps(docs, benchmark, window, keep=("doc_id",))
    spans = F.col("hit_spans")
    hit = F.aggregate(F.sequence(F.lit(0), F.size(spans)), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.when(i % 2 == 1, F.get(spans, i) - F.get(spans, i - 1)), F.lit(0)))
    hit = F.when(F.size(spans) > 0, hit).otherwise(F.lit(0)).cast("long")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), (F.size(spans) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their columns."""
    done = _searched(docs, benchmark, window, "text", "item_id", "text", tuple(docs.columns))
    return done.where(F.size("w_spans") == 0).select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])
