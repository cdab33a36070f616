"""Exact removal of repeated byte strings by external induced suffix sorting.

Every byte covered by a string of ``length`` bytes that also starts anywhere else in the
corpus is removed. Which strings can repeat at all is narrowed first: each string belongs to
the anchor of least hash in it (a function of its bytes alone), anchors are counted by
fingerprint over all documents, and only runs of strings whose fingerprint occurs twice are
kept, each string once. These runs are dealt by fingerprint into shards, in which equal runs
are one (they repeat each other); where different runs share a fingerprint, the suffixes are
sorted by induction with queues that spill to disk (:mod:`.suffixes`), and neighbours
with a common prefix of ``length`` bytes are repeats. Fingerprints decide only what is
compared; the suffix order and the bytes decide what repeats.

Defined cases: a null or short text loses nothing; a text never matches across its end;
rows with equal text repeat each other wholly, also under one id; a null id is an id of its
own; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, map_batches
from .suffixes import repeated_starts
from .textnp import IdFilter, id_filter, mix64, slices

PRINT = 64
SLICE = 1 << 20
SHARD_BYTES = 3 << 20


def _anchored(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of string starts with one anchor: first and last start, anchor, and the fingerprint at the anchor."""
    n, window = len(data), length - PRINT + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    if n < length:
        return none
    grams = np.ndarray((n - 7,), "<u8", data.tobytes(), 0, (1,))
    h = grams * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    starts = n - length + 1
    low = key[: n - PRINT + 1]
    width = 1
    while width * 2 <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < window:
        low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
    anchor = (low[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # A string must not cross the end of its text.
    valid = np.zeros(n + 1, np.int32)
    sizes = np.diff(offsets)
    fit = sizes >= length
    np.add.at(valid, offsets[:-1][fit], 1)
    np.add.at(valid, offsets[1:][fit] - length + 1, -1)
    valid = np.cumsum(valid)[:starts] > 0
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])))
    new[offsets[:-1][offsets[:-1] < starts]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], starts) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    at = anchor[first]
    prints = np.zeros(len(at), np.uint64)
    for j in range(0, PRINT, 8):
        prints = mix64(prints * np.uint64(3) + grams[at + j])
    return first, last, at, prints


def _prints(length: int):
    def count(batches):
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("body"), SLICE):
                _, _, _, prints = _anchored(data, offsets, length)
                got, times = np.unique(prints, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(times)], names=["fp", "times"])

    return count


def _runs(length: int, chosen):
    """Runs of strings with a fingerprint that may repeat: ``(fp, doc, key, start, twice, bytes)``.

    Equal runs of one slice are sent once, marked ``twice``; the others are known repeats and
    come as ``(null, doc, key, start, ..., their number of starts)``.
    """

    def runs(batches):
        admit = IdFilter(*chosen.value).admit
        for batch in batches:
            docs, keys = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("key").to_numpy(zero_copy_only=False)
            for top, _, data, offsets in slices(batch.column("body"), SLICE):
                first, last, at, prints = _anchored(data, offsets, length)
                some = np.flatnonzero(admit(prints.view(np.int64))) if len(prints) else []
                seen: dict[tuple, int] = {}
                rows: list[list] = []
                raw = data.tobytes()
                for i in some:
                    a, b = int(first[i]), int(last[i])
                    body = raw[a : b + length]
                    row = top + int(np.searchsorted(offsets, a, "right")) - 1
                    start = a - int(offsets[row - top])
                    same = (int(at[i]) - a, body)
                    if same in seen:
                        rows[seen[same]][4] = True
                        rows.append([None, int(docs[row]), int(keys[row]), start, True, None, b - a + 1])
                    else:
                        seen[same] = len(rows)
                        rows.append([int(prints[i].astype(np.int64)), int(docs[row]), int(keys[row]), start, False, body, b - a + 1])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RUN_TYPES, strict=True)], names=_RUN)

    return runs


_RUN = ["fp", "doc", "key", "start", "twice", "body", "starts"]
_RUN_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32()]
_RUN_SCHEMA = "fp long, doc long, key long, start long, twice boolean, body binary, starts int"


class _Shard:
    """Runs gathered by fingerprint until there are enough to sort."""

    def __init__(self, length: int):
        self.length = length
        self.out: list[list] = [[], [], [], []]
        self.reset()

    def reset(self) -> None:
        self.bodies: list[bytes] = []
        self.owners: list[tuple[int, int, int] | None] = []  # None where all starts are known to repeat
        self.size = 0

    def emit(self, doc: int, key: int, lo: int, hi: int) -> None:
        for to, x in zip(self.out, (doc, key, lo, hi), strict=True):
            to.append(x)

    def add(self, group: dict[bytes, list[tuple[int, int, int, bool]]]) -> None:
        """All runs of one fingerprint by their bytes. Equal runs repeat each other, so one stands for them."""
        single = False
        for body, places in group.items():
            if len(places) > 1 or places[0][3]:
                for doc, key, start, _ in places:
                    self.emit(doc, key, start, start + len(body) - self.length + 1)
            else:
                single = True
        if not single or len(group) == 1:
            return  # nothing is left to find
        for body, places in group.items():
            known = len(places) > 1 or places[0][3]
            self.bodies.append(body)
            self.owners.append(None if known else places[0][:3])
            self.size += len(body)

    def sort(self) -> None:
        for owner, found in zip(self.owners, repeated_starts(self.bodies, self.length) if self.bodies else [], strict=True):
            if owner is not None and len(found):
                doc, key, start = owner
                for part in np.split(found, np.flatnonzero(np.diff(found) != 1) + 1):
                    self.emit(doc, key, start + int(part[0]), start + int(part[-1]) + 1)
        self.reset()

    def flush(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.out], names=["doc", "key", "lo", "hi"])
        self.out = [[], [], [], []]
        return batch


def _sorted_shards(length: int):
    """Repeated starts of each run as ``(doc, key, lo, hi)``, hi excluded."""

    def shards(batches):
        shard, group, last = _Shard(length), {}, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("fp", "body", "doc", "key", "start", "twice")]
            for fp, body, doc, key, start, twice in zip(*columns, strict=True):
                if fp != last:
                    shard.add(group)
                    group, last = {}, fp
                    # A shard ends between fingerprints; one fingerprint may make it as large as it is.
                    if shard.size >= SHARD_BYTES:
                        shard.sort()
                group.setdefault(body, []).append((doc, key, start, twice))
            if len(shard.out[0]) > 100_000:
                yield shard.flush()
        shard.add(group)
        shard.sort()
        yield shard.flush()

    return shards


def _cleaned(length: int):
    def clean(batches):
        for batch in batches:
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for i in range(batch.num_rows):
                body = batch.column("body")[i].as_py() or b""
                found = batch.column("found")[i].as_py()
                merged: list[list[int]] = []
                for lo, hi in sorted((f["lo"], f["hi"]) for f in found or ()):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi - 1 + length)
                    else:
                        merged.append([lo, hi - 1 + length])
                left, at = [], 0
                for lo, hi in merged:
                    left.append(body[at:lo])
                    at = hi
                rest = b"".join([*left, body[at:]])
                sizes.append(len(body))
                removed.append(len(body) - len(rest))
                spans.append(len(merged))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return clean


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id, n_bytes, n_removed, n_spans long, kept_sha256 string, kept binary``."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    # Rows are known by id and text; equal rows get equal results.
    keyed = texts.select("id", F.coalesce("id", F.lit(-1)).alias("doc"), F.xxhash64("id", "body").alias("key"), "body")
    long_ = keyed.where(F.length("body") >= length).select("doc", "key", "body")
    prints = cut(map_batches(long_.select("body"), _prints(length), "fp long, times long").groupBy("fp").agg(F.sum("times").alias("times")).where("times > 1").select("fp"), "repeats-prints")
    chosen = id_filter(prints, "fp", 4 * prints.count())
    runs = cut(map_batches(long_, _runs(length, chosen), _RUN_SCHEMA), "repeats-runs")
    forget(prints)
    shards = runs.where("fp is not null").repartition("fp").sortWithinPartitions("fp")
    found = map_batches(shards, _sorted_shards(length), "doc long, key long, lo long, hi long")
    known = runs.where("fp is null").select("doc", "key", F.col("start").alias("lo"), (F.col("start") + F.col("starts")).alias("hi"))
    found = found.union(known).groupBy("doc", "key").agg(F.collect_set(F.struct("lo", "hi")).alias("found"))
    joined = keyed.join(found, ["doc", "key"], "left").select("id", "body", "found")
    return map_batches(joined, _cleaned(length), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
