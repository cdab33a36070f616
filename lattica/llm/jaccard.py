"""N-gram Jaccard join by token-combination prefixes.

A text's set holds its distinct k-word shingles. All sets are ordered alike: shingles of
rare classes first, then frequent ones, by class and hash. The class comes from counts over
all documents in a sketch of fixed size; a wrong class costs time, never a link.

Two sets that are similar enough share a shingle within their first ``n - need + 1`` and two
within their first ``n - need + 2``. Rare shingles of the former prefix are keys on their
own; frequent ones only as pairs from the extended prefix (in sets above a size at which
pairs would be too many, on their own; sizes around the bound get both). Candidates that
pass the size and position bounds are pruned by parity bitmaps (a proven upper bound of the
overlap) and then verified on the whole sets.

Only components are wanted, so a bucket's pairs aren't all made: its members are compared
with the one of them whose key comes earliest in its order; then, in buckets that still span several components, exactly the pairs
whose components differ are tested. No link between different components is lost.

Defined cases: texts that are null or wordless have an empty set and are alone; equal sets
are linked through the smallest id; rows with equal id are one node; a null id is alone
with a null component; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, forget, map_batches
from .textnp import IdFilter, id_filter, shingle_sets

SKETCH_BITS, SLICES = 22, 64
#: Prefixes of at most so many shingles are indexed by pairs.
PAIR_PREFIX = 64


def need(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any similar set."""
    return (percent * n + 99) // 100


def _survey(k: int):
    """Per text its set's size and digest; per task the counts of shingle classes."""

    def survey(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            sizes, digests, pending = [], [], []
            for _, found in shingle_sets(batch.column("body"), k):
                if len(found):
                    pending.append(found >> np.uint64(64 - SKETCH_BITS))
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            if pending:
                at, times = np.unique(np.concatenate(pending), return_counts=True)
                counts[at.astype(np.int64)] += times.astype(np.uint32)
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=_SURVEY)
        if counts.any():
            blobs = [zlib.compress(c.tobytes(), 1) for c in counts.reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], names=_SURVEY)

    return survey


_SURVEY = ["id", "n", "digest", "slice", "blob"]


def _add_counts(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slice_, blob in zip(batch.column("slice").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            got = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.int64)
            sums[slice_] = sums[slice_] + got if slice_ in sums else got
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["slice", "blob"])


def _classes(survey: DataFrame):
    """Broadcast class of each sketch bucket (4 MB): 0 rare, else the logarithm of how far it is above chance."""
    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.int64)
    dealt = survey.where("slice is not null").select("slice", "blob").repartition(SLICES, "slice")
    for row in map_batches(dealt, _add_counts, "slice int, blob binary").toLocalIterator():
        counts[row["slice"]] = np.frombuffer(row["blob"], np.int64)
    counts = counts.ravel()
    mean = counts.mean()
    # Chance alone seldom takes a bucket of about ``mean`` that far; calling a rare shingle frequent costs little.
    top = np.log2(1 + np.maximum(0, counts - mean) / (3 * np.sqrt(mean) + 4)).astype(np.uint8)
    return survey.sparkSession.sparkContext.broadcast(top.tobytes())


def _index(k: int, percent: int, classes):
    """Keys of each distinct set of a task: ``(key, id, n, rest)``; rest bounds the overlap if the key's shingles are the first shared."""
    pair_sizes = (PAIR_PREFIX - 2) * 100 // (100 - percent)

    def index(batches):
        table = np.frombuffer(classes.value, np.uint8)
        seen: set[bytes] = set()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            out: list[list[np.ndarray]] = [[], [], [], []]
            for row, found in shingle_sets(batch.column("body"), k):
                n = len(found)
                if n < 2 or ids[row] is None:
                    continue
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                if digest in seen:
                    continue
                seen.add(digest)
                kind = table[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                if kind.any():
                    order = np.argsort(kind, kind="stable")
                    found, kind = found[order], kind[order]
                least = need(n, percent)
                short, long = n - least + 1, min(n, n - least + 2)
                rare = int(np.searchsorted(kind[:long] > 0, True))
                alone = np.arange(short if n * 100 >= pair_sizes * percent else min(short, rare))
                keys, rest = [found[alone]], [n - alone]
                if n <= pair_sizes and long - rare >= 2:
                    i, j = np.triu_indices(long - rare, 1)
                    keys.append((found[rare + i] * np.uint64(0x9E3779B97F4A7C15)) ^ (found[rare + j] + np.uint64(0x632BE59BD9B4E019)))
                    rest.append(n - (rare + j) + 1)
                key = np.concatenate(keys)
                for to, values in zip(out, (key.view(np.int64), np.full(len(key), ids[row], np.int64), np.full(len(key), n, np.int32), np.concatenate(rest).astype(np.int32)), strict=True):
                    to.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["key", "id", "n", "rest"])

    return index


def _bitmap(found: np.ndarray) -> bytes:
    bits = max(64, 1 << (2 * len(found) - 1).bit_length())
    at = (found & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1).astype(np.uint8).tobytes()


def _fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    # Bit order in packbits is by position, so halves of the table fold by xor.
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def _chosen(k: int, chosen, whole: bool):
    """``(id, n, data)`` of the chosen documents: the whole set or its parity bitmap."""

    def choose(batches):
        admit = IdFilter(*chosen.value)
        for batch in batches:
            id_ = batch.column("id")
            mask = np.zeros(len(id_), bool)
            valid = id_.is_valid().to_numpy(zero_copy_only=False)
            mask[valid] = admit.admit(id_.drop_null().to_numpy(zero_copy_only=False))
            if not mask.any():
                continue
            some = pa.Table.from_batches([batch]).filter(pa.array(mask)).combine_chunks()
            for part in some.to_batches():
                sizes, data = [], []
                for _, found in shingle_sets(part.column("body"), k):
                    sizes.append(len(found))
                    data.append((found.tobytes() if whole else _bitmap(found)) if len(found) else b"")
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], names=["id", "n", "data"])

    return choose


def _tested(percent: int, whole: bool):
    def test(batches):
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = left[i].as_buffer(), right[i].as_buffer()
                if whole:
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.concatenate((x, y))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                else:
                    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                    size = min(len(x), len(y))
                    apart = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
                    shared = (int(na[i]) + int(nb[i]) - apart) // 2
                good[i] = 100 * shared >= percent * (int(na[i]) + int(nb[i]) - shared)
            kept = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept)], names=["a", "b"])

    return test


def _verify(texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that are similar: first by bitmaps, then by whole sets."""
    for whole in (False, True):
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        chosen = id_filter(ids, "id", pairs.count() * 2)
        data = map_batches(texts, _chosen(k, chosen, whole), "id long, n int, data binary")
        side = lambda s: data.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("data").alias("left" if s == "a" else "right"))  # noqa: B023, E731
        joined = pairs.join(side("a"), "a").join(side("b"), "b")
        pairs = cut(map_batches(joined, _tested(percent, whole), "a long, b long"), "jaccard-pairs")
        chosen.destroy()
    return pairs


def link(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id, n_shingles long, component long`` (smallest id reachable by links).

    ``percent`` is over 50 and at most 100, or 50 where no set of one shingle can meet one of two.
    """
    if not 50 <= percent <= 100:
        raise ValueError("the similarity must be at least 50 and at most 100 percent")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    survey = cut(map_batches(texts, _survey(k), "id long, n long, digest binary, slice int, blob binary"), "jaccard-survey")
    rows = survey.where("slice is null").select("id", "n", "digest")
    classes = _classes(survey)
    keys = map_batches(texts, _index(k, percent, classes), "key long, id long, n int, rest int")
    order = Window.partitionBy("key").orderBy(F.desc(F.col("rest") / F.col("n")), "id")
    run = keys.repartition("key").withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("m > 1")
    run = run.select("key", "id", "n", "rest", F.first(F.struct("id", "n", "rest")).over(order).alias("p"))
    index = cut(run, "jaccard-index")
    classes.destroy()

    fits = lambda n, m, r, s: F.least(r, s) * (100 + percent) >= (n + m) * percent
    # In copies of one text, that with the fewest shingles of its own is nearest to the others.
    first = index.where( (F.col("id") != F.col("p.id")) & fits(F.col("n"), F.col("p.n"), F.col("rest"), F.col("p.rest")))
    first = cut(first.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct(), "jaccard-first")
    links = _verify(texts, first, k, percent)
    equal = rows.where("n > 0 and id is not null").groupBy("n", "digest").agg(F.min("id").alias("m"))
    equal = rows.join(equal, ["n", "digest"]).where("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b"))
    links = cut(links.union(equal), "jaccard-links")
    found = cut(components(links), "jaccard-components")

    # Buckets that still span components: every pair of different components there is tested.
    label = F.coalesce("component", "id")
    known = index.select("key", "id", "n", "rest").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("c", label).drop("component")
    open_ = known.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    known = cut(known.join(open_, "key", "left_semi").select("key", "id", "n", "rest", "c"), "jaccard-open")
    x, y = known.alias("x"), known.alias("y")
    fit = fits(F.col("x.n"), F.col("y.n"), F.col("x.rest"), F.col("y.rest"))
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.c") != F.col("y.c")) & fit)
    more = more.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = cut(more, "jaccard-more")
    forget(index)
    if not more.isEmpty():
        # Components so far are stars: new links join them by their labels' nodes.
        links = cut(links.union(_verify(texts, more, k, percent)), "jaccard-all")
        found = cut(components(links), "jaccard-components")
    return rows.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.col("n").alias("n_shingles"), label.alias("component"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are alone or the first of their component (rows with that id all stay)."""
    gone = link(docs, k, percent, id_col, text_col).where("component <> id").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
