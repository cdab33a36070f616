"""Embedding near-duplicates by NN-descent.

Equal vectors of a label are one class. Classes get first neighbours from the leaves of
random-hyperplane trees; then neighbours of common neighbours are compared and the lists of
the nearest are refined until hardly any changes. Links are list entries at or above the
threshold. Wherever lists link classes, they are enlarged to the whole linked component (a
saturated list can hold no more than its length): its members are compared in blocks of
bounded size, which only count links. Recall is then audited by brute force for a bounded
number of classes against all, classes with links among them; if it falls short, more trees
are grown and the search goes on, and it ends in an error rather than with a bad recall.
Large leaves and the many neighbours of a hub are compared in blocks of other members in each
tree and round.

Defined cases: a null label, and a vector that is null, empty, zero or holds a null or
non-finite component, links with nothing; vectors of different length don't link; rows with
equal id and vector count as one vector; other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, map_batches

K = 8
LEAF, BLOCK = 64, 512
TREES = 8
AUDIT = 256
RECALL = 0.999


def grouped(batches, keys: tuple[str, ...], most: int | None = None) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys in sorted batches; runs longer than ``most`` come in pieces."""
    held: list[pa.RecordBatch] = []
    now, size = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if now is not None and key != now and held:
                yield now, pa.Table.from_batches(held)
                held, size = [], 0
            now = key
            while a < b:
                take = b - a if most is None else min(b - a, most - size)
                held.append(batch.slice(a, take))
                size += take
                a += take
                if most is not None and size >= most:
                    yield now, pa.Table.from_batches(held)
                    held, size = [], 0
    if held:
        yield now, pa.Table.from_batches(held)


def _unit(column) -> np.ndarray:
    """Rows of equal length, scaled to length one in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of tiny or huge values are lost
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _leaves(seed: int):
    """``(cid, grp, tree, code, vec)``: each class in a leaf of each tree of its group."""

    def leaves(batches):
        for batch in batches:
            grp, bits, vec = batch.column("grp").to_numpy(), batch.column("bits").to_numpy(), batch.column("vec")
            sizes = pa.compute.list_value_length(vec).to_numpy()
            codes = np.zeros((batch.num_rows, TREES), np.int64)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = _unit(vec.take(pa.array(rows)))
                planes = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), TREES * 40))
                side = (x @ planes > 0).reshape(len(rows), TREES, 40)
                mask = np.arange(40)[None, None, :] < bits[rows][:, None, None]
                codes[rows] = ((side & mask) * (1 << np.arange(40, dtype=np.int64))).sum(axis=2)
            at = np.repeat(np.arange(batch.num_rows), TREES)
            yield pa.RecordBatch.from_arrays([batch.column("cid").take(pa.array(at)), pa.array(grp[at]), pa.array(np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows)), pa.array(codes.ravel()), vec.take(pa.array(at))], names=["cid", "grp", "tree", "code", "vec"])

    return leaves


def _best(ids: np.ndarray, sims: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The up to K nearest of each row that are above its floor."""
    np.fill_diagonal(sims, -2)
    k = min(K, len(ids) - 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(ids) - 1 else np.argsort(-sims, axis=1)[:, :k]
    u = np.repeat(np.arange(len(ids)), k)
    v = near.ravel()
    s = sims[u, v]
    good = (s > floor[u]) & (ids[u] != ids[v])
    return ids[u][good], ids[v][good], s[good]


def _neighbours(keys: tuple[str, ...]):
    def neighbours(batches):
        out, size = [], 0
        for _, table in grouped(batches, keys, BLOCK):
            if table.num_rows < 2:
                continue
            ids = table.column("cid").to_numpy()
            x = _unit(table.column("vec"))
            floor = table.column("floor").to_numpy() if "floor" in table.column_names else np.full(len(ids), -2.0)
            out.append(_best(ids, x @ x.T, floor))
            size += len(out[-1][0])
            if size > 20_000:
                yield _edges(out)
                out, size = [], 0
        if out:
            yield _edges(out)

    return neighbours


def _edges(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["u", "v", "sim"])


def _nearest(edges: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("r", rank).where(F.col("r") <= K).drop("r")


def _dealt(rows: DataFrame, keys: tuple[str, ...], mix) -> DataFrame:
    """Neighbours within groups. Large groups are worked on in blocks, dealt over tasks by a salt.

    ``mix`` orders a group's members, differently in each tree and round, so that the blocks
    of one are not those of another.
    """
    rows = rows.withColumn("mix", mix)
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 4 * BLOCK).withColumn("parts", F.ceil(F.col("m") / (4 * BLOCK)))
    rows = rows.join(hot.select(*keys, "parts"), list(keys), "left").withColumn("salt", F.pmod("mix", F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    rows = rows.repartition(*keys, "salt").sortWithinPartitions(*keys, "salt", F.xxhash64("mix"), "cid").drop("mix")
    return map_batches(rows, _neighbours((*keys, "salt")), "u long, v long, sim double")


def _grow(classes: DataFrame, seed: int) -> DataFrame:
    kind = classes.schema["vec"].dataType.simpleString()
    leaf = map_batches(classes.select("cid", "grp", "bits", "vec"), _leaves(seed), f"cid long, grp long, tree int, code long, vec {kind}")
    return _dealt(leaf, ("grp", "tree", "code"), F.xxhash64("cid", "tree", F.lit(seed)))


def _descend(classes: DataFrame, edges: DataFrame, rounds: int, seed: int) -> DataFrame:
    n = classes.count()
    for k in range(rounds):
        floor = edges.groupBy("u").agg(F.when(F.count(F.lit(1)) >= K, F.min("sim")).otherwise(-2.0).alias("floor"))
        member = edges.select(F.col("v").alias("center"), F.col("u").alias("cid")).union(edges.select(F.col("u").alias("center"), F.col("v").alias("cid"))).distinct()
        known = classes.select("cid", "vec").join(floor.withColumnRenamed("u", "cid"), "cid", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        found = _dealt(member.join(known, "cid"), ("center",), F.xxhash64("cid", F.lit(seed), F.lit(k)))
        after = cut(_nearest(edges.union(found)), "descent-lists")
        changed = after.join(edges, ["u", "v"], "left_anti").count()
        edges = after
        if changed <= 0.01 * K * n:
            break
    return edges


def _count_links(threshold: float):
    def count(batches):
        for (_, i, j), table in grouped(batches, ("comp", "i", "j")):
            ids, part, times = (table.column(c).to_numpy() for c in ("cid", "part", "times"))
            x = _unit(table.column("vec"))
            left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
            near = x[left] @ x[right].T >= threshold
            if i == j:
                np.fill_diagonal(near, False)
            got = np.zeros(len(ids), np.int64)
            got[left] += near @ times[right]
            if i != j:
                got[right] += near.T @ times[left]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(got)], names=["cid", "links"])

    return count


def _complete(classes: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Links of each class to all others of its component, by pairs of blocks."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("m")).withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int"))
    rows = found.select(F.col("node").alias("cid"), "component").join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    rows = rows.join(classes.select("cid", "vec", "times"), "cid").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(F.col("component").alias("comp"), F.least("part", "x").alias("i"), F.greatest("part", "x").alias("j"), "cid", "part", "times", "vec")
    rows = rows.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return map_batches(rows, _count_links(threshold), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def _audit(classes: DataFrame, links: DataFrame, threshold: float) -> float:
    """Share of the links of a bounded number of classes that were found: of any classes, and of classes that have links."""
    any_ = classes.select("cid", "grp", "vec").orderBy(F.xxhash64("cid"), "cid").limit(AUDIT)
    linked = classes.join(links.where("links > 0").select("cid"), "cid", "left_semi").select("cid", "grp", "vec").orderBy(F.xxhash64("cid"), "cid").limit(AUDIT)
    some = any_.union(linked).dropDuplicates(["cid"]).collect()
    if not some:
        return 1.0
    asked = classes.sparkSession.sparkContext.broadcast([(r["cid"], r["grp"], list(r["vec"])) for r in some])

    def brute(batches):
        by_group: dict[int, tuple] = {}
        for grp in {g for _, g, _ in asked.value}:
            mine = [(c, v) for c, g, v in asked.value if g == grp]
            by_group[grp] = np.array([c for c, _ in mine]), _unit(pa.array([v for _, v in mine], pa.list_(pa.float64())))
        for batch in batches:
            grp, ids, times, vec = batch.column("grp").to_numpy(), batch.column("cid").to_numpy(), batch.column("times").to_numpy(), batch.column("vec")
            for g, (qid, q) in by_group.items():
                rows = np.flatnonzero(grp == g)
                if len(rows):
                    near = (q @ _unit(vec.take(pa.array(rows))).T >= threshold) & (qid[:, None] != ids[rows][None])
                    yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array((near @ times[rows]).astype(np.int64))], names=["cid", "links"])

    true = map_batches(classes, brute, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("all"))
    got = true.join(links, "cid", "left").agg(F.sum("all").alias("a"), F.sum(F.least("all", F.coalesce("links", F.lit(0)))).alias("g")).first()
    return got["g"] / got["a"] if got["a"] else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, rounds: int = 3, restarts: int = 6, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: ``vec_id, n_links long, component_id long, kept boolean``.

    A recall below ``RECALL`` in the audit after the last restart is warned of, one below 0.9 an error.
    """
    vec = F.col(vec_col) if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else F.col(vec_col).cast("array<double>")
    inf = F.lit(float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    fine = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("vec", lambda x: x != 0), F.lit(False))
    good = rows.where(fine).withColumn("digest", F.md5(F.array_join(F.col("vec").cast("array<string>"), ","))).withColumn("grp", F.xxhash64("label", F.size("vec")))
    classes = good.groupBy("grp", "label", "digest").agg(F.min("vec_id").alias("cid"), F.count_distinct("vec_id").alias("times"), F.first("vec").alias("vec"))
    classes = cut(classes, "descent-classes")
    counts = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    bits = F.least(F.lit(40), F.greatest(F.lit(0), F.ceil(F.log2(F.col("m") / LEAF)))).cast("int")
    vecs = cut(classes.select("grp", "cid", "times", "vec").join(counts.select("grp", bits.alias("bits")), "grp"), "descent-vectors")
    edges = None
    for seed in range(restarts):
        grown = _grow(vecs, seed)
        edges = cut(_nearest(grown if edges is None else edges.union(grown)), "descent-lists")
        edges = _descend(vecs, edges, rounds, seed)
        found = cut(components(edges.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))), "descent-components")
        links = cut(_complete(vecs, found, threshold), "descent-links")
        recall = _audit(vecs, links, threshold)
        if recall >= RECALL:
            break
    else:
        if recall < 0.9:
            raise RuntimeError(f"links found in the audit: {recall:.3f} of all")
        warnings.warn(f"links found in the audit: {recall:.4f} of all", stacklevel=2)
    by_class = classes.select("grp", "label", "digest", "cid", "times").join(links, "cid", "left").join(found.withColumnRenamed("node", "cid"), "cid", "left")
    by_class = by_class.select("grp", "label", "digest", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    marked = good.select("vec_id", "grp", "label", "digest").join(by_class, ["grp", "label", "digest"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return marked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
