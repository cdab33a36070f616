"""Shared helpers: table access, lineage cuts in the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of our own only where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


FILES_PER_CORE, PARTITIONS_PER_FILE = 3, 8


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lost executors cost a reread, not the lineage.

    The files are a few for each core of the cluster, or one for several shuffle partitions where these are many more; a task works on
    its partitions one by one.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    files = max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_PER_FILE)
    df.coalesce(files).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of one Arrow batch on its way to or from a Python worker: neither side holds more than a few of them.
BATCH_BYTES = 4 << 20


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` in batches bounded by bytes, so long texts don't fill executors; this sets the session's ``maxBytesPerBatch``."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def with_text(docs: DataFrame, keep: tuple, text_col: str) -> tuple[DataFrame, int]:
    """Columns ``keep`` as ``in_NAME`` for a Python worker, and the place of the text, which is sent once: with them or after them."""
    sent = [F.col(f"`{c}`").alias(f"in_{c}") for c in keep]
    if text_col in keep and docs.schema[text_col].dataType.typeName() == "string":
        return docs.select(*sent), keep.index(text_col)
    return docs.select(*sent, F.col(f"`{text_col}`").cast("binary").alias("body")), len(keep)


def replace_columns(df: DataFrame, new: dict) -> DataFrame:
    """Append columns; a column of the input with the same name gives way."""
    lower = {k.lower() for k in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower], *[v.alias(k) for k, v in new.items()])


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)``, component being the smallest node.

    Alternating large-star and small-star steps; each is an aggregation with map-side
    combining and a join on the node, and the number of rounds grows with the logarithm of
    the graph. Self-loops and repeated edges are harmless. Nodes without edges get no row.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    last = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == last or mark["n"] == 0:
            break
        last = mark
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = cut(small.select("e.*").where("a <> b").distinct(), name)
        forget(now)
        now = after
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
