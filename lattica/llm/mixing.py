"""Mix sources to target weights by nested hash-threshold histograms (DataFrame functions only).

Every document has a 52-bit hash. Words are summed by source and leading hash bits; the
bucket in which the running sum passes a source's budget is found and only that bucket is
summed again by the next bits, until the threshold is a single hash. Documents are then
taken by comparing their hash with the threshold: nothing is sorted by document.

Defined cases: a null text has size 0; a null source is a source of its own, ranked last;
rows with equal id and size share a hash and are taken together; empty input gives no rows;
input columns named like an appended one give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, replace_columns

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, STEP_BITS = 52, 13
#: Plans of at most so many sources are sent to every executor; larger ones are joined by salted keys.
BROADCAST_SOURCES = 20_000
SALTS = 64


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def doc_hash(doc_id: Column, size: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), size.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(per_source: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """From ``(sk, sn, source_size)`` to ``(sid, sk, sn, source_size, target)``.

    Sources are numbered in code point order, nulls last, by range partitions whose row
    counts (one per partition) are all that reaches the driver. Targets share the total by
    weight; those above ``max_epochs`` times their source stop there and the rest is shared
    again until none is above.
    """
    spark = per_source.sparkSession
    ranged = cut(per_source.repartitionByRange("sn", "sk").withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offset, before = [], 0
    for part in sorted(counts):
        offset.append((part, before))
        before += counts[part]
    starts = spark.createDataFrame(offset or [(0, 0)], "part int, start long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("sn", "sk")) - 1 + F.col("start")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = ranged.join(F.broadcast(starts), "part").withColumn("sid", rank.cast("long"))
    ranked = cut(ranked.withColumn("w", F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int")).cast("long")).drop("part", "start"), "mix-ranked")
    first = ranked.agg(F.sum("source_size").alias("s"), F.sum("w").alias("w")).first()
    total, rest, share = first["s"] or 0, first["s"] or 0, first["w"] or 1
    big = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    while True:
        over = F.col("source_size").cast("decimal(19,0)") * max_epochs * big(share) < F.col("w").cast("decimal(19,0)") * big(rest)
        got = ranked.agg(F.sum(F.when(over, F.col("source_size") * max_epochs).otherwise(0)).alias("s"), F.sum(F.when(over, 0).otherwise(F.col("w"))).alias("w")).first()
        after = total - (got["s"] or 0), got["w"] or 1
        if after == (rest, share):
            break
        rest, share = after
    target = F.when(over, (F.col("source_size") * max_epochs).cast("double")).otherwise((F.col("w") * F.lit(rest)).cast("double") / F.lit(float(share)))
    return ranked.select("sid", "sk", "sn", "source_size", target.alias("target"))


def _with_plan(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    if few:
        return rows.join(F.broadcast(plan), ["sn", "sk"])
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["sn", "sk", "salt"]).drop("salt")


def mix(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``size, source_size, target, taken`` appended."""
    keep = tuple(docs.columns) if keep is None else keep
    sk, sn = F.coalesce(F.col(source_col).cast("string"), F.lit("")), F.col(source_col).isNull()
    size = word_count(F.col(text_col))
    base = docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in keep], sk.alias("sk"), sn.alias("sn"), size.alias("n"), F.col(id_col).alias("hid"))
    base = base.withColumn("h", doc_hash(F.col("hid"), F.col("n"))).drop("hid")
    light = set(keep) <= {id_col, source_col}
    if light:
        base = sized = cut(base, "mix-sized")
    else:
        sized = cut(base.select("sk", "sn", "n", "h"), "mix-sized")
    plan = source_targets(sized.groupBy("sn", "sk").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long")
    plan = cut(plan.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    few = plan.count() <= BROADCAST_SOURCES
    rows = sized.select("sn", "sk", "n", "h")
    rows = _with_plan(rows, plan.select("sid", "sn", "sk"), few).select("sid", "n", "h")
    if not few:
        rows = cut(rows, "mix-rows")
    state = plan.select("sid", F.lit(0).cast("long").alias("prefix"), "need")
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        here = state.select("sid", "prefix", "need")
        inside = rows.withColumn("prefix", F.shiftright("h", shift + STEP_BITS))
        inside = inside.join(F.broadcast(here) if few else here, ["sid", "prefix"])
        sums = inside.groupBy("sid", F.shiftright("h", shift).alias("b")).agg(F.sum("n").alias("s"), F.first("need").alias("need"))
        upto = F.sum("s").over(Window.partitionBy("sid").orderBy("b"))
        passed = sums.withColumn("upto", upto).where("upto >= need").groupBy("sid").agg(F.min_by(F.struct("b", "s", "upto", "need"), "b").alias("x"))
        state = cut(passed.select("sid", F.col("x.b").alias("prefix"), (F.col("x.need") - (F.col("x.upto") - F.col("x.s"))).alias("need"), F.col("x.s").alias("s")), "mix-level")
    # The document (or tied documents) at the threshold are taken when that comes nearer to the budget.
    edge = state.select("sid", F.when(F.col("s") - F.col("need") <= F.col("need"), F.col("prefix")).otherwise(F.col("prefix") - 1).alias("edge"))
    full = plan.join(edge, "sid", "left")
    more = F.when(F.col("edge").isNull() | (F.col("h") <= F.col("edge")), 1).otherwise(0)
    taken = (F.col("n") * F.least(F.col("whole") + more, F.lit(max_epochs))).cast("long")
    done = _with_plan(base, full, few)
    back = done.select(*[F.col(f"in_{c}").alias(c) for c in keep], F.col("n").alias("__n"), F.col("source_size").alias("__s"), F.col("target").alias("__t"), taken.alias("__k"))
    return replace_columns(back, {"size": F.col("__n"), "source_size": F.col("__s"), "target": F.col("__t"), "taken": F.col("__k")}).drop("__n", "__s", "__t", "__k")
