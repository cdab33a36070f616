"""Bounded training samples chosen by a hash of the id, whatever the size of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def bounded_sample(rows: DataFrame, group: str, id_col: str, per_group: int, total: int = 19_200) -> DataFrame:
    """About ``per_group`` rows of each group (all of a smaller group), fewer of each where there would be over ``total``."""
    groups = rows.select(group).distinct().count()
    if not groups:
        return rows.limit(0)
    each = float(max(1, min(per_group, total // groups)))
    # The least hash of a group always counts, so no group is left out by chance.
    at = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), 11) / F.lit(float(1 << 53))
    rows = rows.withColumn("__at", at)
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__least"))
    kept = rows.join(counts, group).where((F.col("__at") < F.lit(each) / F.col("__n")) | (F.col("__at") == F.col("__least")))
    return kept.drop("__at", "__n", "__least")
