"""Firsts of keys and numbers in a global order, with no task that holds all rows of a hot key or the whole order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: A key of more than one row in HOT is hot, so fewer than HOT keys are: their firsts are broadcast.
HOT = 256
#: Of a global order, BOUNDS ranges are cut from SAMPLE keys; they decide how even the ranges are, never a number.
BOUNDS, SAMPLE = 64, 4096


def with_least(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """rows with the least `value` of their key as `name`; null where the key is null.

    The leasts are one aggregate, combined before its shuffle. Hot keys get theirs from a broadcast of fewer than HOT rows, all other rows from
    a join; in that join the rows of hot and null keys are spread by their hash and meet nothing."""
    least, count, hot = f"_{name}", f"_n_{name}", f"_hot_{name}"
    firsts = cut(rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(value).alias(least), F.count(F.lit(1)).alias(count)))
    total = firsts.agg(F.sum(count).alias("_total"))
    hottest = firsts.join(F.broadcast(total), how="cross").where(F.col(count) * HOT > F.col("_total")).select("_k", F.col(least).alias(hot))
    at = rows.join(F.broadcast(hottest), F.col(key) == F.col("_k"), "left").drop("_k")
    alone = F.concat(F.lit("\0"), F.hex(F.xxhash64(*(c for c, t in rows.dtypes if not t.startswith(("map", "variant"))))))
    at = at.withColumn("_j", F.when(F.col(hot).isNull() & F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(alone))
    cold = firsts.select(F.concat(F.lit("k"), F.col("_k").cast("string")).alias("_j"), least)
    return at.join(cold, "_j", "left").withColumn(name, F.coalesce(hot, least)).drop("_j", hot, least)


def numbered(rows: DataFrame, order: str, name: str, bounds: int = BOUNDS) -> DataFrame:
    """rows with their place in the order of a column of distinct values, from 1.

    Ranges of the order are numbered within, and the counts of the ranges before are added: `bounds` + 1 counts at most go to every task.
    The range limits are values of the rows with the SAMPLE least hashes, so they are the same in every attempt of a task."""
    sample = rows.select(order).orderBy(F.xxhash64(F.col(order)), F.col(order)).limit(SAMPLE)
    sorted_ = sample.agg(F.sort_array(F.collect_list(order)).alias("_all"))
    step = f"greatest(cast(floor(size(_all) / {int(bounds)}) as int), 1)"
    limits = sorted_.select(F.expr(f"filter(_all, (x, i) -> i > 0 and i % {step} = 0)").alias("_limits"))
    at = rows.join(F.broadcast(limits), how="cross").withColumn("_range", F.size(F.filter("_limits", lambda x: x <= F.col(order)))).drop("_limits")
    counts = at.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).agg(F.collect_list(F.struct("_range", "_n")).alias("_counts"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    ahead = F.aggregate(F.filter("_counts", lambda c: c["_range"] < F.col("_range")), F.lit(0).cast("bigint"), lambda a, c: a + c["_n"])
    return at.withColumn("_within", within).join(F.broadcast(counts), how="cross").withColumn(name, F.col("_within") + ahead).drop("_within", "_range", "_counts")
