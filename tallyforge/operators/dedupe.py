"""Billing each response once across files: the file whose last record is oldest owns it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owners(ids: DataFrame, files: DataFrame) -> DataFrame:
    """(id, owner) of the ids that more than one file has. ids: (path, id); files: (path, last)."""
    at = ids.select("path", "id").distinct().join(files.select("path", "last"), "path", "left")
    order = F.struct(F.col("last").isNull().alias("none"), F.col("last").alias("last"), F.col("path").alias("path"))
    return at.groupBy("id").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.col("first.path").alias("owner"))


def marked(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (path, id) with `copied`: whether another file owns the id. No row is dropped."""
    return rows.join(found, "id", "left").withColumn("copied", F.coalesce(F.col("owner") != F.col("path"), F.lit(False))).drop("owner")


def stats(per_file: DataFrame, deduped: DataFrame) -> DataFrame:
    """(files, calls, usd): what global dedupe takes away. Both inputs: (path, usd) for each billed call."""
    total = per_file.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("usd").alias("u"))
    kept = deduped.groupBy("path").agg(F.count(F.lit(1)).alias("m"), F.sum("usd").alias("v"))
    both = total.join(kept, "path", "left").where(F.coalesce("m", F.lit(0)) < F.col("n"))
    return both.agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("n") - F.coalesce("m", F.lit(0))).alias("calls"), F.sum(F.col("u") - F.coalesce("v", F.lit(0))).alias("usd"))
