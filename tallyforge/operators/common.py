"""Window helpers. A thread is a column `path`; calls in it are numbered `idx`, from 0."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def exact_unions(spark: SparkSession) -> None:
    """Shuffles after a union stay: it may otherwise count as partitioned like its parts, though these are coalesced apart."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def by_path(*order: str) -> Window:
    return Window.partitionBy("path").orderBy(*order)


def running(*order: str) -> Window:
    return by_path(*order).rowsBetween(Window.unboundedPreceding, 0)


def before(column: str, *order: str) -> Column:
    return F.lag(column).over(by_path(*order))


def or0(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("bigint")


# The context of a vendor-A call: all its input tokens.
def context() -> Column:
    return or0("inp") + or0("cc") + or0("cr")


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder of spark.checkpoint.dir: its plan ends there, and a lost executor loses none of it."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tallyforge-"))
    return df.checkpoint()
