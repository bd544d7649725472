"""Vendor A: calls, tool uses and context items of a thread, from the rows of the transcript source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_path, or0


def merged_usage(records: DataFrame) -> DataFrame:
    """One row for each response of a file (path, key), from its streamed records in the order of `line`.

    The first record fixes model, time and place; input is the latest that is not 0, cache fields are the latest that are not
    null, output and thinking the largest, fast and us stick, and attempts are the latest list."""
    late = lambda c, cond: F.expr(f"max_by({c}, line) filter (where {cond})")
    return records.groupBy("path", "key").agg(
        F.min("line").alias("first_line"), F.min_by("kind", "line").alias("kind"), F.min_by("model", "line").alias("model"), F.min_by("ts", "line").alias("ts"),
        F.coalesce(late("inp", "inp <> 0"), F.lit(0)).alias("inp"), F.coalesce(late("cc", "cc is not null"), F.lit(0)).alias("cc"),
        F.coalesce(late("cc5", "tiers"), F.lit(0)).alias("cc5"), F.coalesce(late("cc1", "tiers"), F.lit(0)).alias("cc1"),
        F.coalesce(late("cr", "cr is not null"), F.lit(0)).alias("cr"), F.coalesce(F.max("out"), F.lit(0)).alias("out"), F.max("think").alias("think"),
        F.when(F.bool_or("fast"), "fast").alias("speed"), F.when(F.bool_or("us"), "us").alias("geo"), late("iters", "iters is not null").alias("iters"),
    )


def calls(rows: DataFrame) -> DataFrame:
    """Calls numbered by their first record; `id` is the response, `copied` is false until dedupe."""
    found = merged_usage(rows.where("tag = 'call'")).withColumnRenamed("key", "id")
    return found.withColumns({"idx": F.row_number().over(by_path("first_line")) - 1, "copied": F.lit(False)})


def items(rows: DataFrame, made: DataFrame) -> DataFrame:
    """(path, entry, seq, item, sub, chars, img_tok, use_id, tool, bash, src): what enters the context of call `entry`.

    An item enters the next new call after it; `src` is the call that put out an assistant item."""
    marks = made.select("path", F.col("first_line").alias("line"), F.lit(-1).alias("block"), F.lit(1).alias("opens"))
    found = rows.where("tag = 'item'").select("path", "line", "block", "key", "item", "sub", "chars", "img_tok", "use_id", "tool", "bash", F.lit(0).alias("opens"))
    both = found.unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("entry", F.sum("opens").over(by_path("line", "block").rowsBetween(Window.unboundedPreceding, 0)))
    sizes = made.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    entered = both.where("opens = 0").join(sizes, "path").where("entry < n")
    sources = made.select("path", F.col("id").alias("key"), F.col("idx").alias("src"))
    entered = entered.join(sources, ["path", "key"], "left")
    return entered.select("path", "entry", "line", "block", "item", "sub", or0("chars").alias("chars"), or0("img_tok").alias("img_tok"), "use_id", "tool", "bash", "src")


def tool_uses(rows: DataFrame) -> DataFrame:
    """(path, use_id, used_tool, used_bash): the last use of an id wins."""
    found = rows.where("tag = 'item' and sub = 'tool_use'").groupBy("path", "use_id").agg(F.max_by(F.struct("tool", "bash"), F.struct("line", "block")).alias("x"))
    return found.select("path", "use_id", F.col("x.tool").alias("used_tool"), F.col("x.bash").alias("used_bash"))
