"""Vendor B: context rent, the tokens and dollars that resident content takes on every later call, from prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import CHARS_B
from .common import or0, running

# Rates of models without a price, in USD a token.
NOMINAL_IN, NOMINAL_CACHED = 1.0 / 1e6, 0.1 / 1e6


def resident_calls(calls: DataFrame) -> DataFrame:
    """calls (path, idx, window, turn, copied, rates of short requests) with weights, their running sums, and the ends of windows and turns."""
    window, turn = Window.partitionBy("path", "window"), Window.partitionBy("path", "window", "turn")
    c = calls.withColumn("w", F.when(F.col("copied"), 0).otherwise(1))
    c = c.withColumns({"cum": F.sum("w").over(running("idx")) - F.col("w"), "win_start": F.min("idx").over(window), "win_end": F.max("idx").over(window) + 1, "turn_end": F.max("idx").over(turn) + 1})
    c = c.withColumns({"cum_win": F.max(F.col("cum") + F.col("w")).over(window), "cum_turn": F.max(F.col("cum") + F.col("w")).over(turn)})
    return c.withColumns({"pin": F.coalesce("p_in", F.lit(NOMINAL_IN)), "pc": F.coalesce("p_cached", F.lit(NOMINAL_CACHED))})


def rent(calls: DataFrame, tools: DataFrame, messages: DataFrame) -> DataFrame:
    """(category, token_calls, usd, weighted) of all sessions.

    Content is resident from the call that it enters to the end of its window (reasoning: of its turn)."""
    c = resident_calls(calls)
    n = c.groupBy("path").agg(F.max(F.col("idx") + 1).alias("n"), F.max(F.col("cum") + F.col("w")).alias("cum_n"))
    heads = c.where("idx = win_start").withColumn("R", F.col("cum_win") - F.col("cum"))
    first = (F.col("inp") - F.col("ca")) * F.col("pin") + F.col("ca") * F.col("pc")
    baseline = heads.select(
        F.when(F.col("idx") == 0, "prefix_first_window").otherwise("post_compaction_baseline").alias("category"), (F.col("inp") * F.col("R")).cast("double").alias("token_calls"),
        (first * F.col("w") + F.col("inp") * (F.col("R") - F.col("w")) * F.col("pc")).alias("usd"), (first / F.col("pin") * F.col("w") + F.col("inp") * (F.col("R") - F.col("w")) * F.col("pc") / F.col("pin")).alias("weighted"),
    )
    at = c.select("path", F.col("idx").alias("pl"), "w", "cum", "pin", "pc", "win_start", "cum_win")
    visible = c.select("path", (F.col("idx") + 1).alias("pl"), F.lit("model_visible_output").alias("category"), (F.col("out") - F.col("reas")).cast("double").alias("T"), F.col("cum_win").alias("cum_b"))
    thought = c.select("path", (F.col("idx") + 1).alias("pl"), F.lit("reasoning_carried").alias("category"), F.col("reas").cast("double").alias("T"), F.col("cum_turn").alias("cum_b"))
    outputs = tools.select("path", "pl", F.concat(F.lit("tool_output:"), F.coalesce("kind", "tool")).alias("category"), (F.coalesce("vis", F.col("out_chars").cast("double")) / CHARS_B).alias("T"))
    said = messages.select("path", "pl", F.concat(F.lit("message:"), "kind").alias("category"), (F.col("chars") / CHARS_B).alias("T"))
    entered = outputs.unionByName(said).join(at, ["path", "pl"]).where("pl <> win_start").withColumn("cum_b", F.col("cum_win"))
    after = visible.unionByName(thought).join(at, ["path", "pl"], "left").join(n.select("path", "cum_n"), "path").withColumn("cum", F.coalesce("cum", "cum_n"))
    columns = ["category", "T", "cum", "cum_b", "w", "pin", "pc"]
    held = entered.select(*columns).unionByName(after.select(*columns)).withColumns({"R": F.col("cum_b") - F.col("cum"), "w": or0("w"), "pin": F.coalesce("pin", F.lit(NOMINAL_IN)), "pc": F.coalesce("pc", F.lit(NOMINAL_CACHED))}).where("T > 0 and R > 0")
    later = F.col("R") - F.col("w")
    carried = held.select("category", (F.col("T") * F.col("R")).alias("token_calls"), (F.col("T") * F.col("pin") * F.col("w") + F.col("T") * later * F.col("pc")).alias("usd"), (F.col("T") * (F.col("w") + F.col("pc") / F.col("pin") * later)).alias("weighted"))
    return baseline.unionByName(carried).groupBy("category").agg(F.sum("token_calls").alias("token_calls"), F.sum("usd").alias("usd"), F.sum("weighted").alias("weighted"))
