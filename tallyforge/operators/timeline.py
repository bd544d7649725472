"""Timelines that the replay reads: calls with prices, and items with entry, tokens, death and whether they can be evicted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from .attribution import RESET_SHARE, SCHEMAS_LOADED
from .common import context, before, flag, or0, running

CALLS = ["path", "idx", "ctx", "wt", "read_price", "write_price", "out_price", "cw", "cr_sum"]
ITEMS = ["path", "seq", "entry", "tokens", "death", "evictable"]


def with_sums(calls: DataFrame) -> DataFrame:
    """cw and cr_sum: billed calls and billed read price before each call."""
    return calls.withColumns({"cw": F.sum("wt").over(running("idx")) - F.col("wt"), "cr_sum": F.sum(F.col("wt") * F.col("read_price")).over(running("idx")) - F.col("wt") * F.col("read_price")}).select(*CALLS)


def timeline_a(costed: DataFrame, items: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool results can be evicted; boot prefix, summaries, prompts and outputs cannot. A marker or a near-total reset ends all items."""
    thread = Window.partitionBy("path")
    hour = (or0("cc1") > or0("cc5")) | ((or0("cc1") == 0) & (or0("cc5") == 0) & (F.sum("cc1").over(thread) > F.sum("cc5").over(thread)))
    c = costed.withColumns({"ctx": context().cast("double"), "wt": F.when(F.col("copied"), 0).otherwise(1), "read_price": F.coalesce("p_read", F.lit(0.0)), "write_price": F.coalesce(F.when(hour, F.col("p_w1")).otherwise(F.col("p_w5")), F.lit(0.0)), "out_price": F.coalesce("p_out", F.lit(0.0)), "n": F.count(F.lit(1)).over(thread)})
    at = costed.select("path", F.col("idx").alias("entry"), F.col("model").alias("entry_model"))
    given = items.where("item not in ('compact_marker', 'assistant_out')").join(at, ["path", "entry"]).join(uses, ["path", "use_id"], "left")
    can = (F.col("item") == "tool_result") & (L.result_category(F.col("used_tool"), F.col("used_bash")) != SCHEMAS_LOADED)
    given = given.select("path", "entry", (F.col("chars") / L.chars_per_token(F.col("entry_model")) + F.col("img_tok")).alias("est"), can.alias("evictable"), F.lit(0).alias("rank"), F.col("line").alias("o1"), F.col("block").cast("bigint").alias("o2"))
    outs = items.where("item = 'assistant_out'").select("path", "entry", "src").distinct().join(costed.select("path", F.col("idx").alias("src"), F.col("out").cast("double").alias("est")), ["path", "src"])
    new = given.unionByName(outs.select("path", "entry", "est", F.lit(False).alias("evictable"), F.lit(1).alias("rank"), F.col("src").cast("bigint").alias("o1"), F.lit(0).cast("bigint").alias("o2")))
    sums = new.groupBy("path", F.col("entry").alias("idx")).agg(F.sum("est").alias("S"))
    marks = items.where("item = 'compact_marker'").select("path", F.col("entry").alias("idx"), F.lit(1).alias("marker")).distinct()
    c = c.join(sums, ["path", "idx"], "left").join(marks, ["path", "idx"], "left").withColumns({"S": F.coalesce("S", F.lit(0.0)), "marker": F.col("marker").isNotNull(), "prev": F.coalesce(before("ctx", "idx"), F.lit(0.0))})
    shrinks = (F.col("idx") > 0) & ~F.col("marker") & (F.col("ctx") < F.col("prev")) & (F.col("prev") > 0)
    c = c.withColumn("reset", (F.col("idx") == 0) | F.col("marker") | (shrinks & ((F.col("ctx") - F.least("S", "ctx")) / F.col("prev") < RESET_SHARE)))
    delta = F.col("ctx") - F.col("prev")
    c = c.withColumn("tail", F.when(delta >= 0, delta).otherwise(F.least("S", "ctx"))).withColumn("scale", F.when(F.col("S") > 0, F.least(F.lit(1.0), F.col("tail") / F.col("S"))).otherwise(0.0))
    c = c.withColumn("life", F.sum(flag(F.col("reset"))).over(running("idx")))
    c = c.withColumn("death", F.max("idx").over(Window.partitionBy("path", "life")) + 1)
    state = c.select("path", F.col("idx").alias("entry"), "ctx", "tail", "S", "scale", "reset", "death")
    entered = new.join(state.where("not reset"), ["path", "entry"]).select("path", "entry", (F.col("est") * F.col("scale")).alias("tokens"), "death", "evictable", "rank", "o1", "o2")
    tokens = F.when(F.col("reset"), F.col("ctx")).otherwise(F.col("tail") - F.col("S") * F.col("scale"))
    rest = state.withColumn("tokens", tokens).where("reset or tokens > 0").select("path", "entry", "tokens", "death", F.lit(False).alias("evictable"), F.lit(2).alias("rank"), F.lit(0).cast("bigint").alias("o1"), F.lit(0).cast("bigint").alias("o2"))
    rows = entered.unionByName(rest).withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("entry", "rank", "o1", "o2")) - 1)
    return with_sums(c), rows.select(*ITEMS)


def timeline_b(calls: DataFrame, tools: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool outputs can be evicted until their window ends; a rewritten suffix costs as uncached input. calls have the rates they paid."""
    window = Window.partitionBy("path", "window")
    c = calls.withColumns({"ctx": F.col("inp").cast("double"), "wt": F.when(F.col("copied"), 0).otherwise(1), "read_price": F.coalesce("p_cached", F.lit(0.0)), "write_price": F.coalesce("p_in", F.lit(0.0)), "out_price": F.coalesce("p_out", F.lit(0.0)), "win_start": F.min("idx").over(window), "win_end": F.max("idx").over(window) + 1})
    none = F.lit(0).cast("bigint")
    heads = c.where("idx = win_start").select("path", F.col("idx").alias("entry"), F.lit(0).alias("rank"), none.alias("o1"), F.col("ctx").alias("tokens"), F.col("win_end").alias("death"), F.lit(False).alias("evictable"))
    shown = c.where("out - reas > 0 and idx + 1 < win_end").select("path", (F.col("idx") + 1).alias("entry"), F.lit(1).alias("rank"), none.alias("o1"), (F.col("out") - F.col("reas")).cast("double").alias("tokens"), F.col("win_end").alias("death"), F.lit(False).alias("evictable"))
    at = c.select("path", F.col("idx").alias("pl"), "win_start", "win_end")
    said = messages.join(at, ["path", "pl"]).where("pl <> win_start").select("path", F.col("pl").alias("entry"), F.lit(2).alias("rank"), F.col("pos").cast("bigint").alias("o1"), (F.col("chars") / L.CHARS_B).alias("tokens"), F.col("win_end").alias("death"), F.lit(False).alias("evictable"))
    outs = tools.where("coalesce(part, 0) = 0").join(at, ["path", "pl"]).where("pl <> win_start").select("path", F.col("pl").alias("entry"), F.lit(3).alias("rank"), F.col("pos").cast("bigint").alias("o1"), (F.col("out_chars") / L.CHARS_B).alias("tokens"), F.col("win_end").alias("death"), F.lit(True).alias("evictable"))
    rows = heads.unionByName(shown).unionByName(said).unionByName(outs).withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("entry", "rank", "o1")) - 1)
    return with_sums(c), rows.select(*ITEMS)
