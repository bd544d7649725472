"""Vendor A: which context items cause a thread's input cost. Prefix sums and equi-joins, no row for each item and call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from .common import context, before, by_path, flag, or0, running

REBUILD_TOKENS, REBUILD_SHARE, RESET_SHARE = 2000, 0.1, 0.05
HOUR, MINUTES = 3600, 300
CAUSES = ("after_refusal_fallback", "model_switch", "ttl_expired_idle_gap", "idle_gap_5m_segment_on_1h_thread", "context_shrink_or_edit", "prefix_mutation_unexplained")
SCHEMAS_LOADED = "tool_result:ToolSearch:loaded_tool_schemas"


def estimates(items: DataFrame, uses: DataFrame, calls: DataFrame) -> DataFrame:
    """(path, entry, category, est): the new items of each call in tokens. What a call put out is split into thinking and visible
    text by its own counts and the characters of its parts."""
    at = calls.select("path", F.col("idx").alias("entry"), F.col("model").alias("entry_model"))
    rows = items.where("item <> 'compact_marker'").join(at, ["path", "entry"])
    given = rows.where("item <> 'assistant_out'").join(uses, ["path", "use_id"], "left")
    category = F.when(F.col("item") == "tool_result", L.result_category(F.col("used_tool"), F.col("used_bash"))).when(F.col("item") == "attachment", F.concat(F.lit("attachment:"), F.coalesce("sub", F.lit("None")))).otherwise(F.col("item"))
    given = given.select("path", "entry", category.alias("category"), (F.col("chars") / L.chars_per_token(F.col("entry_model")) + F.col("img_tok")).alias("est"))
    made = calls.select("path", F.col("idx").alias("src"), F.col("out").alias("src_out"), F.col("think").alias("src_think"), F.col("model").alias("src_model"))
    own = rows.where("item = 'assistant_out'").join(made, ["path", "src"])
    part = Window.partitionBy("path", "entry", "src")
    seen = F.col("sub") != "thinking"
    own = own.withColumns({"vis_chars": F.sum(F.when(seen, F.col("chars")).otherwise(0)).over(part), "vis_n": F.sum(flag(seen)).over(part), "thk_n": F.sum(flag(~seen)).over(part), "nth": F.row_number().over(part.orderBy("line", "block"))})
    guess = F.when(F.col("thk_n") > 0, F.least(F.col("vis_chars") / L.chars_per_token(F.col("src_model")), F.col("src_out").cast("double"))).otherwise(F.col("src_out").cast("double"))
    own = own.withColumn("vis_total", F.when(F.col("src_think").isNotNull(), F.greatest(F.col("src_out") - F.col("src_think"), F.lit(0)).cast("double")).otherwise(guess))
    own = own.withColumn("think_total", F.when(F.col("src_think").isNotNull(), F.col("src_think").cast("double")).otherwise(F.col("src_out") - F.col("vis_total")))
    once = own.where("nth = 1")
    thinking = once.where("think_total > 0").select("path", "entry", F.lit("assistant:thinking").alias("category"), F.col("think_total").alias("est"))
    bare = once.where("vis_total > 0 and vis_n = 0").select("path", "entry", F.lit("assistant:text").alias("category"), F.col("vis_total").alias("est"))
    share = F.when(F.col("vis_chars") > 0, F.col("chars") / F.col("vis_chars")).otherwise(1.0 / F.greatest(F.col("vis_n"), F.lit(1)))
    kind = F.when(F.col("sub") == "text", "assistant:text").otherwise(F.concat(F.lit("assistant:tool_input:"), F.coalesce("tool", F.lit("None"))))
    shown = own.where("vis_total > 0 and sub <> 'thinking'").select("path", "entry", kind.alias("category"), (F.col("vis_total") * share).alias("est"))
    return given.unionByName(thinking).unionByName(bare).unionByName(shown)


def _split(tail, cx):
    """The new tail of a call's input is priced write-first, then uncached, then read; the rest is the carried prefix."""
    tail_cc = F.least(tail, F.col("cc"))
    rest = tail - tail_cc
    tail_in = F.least(rest, F.col("inp"))
    tail_cr = F.least(rest - tail_in, F.col("cr"))
    cost = tail_cc * F.col("pw") + tail_in * or0("p_in") + tail_cr * or0("p_read")
    return {"tail_cost": cost, "old_tok": cx - tail, "old_cost": F.greatest(F.col("in_cost") - cost, F.lit(0.0)), "rewrite": F.col("cc") - tail_cc}


def call_states(costed: DataFrame, new: DataFrame, markers: DataFrame) -> DataFrame:
    """Each call with its tail, prefix, reset and rebuild, and the running sums from which an item's carry follows.

    costed: calls with rates and in_cost; new: estimates(); markers: (path, entry) of compaction markers."""
    sums = new.groupBy("path", F.col("entry").alias("idx")).agg(F.sum("est").alias("new_tokens"), F.max(flag(F.col("category") == "tool_result:ToolSearch")).alias("loads"))
    marks = markers.select("path", F.col("entry").alias("idx"), F.lit(1).alias("marker")).distinct()
    c = costed.join(sums, ["path", "idx"], "left").join(marks, ["path", "idx"], "left")
    thread = Window.partitionBy("path")
    pw = F.when(or0("cc5") + or0("cc1") > 0, (F.col("cc5") * or0("p_w5") + F.col("cc1") * or0("p_w1")) / (F.col("cc5") + F.col("cc1"))).otherwise(or0("p_w5"))
    c = c.withColumns({"ctx": context().cast("double"), "w": F.when(F.col("copied"), 0.0).otherwise(1.0), "S": F.coalesce("new_tokens", F.lit(0.0)), "marker": F.coalesce(F.col("marker") == 1, F.lit(False)), "pw": pw, "n": F.count(F.lit(1)).over(thread)})
    c = c.withColumns({"ttl": F.when(F.sum("cc1").over(thread) > F.sum("cc5").over(thread), HOUR).otherwise(MINUTES), "prev_ctx": F.coalesce(before("ctx", "idx"), F.lit(0.0)), "prev_model": before("model", "idx"), "prev_ts": before("ts", "idx"), "prev_iters": before("iters", "idx")})
    delta = F.col("ctx") - F.col("prev_ctx")
    c = c.withColumn("tail", F.when((F.col("idx") == 0) | F.col("marker"), F.col("ctx")).otherwise(F.when(delta >= 0, delta).otherwise(F.least("S", "ctx"))))
    c = c.withColumns(_split(F.col("tail"), F.col("ctx")))
    c = c.withColumn("shrinks", (F.col("idx") > 0) & ~F.col("marker") & (delta < 0))
    c = c.withColumn("f", F.when(F.col("shrinks"), F.when(F.col("prev_ctx") > 0, F.col("old_tok") / F.col("prev_ctx")).otherwise(0.0)).otherwise(1.0))
    c = c.withColumn("near_reset", F.col("shrinks") & (F.col("f") < RESET_SHARE))
    c = c.withColumns({"reset": F.col("marker") | F.col("near_reset"), "tail": F.when(F.col("near_reset"), F.col("ctx")).otherwise(F.col("tail"))})
    again = _split(F.col("tail"), F.col("ctx"))
    c = c.withColumns({k: F.when(F.col("near_reset"), again[k] if k == "tail_cost" else F.lit(0.0)).otherwise(F.col(k)) for k in again})
    c = c.withColumn("tail_price", F.when(F.col("tail") > 0, F.col("tail_cost") / F.col("tail")).otherwise(0.0))
    c = c.withColumn("rebuild", (F.col("idx") > 0) & ~F.col("reset") & (F.col("rewrite") > REBUILD_TOKENS) & (F.col("rewrite") > REBUILD_SHARE * F.greatest(F.col("old_tok"), F.lit(1.0))))
    c = c.withColumn("excess", F.when(F.col("rebuild"), F.least(F.col("rewrite") * F.greatest(F.col("pw") - or0("p_read"), F.lit(0.0)), F.col("old_cost"))).otherwise(0.0))
    # A life runs from one reset to the next. No item outlives it, so the running product F and sum Q begin anew in each.
    c = c.withColumn("life", F.sum(flag(F.col("reset") & (F.col("idx") > 0))).over(running("idx")))
    life = Window.partitionBy("path", "life")
    upto = life.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    keep = F.when(F.col("shrinks") & ~F.col("near_reset"), F.log("f")).otherwise(0.0)
    c = c.withColumns({"decay": F.exp(F.sum(keep).over(upto)), "opss": F.when(F.col("old_tok") > 0, (F.col("old_cost") - F.col("excess")) / F.col("old_tok")).otherwise(0.0)})
    c = c.withColumn("Q", F.sum(F.col("opss") * F.col("decay") * F.col("w")).over(upto))
    return c.withColumns({"Q_end": F.max_by("Q", "idx").over(life), "death": F.max("idx").over(life) + 1, "cause": F.when(F.col("rebuild") & ~F.col("copied"), cause())})


def cause():
    gap = F.when(F.col("ts").isNotNull() & F.col("prev_ts").isNotNull(), F.col("ts") - F.col("prev_ts")).otherwise(0.0)
    return (
        F.when(F.coalesce(F.size("prev_iters") > 0, F.lit(False)), CAUSES[0]).when(~F.col("model").eqNullSafe(F.col("prev_model")), CAUSES[1]).when(gap > F.col("ttl"), CAUSES[2])
        .when((F.col("ttl") == HOUR) & (gap > MINUTES), CAUSES[3]).when(F.col("ctx") < F.col("prev_ctx"), CAUSES[4]).otherwise(CAUSES[5])
    )


def item_costs(states: DataFrame, new: DataFrame) -> DataFrame:
    """(path, category, entry, tokens, entry_usd, carry_usd): every item with what it cost on entry and while it was carried."""
    plain = (F.col("idx") > 0) & ~F.col("reset")
    scale = F.when(F.col("S") > 0, F.least(F.lit(1.0), F.col("tail") / F.col("S"))).otherwise(0.0)
    state = states.select("path", "idx", "tail", "S", scale.alias("scale"), plain.alias("plain"), "ctx", "marker", "in_cost", "tail_price", "w", "decay", "Q", "Q_end", "death", "loads")
    entered = new.withColumnRenamed("entry", "idx").join(state.where("plain"), ["path", "idx"]).withColumn("tokens", F.col("est") * F.col("scale")).withColumn("own", F.lit(None).cast("double"))
    whole = state.where("not plain").withColumns({"category": F.when(F.col("idx") == 0, "boot_prefix").when(F.col("marker"), "post_compact_context").otherwise("post_reset_context"), "tokens": F.col("ctx"), "own": F.col("in_cost")})
    rest = F.col("tail") - F.col("S") * F.col("scale")
    grown = state.where("plain").withColumn("tokens", rest).where("tokens > 0").withColumns({"category": F.when(F.col("loads") == 1, SCHEMAS_LOADED).otherwise("unattributed_growth"), "own": F.lit(None).cast("double")})
    columns = ["path", "idx", "category", "tokens", "own", "tail_price", "w", "decay", "Q", "Q_end", "death"]
    rows = entered.select(*columns).unionByName(whole.select(*columns)).unionByName(grown.select(*columns))
    carry = F.when((F.col("decay") > 0) & (F.col("death") - 1 > F.col("idx")), F.col("tokens") / F.col("decay") * (F.col("Q_end") - F.col("Q"))).otherwise(0.0)
    return rows.select("path", "category", F.col("idx").alias("entry"), "tokens", F.coalesce("own", F.col("tokens") * F.col("tail_price") * F.col("w")).alias("entry_usd"), carry.alias("carry_usd"))


def by_category(costs: DataFrame, states: DataFrame) -> DataFrame:
    """(category, usd, tokens, items), with the excess of rebuilds by cause."""
    rows = costs.groupBy("category").agg(F.sum(F.col("entry_usd") + F.col("carry_usd")).alias("usd"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    return rows.unionByName(rebuilds(states).select(F.concat(F.lit("cache_rebuild_excess:"), "cause").alias("category"), F.col("usd"), F.lit(0.0).alias("tokens"), F.lit(0).cast("bigint").alias("items")))


def rebuilds(states: DataFrame) -> DataFrame:
    """(cause, events, tokens, usd)."""
    return states.where("cause is not null").groupBy("cause").agg(F.count(F.lit(1)).alias("events"), F.sum("rewrite").alias("tokens"), F.sum("excess").alias("usd"))
