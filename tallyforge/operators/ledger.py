"""The bill: what each call costs, and its totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flag, or0

TIERS = ("input", "cache_write_5m", "cache_write_1h", "cache_read", "output")


def attempt_costs(calls: DataFrame, zero=0.0) -> DataFrame:
    """calls with rates (p_in, p_w5, p_w1, p_read, p_out; null: no price) and the cost of each tier.

    Writes without a tier split cost as 5-minute writes."""
    plain = (or0("cc5") + or0("cc1") == 0) & (F.col("cc") > 0)
    five = F.when(plain, F.col("cc")).otherwise(or0("cc5"))
    cost = lambda tokens, rate: F.coalesce(tokens * F.col(rate), F.lit(zero))
    costs = {"input": cost(F.col("inp"), "p_in"), "cache_write_5m": cost(five, "p_w5"), "cache_write_1h": cost(F.col("cc1"), "p_w1"), "cache_read": cost(F.col("cr"), "p_read"), "output": cost(F.col("out"), "p_out")}
    own = F.when(F.col("copied"), F.lit(zero)) if "copied" in calls.columns else None
    costs = {f"c_{k}": own.otherwise(v) if own is not None else v for k, v in costs.items()}
    return calls.withColumns(costs).withColumns({"in_cost": F.col("c_input") + F.col("c_cache_write_5m") + F.col("c_cache_write_1h") + F.col("c_cache_read")}).withColumn("cost", F.col("in_cost") + F.col("c_output"))


def tiers(costed: DataFrame) -> DataFrame:
    """A row for each call and tier: model, kind, tier, tokens, cost. Tokens without a split count as 5-minute writes."""
    split = F.when(or0("cc5") + or0("cc1") > 0, F.col("cc5")).otherwise(F.col("cc"))
    counts = {"input": F.col("inp"), "cache_write_5m": split, "cache_write_1h": F.col("cc1"), "cache_read": F.col("cr"), "output": F.col("out")}
    return costed.select("model", "kind", F.inline(F.array(*(F.struct(F.lit(t).alias("tier"), counts[t].alias("tokens"), F.col(f"c_{t}").alias("cost")) for t in TIERS))))


def totals_a(costed: DataFrame) -> DataFrame:
    """Tokens and cost by tier, by tier and model, by tier and kind, and in all, in one pass over the billed calls."""
    rows = tiers(costed.where("not copied"))
    sets = rows.groupingSets([["tier"], ["tier", "model"], ["tier", "kind"], []], "tier", "model", "kind")
    return sets.agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.grouping_id().cast("bigint").alias("level"))


def call_flags() -> list[Column]:
    """Aggregates over calls: those without a price (un) and their tokens (un_tok), those in fast mode and those of one region."""
    none = F.col("p_in").isNull()
    tokens = F.col("inp") + F.col("cc") + F.col("cr") + F.col("out")
    return [F.sum(flag(none)).alias("un"), F.sum(F.when(none, tokens).otherwise(0)).alias("un_tok"), F.count_if(F.col("speed") == "fast").alias("fast"), F.count_if(F.col("geo") == "us").alias("us")]


def declined(costed: DataFrame) -> DataFrame:
    """(path, id, model, inp, cc, cc5, cc1, cr, out) of the attempts before the served one; a null model is the call's."""
    rows = costed.where("not copied and iters is not null").select("path", "id", F.col("model").alias("served"), F.inline("iters")).where("type = 'message'")
    return rows.withColumn("model", F.coalesce("model", "served")).withColumns({"speed": F.lit(None).cast("string"), "geo": F.lit(None).cast("string")})


def call_cost_b(calls: DataFrame) -> DataFrame:
    """Vendor-B calls (inp, ca, wr, out, rates p_in, p_cached, p_write, p_out) with their cost; null where unpriced."""
    fresh = F.greatest(F.lit(0), F.col("inp") - F.col("ca") - F.col("wr"))
    return calls.withColumn("fresh", fresh).withColumn("cost", F.col("fresh") * F.col("p_in") + F.col("ca") * F.col("p_cached") + F.col("wr") * F.col("p_write") + F.col("out") * F.col("p_out"))


def totals_b(costed: DataFrame) -> DataFrame:
    """By model and in all: calls, tokens, cost, its parts, long and unpriced calls."""
    money = lambda e: F.sum(F.when(F.col("cost").isNotNull(), e))
    rows = costed.where("not copied").withColumn("model", F.coalesce("model", F.lit("unknown")))
    return rows.rollup("model").agg(
        F.grouping("model").alias("whole"), F.count(F.lit(1)).alias("calls"), F.sum("inp").alias("inp"), F.sum("ca").alias("ca"), F.sum("wr").alias("wr"), F.sum("out").alias("out"), F.sum("reas").alias("reas"),
        F.sum(flag(F.col("over_threshold"))).alias("over"), F.sum(flag(F.col("over_threshold") & F.col("has_long"))).alias("long"),
        F.sum(flag(F.col("cost").isNull())).alias("unpriced"), F.sum(F.when(F.col("cost").isNull(), F.col("inp") + F.col("out")).otherwise(0)).alias("unpriced_tokens"),
        F.sum("cost").alias("cost"), money(F.col("ca") * F.col("p_cached")).alias("cached_in"), money(F.col("fresh") * F.col("p_in") + F.col("wr") * F.col("p_write")).alias("uncached_in"),
        money(F.col("reas") * F.col("p_out")).alias("out_reasoning"), money((F.col("out") - F.col("reas")) * F.col("p_out")).alias("out_visible"),
    )
