"""Audits over calls, items and timelines; each gives small aggregates that the reports turn into sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from .common import context, before, by_path, flag, or0, running

LISTINGS = {"skill_listing": "Skill", "deferred_tools_delta": "ToolSearch", "mcp_instructions_delta": "mcp"}
AGENTS = ("subagent", "workflow_agent")
PING_IN, PING_OUT, MARGIN = 10, 1, 30
REBUILD_TOKENS, REBUILD_SHARE = 2000, 0.1
CACHE_IDLE = 300
THRESHOLDS, CAP, NEED_RATE = (10_000, 25_000, 50_000), 10_000, 0.65


# ---- boot scope


def boot_threads(costed: DataFrame, items: DataFrame, uses: DataFrame) -> DataFrame:
    """A row for each agent thread whose first call is billed: boot, harness, listing, task and growth tokens, and their dollars."""
    c = costed.where(F.col("kind").isin(*AGENTS)).withColumn("ctx", context())
    first = c.where("idx = 0 and not copied").select("path", "kind", F.col("ctx").alias("boot"), F.col("model").alias("first_model"))
    at_boot = items.where("entry = 0 and item not in ('assistant_out', 'compact_marker')").join(first, "path")
    est = F.col("chars") / L.chars_per_token(F.col("first_model")) + F.col("img_tok")
    listed = {k: (F.col("item") == "attachment") & (F.col("sub") == k) for k in LISTINGS}
    other = ~((F.col("item") == "attachment") & F.coalesce(F.col("sub").isin(*LISTINGS), F.lit(False)))
    sums = at_boot.groupBy("path").agg(F.sum(F.when(other, est).otherwise(0.0)).alias("task"), *(F.sum(F.when(listed[k], est).otherwise(0.0)).alias(k) for k in LISTINGS))
    grown = c.withColumn("up", F.greatest(F.col("ctx") - before("ctx", "idx"), F.lit(0))).groupBy("path").agg(or0(F.sum("up")).alias("growth"))
    used = uses.groupBy("path").agg(F.collect_set("used_tool").alias("used"))
    t = first.join(sums, "path", "left").join(grown, "path", "left").join(used, "path", "left")
    t = t.withColumns({"used": F.coalesce("used", F.array().cast("array<string>")), **{k: F.coalesce(k, F.lit(0.0)) for k in ("task", *LISTINGS)}})
    t = t.withColumn("listing", sum((F.col(k) for k in LISTINGS), F.lit(0.0)))
    t = t.withColumn("harness", F.greatest(F.col("boot") - F.col("task") - F.col("listing"), F.lit(0.0))).withColumns({"shared": F.col("harness") + F.col("listing"), "task_unique": F.col("task") + F.col("growth")})
    share = lambda x: F.sum(F.when(F.col(x) != 0, F.col("in_cost") * F.least(F.lit(1.0), F.col(x) / F.col("ctx"))).otherwise(0.0))
    billed = c.where("not copied and ctx > 0").select("path", "ctx", "in_cost").join(t.select("path", "shared", *LISTINGS), "path")
    usd = billed.groupBy("path").agg(F.sum("in_cost").alias("input_usd"), share("shared").alias("shared_usd"), *(share(k).alias(f"usd_{k}") for k in LISTINGS))
    return t.join(usd, "path", "left").withColumn("n_used", F.least(F.size("used"), F.lit(10)))


def boot_totals(threads: DataFrame) -> DataFrame:
    agg = [F.count(F.lit(1)).alias("threads"), *(F.sum(flag(F.col("kind") == k)).alias(f"threads_{k}") for k in AGENTS)]
    agg += [F.sum(c).alias(c) for c in ("boot", "harness", "listing", "task", "task_unique", "input_usd", "shared_usd")] + [F.sum(flag(F.col("shared") > F.col("task_unique"))).alias("over")]
    for k, tool in LISTINGS.items():
        on = F.col(k) != 0
        idle = on & ~F.array_contains("used", tool)
        agg += [F.sum(flag(on)).alias(f"n_{k}"), F.sum(k).alias(f"tok_{k}"), F.sum(F.when(on, F.col(f"usd_{k}"))).alias(f"usd_{k}"), F.sum(flag(idle)).alias(f"idle_{k}"), F.sum(F.when(idle, F.col(k))).alias(f"idle_tok_{k}"), F.sum(F.when(idle, F.col(f"usd_{k}"))).alias(f"idle_usd_{k}")]
    return threads.agg(*agg)


def boot_sessions(calls: DataFrame, sources: DataFrame) -> DataFrame:
    """Vendor B by session source: boot against later growth. calls have the rates they paid; sources: (path, source)."""
    c = calls.withColumn("up", F.greatest(F.col("inp") - before("inp", "idx"), F.lit(0)))
    heads = c.where("idx = 0 and not copied").select("path", F.col("inp").alias("boot"))
    cost = F.greatest(F.col("inp") - F.col("ca"), F.lit(0)) * F.col("p_in") + F.col("ca") * F.col("p_cached")
    paid = (~F.col("copied")) & F.col("p_in").isNotNull() & (F.col("inp") > 0)
    each = c.join(heads, "path").groupBy("path", "boot").agg(or0(F.sum("up")).alias("growth"), F.coalesce(F.sum(F.when(paid, cost)), F.lit(0.0)).alias("input_usd"), F.coalesce(F.sum(F.when(paid, cost * F.least(F.lit(1.0), F.col("boot") / F.col("inp")))), F.lit(0.0)).alias("boot_usd"))
    return each.join(sources, "path", "left").groupBy("source").agg(F.count(F.lit(1)).alias("sessions"), F.sum("boot").alias("boot"), F.sum("growth").alias("growth"), F.sum(flag(F.col("boot") > F.col("growth"))).alias("over"), F.sum("input_usd").alias("input_usd"), F.sum("boot_usd").alias("boot_usd"))


# ---- keep-alive


def _pings(context) -> dict:
    write = F.when(F.col("hour"), F.col("p_w1")).otherwise(F.col("p_w5"))
    ping = context * F.col("p_read") + PING_IN * F.col("p_in") + PING_OUT * F.col("p_out")
    return {"ping": ping, "cap": F.when(ping > 0, F.floor(context * (write - F.col("p_read")) / ping)).otherwise(0), "extra": write - F.col("p_read")}


def idle_gaps(costed: DataFrame) -> DataFrame:
    """Idle gaps longer than the ping interval, with what pings and rebuilds cost at the prices of the call behind them."""
    thread = Window.partitionBy("path")
    c = costed.withColumn("ctx", context()).withColumn("hour", F.sum("cc1").over(thread) > F.sum("cc5").over(thread))
    c = c.withColumns({"ttl": F.when(F.col("hour"), 3600).otherwise(300), "prev_ts": before("ts", "idx"), "prev_model": before("model", "idx"), "prev_iters": before("iters", "idx"), "P": before("ctx", "idx")})
    c = c.withColumns({"every": F.col("ttl") - MARGIN, "gap": F.col("ts") - F.col("prev_ts")})
    g = c.where("idx > 0 and not copied and gap is not null and gap > every and model <=> prev_model and p_in is not null").where(F.coalesce(F.size("prev_iters"), F.lit(0)) <= 0)
    g = g.withColumns(_pings(F.col("P")))
    g = g.withColumns({"fired": F.floor(F.col("gap") / F.col("every")), "need": F.when(F.col("gap") > F.col("ttl"), F.ceil((F.col("gap") - F.col("ttl")) / F.col("every"))).otherwise(0), "rewritten": F.least(F.greatest(F.col("cc") - F.greatest(F.col("ctx") - F.col("P"), F.lit(0)), F.lit(0)), F.col("P"))})
    g = g.withColumn("rebuild", (F.col("gap") > F.col("ttl")) & (F.col("rewritten") > REBUILD_TOKENS) & (F.col("rewritten") > REBUILD_SHARE * F.greatest(F.col("P"), F.lit(1))))
    return g.withColumn("excess", F.when(F.col("rebuild"), F.col("rewritten") * F.col("extra")).otherwise(0.0))


def keepalive_totals(gaps: DataFrame) -> DataFrame:
    """By tier (is it the hour's?): gaps, rebuilds, and the three policies."""
    hind = F.col("rebuild") & (F.col("need") * F.col("ping") < F.col("excess"))
    bridged = F.col("rebuild") & (F.col("need") <= F.col("cap"))
    return gaps.groupBy("hour").agg(
        F.count(F.lit(1)).alias("gaps"), F.sum(flag(F.col("gap") > F.col("ttl"))).alias("over_ttl"), F.sum(flag(F.col("rebuild"))).alias("rebuilds"), F.sum("excess").alias("excess"),
        F.sum(flag(hind)).alias("hindsight_gaps"), F.sum(F.when(hind, F.col("excess") - F.col("need") * F.col("ping")).otherwise(0.0)).alias("hindsight"),
        F.sum(F.least("cap", "fired") * F.col("ping")).alias("capped_pings"), F.sum(F.when(bridged, F.col("excess")).otherwise(0.0)).alias("capped_saved"), F.sum(flag(bridged)).alias("bridged"),
        F.sum(F.col("fired") * F.col("ping")).alias("always_pings"), F.sum("excess").alias("always_saved"),
    )


def keepalive_tail(costed: DataFrame) -> DataFrame:
    """What the capped policy pays after the last call of each main thread."""
    thread = Window.partitionBy("path")
    c = costed.withColumn("ctx", context()).withColumns({"hour": F.sum("cc1").over(thread) > F.sum("cc5").over(thread), "last": F.max("idx").over(thread)})
    ends = c.where("idx = last and kind = 'main' and not copied and p_in is not null").withColumns(_pings(F.col("ctx")))
    return ends.agg(F.count(F.lit(1)).alias("threads"), F.coalesce(F.sum(F.col("cap") * F.col("ping")), F.lit(0.0)).alias("pings"))


# ---- polls


def poll_chains(calls: DataFrame, entered: DataFrame) -> DataFrame:
    """Runs of calls whose only new input was polls without new output, by islands.

    calls: (path, idx, cost, copied, ts in seconds, ca, rates); entered: (path, idx, empty): what entered each call. A row for each
    chain: first and last call, avoidable calls and their cost, and the penalty if the cache went cold meanwhile."""
    seen = entered.groupBy("path", "idx").agg(F.sum(flag(F.col("empty"))).alias("e"), F.sum(flag(~F.col("empty"))).alias("o"))
    c = calls.join(seen, ["path", "idx"], "left").withColumn("cand", (F.col("idx") > 0) & (or0("e") > 0) & (or0("o") == 0))
    c = c.withColumns({"start": before("ts", "idx"), "island": F.col("idx") - F.sum(flag(F.col("cand"))).over(running("idx")), "next": F.struct(*(F.lead(x).over(by_path("idx")).alias(x) for x in ("idx", "copied", "ts", "ca", "p_in", "p_cached")))})
    runs = c.where("cand").groupBy("path", "island").agg(
        F.min("idx").alias("first"), F.max("idx").alias("last"), F.min_by("start", "idx").alias("t0"), F.max_by("next", "idx").alias("next"),
        F.sum(flag(~F.col("copied") & F.col("cost").isNotNull())).alias("calls"), F.sum(flag(~F.col("copied") & F.col("cost").isNull())).alias("unpriced"), F.coalesce(F.sum(F.when(~F.col("copied"), F.col("cost"))), F.lit(0.0)).alias("usd"),
    )
    cold = F.coalesce(F.col("next.idx").isNotNull() & ~F.col("next.copied") & (F.col("next.ts") - F.col("t0") > CACHE_IDLE) & F.col("next.p_in").isNotNull(), F.lit(False))
    return runs.select("path", "first", "last", "calls", "unpriced", "usd", cold.alias("cold"), F.when(cold, F.col("next.ca") * (F.col("next.p_in") - F.col("next.p_cached"))).otherwise(0.0).alias("penalty"))


# ---- oversized outputs


def oversized(calls: DataFrame, items: DataFrame) -> DataFrame:
    """Each evictable item of the first threshold or more with what entering and carrying it cost, and what capping it would save."""
    at = calls.select("path", F.col("idx").alias("entry"), "ctx", "wt", "read_price", "write_price")
    after = calls.select("path", (F.col("idx") + 1).alias("x"), (F.col("cr_sum") + F.col("wt") * F.col("read_price")).alias("cr"))
    big = items.where(F.col("evictable") & (F.col("tokens") >= THRESHOLDS[0])).join(at, ["path", "entry"])
    big = big.join(after.select("path", F.col("x").alias("death"), F.col("cr").alias("cr_death")), ["path", "death"]).join(after.select("path", (F.col("x") - 1).alias("entry"), F.col("cr").alias("cr_entered")), ["path", "entry"])
    big = big.withColumn("usd", F.col("tokens") * F.col("write_price") * F.col("wt") + F.col("tokens") * (F.col("cr_death") - F.col("cr_entered")))
    capped = (F.col("tokens") > CAP) & (F.col("wt") > 0)
    over = F.col("tokens") - CAP
    saving = over * F.col("usd") / F.col("tokens")
    return big.withColumns({"capped": capped, "over": F.when(capped, over).otherwise(0.0), "saving": F.when(capped, saving).otherwise(0.0), "net": F.when(capped, (1 - NEED_RATE) * saving - NEED_RATE * F.col("ctx") * F.col("read_price")).otherwise(0.0)})


def oversized_totals(big: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    agg = []
    for t in THRESHOLDS:
        on = F.col("tokens") >= t
        agg += [or0(F.sum(flag(on))).alias(f"n_{t}"), zero(F.sum(F.when(on, F.col("tokens")))).alias(f"tokens_{t}"), zero(F.sum(F.when(on, F.col("usd")))).alias(f"usd_{t}")]
    return big.agg(*agg, or0(F.sum(flag(F.col("capped")))).alias("capped"), zero(F.sum("over")).alias("over"), zero(F.sum("saving")).alias("saving"), zero(F.sum("net")).alias("net"))
