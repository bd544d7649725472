"""Running sums over long threads in two levels: windows within chunks of a thread, a summary of each chunk, windows over the summaries.

A chunk holds the rows whose first order column lies in one span of `size`, so a thread of any length is many tasks; only summaries, one
for each chunk, are put in order by thread. Thread keys are not null; the order columns tell rows of a thread apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import flag

SIZE = 4096
_EARLIER = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, 0)


def _chunk(order: str, size: int) -> Column:
    return F.floor(F.col(order) / F.lit(size)).cast("bigint")


def sums(rows: DataFrame, order: list[str], upto: dict[str, Column], totals: dict[str, Column] | None = None, key: str = "path", size: int = SIZE) -> DataFrame:
    """rows with running sums up to each row (nulls count as 0) and with sums of the whole thread. Order columns are not null."""
    totals = totals or {}
    held = rows.withColumn("_chunk", _chunk(order[0], size)).withColumns({f"_s_{n}": F.coalesce(c, F.lit(0)) for n, c in (upto | totals).items()})
    thread = Window.partitionBy(key)
    brief = held.groupBy(key, "_chunk").agg(*(F.sum(f"_s_{n}").alias(f"_b_{n}") for n in upto | totals))
    offset = {n: F.coalesce(F.sum(f"_b_{n}").over(thread.orderBy("_chunk").rowsBetween(*_EARLIER)), F.lit(0)) for n in upto} | {n: F.sum(f"_b_{n}").over(thread) for n in totals}
    brief = brief.select(key, "_chunk", *(c.alias(f"_o_{n}") for n, c in offset.items()))
    within = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(*_UPTO)
    held = held.withColumns({n: F.sum(f"_s_{n}").over(within) for n in upto}).join(brief, [key, "_chunk"])
    found = held.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in upto} | {n: F.col(f"_o_{n}") for n in totals})
    return found.select(*(c for c in rows.columns if c not in upto and c not in totals), *upto, *totals)


def previous(calls: DataFrame, names: dict[str, str], size: int = SIZE) -> DataFrame:
    """calls with columns of the call before (null at the first): new name to column. Calls are numbered `idx` without gaps, so the last
    call of a chunk is given to the next chunk too and nothing is joined."""
    here = _chunk("idx", size)
    chunks = F.when((F.col("idx") + 1) % size == 0, F.array(here, here + 1)).otherwise(F.array(here))
    order = Window.partitionBy("path", "_chunk").orderBy("idx")
    found = calls.withColumn("_chunk", F.explode(chunks)).withColumns({new: F.lag(old).over(order) for new, old in names.items()})
    return found.where(F.col("_chunk") == here).drop("_chunk")


def lives(calls: DataFrame, reset: Column, shrink: Column, rate: Column, totals: dict[str, Column] | None = None, size: int = SIZE) -> DataFrame:
    """calls with `life` (resets up to the call), `decay` (product of the shares kept, exp of `shrink`, since the life began), `Q` (sum of
    rate x decay since then), `Q_end` (Q of the life's last call) and `death` (the call after it), and with sums of the whole thread.

    A chunk's summary is what its last life multiplies and adds to what came in: (resets, log of its decay, its Q). Such summaries compose,
    so what comes into a chunk is a running sum since the last chunk with a reset."""
    totals = totals or {}
    nth = Window.partitionBy("path", "_chunk")
    own = Window.partitionBy("path", "_chunk", "_life")
    c = calls.withColumns({"_chunk": _chunk("idx", size), "_reset": flag(reset), "_log": F.coalesce(shrink, F.lit(0.0)), "_rate": F.coalesce(rate, F.lit(0.0))} | {f"_s_{n}": F.coalesce(t, F.lit(0)) for n, t in totals.items()})
    c = c.withColumn("_life", F.sum("_reset").over(nth.orderBy("idx").rowsBetween(*_UPTO)))
    c = c.withColumn("_log", F.sum("_log").over(own.orderBy("idx").rowsBetween(*_UPTO)))
    c = c.withColumn("_q", F.sum(F.col("_rate") * F.exp("_log")).over(own.orderBy("idx").rowsBetween(*_UPTO)))
    c = c.withColumns({"_q_end": F.max_by("_q", "idx").over(own), "_last": F.max("idx").over(own), "_resets": F.max("_life").over(nth)})
    # One row for each chunk: the head is the life that came in, the tail the one that goes out; the head may be empty.
    head = F.col("_life") == 0
    brief = c.groupBy("path", "_chunk").agg(
        F.max("_life").alias("resets"), F.max_by("_log", "idx").alias("tail_log"), F.max_by("_q", "idx").alias("tail_q"), F.max("idx").alias("tail_last"),
        F.max(F.when(head, F.col("_last"))).alias("head_last"), F.max(F.when(head, F.col("_q_end"))).alias("head_q"),
        *(F.sum(f"_s_{n}").alias(f"_b_{n}") for n in totals),
    )
    thread = Window.partitionBy("path").orderBy("_chunk")
    run = Window.partitionBy("path", "_run").orderBy("_chunk").rowsBetween(*_UPTO)
    fresh = F.col("resets") > 0
    brief = brief.withColumns({"_life0": F.coalesce(F.sum("resets").over(thread.rowsBetween(*_EARLIER)), F.lit(0)), "_run": F.sum(flag(fresh)).over(thread.rowsBetween(*_UPTO))})
    brief = brief.withColumn("_acc", F.sum("tail_log").over(run))
    brief = brief.withColumn("_log0", F.coalesce(F.lag("_acc").over(thread), F.lit(0.0)))
    brief = brief.withColumn("_acc", F.sum(F.when(fresh, F.col("tail_q")).otherwise(F.exp("_log0") * F.col("tail_q"))).over(run))
    brief = brief.withColumn("_q0", F.coalesce(F.lag("_acc").over(thread), F.lit(0.0)))
    # The life that came in ends where the last of its chunks has it; the one that goes out may go on as the head of the next chunk.
    same = Window.partitionBy("path", "_life0")
    brief = brief.withColumns({"_h_q": F.max_by(F.col("_q0") + F.exp("_log0") * F.col("head_q"), F.when(F.col("head_last").isNotNull(), F.col("_chunk"))).over(same), "_h_last": F.max("head_last").over(same)})
    brief = brief.withColumns({"_t_q": F.lead("_h_q").over(thread), "_t_last": F.lead("_h_last").over(thread)})
    brief = brief.withColumns({"_t_q": F.when(F.col("_t_last").isNull(), F.col("tail_q")).otherwise(F.col("_t_q")), "_t_last": F.coalesce("_t_last", "tail_last")})
    whole = (F.sum(f"_b_{n}").over(Window.partitionBy("path")).alias(n) for n in totals)
    c = c.join(brief.select("path", "_chunk", "_life0", "_log0", "_q0", "_h_q", "_h_last", "_t_q", "_t_last", *whole), ["path", "_chunk"])
    tail = F.col("_life") == F.col("_resets")
    found = c.withColumns({
        "life": F.col("_life") + F.col("_life0"),
        "decay": F.exp(F.col("_log") + F.when(head, F.col("_log0")).otherwise(0.0)),
        "Q": F.when(head, F.col("_q0") + F.exp("_log0") * F.col("_q")).otherwise(F.col("_q")),
        "Q_end": F.when(head, F.col("_h_q")).when(tail, F.col("_t_q")).otherwise(F.col("_q_end")),
        "death": F.when(head, F.col("_h_last")).when(tail, F.col("_t_last")).otherwise(F.col("_last")) + 1,
    })
    made = ["life", "decay", "Q", "Q_end", "death", *totals]
    return found.select(*(x for x in calls.columns if x not in made), *made)
