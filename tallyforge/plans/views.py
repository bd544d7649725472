"""The driver's tables as the relations that the operators take, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import prices as P

MODELS = {"click": "claude-opus-5-5", "purchase": "claude-fable-5-1", "signup": "claude-sonnet-4-5-20250929", "view": "claude-opus-5"}
TAGS = {"click": "reasoning", "purchase": "tc", "signup": "out", "view": "call"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def pick(column, names: dict, other: str):
    out = F.lit(other)
    for k, v in names.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def pick_sql(column: str, names: dict, other: str) -> str:
    return f"case {column} {' '.join(f"when '{k}' then '{v}'" for k, v in names.items())} else '{other}' end"


def calls_a(spark: SparkSession, sf: str) -> DataFrame:
    """events as vendor-A calls: a user is a thread."""
    e = table(spark, sf, "events").withColumns({"k": F.regexp_extract("props", r"(\d+)", 1).cast("bigint"), "us": micros("ts")})
    wrote = F.floor(F.col("value") * 60)
    third = F.col("event_id") % 3
    return e.select(
        F.col("user_id").cast("string").alias("path"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint").alias("idx"), "event_id", "us", (F.col("us") / 1e6).alias("ts"),
        pick(F.col("event_type"), MODELS, "other-model").alias("model"), F.element_at(F.array(*map(F.lit, ("main", "subagent", "workflow_agent"))), (F.col("user_id") % 3 + 1).cast("int")).alias("kind"),
        F.col("k").alias("inp"), wrote.alias("cc"), F.when(third == 1, wrote).otherwise(0).alias("cc5"), F.when(third == 2, wrote).otherwise(0).alias("cc1"), F.floor(F.col("value") * 100).alias("cr"), (F.col("k") * 3).alias("out"),
        F.when(F.col("event_id") % 5 == 0, "fast").alias("speed"), F.when(F.col("event_id") % 7 == 0, "us").alias("geo"), F.lit(False).alias("copied"), F.lit(None).cast("array<int>").alias("iters"),
    )


CALLS_A = f"""ev as (select *, cast(regexp_extract(props, '(\\d+)', 1) as bigint) as k, epoch_us(ts) as us, cast(floor(value * 60) as bigint) as wrote from events),
pc as (select cast(user_id as varchar) as path, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, event_id, us, us / 1e6 as ts, {pick_sql('event_type', MODELS, 'other-model')} as model,
  ['main', 'subagent', 'workflow_agent'][user_id % 3 + 1] as kind, k as inp, wrote as cc, case when event_id % 3 = 1 then wrote else 0 end as cc5, case when event_id % 3 = 2 then wrote else 0 end as cc1,
  cast(floor(value * 100) as bigint) as cr, k * 3 as out, case when event_id % 5 = 0 then 'fast' end as speed, case when event_id % 7 = 0 then 'us' end as geo from ev)"""


def rates_a_sql() -> str:
    """A VALUES list of exact rates (nano-dollars a token)."""
    p = P.SnapshotA.load()
    rows = []
    for m, (i, w5, w1, rd, o) in p.models.items():
        for speed in ("", "fast"):
            a, b, c, d, e = (i, w5, w1, rd, o) if not speed or m not in p.fast else (p.fast[m][0], p.fast[m][0] * 1.25, p.fast[m][0] * 2, p.fast[m][0] * (rd / i), p.fast[m][1])
            for geo, f in (("", 1.0), ("us", p.us)):
                rows.append(f"('{m}', '{speed}', '{geo}', {', '.join(str(round(x * f * 1000)) for x in (a, b, c, d, e))})")
    return f"pa as (select * from (values {', '.join(rows)}) as v(base, speed, geo, p_in, p_w5, p_w1, p_read, p_out))"


def rated_a_sql() -> str:
    """pc with exact rates and costs: `rc`."""
    names = ", ".join(f"'{m}'" for m in P.SnapshotA.load().models)
    return f"""{CALLS_A}, {rates_a_sql()},
rb as (select pc.*, case when model in ({names}) then model when regexp_extract(model, '^(.+)-\\d{{8}}$', 1) in ({names}) then regexp_extract(model, '^(.+)-\\d{{8}}$', 1) end as price_id from pc),
rr as (select rb.*, p_in, p_w5, p_w1, p_read, p_out from rb left join pa on price_id = base and coalesce(rb.speed, '') = pa.speed and coalesce(rb.geo, '') = pa.geo),
rc as (select *, coalesce(inp * p_in, 0) as c_input, coalesce(case when cc5 + cc1 = 0 and cc > 0 then cc else cc5 end * p_w5, 0) as c_cache_write_5m, coalesce(cc1 * p_w1, 0) as c_cache_write_1h, coalesce(cr * p_read, 0) as c_cache_read, coalesce(out * p_out, 0) as c_output from rr),
rk as (select *, c_input + c_cache_write_5m + c_cache_write_1h + c_cache_read as in_cost, c_input + c_cache_write_5m + c_cache_write_1h + c_cache_read + c_output as cost from rc)"""


def calls_b(spark: SparkSession, sf: str) -> DataFrame:
    """orders as vendor-B calls: a customer is a session, its orders by date are the calls."""
    o = table(spark, sf, "orders").withColumn("inp", F.floor("o_totalprice"))
    names = ["gpt-5.6-sol", "gpt-5.5-2026-04-01", "gpt-6-luna", "codex-auto-review", "gpt-5-mini"]
    return o.select(
        F.col("o_custkey").cast("string").alias("path"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).cast("bigint").alias("idx"), F.col("o_orderkey").alias("id"),
        F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("model"), "inp", F.floor(F.col("inp") / 2).alias("ca"), (F.col("o_orderkey") % 1000).alias("wr"), (F.col("o_orderkey") % 700).alias("out"), (F.col("o_orderkey") % 90).alias("reas"),
        F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 11 == 0).alias("copied"), micros("o_orderdate").alias("us"),
    )


CALLS_B = """pb as (select cast(o_custkey as varchar) as path, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as idx, o_orderkey as id,
  ['gpt-5.6-sol', 'gpt-5.5-2026-04-01', 'gpt-6-luna', 'codex-auto-review', 'gpt-5-mini'][o_orderkey % 5 + 1] as model, cast(floor(o_totalprice) as bigint) as inp, cast(floor(floor(o_totalprice) / 2) as bigint) as ca, o_orderkey % 1000 as wr, o_orderkey % 700 as out, o_orderkey % 90 as reas,
  o_orderstatus as status, o_orderkey % 11 = 0 as copied, epoch_us(o_orderdate) as us from orders)"""


def rated_b_sql() -> str:
    """pb with exact rates and cost: `bk`."""
    p = P.SnapshotB.load()
    base = " ".join([f"when model in ({', '.join(f"'{m}'" for m in p.models)}) then model", *(f"when starts_with(model, '{m}-2') then '{m}'" for m in p.models)])
    rows = []
    for m, plain in p.models.items():
        for long in (False, True):
            i, c, w, o = p.long.get(m, plain) if long else plain
            rows.append(f"('{m}', {str(long).lower()}, {str(m in p.long).lower()}, {round(i * 1000)}, {round(c * 1000)}, {round((i if w is None else w) * 1000)}, {round(o * 1000)})")
    return f"""{CALLS_B}, tb as (select * from (values {', '.join(rows)}) as v(base, is_long, has_long, p_in, p_cached, p_write, p_out)),
bb as (select *, case {base} end as price_id, inp > {p.threshold} as over_threshold, greatest(0, inp - ca - wr) as fresh from pb),
bk as (select bb.*, has_long, p_in, p_cached, p_write, p_out, fresh * p_in + ca * p_cached + wr * p_write + out * p_out as cost from bb left join tb on price_id = base and over_threshold = is_long)"""


def items_a(spark: SparkSession, sf: str) -> DataFrame:
    """lineitems as what enters the orders of a customer: entry is the order's number."""
    li = table(spark, sf, "lineitem")
    o = calls_b(spark, sf).select("path", F.col("idx").alias("entry"), F.col("id").alias("l_orderkey"))
    return li.join(o, "l_orderkey").select("path", "entry", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.floor(F.col("l_quantity") * 200).alias("tokens"), "l_returnflag", "l_linestatus")


ITEMS_A = "it as (select path, idx as entry, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, cast(floor(l_quantity * 200) as bigint) as tokens, l_returnflag, l_linestatus from lineitem join pb on l_orderkey = id)"


def timeline(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders and lineitems as a timeline: the context is the sum of live items; an order of status F ends all before it."""
    from ..operators.timeline import with_sums

    c, i = calls_b(spark, sf), items_a(spark, sf)
    c = c.withColumn("life", F.sum(F.when((F.col("status") == "F") & (F.col("idx") > 0), 1).otherwise(0)).over(Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("death", F.max("idx").over(Window.partitionBy("path", "life")) + 1)
    own = i.groupBy("path", F.col("entry").alias("idx")).agg(F.sum("tokens").alias("new"))
    c = c.join(own, ["path", "idx"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    c = c.withColumn("ctx", F.sum("new").over(Window.partitionBy("path", "life").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)).cast("double"))
    c = c.withColumns({"wt": F.when(F.col("copied"), 0).otherwise(1), "read_price": F.lit(2.0) + F.col("idx") % 3, "write_price": F.lit(25.0), "out_price": F.lit(50.0)})
    rows = i.join(c.select("path", F.col("idx").alias("entry"), "death"), ["path", "entry"])
    seq = F.row_number().over(Window.partitionBy("path").orderBy("entry", "l_partkey", "l_suppkey", "l_linenumber")) - 1
    return with_sums(c), rows.select("path", seq.cast("bigint").alias("seq"), "entry", F.col("tokens").cast("double").alias("tokens"), "death", (F.col("l_returnflag") != "N").alias("evictable"))


TIMELINE = f"""{CALLS_B}, {ITEMS_A},
l0 as (select *, sum(case when status = 'F' and idx > 0 then 1 else 0 end) over (partition by path order by idx rows unbounded preceding) as life from pb),
l1 as (select *, max(idx) over (partition by path, life) + 1 as death from l0),
l2 as (select l1.*, coalesce(n, 0) as n from l1 left join (select path, entry, sum(tokens) as n from it group by 1, 2) as s on s.path = l1.path and s.entry = l1.idx),
l3 as (select *, cast(sum(n) over (partition by path, life order by idx rows unbounded preceding) as double) as ctx, case when copied then 0 else 1 end as wt, 2.0 + idx % 3 as read_price, 25.0 as write_price, 50.0 as out_price from l2),
tl as (select *, sum(wt) over w - wt as cw, sum(wt * read_price) over w - wt * read_price as cr_sum from l3 window w as (partition by path order by idx rows unbounded preceding)),
ti as (select it.path, row_number() over (partition by it.path order by entry, l_partkey, l_suppkey, l_linenumber) - 1 as seq, entry, cast(tokens as double) as tokens, death, l_returnflag <> 'N' as evictable from it join l1 on l1.path = it.path and l1.idx = it.entry)"""


def events_b(spark: SparkSession, sf: str) -> DataFrame:
    """events as the event rows of a vendor-B session, in time order."""
    e = table(spark, sf, "events")
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    nothing = {c: F.lit(None).cast("string") for c in ("stamp", "rid", "tool", "kind")}
    tag = pick(F.col("event_type"), TAGS, "ctxmsg")
    rows = e.select(F.col("user_id").cast("string").alias("path"), line.alias("line"), F.lit(0).alias("part"), "event_id", F.col("value"), k.alias("k"), tag.alias("tag"))
    return rows.withColumns({**nothing, "model": F.when(F.col("tag") == "ctxmsg", F.concat(F.lit("gpt-"), (F.col("k") % 4).cast("string"))), "total": F.when((F.col("tag") == "tc") & (F.col("k") % 10 != 0), F.floor(F.col("value") / 200)), "inp": F.floor(F.col("value") * 100), "ca": F.col("k"), "wr": F.lit(0).cast("bigint"), "out": F.col("k") * 2, "reas": F.col("k"), "chars": F.floor("value"), "call_id": F.col("event_id").cast("string")})


EVENTS_B = f"""eb as (select cast(user_id as varchar) as path, row_number() over (partition by user_id order by ts, event_id) as line, event_id, value, cast(regexp_extract(props, '(\\d+)', 1) as bigint) as k, {pick_sql('event_type', TAGS, 'ctxmsg')} as tag from events),
en as (select *, case when tag = 'tc' and k % 10 <> 0 then cast(floor(value / 200) as bigint) end as total, cast(floor(value * 100) as bigint) as inp, k as ca, k * 2 as out from eb),
ek as (select *, last_value(case when tag = 'tc' then total end ignore nulls) over (partition by path order by line rows between unbounded preceding and 1 preceding) as last_total from en where tag <> 'tc' or total is not null),
ep as (select *, row_number() over (partition by path order by line) - 1 as pos from ek where tag <> 'tc' or last_total is null or total <> last_total)"""
