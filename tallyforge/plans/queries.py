"""The engine's operators over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import attribution, audits, calculator, chunks, dedupe, gate, ledger, rent, replay, sessions_b, streaks, threads_a
from ..operators.common import exact_unions, running
from ..sources import prices as P
from . import advice as A
from . import views as V

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            exact_unions(spark)
            return f(spark, sf)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def big(*names: str) -> dict:
    return {n: F.col(n).cast("bigint") for n in names}


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# ---- ledger and rates


def rated_a(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.attempt_costs(P.rates_a(V.calls_a(spark, sf), P.SnapshotA.load(), exact=True), zero=0)


def rated_b(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.call_cost_b(P.rates_b(V.calls_b(spark, sf), P.SnapshotB.load(), exact=True))


_TIERS_SQL = " union all ".join(f"select model, kind, '{t}' as tier, {n} as tokens, c_{t} as cost from rk" for t, n in (("input", "inp"), ("cache_write_5m", "case when cc5 + cc1 > 0 then cc5 else cc end"), ("cache_write_1h", "cc1"), ("cache_read", "cr"), ("output", "out")))


@query(f"with {V.rated_a_sql()}, t as ({_TIERS_SQL}) select tier, model, kind, cast(sum(tokens) as bigint) as tokens, cast(sum(cost) as bigint) as cost, cast(grouping(tier, model, kind) as bigint) as level from t group by grouping sets ((tier), (tier, model), (tier, kind), ())")
def ledger_tier_model_kind(spark, sf):
    return ledger.totals_a(rated_a(spark, sf)).withColumns(big("tokens", "cost"))


@query(f"with {V.rated_a_sql()} select model, coalesce(speed, '') as speed, coalesce(geo, '') as geo, price_id, cast(count(*) as bigint) as calls, cast(min(p_in) as bigint) as p_in, cast(min(p_w5) as bigint) as p_w5, cast(min(p_read) as bigint) as p_read, cast(min(p_out) as bigint) as p_out from rk group by 1, 2, 3, 4")
def rate_lookup_dated_ids(spark, sf):
    c = rated_a(spark, sf).withColumns({"speed": F.coalesce("speed", F.lit("")), "geo": F.coalesce("geo", F.lit(""))})
    return c.groupBy("model", "speed", "geo", "price_id").agg(F.count(F.lit(1)).alias("calls"), *(F.min(p).alias(p) for p in ("p_in", "p_w5", "p_read", "p_out")))


@query(f"with {V.rated_b_sql()} select model, price_id, over_threshold, cast(count(*) as bigint) as calls, cast(min(p_in) as bigint) as p_in, cast(min(p_cached) as bigint) as p_cached, cast(min(p_write) as bigint) as p_write from bk group by 1, 2, 3")
def rate_lookup_prefix_ids(spark, sf):
    return rated_b(spark, sf).groupBy("model", "price_id", "over_threshold").agg(F.count(F.lit(1)).alias("calls"), *(F.min(p).alias(p) for p in ("p_in", "p_cached", "p_write")))


@query(
    f"with {V.rated_b_sql()} select model, cast(grouping(model) as bigint) as whole, cast(count(*) as bigint) as calls, cast(sum(inp) as bigint) as inp, cast(sum(out) as bigint) as out, cast(sum(case when over_threshold then 1 else 0 end) as bigint) as over, cast(sum(case when over_threshold and has_long then 1 else 0 end) as bigint) as long, cast(sum(case when cost is null then 1 else 0 end) as bigint) as unpriced, cast(sum(cost) as bigint) as cost, cast(sum(case when cost is not null then ca * p_cached end) as bigint) as cached_in, cast(sum(case when cost is not null then fresh * p_in + wr * p_write end) as bigint) as uncached_in, cast(sum(case when cost is not null then (out - reas) * p_out end) as bigint) as out_visible from bk where not copied group by rollup (model)"
)
def long_context_switch(spark, sf):
    t = ledger.totals_b(rated_b(spark, sf))
    return t.withColumns(big("whole")).select("model", "whole", "calls", "inp", "out", "over", "long", "unpriced", "cost", "cached_in", "uncached_in", "out_visible")


@query(f"with {V.rated_a_sql()} select kind, cast(sum(case when p_in is null then 1 else 0 end) as bigint) as calls, cast(sum(case when p_in is null then inp + cc + cr + out else 0 end) as bigint) as tokens, cast(sum(case when speed = 'fast' then 1 else 0 end) as bigint) as fast_calls, cast(sum(case when geo = 'us' then 1 else 0 end) as bigint) as us_calls from rk group by 1")
def unpriced_calls(spark, sf):
    return rated_a(spark, sf).groupBy("kind").agg(*ledger.call_flags()).withColumnsRenamed({"un": "calls", "un_tok": "tokens", "fast": "fast_calls", "us": "us_calls"}).withColumns(big("calls", "tokens", "fast_calls", "us_calls"))


@query(f"with {V.rated_a_sql()}, t as (select model, sum(cost) as cost from rk group by 1) select cast(arg_max(model, cost) as varchar) as model, cast(max(cost) as bigint) as cost from t")
def dominant_model(spark, sf):
    spend = rated_a(spark, sf).groupBy("model").agg(F.sum("cost").alias("cost"))
    return spend.agg(A.dominant_of(F.col("model"), F.col("cost")).alias("x")).select("x.model", F.col("x.cost").cast("bigint").alias("cost"))


@query(f"""with {V.rates_a_sql()},
li as (select l_orderkey, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber) as n, count(*) over (partition by l_orderkey) as many, case when l_linestatus = 'O' then 'message' else 'fallback_message' end as type,
  ['claude-opus-5', 'claude-fable-5', 'other-model'][l_suppkey % 3 + 1] as model, cast(floor(l_quantity) as bigint) as inp, cast(floor(l_extendedprice) as bigint) as cc, case when l_returnflag = 'A' then 0 else cast(floor(l_quantity) as bigint) end as out from lineitem),
d as (select li.*, coalesce(inp * p_in + cc * p_w5 + out * p_out, 0) as cost from li left join pa on li.model = pa.base and pa.speed = '' and pa.geo = '' where many >= 2 and type = 'message')
select model, cast(sum(case when out > 0 then cost else 0 end) as bigint) as billed, cast(sum(case when out > 0 then 0 else cost end) as bigint) as maybe, cast(sum(case when out > 0 then 1 else 0 end) as bigint) as n_billed, cast(count(*) as bigint) as attempts, cast(sum(cc) as bigint) as cc from d group by 1""")
def fallback_billing(spark, sf):
    li = V.table(spark, sf, "lineitem")
    out = F.when(F.col("l_returnflag") == "A", 0).otherwise(F.floor("l_quantity"))
    names = F.element_at(F.array(*map(F.lit, ("claude-opus-5", "claude-fable-5", "other-model"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    zero = F.lit(0).cast("bigint")
    one = F.struct(F.when(F.col("l_linestatus") == "O", "message").otherwise("fallback_message").alias("type"), names.alias("model"), F.floor("l_quantity").alias("inp"), F.floor("l_extendedprice").alias("cc"), zero.alias("cc5"), zero.alias("cc1"), zero.alias("cr"), out.alias("out"))
    calls = li.groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.collect_list(one).alias("iters")).where(F.size("iters") >= 2).withColumns({"id": F.col("path"), "model": F.lit("claude-opus-5"), "copied": F.lit(False)})
    d = ledger.attempt_costs(P.rates_a(ledger.declined(calls), P.SnapshotA.load(), exact=True), zero=0)
    paid = F.col("out") > 0
    return d.groupBy("model").agg(F.sum(F.when(paid, F.col("cost")).otherwise(0)).alias("billed"), F.sum(F.when(paid, 0).otherwise(F.col("cost"))).alias("maybe"), F.count_if(paid).alias("n_billed"), F.count(F.lit(1)).alias("attempts"), F.sum("cc").alias("cc"))


# ---- dedupe

_OWNERS = """f as (select source as path, max(doc_id) as last from documents group by 1), i as (select distinct source as path, sha256(text) as id from documents where text is not null),
o as (select id, arg_min(path, (last, path)) as owner, count(*) as n from i join f using (path) group by 1 having count(*) > 1)"""


def _doc_ids(spark, sf):
    d = V.table(spark, sf, "documents").where("text is not null").select(F.col("source").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("id"), "doc_id")
    files = V.table(spark, sf, "documents").groupBy(F.col("source").alias("path")).agg(F.max("doc_id").alias("last"))
    return d, files


@query(f"with {_OWNERS} select id, owner from o")
def owner_dedupe(spark, sf):
    return dedupe.owners(*_doc_ids(spark, sf)).select("id", "owner")


@query(f"with {_OWNERS}, m as (select d.source as path, coalesce(o.owner <> d.source, false) as copied from documents as d left join o on sha256(d.text) = o.id where d.text is not null), t as (select path, count(*) as n, sum(case when copied then 0 else 1 end) as m from m group by 1) select cast(count(*) as bigint) as files, cast(sum(n - m) as bigint) as calls, cast(sum(n - m) * 5 as bigint) as usd from t where m < n")
def dedupe_stats(spark, sf):
    ids, files = _doc_ids(spark, sf)
    all_ = dedupe.marked(ids, dedupe.owners(ids, files)).withColumn("usd", F.lit(5).cast("bigint"))
    return dedupe.stats(all_, all_.where("not copied"))


@query("""with r as (select l_suppkey as path, l_orderkey as key, row_number() over (partition by l_suppkey order by l_orderkey, l_partkey, l_linenumber) as line, case when l_linenumber % 2 = 0 then 0 else cast(l_quantity as bigint) end as inp, case when l_returnflag <> 'N' then cast(floor(l_extendedprice) as bigint) end as cc, case when l_linestatus = 'O' then l_partkey end as cr, cast(l_quantity as bigint) as out, case when l_returnflag = 'A' then l_linenumber end as think, l_tax > 0.07 as fast from lineitem)
select cast(path as varchar) as path, cast(key as varchar) as key, cast(min(line) as bigint) as first_line, cast(coalesce(arg_max(inp, line) filter (inp <> 0), 0) as bigint) as inp, cast(coalesce(arg_max(cc, line) filter (cc is not null), 0) as bigint) as cc, cast(coalesce(arg_max(cr, line) filter (cr is not null), 0) as bigint) as cr, cast(max(out) as bigint) as out, cast(max(think) as bigint) as think, case when bool_or(fast) then 'fast' end as speed from r group by path, key""")
def usage_merge_last_nonnull(spark, sf):
    li = V.table(spark, sf, "lineitem")
    line = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_partkey", "l_linenumber"))
    none = F.lit(None)
    r = li.select(F.col("l_suppkey").cast("string").alias("path"), F.col("l_orderkey").cast("string").alias("key"), line.cast("bigint").alias("line"), none.cast("string").alias("kind"), none.cast("string").alias("model"), none.cast("double").alias("ts"), F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(F.col("l_quantity").cast("bigint")).alias("inp"), F.when(F.col("l_returnflag") != "N", F.floor("l_extendedprice")).alias("cc"), F.lit(0).alias("cc5"), F.lit(0).alias("cc1"), F.lit(False).alias("tiers"), F.when(F.col("l_linestatus") == "O", F.col("l_partkey")).alias("cr"), F.col("l_quantity").cast("bigint").alias("out"), F.when(F.col("l_returnflag") == "A", F.col("l_linenumber").cast("bigint")).alias("think"), (F.col("l_tax") > 0.07).alias("fast"), F.lit(False).alias("us"), none.cast("array<int>").alias("iters"))
    return threads_a.merged_usage(r).select("path", "key", "first_line", "inp", "cc", "cr", "out", "think", "speed")


# ---- folds of vendor B


@query(f"with {V.EVENTS_B} select path, line, pos, total from ep where tag = 'tc'")
def token_count_dedupe(spark, sf):
    return sessions_b.numbered(V.events_b(spark, sf)).where("tag = 'tc'").select("path", "line", F.col("pos").cast("bigint").alias("pos"), "total")


_FOLD = f"""{V.EVENTS_B},
s0 as (select *, last_value(case when tag in ('reasoning', 'call') then 'r' when tag = 'tc' then 't' else 'i' end) over (partition by path order by pos rows between unbounded preceding and 1 preceding) as earlier from ep),
s1 as (select *, tag in ('reasoning', 'call') and coalesce(earlier, 'none') <> 'r' as begins from s0),
s2 as (select *, last_value(case when begins then 'b' when tag = 'tc' then 't' end ignore nulls) over (partition by path order by pos rows between unbounded preceding and 1 preceding) as last_mark from s1),
s3 as (select *, tag = 'tc' and coalesce(last_mark, 'none') <> 'b' as synthetic from s2),
s4 as (select *, case when begins or synthetic then 1 else 0 end as opens from s3),
s5 as (select *, cast(sum(opens) over (partition by path order by pos rows unbounded preceding) as bigint) as n_calls from s4)"""


@query(f"with {_FOLD} select path, pos, opens, n_calls, synthetic from s5")
def response_islands(spark, sf):
    return sessions_b.folded(V.events_b(spark, sf)).select("path", *(F.col(c).cast("bigint").alias(c) for c in ("pos", "opens", "n_calls")), "synthetic").withColumn("opens", F.col("opens").cast("int"))


@query(f"""with {_FOLD}, o as (select path, n_calls - 1 as raw from s5 where opens = 1), u as (select path, n_calls - 1 as raw, inp, ca, out from s5 where tag = 'tc'),
c as (select o.path, row_number() over (partition by o.path order by o.raw) - 1 as idx, u.inp, u.ca, u.out from o join u on o.path = u.path and o.raw = u.raw),
x as (select *, case when inp < lag(inp) over w - 20000 and inp < 0.85 * lag(inp) over w then 1 else 0 end as fell from c window w as (partition by path order by idx))
select path, cast(idx as bigint) as idx, cast(sum(fell) over (partition by path order by idx rows unbounded preceding) as bigint) as "window", inp, ca, out from x""")
def implicit_windows(spark, sf):
    c = sessions_b.calls(sessions_b.folded(V.events_b(spark, sf)))
    return c.select("path", F.col("idx").cast("bigint").alias("idx"), F.col("window").cast("bigint").alias("window"), "inp", "ca", "out")


@query(f"with {V.EVENTS_B} select path, pos, last_value(case when tag = 'ctxmsg' then 'gpt-' || cast(k % 4 as varchar) end ignore nulls) over (partition by path order by pos rows unbounded preceding) as model from ep")
def model_forward_fill(spark, sf):
    e = sessions_b.numbered(V.events_b(spark, sf))
    return e.select("path", F.col("pos").cast("bigint").alias("pos"), sessions_b.model_at("ctxmsg").alias("model"))


@query(f"""with {V.EVENTS_B}, x as (select path, pos, k % 5 as id, case tag when 'call' then 'call' when 'out' then 'out' when 'ctxmsg' then 'cmd' end as step from ep where tag in ('call', 'out', 'ctxmsg')),
o as (select path, 'c' || pos as call_id, pos as open_pos, lead(pos, 3) over (partition by path order by pos) as close_pos from x where step = 'call'),
m as (select x.path, x.pos, max(o.open_pos) as open_pos from x join o on x.path = o.path and o.open_pos < x.pos and x.pos < coalesce(o.close_pos, 1000000000000) where x.step = 'cmd' group by 1, 2) select path, pos, open_pos from m""")
def lifo_open_match(spark, sf):
    e = sessions_b.numbered(V.events_b(spark, sf)).where("tag in ('call', 'out', 'ctxmsg')").select("path", F.col("pos").cast("bigint").alias("pos"), "tag")
    opens = e.where("tag = 'call'").select("path", F.col("pos").alias("place"), F.coalesce(F.lead("pos", 3).over(Window.partitionBy("path").orderBy("pos")), F.lit(1 << 60)).alias("close_pos"))
    commands = e.where("tag = 'ctxmsg'").select("path", F.col("pos").alias("at"))
    return sessions_b.latest_open(commands, opens).select("path", F.col("at").alias("pos"), F.col("place").alias("open_pos"))


@query("""with a as (select event_id, user_id, value, ts, cast(regexp_extract(props, '(\\d+)', 1) as bigint) % 3 as k from events where event_type in ('click', 'view')), b as (select event_id, user_id, value, ts, cast(regexp_extract(props, '(\\d+)', 1) as bigint) % 3 as k from events where event_type = 'purchase'),
r as (select *, row_number() over (partition by user_id, k order by event_id) as n from a), s as (select *, row_number() over (partition by user_id, k order by event_id) as n from b) select r.event_id, s.event_id as matched from r left join s using (user_id, k, n)""")
def fifo_record_match(spark, sf):
    e = V.table(spark, sf, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("bigint") % 3)
    right = e.where("event_type = 'purchase'").select("user_id", "k", F.col("event_id").alias("matched"))
    return sessions_b.fifo_match(e.where("event_type in ('click', 'view')").select("event_id", "user_id", "k"), right, ["user_id", "k"], "event_id", "matched").select("event_id", "matched")


@query("select cast(l_suppkey as varchar) as path, l_orderkey as pos, l_partkey as part, l_linenumber as line, round(1000.0 * greatest(1, l_quantity - 10) / sum(greatest(1, l_quantity - 10)) over (partition by l_suppkey, l_orderkey), 6) as vis from lineitem")
def visible_share_split(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("path"), F.col("l_orderkey").alias("pos"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), F.lit(1000.0).alias("out_chars"), F.lit("read").alias("kind"), (F.col("l_quantity") - 10).alias("agg"))
    return sessions_b.visible_shares(li).select("path", "pos", "part", "line", F.round("vis", 6).alias("vis"))


@query("""with r as (select cast(user_id as varchar) as path, row_number() over (partition by user_id order by event_id) as line, epoch_us(ts) as us from events), f as (select *, max(case when us > 1704153600000000 then 1 else 0 end) over (partition by path order by line rows unbounded preceding) as late from r)
select path, cast(count(*) as bigint) as kept, cast(max(line) as bigint) as last_line from f where late = 0 group by 1""")
def cutoff_prefix(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("line"), V.micros("ts").alias("us"))
    late = F.max(F.when(F.col("us") > 1704153600000000, 1).otherwise(0)).over(running("line"))
    return e.withColumn("late", late).where("late = 0").groupBy("path").agg(F.count(F.lit(1)).alias("kept"), F.max("line").cast("bigint").alias("last_line"))


# ---- attribution and rent

_STATES = f"""{V.rated_a_sql()},
a0 as (select *, cast(inp + cc + cr as double) as ctx, cast(0.2 * cr as double) as S, coalesce(case when cc5 + cc1 > 0 then (cc5 * p_w5 + cc1 * p_w1) / (cc5 + cc1) else p_w5 end, 0) as pw, event_id % 40 = 0 as marker from rk),
a1 as (select *, sum(cc1) over (partition by path) > sum(cc5) over (partition by path) as hour, coalesce(lag(ctx) over w, 0) as prev_ctx, lag(model) over w as prev_model, lag(ts) over w as prev_ts from a0 window w as (partition by path order by idx)),
a2 as (select *, case when idx = 0 or marker then ctx when ctx >= prev_ctx then ctx - prev_ctx else least(S, ctx) end as tail0 from a1),
a3 as (select *, idx > 0 and not marker and ctx < prev_ctx as shrinks, case when idx > 0 and not marker and ctx < prev_ctx then case when prev_ctx > 0 then (ctx - tail0) / prev_ctx else 0 end else 1 end as f from a2),
a4 as (select *, shrinks and f < 0.05 as near_reset from a3),
a5 as (select *, marker or near_reset as reset, case when near_reset then ctx else tail0 end as tail from a4),
a6 as (select *, least(tail, cc) as tcc, least(tail - least(tail, cc), inp) as tin from a5),
a7 as (select *, tcc * pw + tin * coalesce(p_in, 0) + least(tail - tcc - tin, cr) * coalesce(p_read, 0) as tail_cost, case when near_reset then 0 else ctx - tail end as old_tok, case when near_reset then 0 else cc - tcc end as rewrite from a6),
a8 as (select *, case when near_reset then 0 else greatest(in_cost - tail_cost, 0) end as old_cost, case when tail > 0 then tail_cost / tail else 0 end as tail_price, idx > 0 and not reset and rewrite > 2000 and rewrite > 0.1 * greatest(old_tok, 1) as rebuild from a7),
a9 as (select *, case when rebuild then least(rewrite * greatest(pw - coalesce(p_read, 0), 0), old_cost) else 0 end as excess from a8),
b0 as (select *, case when old_tok > 0 then (old_cost - excess) / old_tok else 0 end as opss, sum(case when reset and idx > 0 then 1 else 0 end) over (partition by path order by idx rows unbounded preceding) as life from a9),
b00 as (select *, exp(sum(case when shrinks and not near_reset then ln(f) else 0 end) over (partition by path, life order by idx rows unbounded preceding)) as decay from b0),
b1 as (select *, sum(opss * decay) over (partition by path, life order by idx rows unbounded preceding) as Q from b00),
b2 as (select *, arg_max(Q, idx) over (partition by path, life) as Q_end, max(idx) over (partition by path, life) + 1 as death from b1)"""


def _states(spark, sf):
    c = ledger.attempt_costs(P.rates_a(V.calls_a(spark, sf), P.SnapshotA.load(), exact=True), zero=0)
    new = c.select("path", F.col("idx").alias("entry"), F.lit("tool_result:Read").alias("category"), (F.lit(0.2) * F.col("cr")).cast("double").alias("est"))
    marks = c.where("event_id % 40 = 0").select("path", F.col("idx").alias("entry"))
    return attribution.call_states(c, new, marks), new


@query(f"""with {_STATES}, g as (select *, case when ts is not null and prev_ts is not null then ts - prev_ts else 0 end as gap, case when hour then 3600 else 300 end as ttl from b2 where rebuild),
c as (select *, case when model is distinct from prev_model then 'model_switch' when gap > ttl then 'ttl_expired_idle_gap' when ttl = 3600 and gap > 300 then 'idle_gap_5m_segment_on_1h_thread' when ctx < prev_ctx then 'context_shrink_or_edit' else 'prefix_mutation_unexplained' end as cause from g)
select cause, cast(count(*) as bigint) as events, cast(floor(sum(rewrite) + 1e-6) as bigint) as tokens, round(sum(excess) / 1e9, 6) as usd from c group by 1""")
def rebuild_taxonomy(spark, sf):
    return attribution.rebuilds(_states(spark, sf)[0]).select("cause", "events", F.floor(F.col("tokens") + 1e-6).cast("bigint").alias("tokens"), F.round(F.col("usd") / 1e9, 6).alias("usd"))


@query(f"""with {_STATES}, sc as (select *, case when S > 0 then least(1.0, tail / S) else 0 end as scale from b2),
i as (select path, idx, 'tool_result:Read' as category, S * scale as T, cast(null as double) as own, tail_price, decay, Q, Q_end, death from sc where idx > 0 and not reset
  union all select path, idx, case when idx = 0 then 'boot_prefix' when marker then 'post_compact_context' else 'post_reset_context' end, ctx, in_cost, tail_price, decay, Q, Q_end, death from sc where idx = 0 or reset
  union all select path, idx, 'unattributed_growth', tail - S * scale, null, tail_price, decay, Q, Q_end, death from sc where idx > 0 and not reset and tail - S * scale > 0)
select category, cast(count(*) as bigint) as items, round(sum(T), 2) as tokens, round(sum(coalesce(own, T * tail_price)) / 1e9, 5) as entry_usd, round(sum(case when decay > 0 and death - 1 > idx then T / decay * (Q_end - Q) else 0 end) / 1e9, 2) as carry_usd from i where T > 1e-6 group by 1""")
def content_carry(spark, sf):
    states, new = _states(spark, sf)
    c = attribution.item_costs(states, new).where("tokens > 1e-6")  # less would hang on the order of sums
    return c.groupBy("category").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("tokens"), 2).alias("tokens"), F.round(F.sum("entry_usd") / 1e9, 5).alias("entry_usd"), F.round(F.sum("carry_usd") / 1e9, 2).alias("carry_usd"))


_RENT = f"""{V.TIMELINE},
r0 as (select *, cast(status = 'F' and idx > 0 as int) as jump from pb), r1 as (select *, sum(jump) over (partition by path order by idx rows unbounded preceding) as win, wt from (select r0.*, case when copied then 0 else 1 end as wt from r0)),
r2 as (select *, sum(wt) over (partition by path order by idx rows unbounded preceding) - wt as cum, min(idx) over (partition by path, win) as win_start from r1), r3 as (select *, max(cum + wt) over (partition by path, win) as cum_win from r2)"""


@query(f"""with {_RENT}, h as (select case when idx = 0 then 'prefix_first_window' else 'post_compaction_baseline' end as category, inp * (cum_win - cum) as tc from r3 where idx = win_start),
e as (select 'tool_output:' || l_returnflag as category, tokens / 4.0 * (cum_win - cum) as tc from it join r3 on r3.path = it.path and r3.idx = it.entry where idx <> win_start and cum_win > cum and tokens > 0),
v as (select 'model_visible_output' as category, (a.out - a.reas) * (a.cum_win - b.cum) as tc from r3 as a join r3 as b on a.path = b.path and b.idx = a.idx + 1 where a.out > a.reas and a.cum_win > b.cum)
select category, round(sum(tc), 2) as token_calls from (select * from h union all select * from e union all select * from v) group by 1""")
def context_rent(spark, sf):
    c = V.calls_b(spark, sf).withColumns({"window": F.sum(F.when((F.col("status") == "F") & (F.col("idx") > 0), 1).otherwise(0)).over(running("idx")), "turn": F.lit(0), "none": F.lit(0)})
    c = P.rates_b(c, P.SnapshotB.load(), inp="none")
    i = V.items_a(spark, sf).select("path", F.col("entry").alias("pl"), F.col("l_returnflag").alias("kind"), F.lit("x").alias("tool"), F.col("tokens").alias("out_chars"), F.col("tokens").cast("double").alias("vis"))
    none = i.select("path", "pl", "kind", F.col("out_chars").alias("chars")).limit(0)
    return rent.rent(c, i, none).where("category <> 'reasoning_carried'").select("category", F.round("token_calls", 2).alias("token_calls"))


@query(f"with {V.TIMELINE} select path, idx, cast(wt as int) as wt, cast(cw as bigint) as cw, cast(cr_sum as double) as cr_sum, ctx from tl")
def residency_prefix_sum(spark, sf):
    return V.timeline(spark, sf)[0].select("path", "idx", "wt", F.col("cw").cast("bigint").alias("cw"), F.col("cr_sum").cast("double").alias("cr_sum"), "ctx")


@query("""with e as (select event_type as path, event_id as idx, sum(case when event_id % 97 = 0 then 1 else 0 end) over (partition by event_type order by event_id rows unbounded preceding) as life from events where event_type is not null and event_id is not null)
select path, cast(life as bigint) as life, count(*) as calls, cast(max(idx) + 1 as bigint) as death from e group by path, life""")
def long_thread_lives(spark, sf):
    c = V.table(spark, sf, "events").where("event_type is not null and event_id is not null").select(F.col("event_type").alias("path"), F.col("event_id").alias("idx"))
    c = chunks.lives(c, F.col("idx") % 97 == 0, F.lit(0.0), F.lit(1.0), size=256)
    return c.groupBy("path", "life").agg(F.max("Q_end").cast("bigint").alias("calls"), F.max("death").alias("death"))


# ---- the rule and the replay

@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity * 200 * l_linenumber * 2.0 - l_extendedprice * (25.0 - 2.0), 4) as margin, l_quantity * 200 * l_linenumber * 2.0 - l_extendedprice * (25.0 - 2.0) > 0 as pays, cast(floor(l_extendedprice / (l_quantity * 200) * 11.5 * 1000) as bigint) as payback_milli from lineitem")
def breakeven_rule(spark, sf):
    li = V.table(spark, sf, "lineitem")
    b, life, s, w, r = F.col("l_quantity") * 200, F.col("l_linenumber"), F.col("l_extendedprice"), F.lit(25.0), F.lit(2.0)
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(replay.margin(b, life, s, w, r), 4).alias("margin"), replay.pays(b, life, s, w, r).alias("pays"), F.floor(replay.payback_calls(b, s, w, r) * 1000).alias("payback_milli"))


_CHOICES = [*((m, t, False, w, r[3]) for m, r in P.SnapshotA.load().models.items() for t, w in (("5m", r[1]), ("1h", r[2]))), *((m, t, long, w, r[1]) for long, p in ((False, P.SnapshotB.load().models), (True, P.SnapshotB.load().long)) for m, r in p.items() for t, w in (("input", r[0]), ("write", r[2])) if w is not None)]
_CHOSEN = sorted({c[0] for c in _CHOICES}) + ["unlisted"]


def _scenarios(spark, sf):
    """lineitem as questions to the calculator: every listed model, rewrite and length, and inputs that are null, negative or nothing."""
    picked = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    order = F.col("l_orderkey")
    removed = F.when(order % 11 == 0, None).when(order % 13 == 0, -F.col("l_quantity")).when(order % 7 == 0, 0).otherwise(F.col("l_quantity") * 200)
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", picked(_CHOSEN, F.col("l_partkey") % len(_CHOSEN)).alias("model"), picked(("5m", "1h", "input", "write"), F.col("l_linenumber") % 4).alias("rewrite"), (F.col("l_suppkey") % 2 == 0).alias("long"), removed.alias("removed"), F.col("l_extendedprice").alias("suffix"))
    return calculator.priced(li, P.SnapshotA.load(), P.SnapshotB.load())


_SCENARIOS = f"""ch as (select * from (values {', '.join(f"('{m}', '{t}', {str(long).lower()}, {w!r}::double, {r!r}::double)" for m, t, long, w, r in _CHOICES)}) as v(model, rewrite, long, w, r)),
sc as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, [{quoted(_CHOSEN)}][l_partkey % {len(_CHOSEN)} + 1] as model, ['5m', '1h', 'input', 'write'][l_linenumber % 4 + 1] as rewrite, l_suppkey % 2 = 0 as long, case when l_orderkey % 11 = 0 then null when l_orderkey % 13 = 0 then -l_quantity when l_orderkey % 7 = 0 then 0 else l_quantity * 200 end as b, l_extendedprice as s, l_linenumber - 1 as calls, case when l_linenumber = 1 then 1000.0::double else 1000000.0::double end as unit from lineitem),
sw as (select *, long and exists (select 1 from ch where ch.model = sc.model and ch.long) as far, case when exists (select 1 from ch where ch.model = sc.model and ch.rewrite = sc.rewrite) then rewrite when model like 'claude%' then '5m' else 'input' end as how from sc)"""


@query(f"""with {_SCENARIOS},
pr as (select sw.*, w, r, coalesce(b >= 0 and w is not null, false) as fit, b * calls * r / unit as saving, s * (w - r) / unit as cost from sw left join ch on ch.model = sw.model and ch.rewrite = sw.how and ch.long = sw.far)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, model, case when not fit then 'Enter values' when saving > cost then 'Pays' else 'Does not pay' end as verdict, cast(case when fit then floor((saving - cost) * 1000) end as bigint) as net_milli, cast(case when fit and b > 0 then floor(s / b * ((w - r) / r) * 1000) end as bigint) as payback_milli, fit and b = 0 as never from pr""")
def calculator_verdicts(spark, sf):
    name = calculator.register(spark)
    rows = _scenarios(spark, sf)
    v = spark.sql(f"select *, {name}(removed, suffix, calls => l_linenumber - 1, write_price => write_price, read_price => read_price, unit => if(l_linenumber = 1, :first, 1000000.0D)) as v from {{rows}}", args={"first": 1000.0}, rows=rows)
    whole = lambda c: F.floor(F.col(c) * 1000).cast("bigint")
    never = F.coalesce(F.col("v.payback_calls") == float("inf"), F.lit(False))
    return v.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "model", "v.verdict", whole("v.net").alias("net_milli"), F.when(~never, whole("v.payback_calls")).alias("payback_milli"), never.alias("never"))


_RATIOS = f"with {_SCENARIOS}, rt as (select sw.model, sw.how as rewrite, sw.far as long, round((w - r) / r, 4) as ratio from sw join ch on ch.model = sw.model and ch.rewrite = sw.how and ch.long = sw.far)"


def _ratios(spark, sf):
    rows = _scenarios(spark, sf).where("read_price is not null")
    return rows.withColumn("ratio", F.round(replay.ratio(F.col("write_price"), F.col("read_price")), 4))


@query(f"{_RATIOS} select model, ratio, count(*) as asked from rt group by 1, 2")
def ratio_table(spark, sf):
    return _ratios(spark, sf).groupBy("model", "ratio").agg(F.count(F.lit(1)).alias("asked"))


@query(f"{_RATIOS} select distinct ratio from rt")
def ratio_set(spark, sf):
    return _ratios(spark, sf).select("ratio").distinct()


# A replay as a recursion: a row for each batch of a thread, with the items that went in it and those gone so far.
_THREADS = "tn as (select path, max(idx) as last from tl group by 1)"
_LEASED = f"""select s.path, c.idx as call, s.gone, list(i.seq) as going, row_number() over (partition by s.path order by c.idx) as nth
  from st as s join tn on tn.path = s.path join tl as c on c.path = s.path and c.idx > s.call and c.idx < tn.last
  join ti as i on i.path = s.path and i.evictable and i.tokens >= {replay.LEASE['least']} and i.entry + {replay.LEASE['age']} <= c.idx and i.death > c.idx and not list_contains(s.gone, i.seq)
  group by s.path, c.idx, s.gone having sum(i.tokens) >= {replay.LEASE['batch']}"""


def _cleared(at_least: int) -> str:
    return f"""select path, call, gone, list(seq) as going, row_number() over (partition by path order by call) as nth from (
    select s.path, c.idx as call, s.gone, i.seq, i.tokens, i.evictable, i.go, c.ctx - sum(case when i.left_out then i.tokens else 0 end) over (partition by s.path, c.idx) as now,
      row_number() over (partition by s.path, c.idx order by i.evictable and not i.left_out desc, i.seq desc) as latest
    from st as s join tn on tn.path = s.path join tl as c on c.path = s.path and c.idx > s.call and c.idx < tn.last
    join lateral (select x.seq, x.tokens, x.evictable, list_contains(s.gone, x.seq) as left_out, x.evictable and not list_contains(s.gone, x.seq) as go from ti as x where x.path = s.path and x.entry <= c.idx and x.death > c.idx) as i on true)
  where go and latest > {replay.CLEARING['keep']} and now >= {replay.CLEARING['trigger']} group by path, call, gone having sum(tokens) >= {at_least}"""


def _scored_sql(batches: str, refetch: float = 0.0) -> str:
    """`sc`: the scored batches; a batch before a copied call is not scored."""
    return f"""with recursive {V.TIMELINE}, {_THREADS},
st as (select path, cast(-1 as bigint) as call, cast([] as bigint[]) as gone, cast([] as bigint[]) as going from tn
  union all select path, call, list_concat(gone, going), going from ({batches}) where nth = 1),
go as (select st.path, st.call, any_value(st.going) as going, sum(case when list_contains(going, seq) then tokens end) as b, count(case when list_contains(going, seq) then 1 end) as n_items,
    sum(case when list_contains(gone, seq) and not list_contains(going, seq) and ti.death > call then tokens else 0 end) as earlier,
    sum(case when entry <= call and ti.death > call and not list_contains(gone, seq) and seq < list_min(going) then tokens else 0 end) as first,
    sum(case when list_contains(going, seq) then tokens * (coalesce(te.cw, tall.cw) - ta.cw) end) as calls_left, sum(case when list_contains(going, seq) then tokens * (coalesce(te.cr_sum, tall.cr_sum) - ta.cr_sum) end) as reads_left
  from st join ti on ti.path = st.path join tl as ta on ta.path = st.path and ta.idx = st.call + 1 left join tl as te on te.path = st.path and te.idx = ti.death
  join (select path, sum(wt) as cw, sum(wt * read_price) as cr_sum from tl group by 1) as tall on tall.path = st.path where st.call >= 0 group by st.path, st.call),
sb as (select go.path, go.call, b, greatest(0, tc.ctx - earlier - b - first) as "S", calls_left / b as "L", reads_left / b as read_life, ta.write_price as w, ta.read_price as r, n_items, tc.ctx - earlier - b as ctx_after, ta.out_price as o
  from go join tl as tc on tc.path = go.path and tc.idx = go.call join tl as ta on ta.path = go.path and ta.idx = go.call + 1 where ta.wt > 0 and b > 0),
s0 as (select path, cast(call as bigint) as call, cast(b as double) as b, cast("S" as double) as "S", cast("L" as double) as "L", cast(read_life as double) as read_life, cast(w as double) as w, cast(r as double) as r, cast(n_items as bigint) as n_items, cast(ctx_after as double) as ctx_after, cast(o as double) as o from sb),
s1 as (select *, b * read_life as saved, "S" * (w - r) as rewrite, n_items * (ctx_after * r + {replay.AGAIN_OUTPUT} * o) as trips, case when "S" > 0 then "L" * b / "S" else 'infinity'::double end as x from s0),
s2 as (select *, b * (read_life + w) + trips as unit from s1),
sc as (select *, {refetch} * unit as refetch, saved - rewrite - {refetch} * unit as net from s2)"""


def _batches(spark, sf, policy, **options):
    return replay.replayed(*V.timeline(spark, sf), policy, **options)


@query(_scored_sql(_LEASED) + " select * from sc")
def replay_lease(spark, sf):
    return replay.scored(_batches(spark, sf, "lease", **replay.LEASE))


@query(_scored_sql(_cleared(20_000)) + " select * from sc")
def replay_clearing_20k(spark, sf):
    return replay.scored(_batches(spark, sf, "clearing", at_least=20_000, **replay.CLEARING))


@query(_scored_sql(_cleared(60_000)) + " select * from sc")
def replay_clearing_60k(spark, sf):
    return replay.scored(_batches(spark, sf, "clearing", at_least=60_000, **replay.CLEARING))


@query(_scored_sql(_cleared(150_000)) + " select * from sc")
def replay_clearing_150k(spark, sf):
    return replay.scored(_batches(spark, sf, "clearing", at_least=150_000, **replay.CLEARING))


@query(_scored_sql(_LEASED, 0.25) + """ select count(*) as batches, coalesce(sum(b), 0) as tokens, cast(coalesce(sum(n_items), 0) as bigint) as items, coalesce(sum(saved), 0) as saved, coalesce(sum(rewrite), 0) as rewrite, coalesce(sum(refetch), 0) as refetch,
  coalesce(sum(unit), 0) as unit, coalesce(sum(trips), 0) as trips, coalesce(sum(net), 0) as net, cast(coalesce(sum(case when net > 0 then 1 else 0 end), 0) as bigint) as pay_batches, coalesce(sum(case when net > 0 then b else 0 end), 0) as pay_tokens, coalesce(sum(case when net > 0 then net else 0 end), 0) as net_paying from sc""")
def breakeven_summary(spark, sf):
    return replay.summary(replay.scored(_batches(spark, sf, "lease", **replay.LEASE), 0.25))


_SCORES = "sb as (select l_quantity * 200 as b, case when l_linenumber = 7 then 0 else l_extendedprice end as s, l_linenumber as l from lineitem), sx as (select b, case when s > 0 then l * b / s else 'infinity'::double end as x from sb)"


@query(f"with {_SCORES} select ratio, cast(count(*) as bigint) as batches, cast(sum(case when x > ratio then 1 else 0 end) as bigint) as pay_batches, sum(case when x > ratio then b else 0 end) as pay_tokens from sx, (values (0.1::double), (0.5::double), (1.15::double)) as v(ratio) group by 1")
def share_paying_by_ratio(spark, sf):
    b = F.col("l_quantity") * 200
    s = F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_extendedprice"))
    rows = V.table(spark, sf, "lineitem").select(b.alias("b"), F.when(s > 0, F.col("l_linenumber") * b / s).otherwise(float("inf")).alias("x"))
    return replay.paying_by_ratio(rows, [0.1, 0.5, 1.15])


# ---- audits


@query(f"""with {V.TIMELINE}, cr as (select path, idx + 1 as x, cr_sum + wt * read_price as cr from tl),
b as (select ti.*, ti.tokens * write_price * wt + ti.tokens * (d.cr - e.cr) as usd, tl.wt as w1, tl.ctx as c1, read_price from ti join tl on tl.path = ti.path and tl.idx = ti.entry join cr as d on d.path = ti.path and d.x = ti.death join cr as e on e.path = ti.path and e.x - 1 = ti.entry where evictable and ti.tokens >= 1000 * 2),
g as (select * from b where tokens >= 5000) select cast(evictable as boolean) as evictable, cast(count(*) as bigint) as n, round(sum(tokens), 2) as tokens, round(sum(usd), 2) as usd from g group by 1""")
def oversized_outputs(spark, sf):
    c, i = V.timeline(spark, sf)
    i = i.withColumn("tokens", F.col("tokens") * 2)  # the tables' items are small: twice their size meets the first threshold
    big_ = audits.oversized(c, i).withColumns({"usd": F.col("usd") / 2, "tokens": F.col("tokens") / 2}).where("tokens >= 5000")
    return big_.groupBy("evictable").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("tokens"), 2).alias("tokens"), F.round(F.sum("usd"), 2).alias("usd"))


_GAPS = f"""{V.rated_a_sql()},
k0 as (select *, inp + cc + cr as ctx, sum(cc1) over (partition by path) > sum(cc5) over (partition by path) as hour from rk),
k1 as (select *, case when hour then 3600 else 300 end as ttl, lag(ts) over w as prev_ts, lag(model) over w as prev_model, lag(ctx) over w as P from k0 window w as (partition by path order by idx)),
k2 as (select *, ts - prev_ts as gap, ttl - 30 as every, case when hour then p_w1 else p_w5 end - p_read as extra, P * p_read + 10 * p_in + p_out as ping from k1 where idx > 0),
k3 as (select *, floor(gap / every) as fired, case when gap > ttl then ceil((gap - ttl) / every) else 0 end as need, case when ping > 0 then floor(P * extra / ping) else 0 end as cap, least(greatest(cc - greatest(ctx - P, 0), 0), P) as rewritten from k2 where gap > every and model is not distinct from prev_model and p_in is not null),
k4 as (select *, gap > ttl and rewritten > 2000 and rewritten > 0.1 * greatest(P, 1) as rebuild from k3), k5 as (select *, case when rebuild then rewritten * extra else 0 end as excess from k4)"""


@query(f"with {_GAPS} select hour, cast(count(*) as bigint) as gaps, cast(sum(case when gap > ttl then 1 else 0 end) as bigint) as over_ttl, cast(sum(case when rebuild then 1 else 0 end) as bigint) as rebuilds, cast(sum(excess) as bigint) as excess from k5 group by 1")
def keepalive_gaps(spark, sf):
    t = audits.keepalive_totals(audits.idle_gaps(rated_a(spark, sf)))
    return t.select("hour", "gaps", "over_ttl", "rebuilds", F.col("excess").cast("bigint").alias("excess"))


@query(f"""with {_GAPS} select hour, cast(sum(case when rebuild and need * ping < excess then 1 else 0 end) as bigint) as hindsight_gaps, round(sum(case when rebuild and need * ping < excess then excess - need * ping else 0 end) / 1e9, 6) as hindsight, round(sum(least(cap, fired) * ping) / 1e9, 6) as capped_pings,
  round(sum(case when rebuild and need <= cap then excess else 0 end) / 1e9, 6) as capped_saved, cast(sum(case when rebuild and need <= cap then 1 else 0 end) as bigint) as bridged, round(sum(fired * ping) / 1e9, 4) as always_pings from k5 group by 1""")
def keepalive_policies(spark, sf):
    t = audits.keepalive_totals(audits.idle_gaps(rated_a(spark, sf)))
    usd = lambda c, n=6: F.round(F.col(c) / 1e9, n).alias(c)
    return t.select("hour", "hindsight_gaps", usd("hindsight"), usd("capped_pings"), usd("capped_saved"), "bridged", usd("always_pings", 4))


@query(f"""with {V.CALLS_A}, c as (select *, idx > 0 and inp % 3 = 0 as cand, lag(ts) over w as start, lead(idx) over w as n_idx, lead(ts) over w as n_ts, lead(cr) over w as n_ca, lead(event_id % 13 = 0) over w as n_copied from pc window w as (partition by path order by idx)),
g as (select *, idx - sum(case when cand then 1 else 0 end) over (partition by path order by idx rows unbounded preceding) as island from c),
r as (select path, min(idx) as first, max(idx) as last, arg_min(start, idx) as t0, arg_max_null(n_ts, idx) as t1, arg_max_null(n_ca, idx) as ca, arg_max_null(n_idx, idx) as n, arg_max_null(n_copied, idx) as cp, sum(case when event_id % 13 <> 0 and model <> 'other-model' then 1 else 0 end) as calls, sum(case when event_id % 13 <> 0 and model <> 'other-model' then inp else 0 end) as usd from g where cand group by path, island)
select path, cast(first as bigint) as first, cast(last as bigint) as last, cast(calls as bigint) as calls, cast(usd as double) as usd, n is not null and not cp and t1 - t0 > 300 as cold, cast(case when n is not null and not cp and t1 - t0 > 300 then ca * 7.0 else 0 end as double) as penalty from r""")
def poll_chains(spark, sf):
    c = V.calls_a(spark, sf).withColumns({"copied": F.col("event_id") % 13 == 0, "cost": F.when(F.col("model") != "other-model", F.col("inp").cast("double")), "ca": F.col("cr"), "p_in": F.lit(10.0), "p_cached": F.lit(3.0)})
    entered = c.select("path", "idx", (F.col("inp") % 3 == 0).alias("empty"))
    r = audits.poll_chains(c, entered)
    return r.select("path", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "calls", "usd", "cold", "penalty")


@query(f"""with {V.CALLS_A}, c as (select *, inp + cc + cr as ctx, greatest(inp + cc + cr - lag(inp + cc + cr) over (partition by path order by idx), 0) as up from pc where kind <> 'main'),
t as (select path, kind, max(case when idx = 0 then ctx end) as boot, coalesce(sum(up), 0) as growth from c group by 1, 2)
select kind, cast(count(*) as bigint) as threads, cast(sum(boot) as bigint) as boot, cast(sum(growth) as bigint) as growth, cast(sum(case when boot > growth then 1 else 0 end) as bigint) as over from t group by 1""")
def boot_scope(spark, sf):
    c = rated_a(spark, sf)
    none = spark.createDataFrame([], "path string, entry int, line bigint, block int, item string, sub string, chars bigint, img_tok bigint, use_id string, tool string, bash string, src int")
    t = audits.boot_threads(c, none, spark.createDataFrame([], "path string, use_id string, used_tool string, used_bash string"))
    return t.groupBy("kind").agg(F.count(F.lit(1)).alias("threads"), F.sum("boot").alias("boot"), F.sum(F.col("growth")).cast("bigint").alias("growth"), F.count_if(F.col("shared") > F.col("task_unique")).alias("over"))


@query("with u as (select count(distinct user_id) as threads, count(distinct case when user_id % 3 = 0 then user_id end) as sessions from events) select cast(threads as bigint) as threads, cast(sessions as bigint) as sessions, threads >= 20 and sessions >= 5 as meets from u")
def sharing_minimum(spark, sf):
    from .scan import enough_to_share

    u = V.calls_a(spark, sf).agg(F.count_distinct("path").alias("threads"), F.count_distinct(F.when(F.col("kind") == "main", F.col("path"))).alias("sessions"))
    return u.withColumn("meets", enough_to_share(F.col("threads"), F.col("sessions")))


@query(f"with {V.rated_a_sql()}, f as (select model as id, sum(cost) - 2 * sum(c_output) as net from rk group by 1) select id, cast(net as bigint) as net from f where net > 0 order by net desc, id limit 3")
def fix_topk(spark, sf):
    f = rated_a(spark, sf).groupBy(F.col("model").alias("id")).agg((F.sum("cost") - 2 * F.sum("c_output")).alias("net"))
    return A.best(f.withColumn("sound", F.lit(True))).select("id", F.col("net").cast("bigint").alias("net"))


@query(f"with {V.rated_a_sql()}, f as (select kind as id, sum(c_output) - sum(cost) as net from rk group by 1) select arg_min(id, net) as id, cast(min(net) as bigint) as net from f where net < 0")
def costly_trick(spark, sf):
    f = rated_a(spark, sf).groupBy(F.col("kind").alias("id")).agg((F.sum("c_output") - F.sum("cost")).alias("net"))
    return A.worst(f.withColumn("sound", F.lit(True))).select("id", F.col("net").cast("bigint").alias("net"))


# ---- labels


def _case_sql(rules, text: str, default: str, flags: str = "") -> str:
    return "case " + " ".join(f"when regexp_matches({text}, {quoted([p])}{flags}) then '{k}'" for k, p in rules) + f" else {default} end"


_COMMANDS = """cm as (select p_partkey, ['npm run test', 'git status', 'cd /x && cat a.txt', 'git commit -m x', 'python3 run.py', 'ls -la', 'curl http://x', 'rg foo', 'sleep 5', 'make', 'psql', 'tail -f x.log'][p_partkey % 12 + 1] || ' ' || p_name as cmd, ['read', 'search', 'list_files', ''][p_size % 4 + 1] as parsed from part)"""


def _commands(spark, sf):
    names = ["npm run test", "git status", "cd /x && cat a.txt", "git commit -m x", "python3 run.py", "ls -la", "curl http://x", "rg foo", "sleep 5", "make", "psql", "tail -f x.log"]
    first = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 12 + 1).cast("int"))
    parsed = F.element_at(F.array(*map(F.lit, ("read", "search", "list_files", ""))), (F.col("p_size") % 4 + 1).cast("int"))
    return V.table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", first, "p_name").alias("cmd"), parsed.alias("parsed"))


@query(f"with {_COMMANDS} select kind, cast(count(*) as bigint) as n from (select {_case_sql(L.BASH_RULES, 'cmd', chr(39) + 'other' + chr(39), ', ' + chr(39) + 'i' + chr(39))} as kind from cm) group by 1")
def bash_kind(spark, sf):
    return _commands(spark, sf).groupBy(L.bash_kind(F.col("cmd")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_COMMANDS}, x as (select *, regexp_replace(cmd, {quoted([L.LEADING_CD])}, '') as bare from cm) select p_partkey, case parsed when 'read' then 'read' when 'search' then 'search' when 'list_files' then 'list' else {_case_sql(L.COMMAND_RULES, 'bare', chr(39) + 'other' + chr(39))} end as kind from x")
def command_kind(spark, sf):
    parsed = F.when(F.col("parsed") != "", F.array("parsed")).otherwise(F.array().cast("array<string>"))
    return _commands(spark, sf).select("p_partkey", L.command_kind(F.col("cmd"), parsed).alias("kind"))


_NAMES = ["Bash", "mcp__x__y", "Task", "TaskGet", "Read", "private_tool", "exec_command", "write_stdin", "exec", "apply_patch", ""]


@query(f"""with n as (select p_partkey, [{quoted(_NAMES)}][p_partkey % 11 + 1] as name, ['', 'web', 'collaboration'][p_size % 3 + 1] as space from part) select p_partkey, case when name = '' then 'unknown' when starts_with(name, 'mcp__') then 'mcp' when name in ({quoted(L.AGENT_TOOLS)}) then 'Agent' when name in ({quoted(L.TASK_TOOLS)}) then 'TaskTools' when name in ({quoted(L.BUILTIN_TOOLS)}) then name else 'other' end as category,
case when contains(name, 'mcp__') or starts_with(name, 'mcp') then 'fn:mcp' when (case when space = '' then name else space || '.' || name end) in ({quoted(L.FUNCTIONS)}) then 'fn:' || (case when space = '' then name else space || '.' || name end) else 'fn:other' end as fn, case when name in ('exec', 'apply_patch') then name else 'custom-other' end as custom from n""")
def tool_labels(spark, sf):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 11 + 1).cast("int"))
    space = F.element_at(F.array(*map(F.lit, ("", "web", "collaboration"))), (F.col("p_size") % 3 + 1).cast("int"))
    p = V.table(spark, sf, "part").select("p_partkey", name.alias("name"), space.alias("space"))
    return p.select("p_partkey", L.tool_category(F.col("name")).alias("category"), L.function_label(F.col("space"), F.col("name")).alias("fn"), L.custom_label(F.col("name")).alias("custom"))


_SCRIPTS = ["tools.write_stdin({chars: 1})", "await tools.web_fetch(x)", "tools.mcp__box(1)", "tools.view_image (p)", "tools.exec_command({cmd: 1})", "fs.readdir(x)", "1 + 1"]


@query(f"""with s as (select p_partkey, [{quoted(_SCRIPTS)}][p_partkey % 7 + 1] as s from part), n as (select *, regexp_extract_all(s, '\\btools\\.([A-Za-z_]+)\\s*\\(', 1) as t from s) select p_partkey, case when list_contains(t, 'write_stdin') then 'exec~poll-process-stdin' when len(list_filter(t, lambda x: starts_with(x, 'web'))) > 0 then 'exec~web-search' when len(list_filter(t, lambda x: starts_with(x, 'mcp__'))) > 0 then 'exec~mcp-app' when list_contains(t, 'view_image') then 'exec~view-image' when list_contains(t, 'exec_command') then 'exec' when regexp_matches(s, 'readFileSync|readFile\\s*\\(|\\bfs\\.|readdir') then 'exec~js-file-io' else 'exec~js-other' end as tool from n""")
def script_tools(spark, sf):
    s = F.element_at(F.array(*map(F.lit, _SCRIPTS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return V.table(spark, sf, "part").select("p_partkey", L.script_tool(s).alias("tool"))


@query(f"select doc_id, {_case_sql(L.DENY, 'text', 'null')} as reason from documents")
def deny_scan(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", L.deny_reason(F.col("text")).alias("reason"))


@query(f"with w as (select page_id, regexp_extract(url, '([^/]+)$', 1) as w from pages) select page_id, case when regexp_matches(w, {quoted([L.LABEL])}) and ({_case_sql(L.DENY, 'w', 'null')}) is null then w else 'other' end as label from w")
def label_sanitize(spark, sf):
    w = V.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"([^/]+)$", 1).alias("w"))
    return w.select("page_id", L.label(F.col("w")).alias("label"))


@query(f"with m as (select event_id, case event_id % 5 when 0 then 'claude-opus-5' when 1 then 'gpt-5.6-sol' when 2 then event_type when 3 then null else 'claude-' || event_type || '@corp' end as m from events) select event_id, case when m is null then 'unknown' when length(m) <= 64 and regexp_matches(m, {quoted([L.MODEL])}) and ({_case_sql(L.DENY, 'm', 'null')}) is null then m else 'other-model' end as model from m")
def model_label(spark, sf):
    five = F.col("event_id") % 5
    m = F.when(five == 0, "claude-opus-5").when(five == 1, "gpt-5.6-sol").when(five == 2, F.col("event_type")).when(five == 4, F.concat(F.lit("claude-"), "event_type", F.lit("@corp")))
    return V.table(spark, sf, "events").select("event_id", L.model_label(m).alias("model"))


@query("select lang, cast(count(*) as bigint) as texts, round(sum(length(text) / case when lang in ('en', 'de') then 2.4 else 3.1 end), 2) as tokens from documents group by 1")
def token_estimate_by_lang(spark, sf):
    model = F.when(F.col("lang").isin("en", "de"), "claude-opus-5-5").otherwise("claude-opus-4-1")
    return V.table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.round(F.sum(F.length("text") / L.chars_per_token(model)), 2).alias("tokens"))


_CATEGORIES = ["tool_result:Bash:test", "cache_rebuild_excess:model_switch", "attachment:skill_listing", "assistant:tool_input:Read", "boot_prefix", "tool_output:read"]


@query(f"with c as (select [{quoted(_CATEGORIES)}][p_partkey % 6 + 1] as c, p_retailprice as usd from part), g as (select c, case when starts_with(c, 'cache_rebuild_excess:') then 'cache_rebuild:' || split_part(c, ':', 2) when starts_with(c, 'tool_result') then 'tool_result' when starts_with(c, 'assistant:tool_input') then 'assistant:tool_input' when starts_with(c, 'attachment:') then 'attachment' else c end as g, case when starts_with(c, 'tool_output:') then 'tool_output' else c end as h, usd from c) select g, h, cast(grouping(g, h) as bigint) as level, round(sum(usd), 2) as usd from g group by rollup (g, h)")
def category_rollup(spark, sf):
    c = F.element_at(F.array(*map(F.lit, _CATEGORIES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    g = V.table(spark, sf, "part").select(L.group_a(c).alias("g"), L.group_b(c).alias("h"), F.col("p_retailprice").alias("usd"))
    return g.rollup("g", "h").agg(F.grouping_id().cast("bigint").alias("level"), F.round(F.sum("usd"), 2).alias("usd"))


@query(f"with l as (select cast(doc_id as varchar) as path, 'k' || source as key, left(lang || ' ' || source, 30) as value from documents union all select cast(doc_id as varchar), source || '@x.com', lang from documents where doc_id % 50 = 0), r as (select *, case when not regexp_matches(key, {quoted([gate.KEY])}) then 'unsafe key' else coalesce({_case_sql(L.DENY, 'key', 'null')}, case when not regexp_matches(value, {quoted([gate.VALUE])}) then 'unsafe value' else {_case_sql(L.DENY, 'value', 'null')} end) end as reason from l) select path, key, value, reason from r where reason is not null")
def gate_violations(spark, sf):
    d = V.table(spark, sf, "documents")
    a = d.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("k"), "source").alias("key"), F.left(F.concat_ws(" ", "lang", "source"), F.lit(30)).alias("value"))
    b = d.where("doc_id % 50 = 0").select(F.col("doc_id").cast("string").alias("path"), F.concat("source", F.lit("@x.com")).alias("key"), F.col("lang").alias("value"))
    return gate.violations(a.unionByName(b))


@query(f"""with l as (select doc_id, '$' as path, unnest(['doc', 'k' || source, 'n']) as key, null as value from documents union all select doc_id, '$.doc', unnest(['lang', 'source']), null from documents
union all select doc_id, '$.doc.lang', null, lang from documents union all select doc_id, '$.doc.source', null, source from documents union all select doc_id, '$.k' || source || '[' || i || '].line', null, li[i + 1] from (select doc_id, source, string_split(text, chr(10)) as li, unnest(range(len(string_split(text, chr(10))))) as i from documents)
union all select doc_id, '$.k' || source || '[' || unnest(range(len(string_split(text, chr(10))))) || ']', 'line', null from documents),
r as (select *, case when key is not null then case when not regexp_matches(key, {quoted([gate.KEY])}) then 'unsafe key' else {_case_sql(L.DENY, 'key', 'null')} end when value is not null then case when not regexp_matches(value, {quoted([gate.VALUE])}) then 'unsafe value' else {_case_sql(L.DENY, 'value', 'null')} end end as reason from l)
select doc_id, path, key, value, reason from r where reason is not null""")
def nested_violations(spark, sf):
    d = V.table(spark, sf, "documents")
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("line")))
    result = F.map_from_arrays(F.array(F.lit("doc"), F.concat(F.lit("k"), "source"), F.lit("n")), F.array(F.to_variant_object(F.struct("lang", "source")), F.to_variant_object(lines), F.to_variant_object(F.array("n_chars"))))
    return gate.violations(gate.flattened(d.select("doc_id", F.to_json(F.to_variant_object(result)).alias("result")), "result"))


# ---- streaks

_PROMPTS = """cv as (select cast(conv_id as varchar) as path, turn, role, text from conversations),
tx as (select *, case when role = 'assistant' then text end as piece from cv),
jn as (select *, string_agg(piece, chr(10) order by turn) over (partition by path order by turn rows between unbounded preceding and 1 preceding) as before from tx),
pr as (select path, turn, text, right(coalesce(before, ''), 500) as tail from jn where role = 'user'),
pk as (select path, row_number() over (partition by path order by turn) - 1 as idx, sha256(text || chr(0) || tail) as key, tail, conv from (select *, cast(path as bigint) as conv from pr))"""


def _conversation_rows(spark, sf):
    c = V.table(spark, sf, "conversations")
    role = F.when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "text")
    rows = c.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line"), F.lit(0).alias("part"), F.lit(None).cast("double").alias("ts"), role.alias("tag"), "text", F.lit(None).cast("string").alias("uuid"))
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("t")).select(F.col("conv_id").cast("string").alias("path"), (F.col("t") + 1).alias("line"), F.lit(0).alias("part"), F.col("conv_id").cast("double").alias("ts"), F.lit("file").alias("tag"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("uuid"))
    return rows.unionByName(ends)


@query(f"with {_PROMPTS} select path, cast(idx as bigint) as idx, key, tail from pk")
def prompt_tail_key(spark, sf):
    p = streaks.with_tails(_conversation_rows(spark, sf))
    idx = F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1
    return p.select("path", idx.cast("bigint").alias("idx"), streaks.prompt_key(F.col("text"), F.col("tail")).alias("key"), "tail")


_MARKED = f"{_PROMPTS}, mk as (select *, min(conv) over (partition by key) < conv as copied from pk)"


def _marked(spark, sf):
    return streaks.copies(streaks.prompts(_conversation_rows(spark, sf)))


@query(f"with {_MARKED} select path, cast(idx as bigint) as idx, key, copied from mk")
def copy_marking(spark, sf):
    return _marked(spark, sf).select("path", F.col("idx").cast("bigint").alias("idx"), "key", "copied")


@query(f"with {_MARKED} select path, cast(idx as bigint) as idx, key from mk where not copied qualify row_number() over (partition by key order by conv, idx) = 1")
def unique_prompts(spark, sf):
    return streaks.unique_prompts(_marked(spark, sf)).select("path", F.col("idx").cast("bigint").alias("idx"), "key")


@query(f"with {_MARKED}, st as (select *, dense_rank() over (order by conv) as number from mk) select key, cast(number as bigint) as session, cast(idx as bigint) as index from st where not copied qualify row_number() over (partition by key order by conv, idx) = 1")
def session_numbers(spark, sf):
    return streaks.key_rows(_marked(spark, sf)).select("key", "session", F.col("index").cast("bigint").alias("index"))


_LETTERS = "['correction', 'correction', 'correction', 'new', 'bug_report', 'retry', 'nudge', 'unknown']"


@query(f"""with {_MARKED}, lb as (select *, {_LETTERS}[('0x' || key[1:2])::int % 8 + 1] as label from mk), ct as (select *, lag(label) over w as h1, lag(label, 2) over w as h2 from lb where label not in ('retry', 'nudge') window w as (partition by path order by idx)),
lv as (select *, label <> 'unknown' and idx > 0 and h1 is not null and h1 <> 'unknown' as live, label = 'correction' as hit from ct where not copied)
select cast(count(*) filter (live and h1 = 'correction') as bigint) as afterone_observed, cast(count(*) filter (live and h1 = 'correction' and hit) as bigint) as afterone_corrections, cast(count(*) filter (live and h1 = 'correction' and h2 = 'correction') as bigint) as aftertwo_observed, cast(count(*) filter (live and h1 = 'correction' and h2 = 'correction' and hit) as bigint) as aftertwo_corrections,
 cast(count(*) filter (live and h1 <> 'correction') as bigint) as otherwise_observed, cast(count(*) filter (live and h1 <> 'correction' and hit) as bigint) as otherwise_corrections, cast((select count(*) from lb where not copied) as bigint) as prompts, cast((select count(distinct path) from lb where not copied) as bigint) as sessions, cast((select count(*) from lb where not copied and label in ('retry', 'nudge')) as bigint) as retry_or_nudge from lv""")
def streak_tally(spark, sf):
    m = _marked(spark, sf)
    letters = ["correction", "correction", "correction", "new", "bug_report", "retry", "nudge", "unknown"]
    label = F.element_at(F.array(*map(F.lit, letters)), (F.conv(F.substring("key", 1, 2), 16, 10).cast("int") % 8 + 1))
    labels = m.select("key", label.alias("label")).distinct().where("label <> 'unknown'")
    t = streaks.tally(streaks.labeled(m, labels))
    return t.select(*(F.col(f"{b}_{x}").cast("bigint").alias(f"{b.lower()}_{x}") for b in streaks.BUCKETS for x in ("observed", "corrections")), *(F.col(c).cast("bigint").alias(c) for c in ("prompts", "sessions", "retry_or_nudge")))
