"""Vendor B: live calls, tool outputs, messages, usage records and polls of a session, folded from its event rows by windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import POLL_TOOLS
from .common import by_path, flag, or0, running

RESPONSE, INPUT = ("reasoning", "call", "asst"), ("out", "ctxmsg", "agentmsg")
DROP_TOKENS, DROP_SHARE = 20_000, 0.85


def numbered(rows: DataFrame) -> DataFrame:
    """Events in order (`pos`), without token counts that repeat the last kept total or have none."""
    events = rows.where("tag not in ('file', 'error')")
    valid = events.where("tag <> 'tc' or total is not null")
    last = F.last(F.when(F.col("tag") == "tc", F.col("total")), ignorenulls=True).over(by_path("line", "part").rowsBetween(Window.unboundedPreceding, -1))
    kept = valid.withColumn("_last", last).where("tag <> 'tc' or _last is null or total <> _last").drop("_last")
    return kept.withColumn("pos", F.row_number().over(by_path("line", "part")) - 1)


def dropped_counts(rows: DataFrame) -> DataFrame:
    """(path, raw, dropped): token-count events, and those that numbered() leaves out."""
    kept = numbered(rows).where("tag = 'tc'").groupBy("path").agg(F.count(F.lit(1)).alias("kept"))
    raw = rows.where("tag = 'tc'").groupBy("path").agg(F.count(F.lit(1)).alias("raw"))
    return raw.join(kept, "path", "left").select("path", "raw", (F.col("raw") - or0("kept")).alias("dropped"))


def anchored(events: DataFrame) -> DataFrame:
    """Events with `start`, the live turn's first position: the last task_started up to the first token count, else 0."""
    whole = Window.partitionBy("path")
    first = F.min(F.when(F.col("tag") == "tc", F.col("pos"))).over(whole)
    with_first = events.withColumn("_first", first)
    start = F.max(F.when((F.col("tag") == "task_started") & (F.col("pos") <= F.col("_first")), F.col("pos"))).over(whole)
    return with_first.withColumn("start", F.coalesce(start, F.lit(0))).withColumn("live", F.col("pos") >= F.col("start")).drop("_first")


def model_at(tag: str = "ctx") -> Column:
    """The model named last, up to each event, by events with that tag."""
    return F.last(F.when(F.col("tag") == tag, F.col("model")), ignorenulls=True).over(running("pos"))


def folded(rows: DataFrame) -> DataFrame:
    """Live events with the state that each one meets.

    `opens` is 1 where a call begins: at the first response item after an input or a token count, and at a token count without such
    an item before it. `n_calls` counts calls up to and with the event. `model`, `window` and `turn` are as the call would take them."""
    events = anchored(numbered(rows))
    events = events.withColumn("model_now", model_at())
    is_state = F.col("live") & F.col("tag").isin(*RESPONSE, "tc", *INPUT)
    state = F.when(F.col("tag").isin(*RESPONSE), "r").when(F.col("tag") == "tc", "t").otherwise("i")
    earlier = F.last(F.when(is_state, state), ignorenulls=True).over(by_path("pos").rowsBetween(Window.unboundedPreceding, -1))
    events = events.withColumn("_earlier", F.coalesce(earlier, F.lit("none")))
    begins = F.col("live") & F.col("tag").isin(*RESPONSE) & (F.col("_earlier") != "r")
    events = events.withColumn("_begins", begins)
    mark = F.when(F.col("_begins"), "b").when(F.col("live") & (F.col("tag") == "tc"), "t")
    events = events.withColumn("_mark", mark)
    last_mark = F.last("_mark", ignorenulls=True).over(by_path("pos").rowsBetween(Window.unboundedPreceding, -1))
    events = events.withColumn("synthetic", F.coalesce((F.col("_mark") == "t") & (F.coalesce(last_mark, F.lit("none")) != "b"), F.lit(False)))
    events = events.withColumn("opens", flag(F.col("_begins")) + flag(F.col("synthetic")))
    events = events.withColumn("n_calls", F.sum("opens").over(running("pos")))
    window = F.sum(flag(F.col("live") & (F.col("tag") == "comp") & (F.col("n_calls") > 0))).over(running("pos"))
    turn = F.sum(flag(F.col("live") & (F.col("tag") == "task_started"))).over(running("pos"))
    return events.withColumns({"window": window, "turn": turn})


def calls(events: DataFrame) -> DataFrame:
    """Live calls (those with usage), numbered by idx; `raw` numbers all calls of the session."""
    opened = events.where("opens = 1").select("path", (F.col("n_calls") - 1).alias("raw"), F.col("model_now").alias("model"), "window", "turn", "synthetic")
    usage = events.where("tag = 'tc' and live").select("path", (F.col("n_calls") - 1).alias("raw"), F.col("stamp"), "inp", "ca", "wr", "out", "reas")
    found = opened.join(usage, ["path", "raw"]).withColumn("idx", F.row_number().over(by_path("raw")) - 1)
    return implicit_windows(found).withColumn("copied", F.lit(False))


def implicit_windows(made: DataFrame) -> DataFrame:
    """A large drop of the input within a window starts a new one."""
    fell = (F.col("window") == F.lag("window").over(by_path("idx"))) & (F.col("inp") < F.lag("inp").over(by_path("idx")) - DROP_TOKENS) & (F.col("inp") < DROP_SHARE * F.lag("inp").over(by_path("idx")))
    return made.withColumn("_fell", flag(fell)).withColumn("window", F.col("window") + F.sum("_fell").over(running("idx"))).drop("_fell")


def live_index(events: DataFrame) -> DataFrame:
    """Events with `pl`: how many calls with usage were opened up to the event. A call gets its usage from a later token count, so
    usage is looked up by the call's number."""
    used = events.where("tag = 'tc' and live").select("path", (F.col("n_calls") - 1).alias("raw"), F.lit(1).alias("used"))
    opened = events.where("opens = 1").select("path", (F.col("n_calls") - 1).alias("raw")).join(used, ["path", "raw"], "left")
    before = F.sum(or0("used")).over(running("raw"))
    upto = opened.withColumn("pl", before).select("path", (F.col("raw") + 1).alias("n_calls"), "pl")
    return events.join(upto, ["path", "n_calls"], "left").withColumn("pl", or0("pl"))


def tools(events: DataFrame) -> DataFrame:
    """(path, pos, pl, tool, kind, vis, out_chars, part, no_new, emitter, no_input, poll): a row for each output and command in it.

    An output answers the last unanswered call of its id; a command belongs to the call opened last of those still open; the
    output's characters are shared by the commands' own output sizes."""
    made = live_index(events).where("live")
    opened = made.where("tag = 'call'").withColumn("call_key", F.when(F.coalesce("call_id", F.lit("")) == "", F.concat(F.lit("anon"), F.col("pos").cast("string"))).otherwise(F.col("call_id")))
    opened = opened.select("path", "call_key", F.col("pos").alias("open_pos"), "tool", "shells", "listed", "no_input", (F.col("n_calls") - 1).alias("emitter"))
    outs = made.where("tag = 'out' and n_calls > 0").withColumn("call_key", F.coalesce("call_id", F.lit("")))
    ends = outs.select("path", "call_key", "pos", "pl", "chars", "no_new")
    # Calls and outputs of one id in order: an output closes the id if a call of it has come since the last output.
    steps = opened.select("path", "call_key", F.col("open_pos").alias("at"), F.lit(0).alias("closes")).union(ends.select("path", "call_key", F.col("pos").alias("at"), F.lit(1).alias("closes")))
    by_id = Window.partitionBy("path", "call_key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumns({"last_open": F.max(F.when(F.col("closes") == 0, F.col("at"))).over(by_id), "last_close": F.max(F.when(F.col("closes") == 1, F.col("at"))).over(by_id)})
    closing = steps.where("closes = 1").select("path", "call_key", F.col("at").alias("pos"), F.when(F.col("last_open") > F.coalesce("last_close", F.lit(-1)), F.col("last_open")).alias("open_pos"))
    answered = ends.join(closing, ["path", "call_key", "pos"]).join(opened.drop("call_key"), ["path", "open_pos"], "left")
    # A re-used id keeps the place in the order of its first opening since it was last closed.
    spans = steps.where("closes = 0").withColumn("begin", F.when(F.coalesce("last_open", F.lit(-1)) > F.coalesce("last_close", F.lit(-1)), F.lit(None)).otherwise(F.col("at")))
    spans = spans.withColumn("place", F.last("begin", ignorenulls=True).over(Window.partitionBy("path", "call_key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    until = closing.where("open_pos is not null").select("path", "open_pos", F.col("pos").alias("close_pos"))
    placed = spans.select("path", F.col("at").alias("open_pos"), "place", "call_key").join(until, ["path", "open_pos"], "left")
    closes = F.max("close_pos").over(Window.partitionBy("path", "call_key", "place"))
    placed = placed.withColumn("close_pos", F.coalesce(closes, F.lit(1 << 60)))
    spans = placed.select("path", "place", "close_pos").distinct()
    commands = made.where("tag = 'cmd'").select("path", F.col("pos").alias("at"), F.col("kind"), F.col("chars").alias("agg"))
    owned = latest_open(commands, spans).withColumnRenamed("close_pos", "pos").drop("place")
    listed = owned.groupBy("path", "pos").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "agg"))).alias("commands"))
    answered = answered.join(listed, ["path", "pos"], "left")
    spare = F.transform(F.coalesce("shells", F.array().cast("array<string>")), lambda k: F.struct(F.lit(0).cast("bigint").alias("at"), k.alias("kind"), F.lit(0).cast("bigint").alias("agg")))
    own = F.when(F.col("open_pos").isNull(), F.array().cast("array<struct<at:bigint,kind:string,agg:bigint>>")).otherwise(F.coalesce("commands", spare))
    answered = answered.select("path", "pos", "pl", F.coalesce("tool", F.lit("unmatched")).alias("tool"), F.col("chars").alias("out_chars"), (F.col("no_new") & F.coalesce(F.col("tool").isin(*POLL_TOOLS), F.lit(False))).alias("no_new"), "emitter", "open_pos", own.alias("own"))
    rows = answered.select("*", F.posexplode_outer("own").alias("part", "c"))
    return visible_shares(rows.select("path", "pos", "pl", "tool", "out_chars", "no_new", "part", F.col("c.kind").alias("kind"), F.col("c.agg").alias("agg")))


def latest_open(commands: DataFrame, spans: DataFrame) -> DataFrame:
    """commands (path, at, ...) with the place and the close_pos of the span (path, place, close_pos) that was opened last before them
    and is still open; commands with none are left out.

    Openings and commands of a session pass by in order. Those still open stand on a stack; a command takes closed ones off its top, as
    no later command can meet them, so each span is pushed and popped once, whatever the order in which spans close. At one place a
    command comes before an opening, and a span that closes there is closed."""
    names = commands.columns
    own = F.struct(*(f"`{c}`" for c in names))
    opened = spans.select("path", F.col("place").alias("_at"), F.lit(1).alias("_opens"), F.col("close_pos").alias("_close"), F.lit(None).cast(commands.select(own.alias("x")).schema["x"].dataType).alias("_own"))
    asked = commands.select("path", F.col("at").alias("_at"), F.lit(0).alias("_opens"), F.lit(None).cast("bigint").alias("_close"), own.alias("_own"))
    steps = opened.unionAll(asked)
    steps = steps.withColumns({c: F.col(c).cast("bigint") for c in ("_at", "_close")}).where("path is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, stack = None, []
        for batch in batches:
            picked, places, closes = [], [], []
            for i, (path, at, opens, close) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                if path != session:
                    session, stack = path, []
                if opens:
                    stack.append((at, close))
                    continue
                while stack and not stack[-1][1] > at:
                    stack.pop()
                if stack:
                    picked.append(i)
                    places.append(stack[-1][0])
                    closes.append(stack[-1][1])
            taken = batch.column(4).take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, pa.array(places, pa.int64()), pa.array(closes, pa.int64())], ["own", "place", "close_pos"])

    dealt = steps.where("_opens = 0 or _close is not null").repartition("path").sortWithinPartitions("path", "_at", "_opens", "_close")
    kind = dealt.schema["_own"].dataType.simpleString()
    found = dealt.select("path", "_at", "_opens", "_close", "_own").mapInArrow(run, f"own {kind}, place bigint, close_pos bigint")
    return found.select(*(F.col(f"own.`{c}`").alias(c) for c in names), "place", "close_pos")


def visible_shares(rows: DataFrame) -> DataFrame:
    """rows (path, pos, out_chars, kind, agg) with `vis`: the output's characters by the commands' sizes, each at least 1."""
    size = F.greatest(F.lit(1), "agg")
    return rows.withColumn("vis", F.when(F.col("kind").isNotNull(), F.col("out_chars") * size / F.sum(size).over(Window.partitionBy("path", "pos"))))


def messages(events: DataFrame) -> DataFrame:
    """(path, pos, pl, kind, chars) of what was put into the context other than tool outputs."""
    return live_index(events).where("live and tag in ('ctxmsg', 'agentmsg') and n_calls > 0").select("path", "pos", "pl", "kind", "chars")


def records(events: DataFrame, made: DataFrame) -> DataFrame:
    """Usage records with `idx`, the live call each is tied to: the k-th record of equal usage to the k-th such call."""
    found = events.where("tag = 'recu'").select("path", "pos", F.col("model_now").alias("model"), "inp", "ca", "wr", "out", "reas", "rid")
    return fifo_match(found, made.select("path", "idx", "inp", "ca", "out"), ["path", "inp", "ca", "out"], "pos", "idx")


def fifo_match(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """left with the right_order of the row that has the same keys and the same rank among them."""
    a = left.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(left_order)))
    b = right.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(right_order)))
    return a.join(b, [*keys, "_k"], "left").drop("_k")


def mark_copied(made: DataFrame, recs: DataFrame, owned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls tied to a response that another file owns are copied; such records without a call go."""
    foreign = recs.where("rid is not null").join(owned.withColumnRenamed("id", "rid"), "rid").where("owner <> path").select("path", "pos", "idx").distinct()
    calls_ = made.drop("copied").join(foreign.where("idx is not null").select("path", "idx", F.lit(True).alias("copied")).distinct(), ["path", "idx"], "left")
    left = recs.join(foreign.where("idx is null").select("path", "pos"), ["path", "pos"], "left_anti")
    return calls_.withColumn("copied", F.coalesce("copied", F.lit(False))), left


def polls(events: DataFrame, made: DataFrame) -> DataFrame:
    """(path, polls, no_input, no_new): polls whose emitting response is billed in the file."""
    sent = events.where("live and tag = 'call'").where(F.col("tool").isin(*POLL_TOOLS)).withColumn("call_key", F.when(F.coalesce("call_id", F.lit("")) == "", F.concat(F.lit("anon"), F.col("pos").cast("string"))).otherwise(F.col("call_id")))
    sent = sent.select("path", "call_key", F.col("pos").alias("open_pos"), (F.col("n_calls") - 1).alias("raw"), "no_input")
    opened = events.where("live and tag = 'call'").select("path", F.when(F.coalesce("call_id", F.lit("")) == "", F.concat(F.lit("anon"), F.col("pos").cast("string"))).otherwise(F.col("call_id")).alias("call_key"), F.col("pos").alias("at"), F.lit(0).alias("closes"), F.lit(False).alias("no_new"))
    ends = events.where("live and tag = 'out' and n_calls > 0").select("path", F.coalesce("call_id", F.lit("")).alias("call_key"), F.col("pos").alias("at"), F.lit(1).alias("closes"), "no_new")
    by_id = Window.partitionBy("path", "call_key").orderBy("at")
    steps = opened.union(ends).withColumns({"next_closes": F.lead("closes").over(by_id), "next_new": F.lead("no_new").over(by_id)}).where("closes = 0")
    answers = steps.select("path", "call_key", F.col("at").alias("open_pos"), ((F.col("next_closes") == 1) & F.col("next_new")).alias("no_new"))
    copied = made.select("path", "raw", "copied")
    found = sent.join(answers, ["path", "call_key", "open_pos"], "left").join(copied, ["path", "raw"], "left").where(~F.coalesce("copied", F.lit(False)))
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("polls"), F.sum(flag(F.col("no_input"))).alias("no_input"), F.sum(flag(F.col("no_new"))).alias("no_new"))


def forked(events: DataFrame) -> DataFrame:
    """(path) of the sessions whose file begins with another session's history."""
    return events.where("not live").where(F.col("tag").isin("comp", *RESPONSE)).select("path").distinct()
