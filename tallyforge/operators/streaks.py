"""Correction streaks: prompts with join keys, copies across sessions, and how often a correction follows corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, flag
from .spread import numbered, with_least

TAIL_CHARS, PROMPT_CHARS = 500, 1500
LABELS, UNKNOWN, SKIPPED = ("correction", "bug_report", "retry", "nudge", "new"), "unknown", ("retry", "nudge")
BUCKETS = ("afterOne", "afterTwo", "otherwise")


class Refusal(Exception):
    """Input that must not be used; the message is for the user."""


def prompt_key(text: Column, tail: Column) -> Column:
    return F.sha2(F.concat(text, F.lit("\0"), tail).cast("binary"), 256)


def with_tails(rows: DataFrame) -> DataFrame:
    """Prompts with the last TAIL_CHARS characters that the assistant wrote before them.

    rows: (path, line, part, tag, text). Pieces are joined by line feeds; an empty piece counts only behind text. Each piece adds a
    character at least, so the last TAIL_CHARS pieces are enough."""
    order = Window.partitionBy("path").orderBy("line", "part")
    piece = F.when(F.col("tag") == "text", F.col("text"))
    r = rows.where("tag in ('text', 'prompt')").withColumn("piece", piece)
    some = F.max(flag(F.length("piece") > 0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("piece", F.when(some > 0, F.right("piece", F.lit(TAIL_CHARS)))).where("tag = 'prompt' or piece is not null")
    r = r.withColumn("texts", F.sum(flag(F.col("tag") == "text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    texts = Window.partitionBy("path").orderBy("texts").rangeBetween(-(TAIL_CHARS - 1), 0)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("tag") == "text", F.struct("line", "part", "piece"))).over(texts)), lambda x: x["piece"]), "\n")
    return r.withColumn("tail", F.right(joined, F.lit(TAIL_CHARS))).where("tag = 'prompt'").drop("piece", "texts", "part")


def prompts(rows: DataFrame) -> DataFrame:
    """(path, idx, key, uuid, last): the prompts of the transcript source's layout `prompts`, keyed; texts go no further."""
    ends = rows.where("tag = 'file'").groupBy("path").agg(F.expr("max_by(ts, line) filter (where ts is not null)").alias("last"))
    found = with_tails(rows).withColumn("key", prompt_key(F.col("text"), F.col("tail")))
    idx = F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1
    return found.withColumn("idx", idx).select("path", "idx", "key", "uuid").join(ends, "path", "left")


def copies(found: DataFrame) -> DataFrame:
    """prompts with `session` (a sort key: by last record, oldest first), the effective key, and whether each is a copy.

    A uuid seen before makes a copy with the key of its first record; so does, between sessions, a key seen in an older one."""
    session = F.struct(F.col("last").isNull().alias("none"), F.col("last").alias("last"), F.col("path").alias("of"))
    here = F.struct("session", "idx")
    p = with_least(cut(found.withColumn("session", session)), "uuid", F.struct("session", "idx", "key"), "_first")
    again = F.col("_first").isNotNull() & (F.struct("_first.session", "_first.idx") < here)
    p = p.withColumns({"again": again, "key": F.when(again, F.col("_first.key")).otherwise(F.col("key"))})
    p = with_least(cut(p.drop("_first")), "key", F.col("session"), "_oldest")
    return cut(p.withColumn("copied", F.col("again") | (F.col("_oldest") < F.col("session"))).drop("again", "_oldest"))


def unique_prompts(marked: DataFrame) -> DataFrame:
    """The first occurrence of each key among prompts that are no copies."""
    others = [c for c in marked.columns if c not in ("key", "session", "idx")]
    first = marked.where("not copied").groupBy("key").agg(F.min(F.struct("session", "idx", *others)).alias("_first"))
    return first.select("key", "_first.*").select(*marked.columns)


def labeled(marked: DataFrame, labels: DataFrame) -> DataFrame:
    return marked.join(labels.select("key", "label"), "key", "left").withColumn("label", F.coalesce("label", F.lit(UNKNOWN)))


def tally(rows: DataFrame) -> DataFrame:
    """One row of counts. rows: (path, session, idx, label, copied). Retries and nudges are passed over; an unknown label breaks a streak."""
    counted = rows.where(~F.col("label").isin(*SKIPPED))
    order = Window.partitionBy("path").orderBy("idx")
    c = counted.withColumns({"h1": F.lag("label", 1).over(order), "h2": F.lag("label", 2).over(order)}).where("not copied")
    live = (F.col("label") != UNKNOWN) & (F.col("idx") > 0) & F.col("h1").isNotNull() & (F.col("h1") != UNKNOWN)
    one = live & (F.col("h1") == "correction")
    two = one & F.coalesce(F.col("h2") == "correction", F.lit(False))
    none = live & (F.col("h1") != "correction")
    hit = F.col("label") == "correction"
    n = lambda cond: F.coalesce(F.sum(flag(cond)), F.lit(0))
    known = F.col("label") != UNKNOWN
    buckets = c.agg(
        n(one).alias("afterOne_observed"), n(one & hit).alias("afterOne_corrections"), n(two).alias("afterTwo_observed"), n(two & hit).alias("afterTwo_corrections"),
        n(none).alias("otherwise_observed"), n(none & hit).alias("otherwise_corrections"), n(~known).alias("unknown_label"), n(known & (F.col("idx") == 0)).alias("first_prompt"),
        n(known & (F.col("idx") > 0) & F.col("h1").isNull()).alias("no_previous"), n(known & (F.col("idx") > 0) & (F.col("h1") == UNKNOWN)).alias("after_unknown"), n(one & (F.col("h2") == UNKNOWN)).alias("after_two_unknown"),
    )
    own = ~F.col("copied")
    whole = rows.agg(n(own).alias("prompts"), F.count_distinct(F.when(own, F.col("path"))).alias("sessions"), n(F.col("copied")).alias("copied"), n(own & F.col("label").isin(*SKIPPED)).alias("retry_or_nudge"), *(n(own & (F.col("label") == x)).alias(f"label_{x}") for x in (*LABELS, UNKNOWN)))
    return whole.join(F.broadcast(buckets), how="cross")  # one row each


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(key, label) of a JSONL labels file; conflicts and bad rows are refused, unknown labels left out."""
    rows = spark.read.schema("key string, label string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    known = F.coalesce(F.col("label").isin(*LABELS, UNKNOWN), F.lit(False))
    shaped = F.coalesce(F.col("key").rlike("^[0-9a-f]{64}$"), F.lit(False))
    found = rows.agg(F.count_if(F.col("_bad").isNotNull()).alias("bad"), F.count_if(~shaped).alias("keys"), F.count_if(~known).alias("labels")).first()
    for n, what in zip(found, ("a line that is not JSON", "a line without a 64-character hex key", "a label outside " + ", ".join(LABELS))):
        if n:
            raise Refusal(f"the labels file has {what}")
    if not rows.groupBy("key").agg(F.count_distinct("label").alias("n")).where("n > 1").isEmpty():
        raise Refusal("the labels file gives a key a second, different label")
    return rows.where(F.col("label") != UNKNOWN).select("key", "label").distinct()


def key_rows(marked: DataFrame) -> DataFrame:
    """(key, session, index) of the first occurrence of every counted key, in order; sessions with prompts are numbered from 1."""
    sessions = numbered(cut(marked.groupBy("path").agg(F.min("session").alias("session"))), "session", "number")
    first = unique_prompts(marked).join(sessions.select("path", "number"), "path")
    return first.select("key", F.col("number").alias("session"), F.col("idx").alias("index")).orderBy("session", "index")


def write_keys(marked: DataFrame, path: str) -> None:
    """key_rows as JSON lines, written by the executors: the files' names are in the order of their rows. An existing path is refused."""
    key_rows(marked).write.mode("errorifexists").json(path)
