"""Two-level sums against a plain loop over each thread, for chunks smaller than a life, as long as one, and longer."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import chunks

SCHEMA = "path string, idx bigint, v bigint, reset boolean, f double, rate double, note string"


def threads(seed, lengths=(1, 2, 7, 40, 0, 23)):
    r = random.Random(seed)
    return [
        (f"t{t}", i, r.choice([None, r.randrange(9)]), i > 0 and r.random() < (0.5, 0.1, 0.02)[seed % 3], r.choice([1.0, 1.0, r.uniform(0.1, 1)]), r.choice([0.0, r.random()]), r.choice([None, f"n{i}"]))
        for t, n in enumerate(lengths)
        for i in range(n)
    ]


def walked(rows):
    """life, decay, Q, Q_end, death of each call, from a walk over its thread."""
    out, ends = {}, {}
    state = {}
    for path, idx, _, reset, f, rate, _ in sorted(rows, key=lambda x: x[:2]):
        life, decay, q = state.get(path, (0, 1.0, 0.0))
        life, decay, q = (life + 1, 1.0, 0.0) if reset else (life, decay, q)
        decay *= f
        q += rate * decay
        state[path] = life, decay, q
        out[path, idx] = life, decay, q
        ends[path, life] = q, idx + 1
    return {k: (*v, *ends[k[0], v[0]]) for k, v in out.items()}


@pytest.mark.parametrize("seed,size", [(0, 3), (1, 3), (2, 1), (2, 5), (1, 4096)])
def test_lives(spark, seed, size):
    rows = threads(seed)
    found = chunks.lives(spark.createDataFrame(rows, SCHEMA), F.col("reset"), F.log("f"), F.col("rate"), {"all": F.col("v")}, size).collect()
    want = walked(rows)
    assert len(found) == len(want)
    for r in found:
        life, decay, q, q_end, death = want[r["path"], r["idx"]]
        assert (r["life"], r["death"], r["all"]) == (life, death, sum(x[2] or 0 for x in rows if x[0] == r["path"]))
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip((r["decay"], r["Q"], r["Q_end"]), (decay, q, q_end)))


@pytest.mark.parametrize("size", [1, 4, 4096])
def test_sums_and_previous(spark, size):
    rows = threads(5)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("v", F.col("v"))
    found = chunks.sums(df, ["idx", "note"], {"upto": F.col("v")}, {"whole": F.col("v"), "n": F.lit(1)}, size=size)
    found = chunks.previous(found, {"was": "note"}, size).collect()
    assert len(found) == len(rows)
    by = {}
    for r in sorted(rows):
        by.setdefault(r[0], []).append(r)
    for r in found:
        own = by[r["path"]]
        assert r["upto"] == sum(x[2] or 0 for x in own[: r["idx"] + 1]) and r["whole"] == sum(x[2] or 0 for x in own) and r["n"] == len(own)
        assert r["was"] == (own[r["idx"] - 1][6] if r["idx"] else None)


def test_a_name_of_the_rows_is_replaced_and_nothing_is_made_of_nothing(spark):
    df = spark.createDataFrame([("a", 0, 2, False, 1.0, 0.0, None)], SCHEMA)
    assert [tuple(r) for r in chunks.sums(df.select("path", "idx", "v"), ["idx"], {"v": F.col("v") * 3}).collect()] == [("a", 0, 6)]
    none = df.where("v > 9")
    assert chunks.lives(none, F.col("reset"), F.lit(0.0), F.lit(0.0)).count() == chunks.sums(none, ["idx"], {"s": F.col("v")}).count() == chunks.previous(none, {"p": "v"}).count() == 0


def test_a_long_thread_is_many_tasks(spark):
    """100,000 calls of one thread lie in several partitions after each fold, in none of them all."""
    calls = spark.range(100_000).select(F.when(F.col("id") >= 0, "t").alias("path"), F.col("id").alias("idx"), F.lit(1).alias("v"), (F.col("id") % 30_000 == 29_999).alias("reset"))
    # As with threads too large to broadcast; and small partitions are not put together.
    given = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        for made in (chunks.sums(calls, ["idx"], {"s": F.col("v")}), chunks.previous(calls, {"p": "v"}), chunks.lives(calls, F.col("reset"), F.lit(0.0), F.lit(1.0))):
            # All columns are read, or the windows would be pruned away.
            sizes = [r["n"] for r in made.withColumn("_p", F.spark_partition_id()).groupBy("_p").agg(F.count(F.lit(1)).alias("n"), *(F.max(c).alias(f"m_{c}") for c in made.columns)).collect()]
            assert len(sizes) > 1 and sum(sizes) == 100_000 and max(sizes) < 60_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    last = chunks.lives(calls, F.col("reset"), F.lit(0.0), F.lit(1.0)).where("idx = 70000").first()
    assert (last["life"], last["death"], last["Q"], last["Q_end"]) == (2, 89_999, 10_002.0, 30_000.0)
