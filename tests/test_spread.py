"""Firsts of hot keys and numbers in a global order, against plain loops and by the rows of each task."""

import json
import os
import random

from pyspark.sql import functions as F

from tallyforge.operators import streaks
from tallyforge.operators.spread import numbered, with_least
from tallyforge.plans import cli

from .test_operators import prompt_files


def test_least_of_hot_and_null_keys(spark):
    r = random.Random(3)
    rows = [(i, None if i % 50 == 1 else "hot" if i % 10 else f"k{r.randrange(40)}", r.randrange(1000)) for i in range(4000)]
    least = {}
    for _, k, v in rows:
        least[k] = min(v, least.get(k, v))
    data = spark.createDataFrame(rows, "id int, k string, v int")
    keep = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = with_least(data, "k", F.col("v"), "least")
        got = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
    assert found.columns == ["id", "k", "v", "least"] and len(got) == len(rows)
    assert all(x["least"] == (None if x["k"] is None else least[x["k"]]) for x in got)
    tasks = [sum(x["task"] == t for x in got) for t in {x["task"] for x in got}]
    assert len(tasks) == 4 and max(tasks) < 0.35 * len(rows)  # 90 % of the rows have one key; each of four tasks has about a quarter


def test_least_of_an_empty_table(spark):
    assert with_least(spark.createDataFrame([], "k string, v int"), "k", F.col("v"), "least").collect() == []


def test_numbers_in_order(spark):
    values = random.Random(5).sample(range(10**6), 3000)
    data = spark.createDataFrame([(v,) for v in values], "v int")
    for bounds in (1, 7, 64):
        got = numbered(data, "v", "n", bounds).orderBy("v").collect()
        assert [(x["v"], x["n"]) for x in got] == [(v, i + 1) for i, v in enumerate(sorted(values))]
    assert numbered(data.where("v < 0"), "v", "n").collect() == []
    plan = numbered(data, "v", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_range" in plan and "windowspecdefinition(v" not in plan


def _plain_copies(found):
    """Session by session, oldest first: what is a copy, and of which key."""
    order = sorted(found, key=lambda x: ((x["last"] is None, x["last"] or 0.0, x["path"]), x["idx"]))
    uuids, keys, out = {}, {}, {}
    for x in order:
        again = x["uuid"] is not None and x["uuid"] in uuids
        key = uuids[x["uuid"]] if again else x["key"]
        if x["uuid"] is not None:
            uuids.setdefault(x["uuid"], key)
        keys.setdefault(key, x["path"])
        out[x["path"], x["idx"]] = (key, again or keys[key] != x["path"])
    return out


def test_copies_against_a_loop(spark):
    r = random.Random(8)
    for case in range(3):
        paths = [(f"p{i}", r.choice([None, float(r.randrange(4))])) for i in range(12)]
        rows = [(p, i, r.choice(["continue", "continue", f"k{r.randrange(30)}"]), r.choice([None, None, f"u{r.randrange(40)}"]), last) for p, last in paths for i in range(r.randrange(9))]
        found = spark.createDataFrame(rows, "path string, idx int, key string, uuid string, last double")
        marked = streaks.copies(found)
        got = {(x["path"], x["idx"]): (x["key"], x["copied"]) for x in marked.collect()}
        assert got == _plain_copies([dict(zip(found.columns, x)) for x in rows]), case
        first = streaks.unique_prompts(marked)
        assert first.columns == marked.columns and first.count() == len({k for k, copied in got.values() if not copied})


def test_keys_written_by_executors(spark, tmp_path):
    prompt_files(str(tmp_path / "c"))
    call = ["streaks", "--claude-dir", str(tmp_path / "c"), "--print-keys", "--keys-dir", str(tmp_path / "keys")]
    assert cli.main(call, spark) == 0
    names = sorted(n for n in os.listdir(tmp_path / "keys") if n.startswith("part-"))
    keys = [json.loads(x) for n in names for x in open(tmp_path / "keys" / n)]
    assert [(k["session"], k["index"]) for k in keys] == [(1, 0), (1, 1), (2, 2), (3, 0)]
    assert cli.main(call, spark) != 0  # the folder is there
