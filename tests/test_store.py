"""Transcripts that share the files of a table: the same rows as from files of their own, and no file or second reading for each of many."""

import json
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.plans.registry import ORACLE_SQL, QUERIES
from tallyforge.sources import transcripts as R
from tests import transcripts as T

#: Those of layout a whose rows are used more than once, then of layout b.
TWICE = "source_items_a source_cutoff_a source_estimates_a source_calls_b source_messages_b source_polls_b source_tools_b source_timeline_b".split()
MANY = 300


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """The tables' folder with so many conversations of three to five turns, and a long one."""
    folder = str(tmp_path_factory.mktemp("many"))
    turns = f"select i as conv_id, t as turn, case when t = 0 and i % 3 = 0 then 'system' when t % 2 = 0 then 'user' else 'assistant' end as role, repeat('né', (i + t) % 9) || t as text from range({MANY + 1}) c(i), range(400) s(t) where t < case when i = {MANY} then 400 else 3 + i % 3 end"
    duckdb.execute(f"copy ({turns}) to '{folder}/conversations.parquet'")
    return folder


def files(top):
    return {os.path.join(d, n) for d, _, names in os.walk(top) for n in names if not n.startswith((".", "_"))}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("source_")))
def test_many_conversations(spark, many, name):
    """The files written do not grow with the conversations, and the rows are those of the SQL."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = files(top)
    found = QUERIES[name](spark, many)
    columns = sorted(found.columns)
    got = sorted(map(repr, map(tuple, found.select(*columns).collect())))
    assert len(files(top) - before) < 60
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{many}/conversations.parquet'")
    assert got == sorted(map(repr, duck.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({ORACLE_SQL[name]})").fetchall()))


@pytest.mark.parametrize("name", TWICE)
def test_transcripts_are_read_once(spark, many, name):
    plan = QUERIES[name](spark, many)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"MapInArrow run\(path#\d+, start#", plan)


@pytest.mark.parametrize("until", [None, "2026-05-04T12:03:00Z"])
@pytest.mark.parametrize("layout", ("a", "b", "prompts"))
def test_the_rows_of_files(spark, tmp_path, monkeypatch, layout, until):
    """In ranges of a few lines, with names that a URI would escape."""
    monkeypatch.setattr(R, "RANGE", 600)
    a, b, *_ = T.corpus(str(tmp_path / "corpus"))
    root = b if layout == "b" else a
    long = [T.said(k, f"question {k} é" + "x" * k) for k in range(60)]
    T.write(os.path.join(a, "wide 50%25 project", "long.jsonl"), long)
    inner, tops = R.folders(spark, root, layout)
    lines = R.lines_of(spark, tops, R.NAMES[layout]).withColumn("n", F.monotonically_increasing_id())
    lines = lines.withColumns({"path": F.url_decode(F.expr(f"substring(path, instr(path, '{inner}') + {len(inner) + 1})")), "value": F.col("value").cast("string")})
    table = str(tmp_path / "table")
    R.store(lines.select("path", "n", "value"), table, "n")
    assert spark.read.parquet(table).groupBy("path").count().agg(F.max("count")).first()[0] > 3

    def rows(found, top):
        body = [r.asDict(True) for r in found.where("tag <> 'file'").collect()]
        at = {x: n for n, x in enumerate(sorted({(r["path"], r["line"]) for r in body}))}
        return sorted(json.dumps(r | {"line": at[r["path"], r["line"]], "path": r["path"][len(top) :]}, sort_keys=True) for r in body)

    def ends(found, top):
        made = {"a": R.ended_a, "b": R.ended_b}[layout](found)
        return sorted(json.dumps(r.asDict(True) | {"path": r["path"][len(top) :]}, sort_keys=True) for r in made.collect())

    want, got = R.transcripts(spark, root, layout, until), R.stored(spark, table, layout, until)
    assert rows(got, "") == rows(want, inner)
    if layout != "prompts":
        assert ends(got, "") == ends(want, inner)
