"""Nested results flattened in Spark against the walk over one value, a sink that lets all rows out or none, and the calculator."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import calculator, gate
from tallyforge.sources import prices as P

NESTED = [
    {"a": {"b": [1, "x", None, True, {"c": "me@y.com"}]}, "d": "fine", "e": {}, "f": [], "g": 1.5},
    [["a b", ["/home/me/x"]], {"bad key": {"k@y.com": 1}}],
    "alone", 7, None, [], {"": "empty key"}, {"x": ""}, {"big": 2**80}, {"t": "12345678-1234-1234-"}, {"k": "a\nb"}, {"é": "ü"},
]


def test_flattened_is_the_walk(spark):
    data = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(NESTED)], "id int, result string")
    got = {(x["id"], x["path"], x["key"], x["value"], x["reason"]) for x in gate.violations(gate.flattened(data, "result")).collect()}
    want = set()
    for i, x in enumerate(NESTED):
        for at, rules, leaf in gate.leaves(x):
            if broken := gate.reason(rules, leaf):
                want.add((i, at, leaf, None, broken) if rules is gate.KEYS else (i, at, None, leaf, broken))
    assert got == {w for w in want if w[3] is None or isinstance(w[3], str)} and len(got) >= 8


def test_flattened_faults(spark):
    data = spark.createDataFrame([(1, "{not json"), (2, None), (3, "[[[[1]]]]"), (4, "[[[1]]]")], "id int, path string").withColumnRenamed("path", "result")
    got = gate.violations(gate.flattened(data, "result", levels=3)).collect()
    assert {(x["id"], x["reason"]) for x in got} == {(1, "not JSON"), (3, "too deep")}
    odd = spark.sql("select 1 as id, named_struct('a', double('NaN'), 'b', array(double('-Infinity'), 1D), 'c', date'2026-01-01', 'd', true) as result")
    assert {(x["path"], x["reason"]) for x in gate.violations(gate.flattened(odd, "result")).collect()} == {("$.a", "non-finite number"), ("$.b[0]", "non-finite number"), ("$.c", "unsupported type")}
    assert gate.flattened(data.limit(0), "result").collect() == []


def _files(folder):
    return [n for at, _, names in os.walk(folder) for n in names if not n.startswith(".")]


def test_sink_writes_all_or_nothing(spark, tmp_path):
    clean = spark.range(0, 2000, 1, 8).select("id", F.lit("label").alias("name"), F.array(F.struct(F.lit(1.5).alias("usd"))).alias("parts"), F.create_map(F.lit("k"), F.lit("v")).alias("by"))
    gate.write_json(clean, str(tmp_path / "clean"))
    assert spark.read.json(str(tmp_path / "clean")).count() == 2000
    secret = F.col("id") == 1777
    for n, (column, value, place) in enumerate([
        ("name", F.when(secret, "me@y.com").otherwise("label"), "email at $.name|unsafe value at $.name"),
        ("parts", F.array(F.struct(F.when(secret, float("nan")).otherwise(1.0).alias("usd"))), "non-finite number at $.parts[0].usd"),
        ("by", F.create_map(F.when(secret, "a key").otherwise("k"), F.lit("v")), "unsafe key at $.by"),
        ("by", F.create_map(F.lit("k"), F.when(secret, "/home/me").otherwise("v")), "unsafe value at $.by.k"),
    ]):
        with pytest.raises(gate.Withheld) as e:
            gate.write_json(clean.withColumn(column, value), str(tmp_path / f"bad{n}"))
        assert str(e.value) in place.split("|") and _files(tmp_path / f"bad{n}") == []
    for bad in (clean.withColumn("a b", F.lit(1)), clean.withColumn("day", F.current_date())):
        with pytest.raises(gate.Withheld):
            gate.write_json(bad, str(tmp_path / "named"))
    assert not (tmp_path / "named").exists()
    gate.write_json(clean.limit(0), str(tmp_path / "empty"))


def test_calculator(spark):
    name = calculator.register(spark)
    inf, nan = float("inf"), float("nan")

    def value(*args):
        sql = ", ".join("cast(null as double)" if x is None else f"double('{x!r}')" for x in args)
        return spark.sql(f"select {name}({sql}, unit => 1D) as v").first()["v"].asDict()

    assert value(10.0, 4.0, 3.0, 3.0, 1.0) == {"ratio": 2.0, "payback_calls": 0.8, "saving": 30.0, "cost": 8.0, "net": 22.0, "pays": True, "verdict": "Pays"}
    assert value(4.0, 6.0, 3.0, 3.0, 1.0)["verdict"] == "Does not pay"  # even
    assert value(0.0, 4.0, 3.0, 3.0, 1.0)["payback_calls"] == inf
    free = value(1.0, 0.0, 3.0, 3.0, 0.0)
    assert free["ratio"] == inf and free["payback_calls"] is None and free["pays"] is False
    for bad in ((None, 1.0, 1.0, 1.0, 1.0), (1.0, nan, 1.0, 1.0, 1.0), (1.0, 1.0, -1.0, 1.0, 1.0), (1.0, 1.0, 1.0, inf, 1.0)):
        got = value(*bad)
        assert got.pop("verdict") == "Enter values" and set(got.values()) == {None}


def test_prices_of_a_choice(spark):
    a = P.SnapshotA({"A": (1.0, 2.0, 3.0, 0.5, 9.0)})
    b = P.SnapshotB({"B": (4.0, 0.4, 5.0, 9.0), "C": (6.0, 0.6, None, 9.0)}, {"B": (8.0, 0.8, 10.0, 9.0)})
    asked = [("A", "5m", False), ("A", "1h", True), ("A", "write", None), ("B", "write", True), ("B", "1h", False), ("C", "write", True), ("D", "5m", False), (None, None, None)]
    got = calculator.priced(spark.createDataFrame(asked, "model string, rewrite string, long boolean"), a, b).collect()
    found = {(x["model"], x["rewrite"], x["long"]): (x["write_price"], x["read_price"]) for x in got}
    assert len(got) == len(asked) and found == dict(zip(asked, [(2.0, 0.5), (3.0, 0.5), (2.0, 0.5), (10.0, 0.8), (4.0, 0.4), (6.0, 0.6), (None, None), (None, None)]))
