import json

from tallyforge.streaming import ledger


def test_late_and_repeated_records_are_billed_once(spark, tmp_path):
    row = lambda i, minute, **m: {"path": "t", "id": i, "ts": f"2026-09-01T10:{minute:02d}:00Z", "kind": "main", "model": "claude-opus-5", "inp": 10, "cc": 100, "cc5": 100, "cc1": 0, "cr": 1000, "out": 5, **m}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, [row("a", 1), row("a", 1), row("b", 2), row("c", 15, model="private")])))
    (tmp_path / "in" / "b.json").write_text("\n".join(map(json.dumps, [row("b", 2), row("d", 3)])))
    rows = ledger.records(spark, str(tmp_path / "in"), 1)
    q = ledger.windowed_costs(rows).writeStream.format("memory").queryName("costs").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["window"].start.minute, r["model"]): (r["calls"], r["cost"]) for r in spark.table("costs").collect()}
    each = 10 * 5000 + 100 * 6250 + 1000 * 500 + 5 * 25000
    assert got == {(0, "claude-opus-5"): (3, 3 * each), (10, "private"): (1, 0)}
    s = ledger.idle_sessions(rows).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "state2")).start()
    s.processAllAvailable()
    s.stop()
