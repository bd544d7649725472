"""Operators on small invented relations, with results worked out by hand."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import labels as L
from tallyforge.operators import audits, gate, replay, sessions_b, streaks
from tallyforge.plans import cli, render, streak_report
from tallyforge.plans import scan as S
from tallyforge.sources import prices as P
from tallyforge.sources import transcripts as R
from tests import transcripts as T

M = 1e-6


def kitchen(copied=-1):
    """Eight calls. Results of 32K, 20K and 12K enter at calls 1, 3 and 5; a prompt of 6K opens the thread, small ones come between."""
    tokens = [6_000.0, 32_000.0, 2_000.0, 20_000.0, 500.0, 12_000.0, 1_000.0, 1_500.0]
    billed = [int(j > copied) for j in range(8)]
    calls = {"idx": list(range(8)), "ctx": [sum(tokens[: j + 1]) for j in range(8)], "wt": billed, "read_price": [2 * M] * 8, "write_price": [20 * M] * 8, "out_price": [80 * M] * 8}
    calls["cw"] = [sum(billed[:j]) for j in range(8)]
    calls["cr_sum"] = [2 * M * sum(billed[:j]) for j in range(8)]
    return calls, {"entry": list(range(8)), "tokens": tokens, "death": [8] * 8, "evictable": [j in (1, 3, 5) for j in range(8)]}


EARLY = replay.Lease(age=1, batch=30_000)


def test_lease_replay():
    # The first result goes a call after it came, the others together once the third is old enough: 20K alone are too few.
    first, second = ({k: x for k, x in zip("call b S L life w r n after o".split(), batch)} for batch in replay.replay_thread(*kitchen(), EARLY))
    assert (first["call"], first["b"], first["n"], first["after"]) == (2, 32_000, 1, 6_000 + 2_000)
    assert (first["S"], first["L"], first["life"]) == (2_000, 5, pytest.approx(10 * M))  # read by calls 3 to 7
    assert (second["call"], second["b"], second["n"], second["after"]) == (6, 20_000 + 12_000, 2, 6_000 + 2_000 + 500 + 1_000)
    assert (second["S"], second["L"], second["life"]) == (500 + 1_000, 1, pytest.approx(2 * M))
    assert (second["w"], second["r"], second["o"]) == (20 * M, 2 * M, 80 * M)
    assert [batch[0] for batch in replay.replay_thread(*kitchen(3), EARLY)] == [6]  # call 3, before which the first one goes, is a copy


def test_clearing_replay():
    (batch,) = replay.replay_thread(*kitchen(), replay.Clearing(trigger=70_000, keep=1, at_least=25_000))
    # At call 5 the context is 72,500; the results of calls 1 and 3 go, and what stands behind the first of them is written anew.
    assert batch[:4] == (5, 52_000, 2_000 + 500 + 12_000, 2)
    assert not replay.replay_thread(*kitchen(), replay.Clearing(trigger=70_000, keep=2, at_least=32_001))


def test_scores(spark):
    df = spark.createDataFrame([("t", *batch) for batch in replay.replay_thread(*kitchen(), EARLY)], replay.BATCH_COLUMNS)
    t = replay.summary(replay.scored(df)).first()
    saved, rewrite = 32_000 * 10 * M + 32_000 * 2 * M, 2_000 * 18 * M + 1_500 * 18 * M
    # Each result that is fetched again costs a read of the context and the output that asks for it.
    again = replay.AGAIN_OUTPUT * 80 * M
    trips = 8_000 * 2 * M + again + 2 * (9_500 * 2 * M + again)
    unit = 32_000 * (10 + 20) * M + 32_000 * (2 + 20) * M + trips
    assert (t["saved"], t["rewrite"], t["net"], t["trips"], t["unit"]) == tuple(pytest.approx(x) for x in (saved, rewrite, saved - rewrite, trips, unit))
    assert replay.breakeven_rate(t["net"], t["refetch"], t["unit"]) == round((saved - rewrite) / unit, 4)
    # L b / S is 80 and 21.3.
    assert {r["ratio"]: r["pay_batches"] for r in replay.paying_by_ratio(replay.scored(df), [21.0, 22.0, 80.0]).collect()} == {21.0: 2, 22.0: 1, 80.0: 0}
    assert replay.summary(replay.scored(df.limit(0))).first()["batches"] == 0


def drawn_thread(draw):
    n, m = draw.randrange(1, 40), draw.randrange(60)
    entry = sorted(draw.randrange(n) for _ in range(m))
    death = [draw.choice([n, draw.randrange(e + 1, n + 1)]) for e in entry]
    tokens = [float(draw.choice([0, 400, 3_000, 9_000, 20_000])) for _ in entry]
    billed, read = [int(draw.random() < 0.8) for _ in range(n)], [draw.choice([M, 2 * M]) for _ in range(n)]
    calls = {"idx": list(range(n)), "wt": billed, "read_price": read, "write_price": [12.5 * M] * n, "out_price": [50 * M] * n}
    calls["ctx"] = [5_000.0 + sum(t for t, e, d in zip(tokens, entry, death) if e <= j < d) for j in range(n)]
    calls["cw"] = [sum(billed[:j]) for j in range(n)]
    calls["cr_sum"] = [sum(b * r for b, r in zip(billed[:j], read)) for j in range(n)]
    return calls, {"entry": entry, "tokens": tokens, "death": death, "evictable": [draw.random() < 0.6 for _ in entry]}


def plain_batches(calls, items, choose):
    """The replay call by call: every item looked at for each call, every sum added up anew."""
    n, gone, found = len(calls["ctx"]), {}, []
    every = list(zip(range(len(items["tokens"])), items["tokens"], items["entry"], items["death"], items["evictable"]))
    for j in range(n - 1):
        here = [x for x in every if x[2] <= j < x[3]]
        standing = [x for x in here if x[0] not in gone]
        context = calls["ctx"][j] - sum(x[1] for x in here if x[0] in gone)
        going = choose(j, context, [x for x in standing if x[4]])
        b = sum(x[1] for x in going)
        gone |= {x[0]: j for x in going}
        if going and b and calls["wt"][j + 1]:
            later = lambda x: [k for k in range(j + 1, x[3]) if calls["wt"][k]]  # noqa: B023, E731
            calls_left = sum(x[1] * len(later(x)) for x in going) / b
            read = sum(x[1] * sum(calls["read_price"][k] for k in later(x)) for x in going) / b
            suffix = max(0.0, context - b - sum(x[1] for x in standing if x[0] < going[0][0]))
            found.append((j, b, suffix, calls_left, read, 12.5 * M, calls["read_price"][j + 1], len(going), context - b, 50 * M))
    return found


def test_replay_equals_a_plain_loop(spark):
    def lease(j, context, outputs):
        old = [x for x in outputs if x[1] >= 500 and x[2] + 3 <= j]
        return old if sum(x[1] for x in old) >= 30_000 else []

    def clearing(j, context, outputs):
        old = outputs[: max(0, len(outputs) - 2)]
        return old if context >= 60_000 and sum(x[1] for x in old) >= 15_000 else []

    draw = random.Random(4)
    threads = [drawn_thread(draw) for _ in range(80)]
    batches = 0
    for calls, items in threads:
        for plain, policy in ((lease, replay.Lease()), (clearing, replay.Clearing(60_000, 2, 15_000))):
            want, got = plain_batches(calls, items, plain), replay.replay_thread(calls, items, policy)
            assert [tuple(r) for r in got] == [pytest.approx(r, rel=1e-9, abs=1e-9) for r in want]
            batches += len(want)
    assert batches > 50
    columns = list(replay.CALL_COLUMNS)
    c = [(f"t{k}", *map(float, r)) for k, (calls, _) in enumerate(threads) for r in zip(*(calls[x] for x in columns))]
    i = [(f"t{k}", float(s), float(e), t, float(d), v) for k, (_, x) in enumerate(threads) for s, (e, t, d, v) in enumerate(zip(x["entry"], x["tokens"], x["death"], x["evictable"]))]
    frames = spark.createDataFrame(c, ["path", *columns]), spark.createDataFrame(i, ["path", *replay.ITEM_COLUMNS])
    got = replay.replayed(*frames, "lease").collect()
    want = [(f"t{k}", *r) for k, t in enumerate(threads) for r in replay.replay_thread(*t, replay.Lease())]
    assert sorted(tuple(r)[:2] for r in got) == sorted(w[:2] for w in want)
    assert sum(r["b"] for r in got) == pytest.approx(sum(w[2] for w in want))


def test_keepalive(spark):
    # Five-minute writes: pauses of 200 s, 900 s and 6,000 s; after the second nearly all is written anew, after the third all.
    rows = [("t", i, "main", float(ts), "m", 0, cc, cc, 0, cr, 5, False) for i, (ts, cc, cr) in enumerate(((0, 40_000, 0), (200, 1_000, 40_000), (1_100, 39_000, 3_000), (7_100, 44_000, 0)))]
    c = spark.createDataFrame(rows, "path string, idx int, kind string, ts double, model string, inp long, cc long, cc5 long, cc1 long, cr long, out long, copied boolean")
    c = c.withColumns({"iters": F.lit(None).cast("array<int>"), "p_in": F.lit(4 * M), "p_w5": F.lit(5 * M), "p_w1": F.lit(8 * M), "p_read": F.lit(0.4 * M), "p_out": F.lit(20 * M)})
    every = 300 - audits.MARGIN
    ping = lambda ctx: (0.4 * ctx + 4 * audits.PING_IN + 20 * audits.PING_OUT) * M
    caps = {ctx: math.floor(ctx * 4.6 * M / ping(ctx)) for ctx in (41_000, 42_000, 44_000)}
    # What was written less what is new: 39,000 - (42,000 - 41,000) and 44,000 - (44,000 - 42,000), at 4.6 more than a read.
    excess = {41_000: 38_000 * 4.6 * M, 42_000: 42_000 * 4.6 * M}
    fired = {41_000: 900 // every, 42_000: 6_000 // every}
    need = {41_000: -(-600 // every), 42_000: -(-5_700 // every)}
    t = audits.keepalive_totals(audits.idle_gaps(c)).first()
    assert (t["hour"], t["gaps"], t["over_ttl"], t["rebuilds"], t["hindsight_gaps"], t["bridged"]) == (False, 2, 2, 2, 1, 1)
    assert need[41_000] <= caps[41_000] < fired[42_000] and need[42_000] > caps[42_000] and need[42_000] * ping(42_000) > excess[42_000]
    assert t["excess"] == pytest.approx(sum(excess.values())) and t["hindsight"] == pytest.approx(excess[41_000] - need[41_000] * ping(41_000))
    assert t["capped_pings"] == pytest.approx(fired[41_000] * ping(41_000) + caps[42_000] * ping(42_000)) and t["capped_saved"] == pytest.approx(excess[41_000])
    assert t["always_pings"] == pytest.approx(sum(n * ping(ctx) for ctx, n in fired.items()))
    assert audits.keepalive_tail(c).first()["pings"] == pytest.approx(caps[44_000] * ping(44_000))


def test_fold_equals_a_straight_loop(spark):
    draw = random.Random(5)
    rows, want = [], []
    names = ["reasoning", "call", "asst", "tc", "out", "ctxmsg", "comp", "ctx", "task_started"]
    for s in range(60):
        tags = [draw.choice(names) for _ in range(draw.randrange(1, 40))]
        totals = [draw.randrange(6) if t == "tc" and draw.random() < 0.9 else None for t in tags]
        rows += [(f"s{s}", i, 0, t, f"m{i}" if t == "ctx" else None, x, 10 * (x or 0), f"c{i}") for i, (t, x) in enumerate(zip(tags, totals))]
        events, last = [], None
        for i, (t, x) in enumerate(zip(tags, totals)):
            if t == "tc":
                if x is None or x == last:
                    continue
                last = x
            events.append((t, i, x))
        first = next((k for k, e in enumerate(events) if e[0] == "tc"), None)
        start = max((k for k, e in enumerate(events[: (first or 0) + 1]) if e[0] == "task_started"), default=0) if first is not None else 0
        model, calls, opened, window, turn = None, [], False, 0, 0
        for k, (t, i, x) in enumerate(events):
            if t == "ctx":
                model = f"m{i}"
            elif k < start:
                continue
            elif t == "comp":
                window += bool(calls)
            elif t in sessions_b.RESPONSE:
                if not opened:
                    calls.append([None, model, window, turn])
                opened = True
            elif t == "tc":
                if calls and calls[-1][0] is None:
                    calls[-1][0] = 10 * x
                else:
                    calls.append([10 * x, model, window, turn])
                opened = False
            elif t == "task_started":
                turn += 1
            elif t in sessions_b.INPUT:
                opened = False
        live = [c for c in calls if c[0] is not None]
        want += [(f"s{s}", k, *c) for k, c in enumerate(live)]
    df = spark.createDataFrame(rows, "path string, line long, part int, tag string, model string, total long, inp long, call_id string")
    df = df.withColumns({c: F.lit(0).cast("long") for c in ("ca", "wr", "out", "reas")}).withColumn("stamp", F.lit("x"))
    got = sessions_b.calls(sessions_b.folded(df)).select("path", "idx", "inp", "model", "window", "turn").collect()
    assert sorted(tuple(str(x) for x in r) for r in got) == sorted(tuple(str(x) for x in r) for r in want)


def test_streak_buckets(spark):
    def count(*labels):
        rows = [("s", k, i, x, False) for k, i, x in ((1, i, x) for i, x in enumerate(labels))]
        t = streaks.tally(spark.createDataFrame(rows, "path string, session int, idx int, label string, copied boolean")).first()
        return {b: (t[f"{b}_corrections"], t[f"{b}_observed"]) for b in streaks.BUCKETS}

    assert count("new", "correction", "correction", "correction", "new") == {"afterOne": (2, 3), "afterTwo": (1, 2), "otherwise": (1, 1)}
    assert count("new", "correction", "retry", "correction")["afterOne"] == (1, 1)
    assert count("new", "correction", "unknown", "correction")["afterOne"] == (0, 0)


def test_labels_agree_in_python_and_spark(spark):
    commands = ["npm run test", "cd /a && git diff", "ls", "cat x", "python3 a.py", "psql -c 1", "echo", "", "tail -f a.log", "sleep 3", "make all", "rg x | head"]
    names = ["Bash", "Task", "TaskGet", "mcp__a", "x", "", None]
    texts = ["a@b.co", "/home/x", "HTTP://x", "sk-abcdefghij", "f" * 24, "plain", "12345678-1234-1234-", "A" * 48]
    ids = ["claude-opus-5", "gpt-5.6-sol", "private", "claude-x@y.co", None, "o3-mini\n"]
    c = spark.createDataFrame([(x,) for x in commands], "c string").select("c", L.bash_kind(F.col("c")).alias("b"), L.command_kind(F.col("c")).alias("k")).collect()
    assert [(r["b"], r["k"]) for r in c] == [(L.bash_of(x), L.command_of(x, [])) for x in commands]
    n = spark.createDataFrame([(x,) for x in names], "n string").select(L.tool_category(F.col("n"))).collect()
    assert [r[0] for r in n] == [L.tool_of(x) for x in names]
    d = spark.createDataFrame([(x,) for x in texts], "t string").select(L.deny_reason(F.col("t"))).collect()
    assert [r[0] for r in d] == [L.unsafe(x) for x in texts]
    m = spark.createDataFrame([(x,) for x in ids], "m string").select(L.model_label(F.col("m"))).collect()
    assert [r[0] for r in m][:5] == [L.model_of(x) for x in ids][:5]


def test_gate():
    assert gate.check({"a": [1, 2.5, None, True, "fine label"], "u": P.SOURCE_A})
    for bad in ({"a": math.nan}, {"a": "x@y.com"}, {"a b": 1}, {"a": "/home/me"}, {1: 2}, {"a": {1, 2}}, {"a": "f" * 30}, ["line\nfeed"]):
        with pytest.raises(gate.Withheld) as e:
            gate.check(bad)
        assert "x@y.com" not in str(e.value) and "/home/me" not in str(e.value)


def test_prices(tmp_path):
    a, b = P.SnapshotA.load(), P.SnapshotB.load()
    assert (len(a.models), len(b.models), len(b.long)) == (19, 17, 9)
    assert P.ratios_a(a)["claude-opus-5"] == {"5m": 11.5, "1h": 19.0} and P.ratios_a(a)["claude-fable-5-1"] == {"5m": 49.0, "1h": 79.0}
    assert {11.5, 19.0, 49.0, 79.0, 9.0} <= set(P.ratio_set(a, b))
    assert json.loads(P.export_json(a, b))["vendor_b"]["models"]["gpt-5.5"]["long_context"] == {"input": 10.0, "cached_input": 1.0}
    for m, rates in a.models.items():
        for f in (1.0, a.us):
            assert all(abs(x * f * 1000 - round(x * f * 1000)) < 1e-6 for x in rates), m


def test_source_helpers(tmp_path):
    assert R.image_tokens({"type": "base64", "data": "AAAA"}) == 1600
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3136).to_bytes(4, "big") + (1000).to_bytes(4, "big")
    import base64

    assert R.image_tokens({"type": "base64", "data": base64.b64encode(png).decode()}) == int(1568 * 500 / 750) + 1
    assert R.result_size({"content": [{"type": "text", "text": "ab"}, {"type": "tool_reference", "tool_name": "xyz"}, 3]}) == (6, 0)
    assert R.script_kinds('tools.exec_command({cmd: "cat a.txt && head b/c"}); cmd: \'git push\'') == ["read", "git-write"]
    assert R.nothing_new("x\nOutput:\n \n") and R.nothing_new('{"output": ""}') and not R.nothing_new("Output:\nx") and not R.nothing_new("[1]")
    assert R.characters({"type": "x", "a": ["bc", {"path": "no", "d": "e"}]}) == 3
    assert not R.human_turn("user", " # AGENTS.md x") and not R.human_turn("user", "<env x>") and R.human_turn("user", "hi")
    groups = R.packed([(str(i), "") for i in range(20)], lambda p: int(p) * 10, 200)
    assert sorted(p for g in groups for p, _ in g) == sorted(str(i) for i in range(20)) and len(groups) >= 8


def prompt_files(root):
    import os

    record = lambda s, t, **m: T.said(s, t, **m)
    one = [record(1, "new real"), T.answer(2, "a", "m", [T.text("reply one")]), record(3, "<x>tag</x>"), record(4, "meta", isMeta=True), record(5, [{"type": "tool_result"}]), record(6, "fix it"), record(7, "[Request interrupted by user]"), record(8, "bot", origin={"kind": "task"})]
    T.write(os.path.join(root, "p", "one.jsonl"), one)
    T.write(os.path.join(root, "p", "two.jsonl"), [*one[:6], record(50, "after resume")])
    T.write(os.path.join(root, "p", "_three.jsonl"), [record(60, "again")])


def test_streaks_end_to_end(spark, tmp_path, capsys):
    prompt_files(str(tmp_path / "c"))
    marked, failed = streak_report.collect(spark, str(tmp_path / "c"))
    rows = marked.orderBy("session", "idx").select("path", "idx", "copied").collect()
    assert failed == 0 and [r["copied"] for r in rows] == [False, False, True, True, False, False]
    assert cli.main(["streaks", "--claude-dir", str(tmp_path / "c"), "--print-keys"], spark) == 0
    keys = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(k["session"], k["index"]) for k in keys] == [(1, 0), (1, 1), (2, 2), (3, 0)]
    file = tmp_path / "labels.jsonl"
    file.write_text("".join(json.dumps({"key": k["key"], "label": x}) + "\n" for k, x in zip(keys, ("new", "correction", "correction", "new"))))
    assert cli.main(["streaks", "--claude-dir", str(tmp_path / "c"), "--labels", str(file)], spark) == 0
    assert "after one correction" in capsys.readouterr().out
    assert cli.main(["streaks", "--claude-dir", str(tmp_path / "c"), "--labels", str(file), "--session", "abc", "--client", "x", "--json"], spark) == 0
    base = json.loads(capsys.readouterr().out)["baseline"]
    assert (base["promptCount"], base["sessionCount"], base["afterOne"], base["otherwise"]) == (4, 3, {"corrections": 1, "observed": 1}, {"corrections": 1, "observed": 1})
    file.write_text(json.dumps({"key": "zz", "label": "new"}))
    assert cli.main(["streaks", "--claude-dir", str(tmp_path / "c"), "--labels", str(file)], spark) == 2
    assert cli.main(["streaks"], spark) == 2


def test_card():
    sections = {"breakeven": {"trick": {"id": "evict_old_tool_results", "net_usd": -5.0, "evaluated": True, "zero_refetch": True, "basis": "modeled"}, "claude_eviction_opportunities": {"batches": 4, "share_batches_that_pay": 0.5}}, "sample": {"basis": "observed", "threads": 3, "sessions": 1, "meets_sharing_minimum": False, "minimum_threads": 20, "minimum_sessions": 5}}
    for k, (i, net, upper) in enumerate((("boot_listings_on_demand", 3.0, False), ("codex_blocking_waits", 9.0, False), ("batched_clearing", 99.0, True), ("cap_large_tool_outputs", 1.0, False), ("keepalive_capped", 2.0, False))):
        sections[f"s{k}"] = {"fix": {"basis": "modeled", "id": i, "net_usd": net, "clears_breakeven": True, "upper_bound": upper, "vendors": ["codex"], "cap_tokens": 10_000, "cap_minutes_5m": 49, "breakeven_refetch_rate": 0.5, "batch_tokens": 60_000}}
    rep = {"audits": sections, "prices": {"anthropic": {"snapshot_date": "2026-09-30"}, "openai": {"snapshot_date": "2026-09-30"}}, "claude": {"list_price_usd": {"served": 80.0}, "declined_fallbacks_usd": {"declined_billed": 0.0}}, "codex": {"list_price_usd": {"total": 20.0}}}
    c = render.card(rep)
    assert [f["id"] for f in c["fixes"]] == ["codex_blocking_waits", "boot_listings_on_demand", "keepalive_capped"]
    assert c["costly_trick"]["share_of_spend"] == -0.05
    text = render.card_text(c)
    assert "$9 in replay, 9.0% of spend read" in text and "49 minutes" in text
    assert "$" not in render.card_text(render.card(rep, shares_only=True))
    assert render.card_svg(c).count("<text") > 8
    assert S.top_fixes(sections)[0]["net_usd"] == 9.0


def test_sums_that_change():
    draw = random.Random(9)
    for n in (1, 2, 7, 64, 100):
        plain, sums = [0.0] * n, replay.Sums(n)
        for _ in range(200):
            i = draw.randrange(n)
            x = float(draw.randrange(5))
            sums.add(i, x - plain[i])
            plain[i] = x
            assert [sums.before(k) for k in range(n + 1)] == [sum(plain[:k]) for k in range(n + 1)]
            if wanted := draw.randrange(int(sum(plain)) + 1):
                assert sums.reaching(wanted) == next(k for k in range(n) if sum(plain[: k + 1]) >= wanted)


@pytest.mark.parametrize("policy", [replay.Lease(2, 30_000), replay.Clearing(100_000, 3, 20_000)])
def test_a_long_thread_takes_few_steps(policy, monkeypatch):
    """Ten times the calls and batches take about ten times the steps of the sums."""
    steps = []
    for n in (1_000, 10_000):
        count = [0]
        for name in ("add", "before", "reaching"):
            monkeypatch.setattr(replay.Sums, name, lambda self, *a, f=getattr(replay.Sums, name): count.__setitem__(0, count[0] + 1) or f(self, *a))
        flat = {"idx": range(n), "wt": [1] * n, "read_price": [M] * n, "write_price": [M] * n, "out_price": [M] * n, "cw": range(n), "cr_sum": range(n)}
        items = {"entry": range(n), "tokens": [9_000.0] * n, "death": [n] * n, "evictable": [True] * n}
        found = replay.replay_thread(flat | {"ctx": [9_000.0 * (j + 1) for j in range(n)]}, items, policy)
        assert len(found) > n / 10
        steps.append(count[0])
        monkeypatch.undo()
    assert steps[1] <= 11 * steps[0]
