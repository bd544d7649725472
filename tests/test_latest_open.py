"""The open call that a command belongs to, against a search over all spans."""

import random

import pytest

from tallyforge.operators import sessions_b


def made(draw, sessions, n):
    spans, commands = [], []
    for s in range(sessions):
        for k in range(n):
            at = draw.randrange(3 * n)
            if draw.random() < 0.5:
                spans.append((f"s{s}", at, at + draw.choice((0, 1, 3, draw.randrange(1, 3 * n), 1 << 60))))
            else:
                commands.append((f"s{s}", at, f"kind {k}", None if k % 5 else k))
    return sorted(set(spans)), commands


@pytest.mark.parametrize("sessions, n", [(6, 40), (1, 300), (40, 6)])
def test_against_all_spans(spark, sessions, n):
    spans, commands = made(random.Random(n), sessions, n)
    want = []
    for c in commands:
        open_then = [(p, q) for path, p, q in spans if path == c[0] and p < c[1] < q]
        want += [(*c, *x) for x in sorted(open_then)[-1:]]
    left = spark.createDataFrame(commands, "path string, at bigint, kind string, agg bigint").repartition(3)
    right = spark.createDataFrame(spans, "path string, place bigint, close_pos bigint").repartition(3)
    assert sorted(map(repr, map(tuple, sessions_b.latest_open(left, right).collect()))) == sorted(map(repr, want))
    assert sessions_b.latest_open(left.limit(0), right).count() == sessions_b.latest_open(left, right.limit(0)).count() == 0


def test_a_long_session_gives_no_more_rows_than_it_has(spark):
    """100,000 events of one session, half of the spans never closed."""
    spans = spark.range(0, 50_000).selectExpr("'one' as path", "2 * id as place", "if(id % 2 = 0, 1L << 60, 2 * id + 2) as close_pos")
    commands = spark.range(0, 50_000).selectExpr("'one' as path", "2 * id + 1 as at", "id as kind")
    found = sessions_b.latest_open(commands, spans)
    assert found.where("place = at - 1").count() == found.count() == 50_000
    assert "SortMergeJoin" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "BroadcastNestedLoopJoin" not in plan
