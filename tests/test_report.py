import random
from datetime import datetime, timedelta, timezone

import pytest

from graphlog.operators import report

START = datetime(2024, 1, 1, 0, 30, tzinfo=timezone.utc)
CALLS = "model_id string, agent_id string, called_at timestamp, outcome string"


def walked(calls, quotas):
    """One agent after the other, one call after the other."""
    agents = {}
    for tenant, agent, at, _ in calls:
        if None not in (tenant, agent, at):
            agents.setdefault((tenant, agent), []).append(at)
    out = []
    for key, times in agents.items():
        opened, used = None, {}
        for at in sorted(times):
            if opened is None or at > opened + timedelta(hours=1):
                opened = at
            used[opened] = used.get(opened, 0) + 1
        allowed = max(0, quotas.get(key, 0))
        out += [(*key, at.replace(tzinfo=None), n, allowed, n > allowed) for at, n in used.items()]
    return sorted(out)


def found(spark, calls, quotas):
    rows = spark.createDataFrame([(*k, n) for k, n in quotas.items()], "model_id string, agent_id string, per_hour int")
    got = report.hourly_usage(spark.createDataFrame(calls, CALLS), rows).selectExpr(
        "model_id", "agent_id", "date_format(opened_at, 'yyyy-MM-dd HH:mm:ss.SSSSSS')", "used", "allowed", "exceeded"
    )
    return sorted((r[0], r[1], datetime.strptime(r[2], "%Y-%m-%d %H:%M:%S.%f"), *r[3:]) for r in got.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_hours_count_from_first_use(spark, seed):
    rnd = random.Random(seed)
    calls = []
    for agent, n, mean in (("busy", 1500, 120), ("slow", 60, 5400), ("rare", 5, 200_000)):
        at = START
        for _ in range(n):
            calls.append(("t0", agent, at, "OK"))
            at += timedelta(seconds=rnd.choice([0, 1, rnd.randint(1, 2 * mean), 3600 if agent == "slow" else 7]))
    quotas = {("t0", "busy"): 40, ("t0", "slow"): -1}
    assert found(spark, calls, quotas) == walked(calls, quotas)


def test_edges_of_an_hour(spark):
    hour, tick = timedelta(hours=1), timedelta(microseconds=1)
    calls = [("t", "exact", START, "OK"), ("t", "exact", START + hour, "OK"), ("t", "exact", START + 2 * hour, "OK")]
    calls += [("t", "past", START, "OK"), ("t", "past", START + hour + tick, "OK"), ("t", "past", START + hour + tick, "OK")]
    last = START.replace(minute=59, second=59, microsecond=999_999)
    calls += [("t", "turn", last, "OK"), ("t", "turn", last + hour, "OK"), ("t", "turn", last + hour + tick, "OK"), ("t", "turn", last + 30 * hour, "OK")]
    calls += [(None, "past", START, "OK"), ("t", None, START, "OK"), ("t", "past", None, None), ("u", "past", START, None)]
    got = found(spark, calls, {("t", "past"): 2})
    assert got == walked(calls, {("t", "past"): 2})
    assert [r[3] for r in got if r[1] == "exact"] == [2, 1]
    assert found(spark, [], {("t", "past"): 2}) == []
