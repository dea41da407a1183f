import random

import pytest

from tessera.operators import versions
from tessera.plans import catalogue


def brute(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for a in after:
        seen, todo = set(), list(after[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        if a in seen:
            out.add(a)
    return out


@pytest.mark.parametrize("n", [20, 60])
def test_deadlocked_against_brute_force(spark, n):
    rng = random.Random(n)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)] + [(n, n), (n + 1, n + 2), (n + 2, n + 1), (n + 2, 0)]
    got = [r.tx for r in versions.deadlocked(spark.createDataFrame(edges, "waiter long, holder long")).collect()]
    assert sorted(got) == sorted(brute(edges))


def test_all_users_are_examined(spark):
    sf = "/root/testdata/sf0.1"
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type").collect()
    users = max(r.user_id for r in events) + 1
    want = brute([(r.user_id, r.event_id % users) for r in events if r.event_type == "error"])
    got = [r.tx for r in catalogue.queries()["deadlocks"](spark, sf).collect()]
    print(len(got), max(got))
    assert sorted(got) == sorted(want) and max(want) >= 40
