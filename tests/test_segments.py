"""Admissions of users cut at gaps."""

import random
from datetime import datetime, timedelta

from parcelspark.streaming import limits


def test_admissions_in_segments(spark):
    rng = random.Random(4)
    rows = []
    for user in (1, 2, None):
        t = 0
        for _ in range(300):
            t += rng.choice([0, 1, 5, 20, 59, 60, 61, 119, 500])
            rows.append((user, len(rows), datetime(2024, 1, 1) + timedelta(seconds=t)))
    want = {}
    for user in (1, 2, None):
        mine = [r for r in rows if r[0] == user]
        ok, _ = limits._admit([r[2].timestamp() for r in mine], [], 3, 60.0)
        want |= {r[1]: x for r, x in zip(mine, ok)}
    rows.append((1, len(rows), None))
    got = limits.admissions(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp"), 3, 60.0)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    assert {r.event_id: r.admitted for r in got.collect()} == want | {len(rows) - 1: True}
