"""Operators that deal a hot group to several tasks give what a plain reading gives."""

import datetime
import random

from pyspark.sql import functions as F

from parcelspark.operators import activity, history, lease_text, portfolio


def test_arrivals_of_one_busy_user(spark):
    rng, start = random.Random(5), datetime.datetime(2024, 1, 1)
    times = [(1, i, start + datetime.timedelta(seconds=rng.randrange(4000) / 4)) for i in range(400)] + [(2, 400, start), (None, 401, start), (None, 402, start), (1, 403, None), (1, 404, None)]
    df = spark.createDataFrame(times, "user_id long, event_id long, ts timestamp")
    got = {r.event_id: (r.earlier, r.limited) for r in activity.over_rate(df, 3, 60).collect()}
    assert len(got) == len(times)
    for user, event, t in times:
        if t is not None:
            n = sum(u == user and s is not None and datetime.timedelta(0) < t - s < datetime.timedelta(seconds=60) for u, _, s in times)
            assert got[event] == (n, n >= 3)


def test_page_chunks_stream_past(spark):
    pages = [(1, p, "x" * n) for p, n in enumerate([10, 50, 60, 5, 200, 1, 1, 1, 1])] + [(2, 1, None), (2, 2, "")] + [(None, 1, "a")]
    got = {(r.doc_id, r.page): r.chunk for r in lease_text.page_chunks(spark.createDataFrame(pages, "doc_id long, page int, text string"), 3, 100).collect()}
    assert [got[1, p] for p in range(9)] == [0, 0, 1, 1, 2, 3, 3, 3, 4]
    assert got[2, 1] == got[2, 2] == 0 and got[None, 1] == 0


def test_concentration_of_many_tenants(spark):
    rows = [(1, f"t{i}", float(i % 97 + 1)) for i in range(900)] + [(1, "giant", 9000.0), (2, "only", 5.0), (3, None, 7.0)]
    df = spark.createDataFrame(rows, "team_id int, tenant string, rent double").withColumns({"tenant_key": F.col("tenant"), "rent": F.col("rent").cast("decimal(18,2)"), "uploaded_at": F.lit("2024-01-01").cast("date"), "lease_id": F.monotonically_increasing_id()})
    got = {r.team_id: r for r in portfolio.concentration(df).collect()}
    shares = sorted((x for t, k, x in rows if t == 1), reverse=True)
    total = sum(shares)
    assert set(got) == {1, 2} and got[1].tenant_count == 901
    assert abs(got[1].top_5_pct - sum(shares[:5]) / total * 100) < 0.011 and abs(got[1].hhi - sum((x / total * 100) ** 2 for x in shares)) < 0.11
    assert (got[2].top_1_pct, got[2].hhi, got[2].concentration_level) == (100.0, 10000.0, "high")


def test_building_trends_without_distinct(spark):
    rows = [(1, "b", "u1", "x", 1), (1, "b", "u1", "y", 2), (1, "b", "u2", "x", 1), (1, "c", None, "x", 1), (1, "c", "u3", None, 1), (2, None, "u4", "x", 1)]
    df = spark.createDataFrame(rows, "team_id int, building_key string, unit_key string, tenant_key string, lease_id long").withColumns({"end_date": F.when(F.col("lease_id") == 1, F.lit("2024-01-01").cast("date")), "uploaded_at": F.lit("2024-01-01").cast("date")})
    got = {(r.team_id, r.building_key): (r.record_count, r.units, r.turnover_count, r.expirations) for r in history.building_trends(df).collect()}
    assert got == {(1, "b"): (3, 2, 1, 2), (1, "c"): (2, 1, 0, 2), (1, "(all)"): (5, 3, 1, 4)}
    plan = history.building_trends(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan.lower()


def test_alerts_parse_the_leases_once(spark, small):
    """Candidates are read from a table of parsed leases and one of keyed flags, not from the orders again and again."""
    from parcelspark.plans import catalog

    plan = catalog.alert_candidates(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and plan.count("Relation") >= 5
