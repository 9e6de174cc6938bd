"""Results that a cap before the choice would cut."""

from parcelspark.operators import identity
from parcelspark.plans import catalog


def test_funnel_takes_the_first_of_all_paths(spark, tmp_path):
    rows = [(i, f"p{i:04d}", i % 7) for i in range(400)] + [(400, None, 1)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long").selectExpr("*", "timestamp'2024-01-01' AS ts").write.parquet(f"file://{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in catalog.traffic_funnel(spark, f"file://{tmp_path}").collect())
    assert got == [(1, "p0000", 1), (2, "p0001", 1), (3, "p0002", 1)]


def test_resolutions_of_others_survive_a_busy_finding(spark):
    finds = spark.createDataFrame([(i, "c", None) for i in range(3)], "finding_id int, category string, field string")
    res = spark.createDataFrame([(i, 0 if i >= 4 else 1 + i % 2, i) for i in range(12)], "resolution_id int, finding_id int, at int")
    got = {}
    for r in identity.recent_resolutions(finds, res, 3).orderBy("nth").collect():
        got.setdefault(r.finding_id, []).append(r.resolution_id)
    assert got == {0: [3, 2, 1], 1: [11, 10, 9], 2: [11, 10, 9]}
