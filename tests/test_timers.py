"""Streams with timers: told once a threshold, and jobs that turn stale; across restarts of the query."""

import pytest
from pyspark.sql import functions as F

from parcelspark.operators import scope
from parcelspark.streaming import limits


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def run(stream, tmp):
    q = stream.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def feed(spark, tmp, n, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp}/in/{n}")


def source(spark, tmp, schema):
    return spark.readStream.schema(schema.replace("ts string", "ts timestamp")).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp}/in")


UNITS = "account long, event_id long, ts string, units long"


def test_thresholds_are_told_once_over_restarts(rocks, tmp_path):
    batches = [
        [(1, 1, "2024-01-02 10:00:00", 40), (2, 2, "2024-01-03 10:00:00", 100), (1, 3, "2024-01-04 10:00:00", 20)],
        [(1, 4, "2024-01-05 10:00:00", 20), (2, 5, "2024-01-06 10:00:00", 5), (None, 6, "2024-01-06 10:00:00", 60)],
        [(1, 7, "2024-01-20 10:00:00", 100), (1, 8, "2024-02-03 10:00:00", 50)],
        [(1, 9, "2024-02-10 10:00:00", 40), (1, 10, "2024-02-11 10:00:00", None)],
    ]
    for n, rows in enumerate(batches):
        feed(rocks, tmp_path, n, rows, UNITS)
        run(limits.threshold_stream(source(rocks, tmp_path, UNITS), 100.0), tmp_path)  # each is a new start from the checkpoint
    got = sorted(map(str, rocks.read.parquet(f"{tmp_path}/out").select("account", "month", "level", "event_id").collect()))
    want = limits.thresholds(rocks.createDataFrame([r for b in batches for r in b], UNITS), 100.0)
    assert got == sorted(map(str, want.select("account", "month", "level", "event_id").collect()))
    assert len(got) == 6


JOBS = "job_id long, state string, ts string"


def test_jobs_turn_stale_by_a_timer(rocks, tmp_path):
    batches = [
        [(1, "queued", "2024-01-01 10:00:00"), (2, "queued", "2024-01-01 10:00:00"), (3, "queued", "2024-01-01 10:00:00")],
        [(1, "processing", "2024-01-01 10:05:00"), (2, "processing", "2024-01-01 10:05:00"), (4, "queued", "2024-01-01 10:10:00")],
        [(2, "complete", "2024-01-01 10:15:00"), (4, "queued", "2024-01-01 10:10:00")],
        [(9, "complete", "2024-01-01 10:50:00")],  # time passes: 1 is stale after twenty minutes of processing
        [(9, "failed", "2024-01-01 14:50:00")],  # 3 and 4 after three hours in the queue
        [(9, "failed", "2024-01-01 15:50:00")],
    ]
    for n, rows in enumerate(batches):
        feed(rocks, tmp_path, n, rows, JOBS)
        run(limits.job_stream(source(rocks, tmp_path, JOBS)), tmp_path)
    out = rocks.read.parquet(f"{tmp_path}/out")
    last = {r.job_id: r.state for r in out.groupBy("job_id").agg(F.max_by("state", F.struct("ts", "state")).alias("state")).collect()}
    batch = scope.job_states(rocks.createDataFrame([r for b in batches for r in b], "job_id long, state string, at string").withColumn("at", F.to_timestamp("at")), "2024-01-01 15:50:00")
    assert last == {r.job_id: r.state for r in batch.collect()} == {1: "stale", 2: "complete", 3: "stale", 4: "stale", 9: "failed"}
    assert out.where("job_id = 4 AND state = 'queued'").count() == 1 and out.where("state = 'stale'").count() == 3
