"""Bytes of written shards."""

import pytest
from pyspark.sql import functions as F

from parcelspark.llm import sharding


def test_written_shards_keep_the_limit(spark, tmp_path):
    one = F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("x" * 94))
    docs = spark.range(600).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), one.alias("text"), F.lit("mine").alias("shard"))
    placed = sharding.write_shards(docs, f"file://{tmp_path}/shards", 2000)
    want = {r.shard: r.b for r in placed.groupBy("shard").agg(F.sum("n_bytes").alias("b")).collect()}
    schema = f"{docs.schema.simpleString()[7:-1].replace(':', ' ')}, __shard string"
    files = spark.read.schema(schema).parquet(f"file://{tmp_path}/shards")
    got = {r["__shard"]: r.b for r in files.groupBy("__shard").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    assert got == want and max(got.values()) <= 2000
    assert sorted(r.text for r in files.select("text").collect()) == sorted(r.text for r in docs.collect())


def brute(rows, limit):
    """Shard of each (hash bits, bytes), splitting one bit at a time."""
    out, todo = {}, [("", rows)]
    while todo:
        name, inside = todo.pop()
        if sum(n for _, n in inside) <= limit or len(inside) <= 1 or len(name) == sharding.BITS:
            out[name] = inside
        else:
            todo += [(name + b, [r for r in inside if r[0][len(name)] == b]) for b in "01"]
    return {bits: ("b" + name, sum(n for _, n in inside), len(inside)) for name, inside in out.items() for bits, _ in inside}


@pytest.mark.parametrize("limit", [150, 1000, 20_000, 10**9])
def test_directory_equals_splitting_bit_by_bit(spark, limit):
    doc_id = F.when(F.col("id") % 4 == 0, 7).when(F.col("id") % 4 != 1, F.col("id"))
    docs = spark.range(800).select(doc_id.alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))
    sized = sharding.cut(sharding._sized(docs, "doc_id"))
    rows = [(format(r.h0 & (1 << 64) - 1, "064b") + format(r.h1 & (1 << 64) - 1, "064b"), r.n_bytes) for r in sized.collect()]
    want = brute(rows, limit)
    got = sharding._placed(sized.select("h0", "h1", "n_bytes", F.struct("h0", "h1").alias("h")), limit).collect()
    assert len(got) == 800
    for r in got:
        bits = format(r.h.h0 & (1 << 64) - 1, "064b") + format(r.h.h1 & (1 << 64) - 1, "064b")
        assert (r.shard, r.shard_bytes, r.shard_docs) == want[bits]
        assert r.depth == len(r.shard) - 1 and r.over_limit == (r.shard_bytes > limit)
