"""Near-duplicates and removals where nothing is small enough to broadcast and every key counts as hot or none does."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.llm import common, minhash
from tests.llm import brute


@pytest.fixture
def shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(("hot", "share"), [(3, 4), (1000, 10**6)])
def test_near_duplicates(shuffled, monkeypatch, hot, share):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(minhash, "SHARE", share)
    rng, rows = np.random.default_rng(hot), []
    for f in range(3):
        base = [f"f{f}t{i}" for i in range(60 + 70 * f)]
        for i in range(40):
            w = list(base)
            for j in rng.choice(len(w), rng.integers(0, 6), replace=False):
                w[j] = f"n{rng.integers(0, 10**6)}"
            rows.append((1000 * f + i, " ".join(w)))
    rows += [(9000 + i, f"alone {i} with words of its own {i * 7}") for i in range(30)]
    docs = shuffled.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:4] for r in minhash.near_duplicates(docs, 5, 80).collect()}
    assert got == brute.components(rows, 5, 80)
    kept = {r.doc_id for r in minhash.one_of_each(docs).collect()}
    assert kept == {k for k, v in got.items() if v[2]}


@pytest.mark.parametrize("hot", [1, 1000])
def test_without(shuffled, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    docs = shuffled.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id") % 10).alias("k"), F.col("id").alias("rows"))
    bad = docs.where("k IN (1, 2)").select(F.struct("k"))
    left = [tuple(r) for r in common.without(docs, F.struct("k"), bad).collect()]
    want = [((i % 10) if i % 3 else None, i) for i in range(300)]
    assert sorted(left, key=str) == sorted([r for r in want if r[0] not in (1, 2)], key=str)
    inside = [tuple(r) for r in common.without(docs, F.struct("k"), bad, anti=False).collect()]
    assert sorted(inside) == sorted(r for r in want if r[0] in (1, 2))
    null = docs.where("k IS NULL").select("k")
    assert common.without(docs, F.col("k"), null).count() == 300  # a bare null matches nothing; struct keys tell nulls apart
