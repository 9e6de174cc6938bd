"""Operator 13 against a plain version and SQL, and on awkward rows."""

import math
import re
from collections import Counter

import duckdb
import pytest

from parcelspark.llm import lexical, queries
from tests.llm.brute import lower
from tests.llm.test_operators import docs_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k=10, once=True):
    counts = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m, score = 100 - 90 + (90 * sum(c.values()) * n_docs) // total, 0
            for t, times in Counter(TERM.findall(lower(text))).items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += (1 if once else times) * w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], "item_id long, text string, row string, rank int, score double")


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_sql_and_plain_version(spark, small):
    got = found(queries.op13_blocked_product_search(spark, small))
    with duckdb.connect() as con:
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
        want = con.execute(queries.ORACLE_SQL["op13_blocked_product_search"]).fetchall()
    assert got == sorted(want, key=repr)
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{small}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got == plain(docs, items) and len(got) == 10 * len(items)


DOCS = [
    (1, "the cat sat on the mat"), (2, "The CAT, the cat; the hat."), (3, None), (4, ""), (5, "... !!"), (6, "dog dog dog 42"), (7, "été ÉTÉ 漢字 cat42"), (8, "the cat sat on the mat"),
    (9, "the cat sat on the mat"), (None, "the cat sat on the mat"), (None, "hat"), (10, "x " * 5000 + "cat"), (10, "hat"), (11, "common " * 3), (12, "common"), (13, "common the"),
]
ITEMS = [(1, "cat cat hat"), (2, None), (3, ""), (4, "unknown words only"), (5, "The the THE"), (5, "The the THE"), (6, "été"), (None, "dog 42"), (7, "x common mat \x00 sat"), (8, "-- ..")]


@pytest.mark.parametrize("block", [3, 200_000])
@pytest.mark.parametrize("once", [True, False])
def test_awkward_rows(spark, once, block):
    got = found(lexical.search(docs_of(spark, DOCS), items_of(spark, ITEMS), k=3, once=once, block=block))
    assert got == plain(DOCS, ITEMS, 3, once)


def test_ties_over_blocks_and_tasks(spark, monkeypatch):
    """Equal scores of many copies, over several tasks and blocks of the product, go by id."""
    docs = [((i * 37) % 1000, "same words here" if i % 3 else f"other text {i}") for i in range(1000)]
    monkeypatch.setattr(lexical.product, "__defaults__", (16,))
    items = [(1, "same here"), (2, "other 900"), (3, "nothing of it")]
    got = found(lexical.search(docs_of(spark, docs).repartition(9), items_of(spark, items)))
    assert got == plain(docs, items)


def test_no_rows(spark):
    docs, items = docs_of(spark, DOCS), items_of(spark, ITEMS)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs_of(spark, [(3, None), (4, "")]), items).count() == 0


def test_long_documents_do_not_overflow():
    assert lexical.length_norm(10**9, 10**11, 10**14) == 10 + 90 * 10**20 // 10**14
