"""Operator 11 against a plain version and SQL, and on awkward rows."""

import hashlib
from collections import defaultdict

import duckdb
import numpy as np

from parcelspark.llm import line_dedup, queries
from tests.llm.brute import lower
from tests.llm.test_operators import docs_of

LICENSE = "All rights reserved, see the license."


def plain(rows, least=20, docs=3):
    """``(doc_id, text, n_lines, n_dropped)`` by loops; each row is a document."""
    keys = [[lower(line.strip(" \t\n\x0b\x0c\r")) for line in (t or "").split("\n")] for _, t in rows]
    holders = defaultdict(set)
    for r, of in enumerate(keys):
        for k in of:
            if len(k) >= least:
                holders[k].add(r)
    out = []
    for r, (doc, t) in enumerate(rows):
        lines, kept = (t or "").split("\n"), []
        for k, line in zip(keys[r], lines):
            best = max((rows[i][0] for i in holders[k] if rows[i][0] is not None), default=None)
            if len(holders[k]) < docs or best is None or doc == best:
                kept.append(line)
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def in_order(rows):
    return sorted(rows, key=repr)


def test_equals_sql_and_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = in_order(tuple(r) for r in line_dedup.line_report(docs).collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
        want = con.execute(queries.ORACLE_SQL["op11_twice_seen_line_dedup"]).fetchall()
    assert got == in_order(want)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got == in_order((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, k in plain(rows))
    assert sum(r[2] for r in got) > 0


AWKWARD = [
    (1, f"{LICENSE}\nfirst\n{LICENSE}"), (2, f" \t{LICENSE.upper()}\r\nsecond"), (3, f"third\n{LICENSE}"), (4, None), (5, ""), (6, "\n\n"), (7, "short line\n" * 3),
    (8, "short line"), (9, "short line"), (10, "é" * 19), (11, "é" * 19), (12, "é" * 19), (13, "漢" * 20 + "\nX"), (14, "漢" * 20), (15, "漢" * 20 + "\n"), (None, f"{LICENSE}\nnull"),
    (16, "only twice here, in two documents\na"), (17, "only twice here, in two documents\nb"), (18, "three times, but in one document\n" * 3), (18, "three times, but in one document\n" * 3),
    (20, "Ünïcode Ä stays apart from ä here"), (21, "Ünïcode ä stays apart from ä here"), (22, "x" * 300_000 + "\n" + LICENSE), (23, f"\x0b{LICENSE}\x0c\n\x85{LICENSE}\n\xa0{LICENSE}"),
]


def test_awkward_rows(spark):
    got = line_dedup.without_repeated_lines(docs_of(spark, AWKWARD), bits=1 << 16).collect()
    assert in_order(tuple(r) for r in got) == in_order(plain(AWKWARD))


def test_full_filters_and_few_bits_lose_nothing(spark):
    rows = [(i, "\n".join(f"line {j} of very many lines" for j in range(i % 40, i % 40 + 30))) for i in range(120)]
    docs = docs_of(spark, rows).repartition(6)
    for bits in (1 << 3, 1 << 12, 1 << 20):
        assert in_order(tuple(r) for r in line_dedup.without_repeated_lines(docs, bits=bits).collect()) == in_order(plain(rows))


def test_second_filter_knows_what_two_documents_hold(spark):
    rows = [(i, f"a line that only document {i} holds\na line that documents {i // 2} share") for i in range(200)]
    known = line_dedup.seen_twice(docs_of(spark, rows).repartition(7), bits=1 << 20)
    shared, own = ([line.encode() for _, t in rows for line in [t.split("\n")[k]]] for k in (1, 0))
    assert line_dedup.has(known, line_dedup.bits_of(shared, 1 << 20)).all()
    assert not line_dedup.has(known, line_dedup.bits_of(own, 1 << 20)).any()
    assert np.unpackbits(known).sum() <= 2 * 100 + 2


def test_one_line_and_one_row_hold_half_of_all(spark):
    rows = [(i, f"{LICENSE}\nown line number {i} is here") for i in range(300)] + [(None, f"{LICENSE}\nnull")] * 300 + [(7, f"{LICENSE}\nseven")] * 200
    got = line_dedup.without_repeated_lines(docs_of(spark, rows), bits=1 << 16).collect()
    assert in_order(tuple(r) for r in got) == in_order(plain(rows))


def test_null_ids_only_and_no_rows(spark):
    docs = docs_of(spark, [(None, LICENSE)] * 4)
    assert [(r.n_dropped, r.text) for r in line_dedup.without_repeated_lines(docs, bits=1 << 16).collect()] == [(0, LICENSE)] * 4
    assert line_dedup.without_repeated_lines(docs.limit(0), bits=1 << 16).count() == 0
