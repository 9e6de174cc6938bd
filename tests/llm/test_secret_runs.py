"""Secrets in one run with a base span or a sample word."""

from parcelspark.llm import secrets

HEX = "f33e61083db5dbdf4bd2369d2f80176e"
TOKEN = "K9z2Lm8Qw4RtY7uPnB3xVc6HjD1sGa"


def test_runs_with_base_spans_and_samples(spark):
    rows = [
        (1, f"x {HEX}-{TOKEN} y", "x [SECRET] y"),
        (2, f"x {TOKEN}-{HEX} y", "x [SECRET] y"),
        (3, f"x /sample/{TOKEN} y", "x /sample[SECRET] y"),
        (4, f"x {TOKEN}AAAAAAAAAA{TOKEN} y", "x [SECRET] y"),
        (5, "x exampleK9z2Lm8Qw4RtY7uPn y", "x exampleK9z2Lm8Qw4RtY7uPn y"),
        (6, f'x token="{TOKEN}" y', 'x [SECRET]" y'),
    ]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.masked(docs).collect()}
    assert got == {k: want for k, _, want in rows}
    spans = {r.doc_id: r.spans for r in secrets.secret_report(docs).collect()}
    assert spans[1].startswith("hex:2:34,entropy:") or spans[1].startswith("entropy:")
    assert "entropy" in spans[3] and spans[5] == "" and "entropy" not in spans[6]
