"""Changes between snapshots, dense counts, scores, and file types."""

from pyspark.sql import functions as F

from parcelspark.operators import documents, extraction, state

FINDING = "natural_key string, severity string, status string, discrepancy_type string"


def test_changes_and_alerts(spark):
    before = spark.createDataFrame([("f:1:x", "low", "open", "a"), ("f:2:x", "low", "open", "a"), ("f:3:x", "low", "resolved", "a"), ("f:4:x", "low", "open", "a"), ("f:5:x", None, "open", "a")], FINDING)
    after = spark.createDataFrame([("f:1:x", "high", "open", "a"), ("f:2:x", "low", "resolved", "a"), ("f:3:x", "low", "open", "a"), ("f:5:x", None, "open", "a"), ("f:6:x", None, "open", "a"), ("odd", "low", "open", "a")], FINDING)
    changes = state.finding_changes(before, after)
    assert {(r.natural_key, r.change) for r in changes.collect()} == {("f:1:x", "changed"), ("f:2:x", "closed"), ("f:3:x", "opened"), ("f:4:x", "closed"), ("f:6:x", "opened"), ("odd", "opened")}
    alerts = {r.natural_key: (r.severity, r.lease_id) for r in state.discrepancy_alerts(changes).collect()}
    assert alerts == {"new_discrepancy:f:3:x": ("low", 3), "new_discrepancy:f:6:x": ("medium", 6), "new_discrepancy:odd": ("low", None)}
    assert state.finding_changes(before, before).count() == 0


def test_summary_is_dense(spark):
    rows = spark.createDataFrame([("a", "high", "open", "rent"), ("b", "high", "open", "dates"), ("c", None, "open", "rent")], FINDING)
    got = {(r.scope, r.name): r.n for r in state.finding_summary(rows).collect()}
    assert got == {("status", "open"): 3, ("status", "resolved"): 0, ("severity", "high"): 2, ("severity", "medium"): 0, ("severity", "low"): 0, ("severity", None): 1, ("type", "rent"): 2, ("type", "dates"): 1}
    assert {r.n for r in state.finding_summary(rows.limit(0)).collect()} == {0}


def test_scores(spark):
    rows = [(1, "rent_amount", "$1,000", "$1,000.40", "high"), (2, "rent_amount", "$900", "$1,000", "high"), (3, "tenant", None, None, None), (4, "tenant", "X", None, "low"), (5, "tenant", None, "X", None), (6, "tenant", "Acme", "ACME Inc", "low")]
    scores = extraction.scored(spark.createDataFrame(rows, "doc_id int, field string, found string, expected string, confidence string"))
    assert [r.kind for r in scores.orderBy("doc_id").collect()] == ["correct_found", "wrong", "correct_absent", "spurious", "missed", "correct_found"]
    got = {r.scope: r for r in extraction.calibration(scores).collect()}
    assert (got["all"].claims, got["all"].wrong, got["all"].confident_wrong, got["all"].p_high, got["all"].p_low, got["all"].calibration_gap, got["all"].p_medium) == (4, 2, 1, 0.5, 0.5, 0.0, None)
    assert [r.doc_id for r in extraction.confident_mistakes(scores).collect()] == [2]


def test_file_types(spark):
    cases = {
        b"%PDF-1.7": "pdf", b"PK\x03\x04..word/document.xml": "docx", b"PK\x03\x04..xl/workbook.xml": "xlsx", b"PK\x03\x04..ppt/slides": "slides", b"PK\x03\x04..x": "archive",
        b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1..W\0o\0r\0d\0D\0o\0c\0": "doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1..W\0o\0r\0k\0b\0o\0o\0k\0": "xls", b"\xff\xd8\xff\xe0": "jpg", b"\x89PNG\r\n\x1a\n": "png", b"II*\0": "tiff", b"GIF89a": "gif",
        b"\0\0\0\x18ftypheic": "heic", b"\0\0\0\x18ftypavif": "avif", b"RIFF\0\0\0\0WEBP": "webp", b"RIFF\0\0\0\0WAVE": None, b"MZ\x90": "program", b"\x7fELF": "program", b"{\\rtf1": "rtf", b" <!DOCTYPE html>": "markup",
        b"a,b\n1,2\n": "csv", "Prose é\nwith lines".encode(): "txt", b"\0\1\2\3": None, b"": "empty", None: None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, c binary").withColumn("t", documents.sniffed(F.col("c")))
    got = {r.i: r.t for r in df.collect()}
    for i, (content, want) in enumerate(cases.items()):
        assert got[i] == want, content
    takes = df.select("t", documents.taken(F.col("t"), F.lit("lease")).alias("a"), documents.taken(F.col("t"), F.lit("other")).alias("b")).collect()
    assert {r.t for r in takes if r.a} == {"pdf", "docx", "doc", "jpg", "png", "tiff", "heic", "webp", "txt"} and not any(r.b for r in takes)
