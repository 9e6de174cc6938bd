"""Operators that SQL cannot check, and rules worth a hand-made case."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelspark.operators import concessions, documents, extraction, overlay, reconcile, risks, state
from parcelspark.sources import delimited, statements
from parcelspark.streaming import limits
from parcelspark.streaming.alerts import AlertStore


def test_rent_roll_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Harbor Plaza\nAs of 2026\n\nUnit,Resident,Unit SF,Lease From,Lease To,Market Rent,Rent Charge,Status\n101,Ann Lee,900,1/1/2025,12/31/2025,1500,\"1,450.00\",Current\n102,VACANT,800,,,1400,,Vacant\n103,Bo Ek,700,1/1/2025,,1300,1200,Future\n104,Cy Po,700,2/1/2025,1/31/2026,1300,\"$1,250\",Current\n104,Cy Po,700,2/1/2025,1/31/2026,1300,\"$1,250\",Current\nTotal,,,,,,2700,\n")
    (tmp_path / "b.csv").write_bytes("Tenant;Rent;Lease Start;Lease End\nDé Fo;1.234,50;1.2.2025;31.1.2026\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes("Tenant\tBase Rent\nEve\t$900\n".encode("utf-16"))
    (tmp_path / "d.csv").write_bytes(b"\x00\x01\x02binary")
    rows = delimited.read_rent_rolls(spark, f"file://{tmp_path}").cache()
    by = {(r.file, r.row_num): r for r in rows.collect()}
    assert len(by) == 8
    first = by["a.csv", 5]
    assert (first.tenant, first.rent, first.unit, first.sqft, first.skip_reason) == ("Ann Lee", "1,450.00", "101", "900", None)
    assert [by["a.csv", i].skip_reason for i in (6, 7, 10)] == ["no tenant", "future resident", "no tenant"]
    assert by["b.csv", 2].tenant == "Dé Fo" and by["c.csv", 2].rent == "$900"
    units = {r.file: r for r in delimited.unit_states(delimited.without_copies(rows)).collect()}
    assert units["a.csv"].occupied == 2 and units["a.csv"].vacant_units == ["102"]


def test_two_row_header():
    rows = [["Monthly", "Lease", "", "Resident"], ["Rent", "Start", "End", "Name"], ["5", "a", "b", "c"]]
    at, columns = delimited.find_header(rows)
    assert at == 1 and columns["rent"] == 0 and columns["tenant"] == 3
    assert delimited.map_header(["Tenant", "Market Rent", "Annual Rent", "Rent"])["rent"] == 3


def test_charge_lines(spark):
    rows = spark.createDataFrame([("f", 1, "1", "base rent", 100.0), ("f", 2, None, "concession", -10.0), ("f", 3, None, "pet rent", 5.0), ("f", 4, "2", "rent", 50.0)], "file string, row_num int, unit string, code string, amount double")
    got = {r.unit: (r.rent, r.concession) for r in delimited.collapse_charges(rows).collect()}
    assert got == {"1": (105.0, 10.0), "2": (50.0, None)}


def test_statements(spark, tmp_path):
    months = ",".join(m.title() + " 2025" for m in statements.MONTHS)
    (tmp_path / "t.csv").write_text(f"Elm Court\n\nLine Item,{months},Total\nGross Potential Rent,{','.join(['100'] * 12)},1200\nBad Debt,{','.join(['(5)'] * 12)},-60\nTotal Rental Income,{','.join(['90'] * 12)},999\nOther,1,2\n")
    lines = statements.read_statements(spark, f"file://{tmp_path}").cache()
    sums = {r.category: r.s for r in lines.where("month_idx > 0").groupBy("category").agg(F.sum("amount").alias("s")).collect()}
    assert sums == {"gross_potential_rent": 1200.0, "bad_debt": -60.0, "rental_income_collected": 1080.0}
    assert {r.category for r in statements.consistent_lines(lines).collect()} == {"gross_potential_rent", "bad_debt"}
    assert statements.month_of("10/2025") == (2025, 10) and statements.month_of("Budget Jan") is None and statements.month_of("2025-07") == (2025, 7)


def test_effective_rent(spark):
    rows = [(1, 1, 1200.0, "2025-01-01", "2025-12-31", "Two months free rent."), (1, 2, 1000.0, "2025-01-01", "2025-12-31", "Credit of $100 per month."), (1, 3, None, "2025-01-01", "2025-12-31", "Two months free rent.")]
    df = spark.createDataFrame(rows, "team_id int, lease_id int, rent double, s string, e string, concessions string")
    df = df.withColumn("start_date", F.to_date("s")).withColumn("end_date", F.to_date("e")).withColumn("rent", F.col("rent").cast("decimal(18,2)"))
    got = {r.lease_id: r for r in concessions.effective_rents(concessions.with_items(df), "2025-02-15").collect()}
    assert (got[1].total_concession, got[1].net_effective_rent, got[1].current_rent) == (2400.0, 1000.0, 0.0)
    assert (got[2].total_concession, got[2].net_effective_rent, got[2].current_rent) == (1200.0, 900.0, 900.0)
    assert got[3].total_concession is None and got[3].net_effective_rent is None
    assert [r.lease_id for r in concessions.ending_soon(concessions.with_items(df), "2025-02-15").where("lease_id = 1").collect()] == [1]


def admitted(times, most, seconds):
    held, out = [], []
    for t in times:
        held = [h for h in held if h > t - seconds]
        out.append(len(held) < most)
        held += [t] if out[-1] else []
    return out


def test_admissions_batch_and_stream(spark, tmp_path):
    times = [0, 1, 2, 30, 61, 62, 63, 64, 200]
    pdf = pd.DataFrame({"user_id": [u for u in (1, 2) for _ in times], "event_id": range(2 * len(times)), "ts": [pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=t * u) for u in (1, 2) for t in times]})
    df = spark.createDataFrame(pdf, "user_id long, event_id long, ts timestamp")
    want = {k: v for u, off in ((1, 0), (2, len(times))) for k, v in zip(range(off, off + len(times)), admitted([t * u for t in times], 2, 60))}
    assert {r.event_id: r.admitted for r in limits.admissions(df, 2, 60).collect()} == want
    for i in range(3):  # three batches in time order
        df.where((F.col("event_id") % len(times)).between(i * 3, i * 3 + 2)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
        q = limits.admissions_stream(stream, 2, 60).writeStream.outputMode("append").format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert {r.event_id: r.admitted for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == want


def test_streams_equal_batches(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").coalesce(1)
    events.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    for name, make in (("fixed", lambda e: limits.fixed_window_counts(e, 3600)), ("monthly", limits.monthly_quota)):
        q = make(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, make(spark.read.parquet(f"file://{tmp_path}/in")).collect()))
    assert limits.sessions(events).agg(F.sum("events")).first()[0] == events.count()
    ups = spark.createDataFrame([("a",), ("a",), ("b",)], "content_hash string")
    assert limits.distinct_uploads(ups).count() == 2


def test_alert_lifecycle(spark, tmp_path):
    store = AlertStore(spark, f"file://{tmp_path}")

    def run(version, *keys):
        store.apply(spark.createDataFrame([(k, "t", "high") for k in keys], "natural_key string, alert_type string, severity string"), version)
        return {r.natural_key: (r.status, r.change) for r in store.snapshot(version).collect()}

    assert run(0, "a", "b") == {"a": ("active", "created"), "b": ("active", "created")}
    assert run(1, "a") == {"a": ("active", "refreshed"), "b": ("auto_resolved", "auto_resolved")}
    assert run(1, "a") == {"a": ("active", "refreshed"), "b": ("auto_resolved", "auto_resolved")}
    assert run(2, "b") == {"a": ("auto_resolved", "auto_resolved"), "b": ("active", "refreshed")}
    for version in (0, 9):  # a folder of another stream; a missing predecessor
        with pytest.raises(ValueError):
            run(version, "a")


def test_findings_keep_their_state(spark):
    old = spark.createDataFrame([("a", "low", 1.0, "resolved"), ("b", "low", 1.0, "open")], "natural_key string, severity string, impact double, status string").withColumn("first_detected_at", F.lit("2024-01-01").cast("timestamp")).withColumn("last_seen_at", F.col("first_detected_at"))
    new = spark.createDataFrame([("a", "high", 5.0), ("c", "high", None)], "natural_key string, severity string, impact double")
    got = state.upsert_findings(old, new, "2024-02-01")
    by = {r.natural_key: r for r in got.collect()}
    assert (by["a"].status, by["a"].severity, by["a"].first_detected_at.month, by["a"].last_seen_at.month) == ("resolved", "high", 1, 2)
    assert (by["b"].status, by["b"].last_seen_at.month) == ("open", 1) and by["c"].first_detected_at.month == 2
    again = state.upsert_findings(got, new, "2024-02-01")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    moved = state.repoint_keys(spark.createDataFrame([("f:5:x:0",), ("f:6:x:0",)], "natural_key string"), spark.createDataFrame([(5, 9)], "old_id long, new_id long"))
    assert {r.natural_key for r in moved.collect()} == {"f:9:x:0", "f:6:x:0"}
    log = spark.createDataFrame([(1, 1, "resolve", 1), (1, 2, "reopen", 2), (2, 3, "resolve", 1)], "finding_id int, event_id int, action string, at int")
    assert {r.finding_id: r.status for r in state.latest_resolution(log).collect()} == {1: "open", 2: "resolved"}


def test_operative_documents(spark):
    cols = "team_id int, lease_id int, unit_key string, tenant string, tenant_key string, rent_amount string, lease_start_date string, lease_end_date string, rent_escalation string, is_rent_roll boolean, rent decimal(18,2), s string, e string"
    from decimal import Decimal as D

    def doc(i, unit, tenant, rent, s, e):
        return (1, i, unit, tenant, tenant, str(rent), s, e, None, False, D(rent), s, e)

    rows = [
        doc(1, "a", "x", 100, "2000-01-01", "2001-01-01"),  # alone: stays though ended
        doc(2, "b", "x", 100, "2020-01-01", "2030-01-01"), doc(3, "b", "x", 100, "2020-01-01", "2030-01-01"),  # a copy
        doc(4, "c", "x", 100, "2020-01-01", "2030-01-01"), doc(5, "c", "x", 120, "2020-01-01", "2030-01-01"), doc(6, "c", "y", 9, "2010-01-01", "2011-01-01"),  # versions; an old one
        doc(7, "d", "x", 1, "2010-01-01", "2011-01-01"), doc(8, "d", "y", 2, "2012-01-01", None),  # none covers: latest start
        doc(9, "e", "x", 1, None, None), doc(10, "e", "y", 1, None, None),  # undated all stay
    ]
    df = spark.createDataFrame(rows, cols).withColumn("start_date", F.to_date("s")).withColumn("end_date", F.to_date("e"))
    got = {r.lease_id: [float(x) for x in r.other_rents] for r in reconcile.operative_documents(df, "2024-06-01").collect()}
    assert got == {1: [], 2: [], 5: [100.0], 8: [], 9: [], 10: []}


def test_date_conflicts_and_segments(spark):
    rows = spark.createDataFrame([(1, 1, "start", "2024-01-01"), (1, 1, "start", "January 1, 2024"), (1, 1, "end", "2025-01-01"), (1, 1, "end", "2026-01-01"), (1, 1, "end", "soon")], "team_id int, lease_id int, role string, value string")
    assert [r.field for r in risks.date_conflicts(rows).collect()] == ["lease_end_date"]
    starts = spark.createDataFrame([(1, 1, 9), (1, 4, 9)], "doc_id int, start_page int, pages int")
    assert sorted((r.start_page, r.end_page) for r in overlay.segments(starts).collect()) == [(1, 3), (4, 9)]


def test_values_match_and_merge(spark):
    rows = [("rent_amount", "$1,000.00", "$1,000.50", True), ("rent_amount", "$1,000", "$1,002", False), ("lease_start_date", "2024-01-01", "January 1, 2024", True), ("tenant", "ACME Inc.", "Acme", True), ("tenant", None, "Acme", False), ("tenant", None, None, True), ("rent_escalation", "3%", "3.0% annually", True)]
    df = spark.createDataFrame(rows, "f string, a string, b string, want boolean")
    assert df.where(extraction.values_match(F.col("f"), F.col("a"), F.col("b")) != F.col("want")).count() == 0
    values = spark.createDataFrame([(1, "rent", "$5.00", "medium", 2), (1, "rent", "5", "high", 3), (1, "x", "a", "high", 1), (1, "x", "b", "high", 2)], "doc_id int, field string, value string, confidence string, page int")
    got = {r.field: tuple(r)[2:] for r in extraction.merge_chunks(values).collect()}
    assert got == {"rent": ("5", "high", None), "x": ("a", "low", "a | b")}


def test_documents(spark):
    pages = spark.createDataFrame([(1, 1, "intro text only"), (1, 2, "the  Rent is due on the first day of each month without demand")], "doc_id int, page int, text string")
    quotes = spark.createDataFrame([(1, 1, "rent is due on the FIRST day"), (1, 2, "rent is due on the first and then something else"), (1, 3, "not there at all")], "doc_id int, quote_id int, quote string")
    assert {(r.quote_id, r.page, r["rank"]) for r in documents.locate_quotes(quotes, pages).collect()} == {(1, 2, 1), (2, 2, 3)}
    df = spark.createDataFrame([("$5 " * 40,), ("1/2/2024 " * 15,), ("text",)], "t string")
    assert [r[0] for r in df.select(documents.looks_like_rent_roll(F.col("t"))).collect()] == [True, True, False]


def test_households(spark):
    from parcelspark.operators import identity

    same = [("José Peña", "Jose Pena"), ("Smith, John", "John Smith"), ("J. Smith", "John Smith"), ("Ann Lee & Bo Ek", "Bo Ek"), ("Alexandra Montgomery", "Alexandra Montgomery-Wills"), ("Søren Kjær", "Soren Kjaer")]
    other = [("John Smith Jr", "John Smith"), ("John Smith", "Jane Smith"), ("Smith", "John Smith"), ("", "x"), (None, "x"), ("Ann Lee & Bo Ek", "Ann Lee & Cy Po")]
    df = spark.createDataFrame([(a, b, True) for a, b in same] + [(a, b, False) for a, b in other], "a string, b string, want boolean")
    for x, y in ("ab", "ba"):
        assert df.where(identity.same_household(F.col(x), F.col(y)) != F.col("want")).count() == 0
    assert "Python" not in df.select(identity.same_household(F.col("a"), F.col("b")))._jdf.queryExecution().toString()


def test_lookups(spark):
    from parcelspark.operators import identity

    leases = spark.createDataFrame([(1, 1, "a", "p", "f1"), (1, 2, "a", "q", "f2"), (1, 3, "a", "q", "f3")], "team_id int, lease_id int, tenant_key string, building_key string, filename string")
    ups = spark.createDataFrame([(1, 10, "a", "p"), (1, 11, "a", "q"), (1, 12, "z", "q")], "team_id int, upload_id int, tenant_key string, building_key string")
    assert [tuple(r) for r in identity.resubmissions(ups, leases).collect()] == [(10, 1)]
    tags = spark.createDataFrame([(1, "x"), (1, "x"), (1, "b"), (2, "x")], "lease_id int, tag string")
    assert {r.lease_id: r.tags for r in identity.with_tags(leases, tags).collect()} == {1: ["b", "x"], 2: ["x"], 3: []}
    assert identity.tagged(leases, tags, "x").count() == 2
    found = spark.createDataFrame([(1, 1, None, None), (2, 9, None, None), (3, None, "a", None), (4, None, "n", None), (5, None, None, "q"), (6, None, None, None)], "finding_id int, lease_id int, tenant_key string, building_key string")
    assert sorted(r.finding_id for r in identity.still_relevant(found, leases).collect()) == [1, 3, 5]
    finds = spark.createDataFrame([(i, "c", None) for i in range(4)], "finding_id int, category string, field string")
    res = spark.createDataFrame([(i, i % 4, i) for i in range(12)], "resolution_id int, finding_id int, at int")
    got = identity.recent_resolutions(finds, res, 2).where("finding_id = 3").orderBy("nth").collect()
    assert [r.resolution_id for r in got] == [10, 9]
    comments = spark.createDataFrame([(i, i, 1, 2) for i in range(5)], "comment_id int, at int, lease_id int, finding_id int")
    assert identity.recent_comments(comments, leases, finds, 3).count() == 3
    old = spark.createDataFrame([(1, "t", "k", "ann", "n", "done")], "team_id int, item_type string, item_key string, assignee string, note string, status string")
    new = spark.createDataFrame([(1, "t", "k", "bo", None), (1, "t", "m", "cy", "x")], "team_id int, item_type string, item_key string, assignee string, note string")
    assert sorted(tuple(r)[2:] for r in identity.assign(old, new).collect()) == [("k", "bo", None, "assigned"), ("m", "cy", "x", "assigned")]
    sums = spark.createDataFrame([("b", "f", 1, 1, 5, 9), ("b", "f", 2, 2, 6, 9), ("b", "g", 1, 3, 1, 1)], "building_key string, file string, at int, summary_id int, occupied int, total int")
    assert tuple(identity.latest_unit_counts(sums).first()) == ("b", 7, 10)


def test_questions(spark):
    from parcelspark.operators import questions

    df = spark.createDataFrame([(1, "Acme Inc", 100.0, "1999-03-01"), (2, "Bo", 300.0, "2000-06-01"), (3, "Acme West", None, None)], "lease_id int, tenant string, rent double, e string").withColumn("end_date", F.to_date("e")).withColumn("start_date", F.lit(None).cast("date")).withColumn("deposit", F.lit(1.0)).withColumn("cam", F.lit(1.0)).withColumn("sqft", F.lit(1.0))
    texts = ["How many leases are there?", "How many leases expire in the next 2 months?", "Which leases expire in the next 18 months?", "What is the average rent?", "What is the rent for Acme?", "Tell me a story", None]
    asked = spark.createDataFrame(list(enumerate(texts)), "question_id int, question string")
    got = {r.question_id: (r.kind, r.value, r.leases) for r in questions.answers(asked, df, "1999-01-31").collect()}
    assert got[0] == ("count", 3.0, None) and got[1] == ("count", 1.0, None) and got[3] == ("aggregate", 200.0, 2)
    assert got[5] == got[6] == ("unsupported", None, None) and got[2][0] == "list" and got[4][0] == "lookup"
    assert sorted(r.lease_id for r in questions.listed(asked, df, "1999-01-31").collect()) == [1, 2]
    assert sorted((r.lease_id, r.value) for r in questions.looked_up(asked, df, "1999-01-31").collect()) == [(1, "100.0"), (3, None)]
    spans = spark.createDataFrame([("next one month",), ("within 10 days",), ("in 2027",), ("this year",), ("soon",)], "q string").select(questions.timeframe(F.col("q"), "1999-01-31").alias("t")).select("t.*")
    assert [(str(r["first"]), str(r["last"])) for r in spans.collect()] == [("1999-01-31", "1999-02-28"), ("1999-01-31", "1999-02-10"), ("2027-01-01", "2027-12-31"), ("1999-01-31", "1999-12-31"), ("None", "None")]


def test_lease_text(spark):
    from parcelspark.operators import lease_text

    one = "LEASE\nLandlord: Elm Holdings LLC\nTenant: Acme Foods, Inc.\nMonthly Rent: $4,500.00. Security Deposit of $9,000.\nCommencement Date: March 1, 2024. Expiration Date: February 28, 2029. Containing 2,400 square feet. Rent rises 3% annually."
    pages = spark.createDataFrame([(1, 1, one), (1, 2, "The rent shall be paid: rent of $1 per month. Tenant: Other Corp\n It expires on March 1, 2030."), (2, 1, None)], "doc_id long, page int, text string")
    got = {r.field: (r.value, r.confidence, r.page) for r in lease_text.extract(pages).where("doc_id = 1").collect()}
    assert got["tenant"] == ("Acme Foods, Inc", "high", 1) and got["rent_amount"] == ("$4,500.00", "high", 1) and got["lease_end_date"] == ("February 28, 2029", "high", 1)
    assert got["square_footage"][0] == "2,400" and got["rent_escalation"][0] == "3% annually" and got["landlord"][0] == "Elm Holdings LLC"
    assert [(r.field, r.start_pages) for r in lease_text.several_leases(pages).collect()] == [("tenant", [1, 2])]
    roles = lease_text.date_candidates(pages).withColumn("team_id", F.lit(1)).withColumn("lease_id", F.col("doc_id"))
    assert [r.field for r in risks.date_conflicts(roles).collect()] == ["lease_end_date"]
    sized = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([5, 5, 5, 20, 1])], "doc_id long, page int, text string")
    assert [r.chunk for r in lease_text.page_chunks(sized, 2, 12).orderBy("page").collect()] == [0, 0, 1, 2, 3]


def test_sinks(spark, small, tmp_path):
    from parcelspark.plans.project import leases
    from parcelspark.sources import sinks

    rows = leases(spark, small)
    sinks.write_csv(sinks.rent_roll(rows, "1999-01-01").limit(50), f"file://{tmp_path}/roll")
    back = spark.read.option("header", True).csv(f"file://{tmp_path}/roll")
    assert back.count() == 50 and back.columns == list(sinks.RENT_ROLL)
    log = spark.createDataFrame([(1,)], "id int").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    sinks.append_log(log, f"file://{tmp_path}/log")
    sinks.append_log(log, f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 2
