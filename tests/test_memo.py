"""Memo figures by property and portfolio."""

from pyspark.sql import functions as F

from parcelspark.operators import memo


def test_memo(spark):
    cols = "team_id int, building_key string, unit_key string, lease_id long, is_rent_roll boolean, rent double, sqft double, e string"
    rows = [(1, "b", "u1", 1, False, 100.0, 10.0, "2025-06-01"), (1, "b", "u1", 2, True, 999.0, 10.0, "2025-06-01"), (1, "c", "u2", 3, True, None, None, None), (1, None, None, 4, True, 50.0, None, "2020-01-01"), (2, "d", "u3", 5, True, None, None, None)]
    df = spark.createDataFrame(rows, cols).withColumns({"end_date": F.to_date("e"), "rent": F.col("rent").cast("decimal(18,2)"), "psf": F.col("rent") / F.col("sqft"), "uploaded_at": F.lit("2024-01-01").cast("date")})
    df = df.withColumns({"cam": F.col("rent"), "deposit": F.col("rent"), "escalation_pct": F.lit(1.0), "notice_days": F.lit(1)})
    findings = spark.createDataFrame([(1, "b", "open", "high"), (1, "b", "resolved", "low"), (1, None, "open", "low")], "team_id int, building_key string, status string, severity string")
    got = {r.scope: r for r in memo.deal_memo(df, findings, "2025-01-01").collect()}
    assert set(got) == {"1|", "1|b", "1|c", "2|", "2|d"}
    assert (got["1|b"].record_count, got["1|b"].lease_count, got["1|b"].total_monthly_rent, got["1|b"].walt_years) == (2, 1, 100.0, 0.41)
    assert (got["1|"].record_count, got["1|"].lease_count, got["1|"].total_monthly_rent, got["1|"].rollover["expired"], got["1|"].year_1_pct) == (4, 3, 150.0, 50.0, 100.0)
    assert (got["1|"].open_findings, got["1|"].resolved_findings, got["1|b"].open_high, got["1|c"].open_findings) == (2, 1, 1, 0)
    assert got["2|d"].total_monthly_rent is None and got["2|d"].rollover is None
