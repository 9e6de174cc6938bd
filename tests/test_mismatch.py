"""The mismatch report: every detector on one join, households, and rents that concessions explain."""

import datetime

import pytest
from pyspark.sql import functions as F

from parcelspark.functions import keys
from parcelspark.operators import concessions, reconcile

DAY = "2025-06-15"
SCHEMA = "team_id int, lease_id long, is_rent_roll boolean, unit_key string, building_key string, tenant string, rent double, start_date date, end_date date, rent_escalation string, concessions string, roll_concession double"


def d(text):
    return datetime.date.fromisoformat(text) if text else None


def typed(spark, rows):
    """Leases of ``(id, roll?, unit, tenant, rent, start, end, clause, roll concession)``."""
    data = [(1, i, roll, unit, "b1", tenant, rent, d(a), d(b), None, clause, shown) for i, roll, unit, tenant, rent, a, b, clause, shown in rows]
    df = spark.createDataFrame(data, SCHEMA).withColumns({"tenant_key": keys.name_key("tenant"), "rent": F.col("rent").cast("decimal(18,2)"), "schedule": F.array().cast("array<struct<year:int,amount:double>>")})
    text = {"rent_amount": F.col("rent").cast("string"), "lease_start_date": F.col("start_date").cast("string"), "lease_end_date": F.col("end_date").cast("string")}
    return concessions.with_items(df.withColumns(text))


TERM = ("2025-01-01", "2025-12-31")
ROWS = [
    # one household in several spellings; the discount that runs now explains the rent
    (1, True, "u1", "Smith, John", 900.0, *TERM, None, None), (2, False, "u1", "JOHN Q. SMITH", 1000.0, *TERM, "Monthly rent credit of $100.00 for the first 8 months.", None),
    # another household; the rent is off by more than a concession
    (3, True, "u2", "Ann Lee", 800.0, *TERM, None, 0.0), (4, False, "u2", "Bob Ray", 1000.0, "2025-01-02", "2025-12-31", None, None),
    # a stated concession nobody can read
    (5, True, "u3", "Ann Lee", 1000.0, *TERM, None, None), (6, False, "u3", "Ann Lee", 1000.0, *TERM, "Concessions as agreed.", None),
    # a full rent beside one month free; the roll of u5 books another amount
    (7, True, "u4", "Ann Lee", 1200.0, *TERM, None, None), (8, False, "u4", "Ann Lee", 1200.0, *TERM, "One month free.", None),
    (9, True, "u5", "Ann Lee", 1200.0, *TERM, None, 40.0), (10, False, "u5", "Ann Lee", 1200.0, *TERM, "One month free.", None),
    # alone on either side, ended, and without any unit
    (11, True, "u6", "Ann Lee", 500.0, *TERM, None, None), (12, False, "u7", "Ann Lee", None, *TERM, None, None), (13, True, "u8", "Ann Lee", 700.0, *TERM, None, None), (14, False, "u8", "Ann Lee", 700.0, "2024-01-01", "2024-12-31", None, None),
    (15, True, None, None, None, None, None, None, None), (16, False, "u9", None, 100.0, None, None, None, None), (17, True, "u9", None, 100.0, None, None, None, None),
]


@pytest.fixture(scope="module")
def found(spark):
    return reconcile.findings(typed(spark, ROWS), DAY).collect()


def kinds(found, unit):
    return sorted((r.discrepancy_type, r.field) for r in found if r.unit_key == unit)


def test_every_detector(found):
    assert kinds(found, "u1") == [("concession_expiring", "concessions")]
    assert kinds(found, "u2") == [("dates_mismatch", "lease_start_date"), ("rent_mismatch", "rent_amount"), ("tenant_mismatch", "tenant")]
    assert kinds(found, "u3") == [("concession_missing", "concessions")]
    assert kinds(found, "u4") == [("concession_missing", "concessions")]
    assert kinds(found, "u5") == [("concession_mismatch", "concessions")]
    assert kinds(found, "u6") == [("unit_no_lease", "presence")]
    assert kinds(found, "u7") == [("lease_no_unit", "presence")]
    assert kinds(found, "u8") == [("dates_mismatch", "lease_end_date"), ("dates_mismatch", "lease_start_date"), ("expired_but_occupied", "lease_end_date")]
    assert kinds(found, "u9") == [] and all(r.unit_key for r in found)


def test_impacts(found):
    by = {(r.unit_key, r.discrepancy_type): r for r in found}
    assert (by["u1", "concession_expiring"].monthly_impact, by["u1", "concession_expiring"].annual_impact) == (100.0, 400.0)
    assert (by["u2", "rent_mismatch"].monthly_impact, by["u2", "rent_mismatch"].income_direction, by["u2", "rent_mismatch"].severity) == (200.0, "understate", "low")
    unread = by["u3", "concession_missing"]
    assert (unread.monthly_impact, unread.annual_impact, unread.income_direction, unread.severity) == (None, None, "overstate", "medium")
    assert (by["u4", "concession_missing"].monthly_impact, by["u4", "concession_missing"].annual_impact) == (100.0, 1200.0)
    assert (by["u5", "concession_mismatch"].monthly_impact, by["u5", "concession_mismatch"].income_direction) == (60.0, "overstate")
    assert by["u6", "unit_no_lease"].income_direction is None and by["u6", "unit_no_lease"].annual_impact == 6000.0
    assert by["u7", "lease_no_unit"].monthly_impact is None and by["u7", "lease_no_unit"].severity == "medium"


def test_reconciliation_knows_households_and_concessions(spark):
    got = sorted((r.unit_key, r.field) for r in reconcile.roll_mismatches(typed(spark, ROWS), DAY).collect())
    assert got == [("u2", "rent_amount"), ("u2", "tenant"), ("u8", "lease_end_date")]


def test_effective_rents_agree_with_the_grouped_form(spark):
    leases = typed(spark, ROWS).where("size(items) > 0")
    grouped = {r.lease_id: r for r in concessions.effective_rents(leases, DAY).collect()}
    for r in leases.select("lease_id", concessions.effective(DAY).alias("x")).collect():
        g = grouped[r.lease_id]
        assert (r.x["items"], r.x.base, r.x.net, r.x.current, r.x.monthly, r.x.yearly) == (g["items"], g.base_rent, g.net_effective_rent, g.current_rent, g.monthly_value, g.annualized_value)


def test_nine_detectors_cost_one_join(spark):
    plan = reconcile.findings(typed(spark, ROWS), DAY)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_statement_detectors(spark):
    rows = [(1, True, "u1", "Ann Lee", 1000.0, *TERM, None, None), (2, True, "u2", "Bob Ray", 1000.0, *TERM, None, None)]
    statement = "team_id int, building_key string, rental_income double, gross_potential double, vacancy_loss double, concessions double"
    debts = "team_id int, building_key string, month_idx int, amount double"
    rising = spark.createDataFrame([(1, "b1", m, -10.0 if m < 10 else -30.0) for m in range(1, 13)], debts)
    full = spark.createDataFrame([(1, "b1", 20000.0, 24000.0, -2400.0, -500.0)], statement)
    got = {r.discrepancy_type: r for r in reconcile.statement_findings(typed(spark, rows), full, rising).collect()}
    assert set(got) == {"t12_income_gap", "t12_occupancy_mismatch", "t12_concession_gap", "t12_bad_debt_trend"}
    assert (got["t12_income_gap"].annual_impact, got["t12_income_gap"].unit_key) == (4000.0, "b1")
    quiet = spark.createDataFrame([(1, "b1", 24000.0, 24000.0, 0.0, None), (2, "b2", None, None, None, 1.0)], statement)
    assert reconcile.statement_findings(typed(spark, rows), quiet, rising.where("month_idx < 12")).collect() == []
    vacant = [*rows, (3, True, "u3", None, 1000.0, *TERM, None, None)]
    assert "t12_bad_debt_trend" not in {r.discrepancy_type for r in reconcile.statement_findings(typed(spark, vacant), full, rising).collect()}
    whole = reconcile.report(typed(spark, rows), DAY, full, rising)
    assert {r.discrepancy_type for r in whole.collect()} == {*got, "unit_no_lease"}


def test_a_report_rates_rents_by_whole_cents(spark):
    """1250.07 less 1000.07 is a hair under 250 in doubles; the report shows 250.00 and rates that."""
    rows = typed(spark, [(1, True, "u1", "Ann Lee", 1250.07, *TERM, None, None), (2, False, "u1", "Ann Lee", 1000.07, *TERM, None, None)])
    assert [(r.monthly_impact, r.severity) for r in reconcile.report(rows, DAY).collect()] == [(250.0, "medium")]
