"""Risk flags, cross-lease comparisons and dated obligations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions import parse
from parcelspark.operators.portfolio import day, with_team_means

EXPECTED = ("insurance_requirements", "default_cure_period", "security_deposit")
SEVERITIES = ("high", "medium", "low")


def severity_order(c: str = "severity") -> Column:
    """Sort key: high, medium, low, then anything else."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(c)), F.lit(0)), F.lit(99))


def lease_flags(leases: DataFrame) -> DataFrame:
    """``team_id, lease_id, check_no, severity, category, field`` of one-lease checks.

    One pass: every check is an element of an array that is exploded, so nine
    checks cost one scan.  ``check_no`` keeps the order of the checks.
    """
    rows = with_team_means(leases, "avg_rent_per_sqft", "avg_monthly_rent", "avg_notice_days")
    rent, psf = F.col("rent").cast("double"), F.col("psf")
    avg_psf, avg_rent, avg_notice = F.col("avg_rent_per_sqft"), F.col("avg_monthly_rent"), F.col("avg_notice_days")
    below = F.when((avg_psf > 0) & psf.isNotNull(), (avg_psf - psf) / avg_psf * 100).when((avg_rent > 0) & rent.isNotNull(), (avg_rent - rent) / avg_rent * 100)
    notice = F.col("notice_days")
    years = F.when(F.col("end_date") > F.col("start_date"), F.datediff("end_date", "start_date") / 365.25)
    spread = parse.rate_spread(F.col("schedule"))

    def flag(no, when, severity, category, field):
        s = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(when, F.struct(F.lit(no).alias("check_no"), s.alias("severity"), F.lit(category).alias("category"), F.lit(field).alias("field")))

    checks = [
        flag(1, below >= 10, F.when(below >= 25, "high").otherwise("medium"), "below_market_rent", "rent_amount"),
        *[flag(2 + i, F.col(f).isNull(), "medium", "missing_clause", f) for i, f in enumerate(EXPECTED)],
        flag(5, (notice < 30) | (notice > 270), F.when(notice < 30, "medium").otherwise("low"), "notice_period_outlier", "renewal_options"),
        flag(6, (avg_notice > 0) & (F.abs(notice - avg_notice) / avg_notice * 100 > 50), "low", "notice_period_outlier", "renewal_options"),
        flag(7, F.col("rent_escalation").isNull() & (years > 2), "medium", "one_sided_terms", "rent_escalation"),
        flag(8, F.col("cure_days") > 30, "medium", "one_sided_terms", "default_cure_period"),
        flag(9, spread > 2, F.when(spread > 5, "high").otherwise("medium"), "escalation_inconsistency", "rent_escalation"),
        flag(10, F.col("end_date") <= F.col("start_date"), "high", "date_inconsistency", "lease_end_date"),
    ]
    return rows.select("team_id", "lease_id", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("x")).select("team_id", "lease_id", "x.*")


def date_conflicts(candidates: DataFrame) -> DataFrame:
    """Roles (start, end) for which a document states two or more dates.

    ``candidates``: team_id, lease_id, role, value; values that are no dates are left out.
    """
    parsed = candidates.withColumn("d", parse.date("value")).where("d IS NOT NULL").select("team_id", "lease_id", "role", "d").distinct()
    return (
        parsed.groupBy("team_id", "lease_id", "role").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("d").cast("string"))), ", ").alias("dates"))
        .where("n >= 2").select("team_id", "lease_id", F.lit("high").alias("severity"), F.lit("date_inconsistency").alias("category"), F.concat(F.lit("lease_"), "role", F.lit("_date")).alias("field"), "dates")
    )


def cross_lease(leases: DataFrame) -> DataFrame:
    """Leases of one unit that disagree on rent per square foot or area, seen from both sides.

    A self join on the unit, each pair once (smaller id first).
    """
    side = leases.where("unit_key IS NOT NULL").select("team_id", "unit_key", "lease_id", "psf", "sqft")
    a, b = (side.select("team_id", "unit_key", *[F.col(c).alias(f"{c}_{s}") for c in ("lease_id", "psf", "sqft")]) for s in "ab")
    pairs = a.join(b, ["team_id", "unit_key"]).where("lease_id_a < lease_id_b")

    def apart(c):
        x, y = F.col(f"{c}_a"), F.col(f"{c}_b")
        return F.when((x != 0) & (y != 0), F.abs(x - y) / F.greatest(x, y) * 100)

    def graded(field, diff, high, medium):
        return F.struct(F.lit(field).alias("field"), diff.alias("diff"), F.when(diff >= high, "high").when(diff >= medium, "medium").alias("severity"))

    found = pairs.withColumn("x", F.explode(F.array(graded("rent_amount", apart("psf"), 25, 10), graded("square_footage", apart("sqft"), 15, 5)))).where("x.severity IS NOT NULL")
    both = found.withColumn("v", F.explode(F.array(F.struct(F.col("lease_id_a").alias("lease_id"), F.col("lease_id_b").alias("other_id")), F.struct(F.col("lease_id_b").alias("lease_id"), F.col("lease_id_a").alias("other_id")))))
    return both.select("team_id", "v.lease_id", "v.other_id", "x.field", "x.severity", F.round("x.diff", 1).alias("diff_pct"))


def all_flags(leases: DataFrame) -> DataFrame:
    """One-lease and cross-lease flags together."""
    crossed = cross_lease(leases).select("team_id", "lease_id", F.lit(99).alias("check_no"), "severity", F.lit("cross_lease_mismatch").alias("category"), "field")
    return lease_flags(leases).unionByName(crossed)


def obligations(leases: DataFrame, as_of: str, years_ahead: int = 40) -> DataFrame:
    """Dated duties of each lease (R13, O7): renewal and termination notices, escalations, insurance.

    Yearly escalations are generated from a sequence and end with the term, or
    five years from ``as_of`` without one.
    """
    today = day(as_of)
    one = F.col("lease_id").isNotNull()

    def entry(kind, due, past="overdue"):
        return F.struct(F.lit(kind).alias("obligation_type"), due.alias("due_date"), F.lit(past).alias("past"))

    renewal = F.when(F.col("notice_days").isNotNull() & F.col("end_date").isNotNull(), F.array(entry("renewal_notice_deadline", F.date_sub("end_date", F.col("notice_days")))))
    effective = F.date_sub(F.add_months("start_date", F.col("termination_year") * 12), 1)
    termination = F.when(effective.isNotNull() & F.col("termination_notice_days").isNotNull(), F.array(entry("termination_notice_deadline", F.date_sub(effective, F.col("termination_notice_days")))))
    steps = F.transform(F.filter("schedule", lambda s: s["year"] > 1), lambda s: entry("rent_escalation", F.add_months("start_date", (s["year"] - 1) * 12), "already_in_effect"))
    horizon = F.coalesce("end_date", F.add_months(today, 60))
    yearly = F.filter(
        F.transform(F.sequence(F.lit(1), F.lit(years_ahead)), lambda i: entry("rent_escalation", F.add_months("start_date", i * 12), "already_in_effect")), lambda e: e["due_date"] <= horizon
    )
    is_yearly = parse.percent("rent_escalation").isNotNull() & F.lower("rent_escalation").rlike("annual|anniversary")
    escalation = F.when(F.col("start_date").isNotNull(), F.when(F.size("schedule") > 0, steps).when(is_yearly, yearly))
    insurance = F.when(F.col("insurance_requirements").isNotNull(), F.array(entry("insurance_certificate", F.lit(None).cast("date"))))
    none = F.array().cast("array<struct<obligation_type:string,due_date:date,past:string>>")
    every = F.concat(*[F.coalesce(x, none) for x in (renewal, termination, escalation, insurance)])
    rows = leases.where(one).select("team_id", "lease_id", F.explode(every).alias("x")).select("team_id", "lease_id", "x.*")
    left = F.datediff("due_date", today)
    status = F.when(left.isNull(), "not_date_computable").when(left < 0, F.col("past")).otherwise("upcoming")
    return rows.select("team_id", "lease_id", "obligation_type", "due_date", left.alias("days_remaining"), status.alias("status"))


def action_items(obligations_: DataFrame, alerts: DataFrame, tasks: DataFrame) -> DataFrame:
    """One dated list of three sources, earliest first."""
    parts = [obligations_.select("team_id", "lease_id", F.col("obligation_type").alias("item"), "due_date"), alerts.select("team_id", "lease_id", F.col("kind").alias("item"), "due_date"), tasks.select("team_id", "lease_id", F.col("title").alias("item"), "due_date")]
    return reduce(DataFrame.unionByName, parts).where("due_date IS NOT NULL")
