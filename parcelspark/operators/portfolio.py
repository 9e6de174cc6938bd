"""Portfolio totals, concentration, rollover, timelines and comparisons.

Inputs are typed leases (see ``plans.project.typed_leases``).  An aggregate
covers only rows whose value parsed; with none it is NULL, never 0.  ``as_of``
is always a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.plans.project import CORE_FIELDS, FIELDS

DAYS_PER_MONTH = 30.4375
DAYS_PER_YEAR = 365.25
BUCKETS = ("year_1", "year_2", "year_3", "year_4", "year_5", "year_6_plus")


def total(c: str) -> Column:
    return F.round(F.sum(c).cast("double"), 2)


def mean(c: str, digits: int = 2) -> Column:
    return F.round(F.try_divide(F.sum(c).cast("double"), F.count(c)), digits)


def day(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def days_left(as_of: str) -> Column:
    return F.datediff("end_date", day(as_of))


def metrics(leases: DataFrame) -> DataFrame:
    """Headline totals and means of each team (A1, A2, A3, P20 on any subset)."""
    return leases.groupBy("team_id").agg(
        F.count("*").alias("lease_count"),
        total("rent").alias("total_monthly_rent"),
        mean("rent").alias("avg_monthly_rent"),
        F.round(F.avg("psf"), 2).alias("avg_rent_per_sqft"),
        total("cam").alias("total_cam_exposure"),
        mean("cam").alias("avg_cam"),
        mean("deposit").alias("avg_security_deposit"),
        F.round(F.avg("escalation_pct"), 2).alias("avg_escalation_pct"),
        F.round(F.avg("notice_days"), 2).alias("avg_notice_days"),
        F.round(F.sum("sqft"), 2).alias("total_square_footage"),
    )


def present(field: str) -> Column:
    """A field counts as found if it is not blank."""
    return F.nullif(F.trim(F.col(field)), F.lit("")).isNotNull()


def missing_fields(leases: DataFrame) -> DataFrame:
    """``team_id, field, n_missing`` for the whole vocabulary, in one pass."""
    counts = leases.groupBy("team_id").agg(*[F.count(F.when(~present(f), 1)).alias(f) for f in FIELDS])
    return counts.unpivot("team_id", list(FIELDS), "field", "n_missing")


def confidence_by_lease(fields: DataFrame) -> DataFrame:
    """Tier counts of each lease from ``team_id, lease_id, field, confidence, validation_note`` (A4)."""

    def tier(name):
        return F.count(F.when(F.col("confidence") == name, 1))

    return (
        fields.groupBy("team_id", "lease_id")
        .agg(
            F.count("*").alias("total_fields"),
            *[tier(t).alias(t) for t in ("high", "medium", "low")],
            F.count(F.when(~F.coalesce(F.col("confidence").isin("high", "medium", "low"), F.lit(False)), 1)).alias("not_found"),
            F.count("validation_note").alias("flagged_for_review"),
        )
    )


def confidence(fields: DataFrame) -> DataFrame:
    """Tier counts of each team, summed over leases (A5)."""
    names = ("total_fields", "high", "medium", "low", "not_found", "flagged_for_review")
    out = confidence_by_lease(fields).groupBy("team_id").agg(F.count("*").alias("lease_count"), *[F.sum(n).alias(n) for n in names])
    return out.withColumn("high_confidence_pct", F.round(F.try_divide(F.col("high") * 100.0, F.col("total_fields")), 1))


def tenant_shares(leases: DataFrame) -> DataFrame:
    """Rent share of each tenant, largest first (A6); the first-seen spelling is shown."""
    valid = leases.where("tenant_key IS NOT NULL AND rent >= 0")
    # Partial sums per tenant come first, so a tenant with most of the rows is no hot spot.
    by_tenant = valid.groupBy("team_id", "tenant_key").agg(F.sum("rent").alias("rent_sum"), F.min_by("tenant", F.struct("uploaded_at", "lease_id")).alias("tenant"))
    whole = by_tenant.groupBy("team_id").agg(F.sum("rent_sum").alias("team_rent")).where("team_rent > 0")
    pct = F.col("rent_sum").cast("double") / F.col("team_rent").cast("double") * 100
    return by_tenant.join(whole, "team_id").select("team_id", "tenant", "tenant_key", "rent_sum", "team_rent", pct.alias("pct"))


#: Parts into which a team's tenants are dealt before they are ranked.
DEALT = 64


def concentration(leases: DataFrame) -> DataFrame:
    """Tenant count, cumulative shares of the largest 1, 3 and 5, and the Herfindahl index.

    A team's tenants are ranked in ``DEALT`` parts by their keys; each hands on its
    five largest and its sums, so no task ranks a whole team.
    """
    part = F.pmod(F.xxhash64("tenant_key"), F.lit(DEALT))
    order = Window.partitionBy("team_id", "part").orderBy(F.desc("rent_sum"), "tenant_key")
    ranked = tenant_shares(leases).withColumn("part", part).withColumn("place", F.row_number().over(order))
    large = F.when(F.col("place") <= 5, F.struct((-F.col("rent_sum")).alias("o"), "tenant_key", "pct"))
    parts = ranked.groupBy("team_id", "part").agg(F.count("*").alias("n"), F.first("team_rent").alias("team_rent"), F.sum(F.col("pct") * F.col("pct")).alias("squares"), F.collect_list(large).alias("large"))
    teams = parts.groupBy("team_id").agg(F.sum("n").alias("n"), F.first("team_rent").alias("team_rent"), F.sum("squares").alias("squares"), F.slice(F.array_sort(F.flatten(F.collect_list("large"))), 1, 5).alias("large"))

    def top(n):
        return F.round(F.aggregate(F.slice("large", 1, n), F.lit(0.0), lambda acc, x: acc + x["pct"]), 2)

    out = teams.select(
        "team_id",
        F.col("n").alias("tenant_count"),
        F.round(F.col("team_rent").cast("double"), 2).alias("total_rent"),
        top(1).alias("top_1_pct"),
        top(3).alias("top_3_pct"),
        top(5).alias("top_5_pct"),
        F.round("squares", 1).alias("hhi"),
    )
    level = F.when((F.col("hhi") >= 2500) | (F.col("top_1_pct") >= 25), "high").when((F.col("hhi") >= 1500) | (F.col("top_1_pct") >= 15), "moderate").otherwise("low")
    return out.withColumn("concentration_level", level)


def walt(leases: DataFrame, as_of: str) -> DataFrame:
    """Rent-weighted remaining term in years over unexpired, rent-paying leases."""
    valid = (F.col("rent") > 0) & (days_left(as_of) >= 0)
    weight = F.when(valid, days_left(as_of).cast("decimal(18,0)") * F.col("rent"))
    rent = F.when(valid, F.col("rent"))
    return leases.groupBy("team_id").agg(
        F.round(F.try_divide(F.sum(weight).cast("double"), F.sum(rent).cast("double")) / DAYS_PER_YEAR, 2).alias("walt_years"),
        F.count(rent).alias("lease_count"),
        (F.count("*") - F.count(rent)).alias("excluded_lease_count"),
        F.round(F.sum(rent).cast("double"), 2).alias("total_weighted_rent"),
    )


def rollover(leases: DataFrame, as_of: str) -> DataFrame:
    """Six year buckets and the expired, every bucket present for every team."""
    valid = leases.where("rent > 0 AND end_date IS NOT NULL").select("team_id", "rent", days_left(as_of).alias("left"))
    bucket = F.when(F.col("left") < 0, "expired").otherwise(F.array(*map(F.lit, BUCKETS))[F.least(F.floor(F.col("left") / DAYS_PER_YEAR), F.lit(5)).cast("int")])
    sums = valid.groupBy("team_id", bucket.alias("bucket")).agg(F.sum("rent").alias("rent_sum"), F.count("*").alias("n"))
    dense = sums.select("team_id").distinct().withColumn("bucket", F.explode(F.array(*map(F.lit, (*BUCKETS, "expired")))))
    filled = dense.join(sums, ["team_id", "bucket"], "left").fillna(0, ["n"]).withColumn("rent_sum", F.coalesce("rent_sum", F.lit(0).cast("decimal(28,2)")))
    alive = F.col("bucket") != "expired"
    team = Window.partitionBy("team_id")
    rent, n = (F.sum(F.when(alive, F.col(c))).over(team) for c in ("rent_sum", "n"))
    return filled.select(
        "team_id",
        "bucket",
        F.round(F.col("rent_sum").cast("double"), 2).alias("rent"),
        F.col("n").alias("lease_count"),
        F.when(alive, F.round(F.coalesce(F.try_divide(F.col("rent_sum").cast("double"), rent.cast("double")), F.lit(0.0)) * 100, 2)).alias("pct_of_total_rent"),
        F.when(alive, F.round(F.coalesce(F.try_divide(F.col("n").cast("double"), n.cast("double")), F.lit(0.0)) * 100, 2)).alias("pct_of_total_leases"),
    )


def rollover_risk(leases: DataFrame, as_of: str) -> DataFrame:
    """Risk level by the share of rent that ends within a year; 'high' if all has expired."""
    year_1 = rollover(leases, as_of).groupBy("team_id").agg(
        F.max(F.when(F.col("bucket") == "year_1", F.col("pct_of_total_rent"))).alias("year_1_pct"),
        F.sum(F.when(F.col("bucket") != "expired", F.col("lease_count"))).alias("lease_count"),
    )
    level = F.when((F.col("lease_count") == 0) | (F.col("year_1_pct") >= 25), "high").when(F.col("year_1_pct") >= 15, "moderate").otherwise("low")
    return year_1.withColumn("rollover_risk_level", level)


def timeline(leases: DataFrame, as_of: str) -> DataFrame:
    """Expiration bucket of each lease, on months rounded to one decimal."""
    months = F.round(days_left(as_of) / DAYS_PER_MONTH, 1)
    bucket = (
        F.when(months.isNull(), "unknown_expiration").when(months < 0, "already_expired").when(months < 6, "expiring_0_6_months")
        .when(months < 12, "expiring_6_12_months").when(months < 24, "expiring_12_24_months").otherwise("expiring_24_plus_months")
    )
    return leases.select("team_id", "lease_id", "filename", "tenant", months.alias("months_remaining"), bucket.alias("bucket"))


def days_bucket(left: Column) -> Column:
    return F.when(left <= 30, "30").when(left <= 60, "60").otherwise("90")


def expiration_alerts(leases: DataFrame, as_of: str, within: int = 90) -> DataFrame:
    """Leases that end, or whose renewal notice falls due, within ``within`` days."""
    left = days_left(as_of)
    alive = leases.where(left >= 0)
    ending = alive.where(left <= within).select("team_id", "lease_id", F.lit("expiring").alias("kind"), F.col("end_date").alias("due_date"), left.alias("days_remaining"), days_bucket(left).alias("bucket"))
    due = F.date_sub("end_date", F.col("notice_days"))
    to_due = F.datediff(due, day(as_of))
    renewal = alive.where(F.col("notice_days").isNotNull() & (to_due <= within)).select(
        "team_id", "lease_id", F.lit("renewal_deadline").alias("kind"), due.alias("due_date"), to_due.alias("days_remaining"), F.when(to_due < 0, "overdue").otherwise(days_bucket(to_due)).alias("bucket")
    )
    return ending.unionByName(renewal)


def loss_to_lease(leases: DataFrame) -> DataFrame:
    """Each lease against the best rent per square foot of its building."""
    valid = leases.where("building_key IS NOT NULL AND psf > 0")
    # Maxima by grouped aggregation and a join back: a building with many leases never meets in one task.
    best = valid.groupBy("team_id", "building_key").agg(F.max("psf").alias("top_psf"), F.count("*").alias("comps")).where("comps >= 2")
    joined = valid.join(best, ["team_id", "building_key"])
    return joined.select(
        "team_id",
        "lease_id",
        "tenant",
        F.round("psf", 2).alias("rent_per_sqft"),
        F.round("top_psf", 2).alias("property_top_rent_per_sqft"),
        F.round((F.col("top_psf") - F.col("psf")) / F.col("top_psf") * 100, 2).alias("loss_pct"),
        F.round((F.col("top_psf") - F.col("psf")) * F.col("sqft"), 2).alias("monthly_upside"),
    )


def with_team_means(leases: DataFrame, *names: str) -> DataFrame:
    """Leases beside their team's means (A3); one row per team on the other side."""
    return leases.join(metrics(leases).select("team_id", *names), "team_id")


def variance_outliers(leases: DataFrame, least: float = 20.0) -> DataFrame:
    """Rent per square foot at least ``least`` percent from the team's mean, either side."""
    avg = F.col("avg_rent_per_sqft")
    diff = (F.col("psf") - avg) / avg * 100
    rows = with_team_means(leases, "avg_rent_per_sqft").where((avg > 0) & (F.col("psf") > 0) & (F.abs(diff) >= least))
    return rows.select("team_id", "lease_id", F.round("psf", 2).alias("rent_per_sqft"), avg.alias("portfolio_avg"), F.round(diff, 1).alias("diff_pct"), F.when(diff > 0, "above").otherwise("below").alias("direction"))


def benchmark(leases: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Each lease's figures against the team's means; a mean of 0 or none is unknown."""
    pairs = {"rent": ("rent", "avg_monthly_rent"), "rent_per_sqft": ("psf", "avg_rent_per_sqft"), "cam": ("cam", "avg_cam"), "deposit": ("deposit", "avg_security_deposit"), "notice_days": ("notice_days", "avg_notice_days")}
    rows = with_team_means(leases, *[m for _, m in pairs.values()])
    items = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(v).cast("double").alias("value"), F.col(m).alias("average")) for n, (v, m) in pairs.items()]))
    rows = rows.select("team_id", "lease_id", items.alias("x")).select("team_id", "lease_id", "x.*").where("value IS NOT NULL")
    diff = F.when(F.col("average") != 0, (F.col("value") - F.col("average")) / F.col("average") * 100)
    status = F.when(diff.isNull(), "unknown").when(F.abs(diff) <= tolerance, "in_line").when(diff > 0, "above").otherwise("below")
    return rows.select("team_id", "lease_id", "metric", F.round(diff, 1).alias("diff_pct"), status.alias("status"))


def side_by_side(leases: DataFrame, ids: list[int]) -> DataFrame:
    """``field`` and one column per chosen lease (P19, S3); two or more ids."""
    if len(ids) < 2:
        raise ValueError("two or more leases to compare")
    rows = leases.where(F.col("lease_id").isin(ids)).select("lease_id", *FIELDS).unpivot("lease_id", list(FIELDS), "field", "value")
    return rows.groupBy("field").pivot("lease_id", sorted(ids)).agg(F.first("value"))


def attention(leases: DataFrame, fields: DataFrame, flags: DataFrame, as_of: str, within: int = 90) -> DataFrame:
    """``team_id, lease_id, reason, detail`` of what needs a look."""
    left = days_left(as_of)
    soon = leases.where(left.between(0, within)).select("team_id", "lease_id", F.lit("expiring_soon").alias("reason"), left.cast("string").alias("detail"))
    lacking = F.array_join(F.filter(F.array(*[F.when(~present(f), F.lit(f)) for f in CORE_FIELDS]), lambda x: x.isNotNull()), ",")
    missing = leases.select("team_id", "lease_id", F.lit("missing_data").alias("reason"), lacking.alias("detail")).where("detail <> ''")
    core = fields.where(F.col("field").isin(*CORE_FIELDS) & (F.col("confidence") == "medium"))
    verify = core.groupBy("team_id", "lease_id").agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("detail")).select("team_id", "lease_id", F.lit("needs_verification").alias("reason"), "detail")
    notable = flags.where("severity IN ('high', 'medium')").groupBy("team_id", "lease_id").agg(F.count("*").cast("string").alias("detail")).select("team_id", "lease_id", F.lit("unusual_terms").alias("reason"), "detail")
    return reduce(DataFrame.unionByName, (soon, missing, verify, notable))


def health(leases: DataFrame, flags: DataFrame, as_of: str) -> DataFrame:
    """Verified share, mean days to expiry, and rent ending within 182 and 365 days."""
    lacking = leases.where(reduce(lambda a, b: a | b, [~present(f) for f in CORE_FIELDS])).select("team_id", "lease_id")
    review = lacking.union(flags.where("severity IN ('high', 'medium')").select("team_id", "lease_id")).distinct().groupBy("team_id").agg(F.count("*").alias("needs_review_count"))
    left = days_left(as_of)
    sums = leases.groupBy("team_id").agg(
        F.count("*").alias("total_leases"),
        F.round(F.avg(F.when(left >= 0, left)), 0).alias("avg_days_to_expiration"),
        F.round(F.sum(F.when(left.between(0, 182), F.col("rent"))).cast("double"), 2).alias("monthly_rent_expiring_6mo"),
        F.round(F.sum(F.when(left.between(0, 365), F.col("rent"))).cast("double"), 2).alias("monthly_rent_expiring_12mo"),
    )
    out = sums.join(review, "team_id", "left").fillna(0, ["needs_review_count"])
    verified = F.col("total_leases") - F.col("needs_review_count")
    return out.withColumn("fully_verified_count", verified).withColumn("fully_verified_pct", F.round(verified * 100.0 / F.col("total_leases"), 1))


def health_score(leases: DataFrame, fields: DataFrame, open_findings: DataFrame, as_of: str, stale_months: float = 6.0) -> DataFrame:
    """Weighted score of confidence, verification, findings and freshness."""
    by_lease = confidence_by_lease(fields)
    conf = by_lease.groupBy("team_id").agg(F.sum("high").alias("h"), F.sum("medium").alias("m"), F.sum("low").alias("l"), F.sum("total_fields").alias("t"))
    conf = conf.select("team_id", F.round((F.col("h") + 0.6 * F.col("m") + 0.3 * F.col("l")) / F.col("t") * 100, 1).alias("confidence_score"))
    complete = reduce(lambda a, b: a & b, [present(f) for f in CORE_FIELDS])
    fresh = F.datediff(day(as_of), "uploaded_at") <= stale_months * DAYS_PER_MONTH
    own = leases.join(by_lease.select("team_id", "lease_id", "flagged_for_review"), ["team_id", "lease_id"], "left").groupBy("team_id").agg(
        F.count("*").alias("n"), F.count(F.when(complete & (F.col("flagged_for_review") == 0), 1)).alias("v"), F.count(F.when(fresh, 1)).alias("f")
    )
    found = open_findings.groupBy("team_id").agg(F.count("*").alias("open_count"))
    rows = own.join(conf, "team_id").join(found, "team_id", "left").fillna(0, ["open_count"])
    rows = rows.withColumn("verification_score", F.round(F.col("v") * 100.0 / F.col("n"), 1)).withColumn("findings_score", F.round(100 / (1 + F.col("open_count") / F.col("n")), 1)).withColumn("freshness_score", F.round(F.col("f") * 100.0 / F.col("n"), 1))
    score = F.round(0.30 * F.col("confidence_score") + 0.25 * F.col("verification_score") + 0.25 * F.col("findings_score") + 0.20 * F.col("freshness_score"), 1)
    rows = rows.withColumn("score", score)
    rating = F.when(score >= 90, "Excellent").when(score >= 75, "Good").when(score >= 60, "Fair").when(score >= 40, "Poor").otherwise("Critical")
    return rows.select("team_id", F.col("n").alias("lease_count"), "confidence_score", "verification_score", "findings_score", "freshness_score", "score", rating.alias("rating"))
