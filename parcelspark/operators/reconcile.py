"""Rent rolls against lease documents and income statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.functions import parse
from parcelspark.operators.identity import same_household
from parcelspark.operators.portfolio import day

IDENTITY = ("tenant", "rent_amount", "lease_start_date", "lease_end_date", "rent_escalation")


def operative_documents(leases: DataFrame, as_of: str) -> DataFrame:
    """The documents that count for each unit on ``as_of``.

    Identical copies collapse; documents whose term covers the day win, and of
    versions with one tenant and term the newest id stands for all, with the
    others' rents in ``other_rents``; else the latest start; undated ones only
    where none has a date.  Windows are per unit, whose documents are few.
    """
    docs = leases.where("NOT is_rent_roll AND unit_key IS NOT NULL")
    unit = Window.partitionBy("team_id", "unit_key")
    texts = F.array(*[F.lower(F.trim(F.coalesce(F.col(f), F.lit("")))) for f in IDENTITY])
    filled = F.array_join(texts, "") != ""
    copy = F.row_number().over(Window.partitionBy("team_id", "unit_key", "__same").orderBy("lease_id"))
    docs = docs.withColumn("__n", F.count("*").over(unit)).withColumn("__same", texts).withColumn("__copy", copy)
    docs = docs.where((F.col("__copy") == 1) | ~filled | (F.col("__n") == 1)).withColumn("__n", F.count("*").over(unit))
    today = day(as_of)
    covers = F.coalesce((F.col("start_date") <= today) & (today <= F.col("end_date")), F.lit(False))
    begun = F.coalesce("start_date", "end_date")
    docs = docs.withColumn("__covers", covers).withColumn("__any", F.max("__covers").over(unit)).withColumn("__dated", F.count(begun).over(unit))
    latest = F.row_number().over(unit.orderBy(F.desc_nulls_last(begun), "lease_id"))
    docs = docs.withColumn("__latest", latest)
    kept = docs.where((F.col("__n") == 1) | F.when(F.col("__any"), F.col("__covers")).when(F.col("__dated") > 0, F.col("__latest") == 1).otherwise(True))
    family = Window.partitionBy("team_id", "unit_key", "tenant_key", "start_date", "end_date")
    newest = F.max("lease_id").over(family)
    collapse = F.col("__any") & (F.col("__n") > 1)
    others = F.filter(F.collect_list(F.struct("lease_id", "rent")).over(family), lambda x: (x["lease_id"] != F.col("lease_id")) & x["rent"].isNotNull())
    kept = kept.withColumn("__newest", newest).withColumn("other_rents", F.when(collapse, F.transform(others, lambda x: x["rent"])).otherwise(F.array().cast("array<decimal(18,2)>")))
    return kept.where(~collapse | (F.col("lease_id") == F.col("__newest"))).drop("__n", "__same", "__copy", "__covers", "__any", "__dated", "__latest", "__newest")


def rent_in_effect(as_of: str) -> Column:
    """``struct<rent, unpriced>`` on ``as_of``: the schedule's latest step, or the yearly rate compounded."""
    today, base = day(as_of), F.col("rent").cast("double")
    year = parse.lease_year(F.col("start_date"), today)
    reached = F.filter("schedule", lambda s: s["year"] <= year)
    stepped = F.coalesce(F.try_element_at(reached, F.lit(-1))["amount"], base)
    pct = parse.percent("rent_escalation")
    yearly = F.lower("rent_escalation").rlike("annual|anniversar|each year|per year|yearly")
    text = F.col("rent_escalation").isNotNull()
    begun = today >= F.col("start_date")
    rent = F.when(text & begun & (F.size("schedule") > 0), stepped).when(text & begun & pct.isNotNull() & yearly, parse.cents(base * F.pow(1 + pct / 100, year - 1))).otherwise(base)
    unpriced = text & (F.col("start_date").isNull() | (begun & (F.size("schedule") == 0) & ~F.coalesce(pct.isNotNull() & yearly, F.lit(False))))
    return F.struct(rent.alias("rent"), F.coalesce(unpriced, F.lit(False)).alias("unpriced"))


def _optional(leases: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in leases.columns else F.lit(None).cast(kind)


def sides(leases: DataFrame, as_of: str, how: str = "full_outer") -> DataFrame:
    """Rent-roll rows beside the operative documents of their unit, and those of either side alone.

    One join feeds every detector.  ``leases`` may have ``items`` and
    ``concessions`` (documents' clauses, ``concessions.with_items``) and
    ``roll_concession`` (what a roll shows a month); where it has not, nothing is
    conceded.  A unit's pairs are all its rolls with all its operative documents.
    """
    from parcelspark.operators import concessions

    fields = ("lease_id", "tenant", "tenant_key", "rent", "start_date", "end_date")
    roll = leases.where("is_rent_roll AND unit_key IS NOT NULL").select("team_id", "unit_key", *[F.col(f).alias(f"roll_{f}") for f in fields], _optional(leases, "roll_concession", "double").cast("double").alias("roll_concession"))
    docs = operative_documents(leases, as_of).withColumn("effect", rent_in_effect(as_of)).withColumn("items", _optional(leases, "items", concessions.ITEM))
    unread = (F.trim(_optional(leases, "concessions", "string")) != "") & (F.coalesce(F.size("items"), F.lit(0)) <= 0)
    docs = docs.select(
        "team_id", "unit_key", *[F.col(f).alias(f"doc_{f}") for f in fields], F.col("effect.rent").alias("doc_rent_now"), F.col("effect.unpriced").alias("doc_unpriced"), "other_rents",
        concessions.effective(as_of).alias("conceded"), F.coalesce(unread, F.lit(False)).alias("unreadable"),
    )
    return roll.join(docs, ["team_id", "unit_key"], how)


def pairs(leases: DataFrame, as_of: str) -> DataFrame:
    """Rent-roll rows joined with the operative documents of their unit."""
    return sides(leases, as_of, "inner")


def other_household() -> Column:
    """Whether a pair's tenants are of two households (J8); unknown names are not."""
    known = F.col("roll_tenant_key").isNotNull() & F.col("doc_tenant_key").isNotNull()
    return known & (F.col("roll_tenant_key") != F.col("doc_tenant_key")) & ~same_household(F.col("roll_tenant"), F.col("doc_tenant"))


def reflects_concession(roll: Column) -> Column:
    """Whether a roll's rent is what the lease's concessions leave, now or over the term, rather than its base rent."""
    base = F.col("conceded.base")
    left = [(c.isNotNull() & parse.differs(c, base) & ~parse.differs(roll, c)) for c in (F.col("conceded.current"), F.col("conceded.net"))]
    return F.coalesce(left[0], F.lit(False)) | F.coalesce(left[1], F.lit(False))


def roll_mismatches(leases: DataFrame, as_of: str) -> DataFrame:
    """Tenant, rent and end-date disagreements (R14): names of one household agree, as do rents that a concession explains."""
    a, b = F.col("roll_rent").cast("double"), F.col("doc_rent").cast("double")
    tests = {"tenant": other_household(), "rent_amount": parse.differs(a, b) & ~reflects_concession(a), "lease_end_date": F.col("roll_end_date") != F.col("doc_end_date")}
    found = F.filter(F.array(*[F.when(t, F.lit(f)) for f, t in tests.items()]), lambda x: x.isNotNull())
    return pairs(leases, as_of).select("team_id", "unit_key", "roll_lease_id", "doc_lease_id", F.explode(found).alias("field"))


def _detectors(as_of: str, in_cents: bool = False) -> dict[str, list[tuple]]:
    """For each kind its findings about a row of ``sides``: condition, field, monthly and annual impact, direction, severity.

    An annual impact of None is twelve months; a severity of None goes by the month.
    ``in_cents``: a rent's severity goes by its gap in whole cents, as it is shown.
    """
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    a, b = F.col("roll_rent").cast("double"), F.col("doc_rent_now")
    both = F.col("roll_lease_id").isNotNull() & F.col("doc_lease_id").isNotNull()
    today = day(as_of)
    runs = both & F.coalesce(F.col("doc_end_date") >= today, F.lit(True))

    # A rent of an older version, or above an escalation without a price, has unknown impact
    older = F.exists("other_rents", lambda r: ~parse.differs(a, r.cast("double")))
    known = ~(older | (F.col("doc_unpriced") & (a > b)))
    gap = F.when(known, F.round(F.abs(a - b), 2))
    rent = (both & parse.differs(a, b) & ~reflects_concession(a), "rent_amount", gap, None, F.when(known, F.when(a > b, "overstate").otherwise("understate")), F.when(known, parse.severity_of_impact(gap if in_cents else F.abs(a - b))).otherwise("medium"))

    expired = (both & (F.col("doc_end_date") < today) & F.col("roll_tenant").isNotNull(), "lease_end_date", F.round(a, 2), None, F.lit("overstate"), None)

    c = F.col("conceded")
    shown, grants = F.coalesce("roll_concession", F.lit(0.0)), F.coalesce(c["items"] > 0, F.lit(False))
    lower = F.coalesce((a < c["base"]) & parse.differs(a, c["base"]), F.lit(False))
    missing = (runs & grants & (shown <= 0) & ~reflects_concession(a) & ~lower, "concessions", c["monthly"], c["yearly"], F.lit("overstate"), None)
    unpriced = (runs & F.col("unreadable") & (shown <= 0), "concessions", none, none, F.lit("overstate"), F.lit("medium"))

    share = F.when(grants, c["monthly"]).when(~F.col("unreadable"), 0.0)
    off = F.round(c["base"] - c["current"], 2)
    agrees = F.coalesce(~parse.differs(shown, share), F.lit(False)) | F.coalesce((off != 0) & ~parse.differs(shown, off), F.lit(False))
    apart = share - shown
    booked = (runs & (shown != 0) & ~agrees, "concessions", F.abs(apart), F.abs(apart) * 12, F.when(apart > 0, "overstate").when(apart.isNotNull(), "understate"), None)

    ending = (runs & (c["current"] < c["base"]) & ~parse.differs(a, c["current"]) & (c["lost"] > 0), "concessions", c["step"], c["lost"], F.lit("understate"), None)

    dates = [(both & (F.col(f"roll_{f}") != F.col(f"doc_{f}")), f"lease_{f}", none, none, text, F.lit("medium")) for f in ("start_date", "end_date")]
    d = F.col("doc_rent").cast("double")
    return {
        "rent_mismatch": [rent],
        "expired_but_occupied": [expired],
        "unit_no_lease": [(F.col("doc_lease_id").isNull(), "presence", F.round(a, 2), None, text, None)],
        "lease_no_unit": [(F.col("roll_lease_id").isNull(), "presence", F.round(d, 2), None, F.when(d.isNotNull(), "understate"), None)],
        "concession_missing": [missing, unpriced],
        "concession_mismatch": [booked],
        "concession_expiring": [ending],
        "dates_mismatch": dates,
        "tenant_mismatch": [(both & other_household(), "tenant", none, none, text, F.lit("high"))],
    }


FINDING = ("team_id", "unit_key", "roll_lease_id", "doc_lease_id", "discrepancy_type", "field", "monthly_impact", "annual_impact", "income_direction", "severity")


def _exploded(rows: DataFrame, keys: tuple, found: dict[str, list[tuple]]) -> DataFrame:
    """One row for each finding about a row: the detectors are elements of one array."""

    def finding(kind, test, field, monthly, annual, direction, severity):
        yearly = F.round(monthly * 12 if annual is None else annual, 2)
        severity = parse.severity_of_impact(monthly) if severity is None else severity
        return F.when(test, F.struct(F.lit(kind).alias("discrepancy_type"), F.lit(field).alias("field"), F.round(monthly, 2).alias("monthly_impact"), yearly.alias("annual_impact"), direction.alias("income_direction"), severity.alias("severity")))

    every = F.array(*[finding(kind, *f) for kind, each in found.items() for f in each])
    return rows.select(*keys, F.explode(F.filter(every, lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")


def findings(leases: DataFrame, as_of: str, kinds: tuple[str, ...] | None = None, in_cents: bool = False) -> DataFrame:
    """Findings of ``kinds``, by default all nine, from one join of rolls and documents."""
    every = _detectors(as_of, in_cents)
    alone = kinds is None or "unit_no_lease" in kinds or "lease_no_unit" in kinds
    rows = sides(leases, as_of, "full_outer" if alone else "inner")
    return _exploded(rows, FINDING[:4], {k: every[k] for k in kinds or every})


def rent_findings(leases: DataFrame, as_of: str) -> DataFrame:
    """Rolls' rents against the rent in effect, with impact and direction.

    A rent that a concession explains agrees; one that matches an older version of
    the lease, or lies above a lease whose escalation has no price, has unknown impact.
    """
    return findings(leases, as_of, ("rent_mismatch",))


def expired_but_occupied(leases: DataFrame, as_of: str) -> DataFrame:
    """Rolls with a tenant where the operative document has ended."""
    return findings(leases, as_of, ("expired_but_occupied",))


def date_and_tenant_findings(leases: DataFrame, as_of: str) -> DataFrame:
    """Start dates, end dates and households that disagree."""
    return findings(leases, as_of, ("dates_mismatch", "tenant_mismatch"))


def presence(leases: DataFrame) -> DataFrame:
    """Units of one side that the other lacks, by an anti join each way."""
    key = ["team_id", "unit_key"]
    roll, docs = leases.where("is_rent_roll AND unit_key IS NOT NULL"), leases.where("NOT is_rent_roll AND unit_key IS NOT NULL")
    a = roll.join(docs.select(*key).distinct(), key, "left_anti").select(*key, "lease_id", F.lit("unit_no_lease").alias("discrepancy_type"))
    b = docs.join(roll.select(*key).distinct(), key, "left_anti").select(*key, "lease_id", F.lit("lease_no_unit").alias("discrepancy_type"))
    return a.unionByName(b)


def statement_findings(leases: DataFrame, statements: DataFrame, bad_debt: DataFrame, least: float = 5.0, rise: float = 25.0) -> DataFrame:
    """Rolls of a building against its statement (R22): income gap, occupancy, concessions, and bad debt that rises in a full house.

    ``statements``: see ``t12_income_gap``; ``bad_debt``: team_id, building_key,
    month_idx (oldest first) and amount, of which a building needs twelve.
    ``unit_key`` of a finding is the building's key.
    """
    key = ["team_id", "building_key"]
    rolls = leases.where("is_rent_roll AND building_key IS NOT NULL").groupBy(*key).agg((F.sum("rent") * 12).cast("double").alias("roll"), F.count("tenant").alias("occupied"), F.count("*").alias("units"))
    magnitude = F.abs(F.col("amount").cast("double"))
    months = bad_debt.where("amount IS NOT NULL").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("month_idx", magnitude.alias("amount")))).alias("m"))
    mean = F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x["amount"]) / F.size("m")
    last = F.aggregate(F.slice("m", -3, 3), F.lit(0.0), lambda acc, x: acc + x["amount"]) / 3
    debts = months.where(F.size("m") >= 12).select(*key, mean.alias("mean"), last.alias("last"))
    rows = statements.join(rolls, key).join(debts, key, "left")
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    gap = F.col("roll") - F.col("rental_income")
    shares = F.col("occupied") / F.col("units") * 100 - (1 - F.try_divide(F.abs("vacancy_loss"), F.abs("gross_potential"))) * 100
    return _exploded(
        rows.withColumn("unit_key", F.col("building_key")).withColumns({c: F.lit(None).cast("long") for c in FINDING[2:4]}),
        FINDING[:4],
        {
            "t12_income_gap": [((gap > 0) & (gap / F.greatest("roll", "rental_income") * 100 > least), "rental_income_collected", gap / 12, gap, F.lit("overstate"), None)],
            "t12_occupancy_mismatch": [(F.abs(shares) > least, "occupancy_rate", none, none, text, F.lit("medium"))],
            "t12_concession_gap": [(F.round(F.abs("concessions"), 2) > 0, "concessions", none, none, text, F.lit("low"))],
            "t12_bad_debt_trend": [((F.col("mean") > 0) & ((F.col("last") - F.col("mean")) / F.nullif("mean", F.lit(0.0)) * 100 > rise) & (F.col("occupied") >= F.col("units")), "bad_debt_trend", none, none, text, F.lit("medium"))],
        },
    )


def report(leases: DataFrame, as_of: str, statements: DataFrame | None = None, bad_debt: DataFrame | None = None) -> DataFrame:
    """All findings of one report (R23, T1): nine detectors on one join, and with a statement four more on another."""
    found = findings(leases, as_of, in_cents=True)
    return found if statements is None else found.unionByName(statement_findings(leases, statements, bad_debt))


def impact_totals(findings: DataFrame) -> DataFrame:
    """Counts, impact per type, and the signed total; NULL where no impact is known."""
    annual = F.col("annual_impact").cast("decimal(18,2)")
    signed = F.when(F.col("income_direction") == "overstate", annual).when(F.col("income_direction") == "understate", -annual)
    return findings.groupBy("team_id", "discrepancy_type").agg(
        F.count("*").alias("n"),
        *[F.count(F.when(F.coalesce("severity", F.lit("low")) == s, 1)).alias(f"n_{s}") for s in ("high", "medium", "low")],
        F.sum(annual).cast("double").alias("annual_impact"),
        F.sum(signed).cast("double").alias("signed_impact"),
    )


def t12_reconciliation(leases: DataFrame, income: DataFrame) -> DataFrame:
    """Annualised rents of each building against its statement's rental income.

    ``income``: team_id, building_key, annual_income.  Rent-roll rows win over
    documents.  Flagged beyond 3,000 dollars and 5 percent.
    """
    key = ["team_id", "building_key"]
    sums = leases.where("building_key IS NOT NULL").groupBy(*key, "is_rent_roll").agg(F.sum("rent").alias("rent_sum"), F.count("rent").alias("n"), (F.count("*") - F.count("rent")).alias("excluded"))
    chosen = sums.groupBy(*key).agg(F.max_by(F.struct("rent_sum", "n", "excluded"), "is_rent_roll").alias("x")).select(*key, "x.*")
    rows = income.join(chosen, key, "left")
    annual = F.round(F.col("rent_sum").cast("double") * 12, 2)
    stated = F.round(F.col("annual_income").cast("double"), 2)
    diff = F.round(annual - stated, 2)
    pct = F.round(F.coalesce(F.try_divide(F.abs(diff), F.greatest(F.abs(annual), F.abs(stated))), F.lit(0.0)) * 100, 2)
    known = annual.isNotNull()
    return rows.select(
        *key,
        F.coalesce("n", F.lit(0)).alias("matched_lease_count"),
        F.coalesce("excluded", F.lit(0)).alias("excluded_lease_count"),
        annual.alias("rent_roll_annual_rent"),
        stated.alias("t12_annual_rental_income"),
        diff.alias("difference"),
        F.when(known, pct).alias("difference_pct"),
        F.when(diff > 0, "rent_roll_higher").when(diff < 0, "t12_higher").when(diff == 0, "agree").alias("direction"),
        F.when(known, (F.abs(diff) > 3000) & (pct > 5)).alias("flagged"),
    )


def trailing_trend(lines: DataFrame, least: float = 25.0) -> DataFrame:
    """Mean of the last three months against the mean of all, per statement line.

    ``lines``: team_id, building_key, category, month_idx, amount.
    """
    n = Window.partitionBy("team_id", "building_key", "category")
    rows = lines.withColumn("last", F.max("month_idx").over(n))
    sums = rows.groupBy("team_id", "building_key", "category").agg(
        F.sum(F.when(F.col("month_idx") > F.col("last") - 3, F.col("amount"))).cast("double").alias("last_3_total"), F.sum("amount").cast("double").alias("total"), F.count("amount").alias("months")
    )
    sums = sums.withColumn("t3", F.col("last_3_total") / 3).withColumn("t12", F.col("total") / F.col("months"))
    change = (F.col("t3") - F.col("t12")) / F.abs(F.col("t12")) * 100
    return sums.where((F.col("months") >= 6) & (F.col("t12") != 0)).select("team_id", "building_key", "category", "last_3_total", "total", F.round(change, 1).alias("change_pct"), (change > least).alias("flagged"))


def superseded_files(files: DataFrame, least: float = 0.5) -> DataFrame:
    """Older roll files of a building replaced by a newer one that repeats half their units.

    ``files``: team_id, building_key, file, uploaded_at, unit_key.
    """
    units = files.select("team_id", "building_key", "file", "uploaded_at", "unit_key").distinct()
    sizes = units.groupBy("team_id", "building_key", "file", "uploaded_at").agg(F.count("*").alias("units"))
    newer = units.select("team_id", "building_key", "unit_key", F.col("file").alias("new_file"), F.col("uploaded_at").alias("new_at"))
    shared = units.join(newer, ["team_id", "building_key", "unit_key"]).where("new_at > uploaded_at").groupBy("team_id", "building_key", "file", "new_file").agg(F.count("*").alias("shared"))
    rows = sizes.join(shared, ["team_id", "building_key", "file"]).where(F.col("shared") >= F.col("units") * least)
    return rows.groupBy("team_id", "building_key", "file").agg(F.min("new_file").alias("replaced_by"), F.max(F.round(F.col("shared") * 100.0 / F.col("units"), 1)).alias("overlap_pct"))


def financial_scope(leases: DataFrame) -> DataFrame:
    """One lease per unit for sums: document over roll, then newest upload; leases without a unit stay."""
    order = Window.partitionBy("team_id", "unit_key").orderBy("is_rent_roll", F.desc("uploaded_at"), F.desc("lease_id"))
    keyed = leases.where("unit_key IS NOT NULL").withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")
    return keyed.unionByName(leases.where("unit_key IS NULL"))


def t12_income_gap(leases: DataFrame, statements: DataFrame, least: float = 5.0) -> DataFrame:
    """Rolls whose yearly rent is above a building's stated rental income by more than ``least`` percent.

    ``statements``: team_id, building_key, rental_income, gross_potential,
    vacancy_loss, concessions, all of a year.
    """
    key = ["team_id", "building_key"]
    rents = leases.where("is_rent_roll AND rent IS NOT NULL").groupBy(*key).agg((F.sum("rent") * 12).cast("double").alias("roll"))
    rows = rents.join(statements.where("rental_income IS NOT NULL"), key).withColumn("gap", F.col("roll") - F.col("rental_income"))
    rows = rows.where((F.col("gap") > 0) & (F.col("gap") / F.greatest("roll", "rental_income") * 100 > least))
    monthly = F.col("gap") / 12
    return rows.select(*key, F.round("roll", 2).alias("roll_annual"), F.round("rental_income", 2).alias("stated_annual"), F.round(monthly, 2).alias("monthly_impact"), F.round("gap", 2).alias("annual_impact"), F.lit("overstate").alias("income_direction"), parse.severity_of_impact(monthly).alias("severity"))


def t12_occupancy_gap(leases: DataFrame, statements: DataFrame, least: float = 5.0) -> DataFrame:
    """Occupied share of the rolls' units against one less vacancy over potential rent, in points."""
    key = ["team_id", "building_key"]
    units = leases.where("is_rent_roll").groupBy(*key).agg(F.count("tenant").alias("occupied"), F.count("*").alias("units"))
    roll = F.col("occupied") / F.col("units") * 100
    stated = (1 - F.abs("vacancy_loss") / F.abs("gross_potential")) * 100
    rows = units.join(statements.where("vacancy_loss IS NOT NULL AND gross_potential <> 0"), key)
    return rows.where(F.abs(roll - stated) > least).select(*key, F.round(roll, 1).alias("roll_pct"), F.round(stated, 1).alias("stated_pct"), F.lit("medium").alias("severity"))


def t12_concessions(statements: DataFrame) -> DataFrame:
    """Stated concessions that no roll can confirm."""
    amount = F.round(F.abs("concessions"), 2)
    return statements.where(amount > 0).select("team_id", "building_key", amount.alias("stated_annual"), F.lit("low").alias("severity"))
