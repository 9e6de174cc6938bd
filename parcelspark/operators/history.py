"""Unit histories: rent growth, turnover and expiration patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_unit():
    return Window.partitionBy("team_id", "unit_key").orderBy("uploaded_at", "lease_id")


def rent_growth(leases: DataFrame) -> DataFrame:
    """Percentage steps between adjacent records of a unit.

    A step needs both rents and a non-zero first; a record without a rent
    breaks the chain and is not bridged.
    """
    rows = leases.where("unit_key IS NOT NULL").select("team_id", "unit_key", "lease_id", "uploaded_at", "tenant_key", F.col("rent").cast("double").alias("rent"))
    unit = _by_unit()
    rows = rows.select("*", F.lag("rent").over(unit).alias("before"), F.lag("lease_id").over(unit).alias("from_lease_id"), F.lag("tenant_key").over(unit).alias("tenant_before"))
    pct = F.round((F.col("rent") - F.col("before")) / F.col("before") * 100, 2)
    return rows.where("rent IS NOT NULL AND before <> 0").select("team_id", "unit_key", "from_lease_id", F.col("lease_id").alias("to_lease_id"), pct.alias("pct_change"), (~F.col("tenant_key").eqNullSafe(F.col("tenant_before"))).alias("tenant_changed"))


def unit_growth(leases: DataFrame) -> DataFrame:
    """First to last parsed rent of each unit, and its records."""
    at = F.struct("uploaded_at", "lease_id")
    rows = leases.where("unit_key IS NOT NULL")
    priced = F.col("rent").isNotNull()
    sums = rows.groupBy("team_id", "unit_key").agg(
        F.count("*").alias("data_points"), F.count("rent").alias("priced"), F.min_by("rent", F.when(priced, at)).alias("first_rent"), F.max_by("rent", F.when(priced, at)).alias("last_rent")
    )
    first, last = F.col("first_rent").cast("double"), F.col("last_rent").cast("double")
    total = F.when((F.col("priced") >= 2) & (first != 0), F.round((last - first) / first * 100, 2))
    return sums.select("team_id", "unit_key", "data_points", total.alias("total_pct_change"))


def turnover(leases: DataFrame) -> DataFrame:
    """Adjacent records of a unit with different known tenants."""
    unit = _by_unit()
    rows = leases.where("unit_key IS NOT NULL").select("team_id", "unit_key", "lease_id", "uploaded_at", "tenant_key", F.lag("tenant_key").over(unit).alias("before"), F.lag("lease_id").over(unit).alias("old_lease_id"))
    return rows.where("tenant_key <> before").select("team_id", "unit_key", "old_lease_id", F.col("lease_id").alias("new_lease_id"), F.col("uploaded_at").alias("detected_at"))


def expirations_by_month(leases: DataFrame) -> DataFrame:
    """Expirations in each calendar month 01 to 12, every month present."""
    counts = leases.where("end_date IS NOT NULL").groupBy("team_id", F.date_format("end_date", "MM").alias("month")).agg(F.count("*").alias("n"))
    months = F.explode(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.lpad(i.cast("string"), 2, "0")))
    dense = leases.select("team_id").distinct().select("team_id", months.alias("month"))
    return dense.join(counts, ["team_id", "month"], "left").fillna(0, ["n"])


def building_trends(leases: DataFrame) -> DataFrame:
    """Records, units, turnovers and expirations of each building, with a total per team.

    Sums per unit come first and are rolled up, so no distinct count is needed.
    """
    keyed = leases.where("building_key IS NOT NULL")
    unit = _by_unit()
    rows = keyed.select("team_id", "building_key", "unit_key", "end_date", "tenant_key", F.lag("tenant_key").over(unit).alias("before"))
    units = rows.groupBy("team_id", "building_key", "unit_key").agg(F.count("*").alias("records"), F.count(F.when(F.col("tenant_key") != F.col("before"), 1)).alias("turnovers"), F.count("end_date").alias("ends"))
    return (
        units.rollup("team_id", "building_key")
        .agg(F.sum("records").alias("record_count"), F.count("unit_key").alias("units"), F.sum("turnovers").alias("turnover_count"), F.sum("ends").alias("expirations"))
        .where("team_id IS NOT NULL")
        .fillna("(all)", ["building_key"])
    )


def property_history(leases: DataFrame) -> DataFrame:
    """The records of each unit in order."""
    rows = leases.where("unit_key IS NOT NULL").withColumn("nth", F.row_number().over(_by_unit()).cast("long"))
    return rows.select("team_id", "unit_key", "lease_id", "uploaded_at", F.col("rent").cast("double").alias("rent"), "nth")


def rent_change_summary(leases: DataFrame, since: str) -> DataFrame:
    """Rent changes per team, their mean, and how many are recent."""
    steps = rent_growth(leases).join(leases.select("team_id", F.col("lease_id").alias("to_lease_id"), "uploaded_at"), ["team_id", "to_lease_id"])
    mean = F.sum(F.col("pct_change").cast("decimal(18,2)")).cast("double") / F.count("*")
    return steps.groupBy("team_id").agg(F.count("*").alias("changes"), F.round(mean, 2).alias("mean_pct"), F.count_if(F.col("uploaded_at") >= F.lit(since).cast("date")).alias("recent"))
