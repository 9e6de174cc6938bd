"""The figures of a deal memo for every property and every whole portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.operators import portfolio, reconcile


def _scoped(rows: DataFrame) -> DataFrame:
    """Each row under its building's scope and its team's: ``<team>|<building>`` and ``<team>|``; without a building, the team's only."""
    team = F.concat(F.col("team_id").cast("string"), F.lit("|"))
    scopes = F.when(F.col("building_key").isNull(), F.array(team)).otherwise(F.array(team, F.concat(team, "building_key")))
    return rows.withColumn("team_id", F.explode(scopes))


def deal_memo(leases: DataFrame, findings: DataFrame, as_of: str) -> DataFrame:
    """One row a scope: records, leases that count (one a unit), rents, remaining term, rollover and findings.

    ``findings``: team_id, building_key, status, severity.  ``rollover``: rent by
    bucket, every bucket there.  A scope without a rent has null figures, not zeros.
    """
    records = _scoped(leases.select("team_id", "building_key")).groupBy("team_id").agg(F.count("*").alias("record_count"))
    counted = _scoped(reconcile.financial_scope(leases))
    metrics = portfolio.metrics(counted).select("team_id", "lease_count", "total_monthly_rent", "avg_rent_per_sqft", "total_square_footage")
    term = portfolio.walt(counted, as_of).select("team_id", "walt_years")
    buckets = portfolio.rollover(counted, as_of).groupBy("team_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "rent")))).alias("rollover"), F.max(F.when(F.col("bucket") == "year_1", F.col("pct_of_total_rent"))).alias("year_1_pct")
    )
    open_ = F.col("status") == "open"
    noted = _scoped(findings).groupBy("team_id").agg(F.count_if(open_).alias("open_findings"), F.count_if(~open_).alias("resolved_findings"), F.count_if(open_ & (F.col("severity") == "high")).alias("open_high"))
    out = records.join(metrics, "team_id", "left").join(term, "team_id", "left").join(buckets, "team_id", "left").join(noted, "team_id", "left")
    return out.fillna(0, ["open_findings", "resolved_findings", "open_high"]).withColumnRenamed("team_id", "scope")
