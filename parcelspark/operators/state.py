"""Natural-keyed state: upserts and lifecycles as full outer merges.

Each function takes the old snapshot and a run's rows and returns the new
snapshot; the caller writes it beside the old one and swaps.  Merging the same
run twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_findings(old: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """Findings by ``natural_key`` (U1, K2): a key seen again takes the new severity, message and impact.

    Status and first detection stay as they were, so a resolved finding stays resolved.
    """
    o = old.select("natural_key", *[F.col(c).alias(f"o_{c}") for c in ("severity", "impact", "status", "first_detected_at", "last_seen_at")])
    joined = o.join(new.select("natural_key", "severity", "impact"), "natural_key", "full_outer")
    seen, time = F.col("severity").isNotNull(), F.lit(at).cast("timestamp")
    return joined.select(
        "natural_key",
        F.coalesce("severity", "o_severity").alias("severity"),
        F.when(seen, F.col("impact")).otherwise(F.col("o_impact")).alias("impact"),
        F.coalesce("o_status", F.lit("open")).alias("status"),
        F.coalesce("o_first_detected_at", time).alias("first_detected_at"),
        F.when(seen, time).otherwise(F.col("o_last_seen_at")).alias("last_seen_at"),
    )


def run_alerts(old: DataFrame, candidates: DataFrame, at: str) -> DataFrame:
    """One alert run.

    New keys are created active; seen ones refresh, and auto-resolved ones
    become active again while dismissed ones stay dismissed; active ones that
    this run lacks are resolved.  ``change`` says what happened.
    """
    o = old.select("natural_key", F.col("alert_type").alias("o_type"), F.col("severity").alias("o_severity"), F.col("status").alias("o_status"), F.col("created_at").alias("o_created"))
    joined = o.join(candidates.select("natural_key", "alert_type", "severity"), "natural_key", "full_outer")
    seen, known = F.col("alert_type").isNotNull(), F.col("o_status").isNotNull()
    status = F.when(~known, "active").when(seen & (F.col("o_status") == "auto_resolved"), "active").when(~seen & (F.col("o_status") == "active"), "auto_resolved").otherwise(F.col("o_status"))
    change = F.when(~known, "created").when(seen, "refreshed").when(F.col("o_status") == "active", "auto_resolved").otherwise("kept")
    return joined.select(
        "natural_key",
        F.coalesce("alert_type", "o_type").alias("alert_type"),
        F.coalesce("severity", "o_severity").alias("severity"),
        status.alias("status"),
        F.coalesce("o_created", F.lit(at).cast("timestamp")).alias("created_at"),
        change.alias("change"),
    )


def digest(alerts: DataFrame) -> DataFrame:
    """Active alerts by severity and type, every pair present."""
    return alerts.where("status = 'active'").groupBy("alert_type").agg(F.count("*").alias("active"), *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in ("high", "medium", "low")])


def finding_keys(flags: DataFrame) -> DataFrame:
    """Natural keys of flags: the n-th repeat of a lease, category and field has its own."""
    from pyspark.sql import Window

    order = Window.partitionBy("team_id", "lease_id", "category", "field").orderBy("check_no", "severity")
    n = F.row_number().over(order) - 1
    return flags.select("team_id", "lease_id", "category", "field", "severity", F.concat_ws(":", F.lit("lease_risk_flag"), "lease_id", "category", "field", n).alias("natural_key"))


def repoint_keys(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """Natural keys with the lease id at their second place rewritten.

    ``moved``: old_id, new_id.
    """
    parts = F.split("natural_key", ":")
    joined = rows.withColumn("__id", parts[1].try_cast("long")).join(moved, F.col("__id") == F.col("old_id"), "left")
    renamed = F.array_join(F.concat(F.slice(parts, 1, 1), F.array(F.col("new_id").cast("string")), F.slice(parts, 3, 100)), ":")
    return joined.withColumn("natural_key", F.when(F.col("new_id").isNotNull(), renamed).otherwise(F.col("natural_key"))).drop("__id", "old_id", "new_id")


def latest_resolution(events: DataFrame) -> DataFrame:
    """Status of each finding after its log of resolutions and reopenings."""
    return events.groupBy("finding_id").agg(F.max_by("action", F.struct("at", "event_id")).alias("last_action"), F.max("at").alias("at")).withColumn("status", F.when(F.col("last_action") == "resolve", "resolved").otherwise("open"))


def patterns(findings: DataFrame, least: int = 3) -> DataFrame:
    """Kinds of findings that touch ``least`` leases or more.

    Leases are counted over both id columns; impacts are summed apart, so the
    second id does not double them.
    """
    key = ["discrepancy_type", "category", "field"]
    findings = findings.withColumn("field", F.coalesce("field", F.lit("")))
    ids = findings.select(*key, F.explode(F.array("lease_id", "related_lease_id")).alias("id")).where("id IS NOT NULL").groupBy(*key).agg(F.count_distinct("id").alias("lease_count"))
    sums = findings.groupBy(*key).agg(F.count("*").alias("discrepancy_count"), F.sum(F.col("impact").cast("decimal(18,2)")).cast("double").alias("total_impact"))
    return sums.join(ids.where(F.col("lease_count") >= least), key)


def finding_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed between two snapshots of findings (R30): ``natural_key, severity, change``.

    ``opened``: new and open, or open again; ``closed``: no longer open, or gone;
    ``changed``: still open with another severity.  Nothing else has a row.
    """
    o = before.where("status = 'open'").select("natural_key", F.col("severity").alias("was"), F.lit(True).alias("o"))
    n = after.where("status = 'open'").select("natural_key", "severity", F.lit(True).alias("n"))
    joined = o.join(n, "natural_key", "full_outer")
    change = F.when(F.col("o").isNull(), "opened").when(F.col("n").isNull(), "closed").when(~F.col("was").eqNullSafe(F.col("severity")), "changed")
    return joined.select("natural_key", F.coalesce("severity", "was").alias("severity"), change.alias("change")).where("change IS NOT NULL")


def discrepancy_alerts(changes: DataFrame) -> DataFrame:
    """An alert for each finding that was opened (R30): ``natural_key, alert_type, severity, lease_id``.

    A finding that closes is in no later run, which resolves its alert (``run_alerts``).
    """
    lease = F.get(F.split("natural_key", ":"), F.lit(1)).try_cast("long")
    opened = changes.where("change = 'opened'")
    return opened.select(F.concat(F.lit("new_discrepancy:"), "natural_key").alias("natural_key"), F.lit("new_discrepancy").alias("alert_type"), F.coalesce("severity", F.lit("medium")).alias("severity"), lease.alias("lease_id"))


#: Every status and severity has a count, if none a zero.
STATUSES, SEVERITIES = ("open", "resolved"), ("high", "medium", "low")


def finding_summary(findings: DataFrame) -> DataFrame:
    """``scope, name, n`` by status, severity and type, in one pass; statuses and severities are all there."""
    sets = findings.groupingSets([["status"], ["severity"], ["discrepancy_type"]], "status", "severity", "discrepancy_type").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    scope = F.when(F.col("g") == 3, "status").when(F.col("g") == 5, "severity").otherwise("type")
    counts = sets.select(scope.alias("scope"), F.coalesce("status", "severity", "discrepancy_type").alias("name"), "n")
    domain = [("status", s) for s in STATUSES] + [("severity", s) for s in SEVERITIES]
    dense = findings.sparkSession.createDataFrame(domain, "scope string, name string")
    joined = counts.join(dense.withColumn("known", F.lit(True)), ["scope", "name"], "full_outer")
    return joined.select("scope", "name", F.coalesce("n", F.lit(0)).alias("n"))
