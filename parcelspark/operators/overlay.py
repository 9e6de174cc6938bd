"""Amendments over base leases, provenance, and version chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


MOST_ROUNDS = 40


def effective_fields(fields: DataFrame) -> DataFrame:
    """The last non-null value of each field of a base lease.

    ``fields``: base_lease_id, doc_id, uploaded_at, field, value.  A grouped
    ``max_by`` combines on the map side, so no window sorts a lease's fields.
    """
    at = F.when(F.col("value").isNotNull(), F.struct("uploaded_at", "doc_id"))
    return fields.groupBy("base_lease_id", "field").agg(F.max_by("value", at).alias("value"), F.max_by("doc_id", at).alias("source_doc_id"), F.count_distinct("doc_id").alias("documents"))


def provenance(fields: DataFrame) -> DataFrame:
    """Every stated value, with the one in force marked."""
    order = Window.partitionBy("base_lease_id", "field").orderBy(F.desc("uploaded_at"), F.desc("doc_id"))
    return fields.where("value IS NOT NULL").select("base_lease_id", "field", "doc_id", "value", (F.row_number().over(order) == 1).alias("is_effective"))


def version_chain(versions: DataFrame) -> DataFrame:
    """``lease_id, root_id, depth`` by following ``supersedes_lease_id`` to its end.

    Doubles the known path each round, so a chain of n needs log n joins.  A chain
    that runs in a circle has no root; ``MOST_ROUNDS`` doublings tell it, and raise.
    """
    steps = versions.select("lease_id", F.col("supersedes_lease_id").alias("up"), F.when(F.col("supersedes_lease_id").isNull(), 0).otherwise(1).alias("depth"))
    for _ in range(MOST_ROUNDS):
        above = steps.select(F.col("lease_id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        longer = steps.join(above, "up", "left").select("lease_id", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.when(F.col("further").isNotNull(), F.col("more")).otherwise(0)).alias("depth"), F.col("further").isNotNull().alias("grew"))
        longer = longer.cache()
        if longer.where("grew").isEmpty():
            return longer.select("lease_id", F.coalesce("up", "lease_id").alias("root_id"), "depth")
        steps = longer.drop("grew")
    raise ValueError("a lease supersedes itself")


def segments(starts: DataFrame, last_page: str = "pages") -> DataFrame:
    """Page ranges between sorted start pages: each ends before the next begins."""
    order = Window.partitionBy("doc_id").orderBy("start_page")
    return starts.select("doc_id", "start_page", (F.coalesce(F.lead("start_page").over(order), F.col(last_page) + 1) - 1).alias("end_page"))
