"""Rent concessions: pricing what clauses grant, and effective rents; all in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions import parse
from parcelspark.operators import clauses
from parcelspark.operators.clauses import ITEM as ITEM
from parcelspark.operators.portfolio import day


def with_items(leases: DataFrame, text: str = "concessions") -> DataFrame:
    """Leases with their concession items (R24); a null clause has none."""
    return leases.withColumn("items", clauses.items(F.col(text)))


def _worth(x: Column, rent: Column) -> Column:
    """An item's dollars, a month or once: as stated, a share of the rent, or what is left of it off the rent."""
    return F.coalesce(x["amount"], rent * x["percent"] / 100, F.greatest(rent - x["reduced_to"], F.lit(0.0)))


def priced(leases: DataFrame, as_of: str) -> DataFrame:
    """Each item with its window, total value and state on ``as_of``.

    A value is NULL where rent or months are unknown.
    """
    today, rent = day(as_of), F.col("rent").cast("double")
    term = F.coalesce(parse.term_months(F.col("start_date"), F.col("end_date")), F.lit(12))
    rows = leases.select("team_id", "lease_id", "rent", "start_date", "end_date", term.alias("term"), F.posexplode("items").alias("item_no", "x"))
    months = F.when(F.col("x.kind") == "recurring_discount", F.coalesce("x.months", F.col("term"))).otherwise(F.col("x.months"))
    worth = _worth(F.col("x"), rent)
    value = F.when(F.col("x.kind") == "free_rent", months * rent).when(F.col("x.kind") == "recurring_discount", months * worth).otherwise(worth)
    whole = F.ceil(F.coalesce(months, F.lit(1.0))).cast("int")
    late = F.col("x.position") == "last"
    begin = F.when(late, F.date_add(F.add_months("end_date", -whole), 1)).otherwise(F.col("start_date"))
    end = F.when(late, F.col("end_date")).otherwise(F.date_sub(F.add_months("start_date", whole), 1))
    state = F.when(begin.isNull() | end.isNull(), "unknown").when(today < begin, "upcoming").when(today > end, "ended").otherwise("active")
    return rows.select("team_id", "lease_id", "item_no", "x.kind", months.alias("months"), F.round(value, 2).alias("total_value"), begin.alias("begins"), end.alias("ends"), state.alias("state"), "rent", "term", worth.alias("amount"), "end_date")


def effective_rents(leases: DataFrame, as_of: str) -> DataFrame:
    """Base, net effective and current rent of leases with concessions.

    NULL unless every item has a price.  Net effective spreads the total over
    the term; current is what is due on ``as_of``.
    """
    rows = priced(leases, as_of)
    all_known = F.bool_and(F.col("total_value").isNotNull())
    now = F.when(F.col("state") == "active", F.when(F.col("kind") == "free_rent", F.col("rent").cast("double")).when(F.col("kind") == "recurring_discount", F.col("amount")).otherwise(0.0)).otherwise(0.0)
    sums = rows.groupBy("team_id", "lease_id").agg(F.count("*").alias("items"), all_known.alias("known"), F.sum("total_value").alias("total"), F.first("rent").cast("double").alias("base"), F.first("term").alias("term"), F.sum(now).alias("now"))
    known = F.col("known") & F.col("base").isNotNull()
    return sums.select(
        "team_id",
        "lease_id",
        "items",
        F.when(F.col("known"), F.round("total", 2)).alias("total_concession"),
        F.round("base", 2).alias("base_rent"),
        F.when(known, parse.cents(F.col("base") - F.col("total") / F.col("term"))).alias("net_effective_rent"),
        F.when(known, F.round(F.greatest(F.col("base") - F.col("now"), F.lit(0.0)), 2)).alias("current_rent"),
        F.when(F.col("known"), parse.cents(F.col("total") / F.col("term") * 12)).alias("annualized_value"),
        F.when(F.col("known"), parse.cents(F.col("total") / F.col("term"))).alias("monthly_value"),
    )


def ending_soon(leases: DataFrame, as_of: str, within: int = 90) -> DataFrame:
    """Active concessions that end within ``within`` days, with the rent that returns."""
    left = F.datediff("ends", day(as_of))
    rows = priced(leases, as_of).where((F.col("state") == "active") & left.between(0, within))
    back = F.when(F.col("kind") == "free_rent", F.col("rent").cast("double")).otherwise(F.col("amount"))
    return rows.select("team_id", "lease_id", "item_no", "kind", "ends", left.alias("days_left"), F.round(back, 2).alias("monthly_change"))


def effective(as_of: str) -> Column:
    """``struct<items,base,net,current,monthly,yearly,step,lost>`` of a lease with ``items`` (R20, R26), without leaving its row.

    The first five after ``items`` are NULL unless every item has a price, as in
    ``effective_rents``.  ``step``: what comes back when active discounts end before
    the lease does; ``lost``: that for each month after it within the term and the
    twelve months from ``as_of``.
    """
    today, rent = day(as_of), F.col("rent").cast("double")
    term = F.coalesce(parse.term_months(F.col("start_date"), F.col("end_date")), F.lit(12))
    start, end = F.col("start_date"), F.col("end_date")

    def month(c):
        return F.year(c) * 12 + F.month(c)

    def item(x):
        recurring, free = x["kind"] == "recurring_discount", x["kind"] == "free_rent"
        months = F.when(recurring, F.coalesce(x["months"], term)).otherwise(x["months"])
        amount = F.when(free, rent).otherwise(_worth(x, rent))
        whole = F.ceil(F.coalesce(months, F.lit(1.0))).cast("int")
        late = x["position"] == "last"
        begins = F.when(late, F.date_add(F.add_months(end, -whole), 1)).otherwise(start)
        ends = F.when(late, end).otherwise(F.date_sub(F.add_months(start, whole), 1))
        active = F.coalesce((begins <= today) & (today <= ends), F.lit(False))
        burns = recurring & active & F.coalesce(ends < end, F.lit(True))
        after = F.least(month(today) + 11, F.coalesce(month(end), month(today) + 11)) - month(ends)
        return F.struct(
            F.round(F.when(free | recurring, months * amount).otherwise(amount), 2).alias("total"),
            F.when(active & (free | recurring), amount).otherwise(0.0).alias("now"),
            F.when(burns, amount).otherwise(0.0).alias("step"),
            F.when(burns, amount * F.greatest(F.lit(0), F.least(F.lit(12), after))).otherwise(0.0).alias("lost"),
        )

    def summed(items, name):
        return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x[name])

    def whole(items):
        known = F.forall(items, lambda x: x["total"].isNotNull())
        total, priced_now = summed(items, "total"), known & rent.isNotNull()
        return F.struct(
            F.size(items).alias("items"),
            F.round(rent, 2).alias("base"),
            F.when(priced_now, parse.cents(rent - total / term)).alias("net"),
            F.when(priced_now, F.round(F.greatest(rent - summed(items, "now"), F.lit(0.0)), 2)).alias("current"),
            F.when(known, parse.cents(total / term)).alias("monthly"),
            F.when(known, parse.cents(total / term * 12)).alias("yearly"),
            summed(items, "step").alias("step"),
            summed(items, "lost").alias("lost"),
        )

    return F.when(F.size("items") > 0, parse.let(F.transform("items", item), whole))


def missing(leases: DataFrame, as_of: str) -> DataFrame:
    """The lease concedes, and the roll shows its full rent and no concession.

    A roll that shows the net or current rent reflects the concession; one below
    the base rent otherwise is a rent mismatch.  What has no price has no impact,
    as has a clause that states a concession nobody could read.
    """
    from parcelspark.operators import reconcile

    return reconcile.findings(leases, as_of, ("concession_missing",))


def mismatched(leases: DataFrame, as_of: str) -> DataFrame:
    """The roll shows a concession that is neither the lease's monthly share nor what is off the rent now.

    A lease that concedes nothing counts as 0, one that cannot be read as unknown.
    """
    from parcelspark.operators import reconcile

    return reconcile.findings(leases, as_of, ("concession_mismatch",))


def expiring(leases: DataFrame, as_of: str) -> DataFrame:
    """The roll shows a discounted rent whose discount ends before the lease does."""
    from parcelspark.operators import reconcile

    return reconcile.findings(leases, as_of, ("concession_expiring",))
