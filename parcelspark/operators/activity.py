"""Usage, traffic, messages and money over event logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Host of a referrer; NULL where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def traffic(views: DataFrame, key: str, top: int = 20) -> DataFrame:
    """Views and distinct sessions of the ``top`` most seen values of ``key``."""
    counts = views.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("views"), F.count_distinct("session_id").alias("sessions"))
    return counts.orderBy(F.desc("views"), key).limit(top)


def funnel(views: DataFrame, steps: list[str]) -> DataFrame:
    """Distinct sessions that saw each step."""
    order = F.array_position(F.array(*map(F.lit, steps)), F.col("path"))
    return views.where(F.col("path").isin(steps)).groupBy(order.alias("step"), F.col("path")).agg(F.count_distinct("session_id").alias("sessions"))


def daily(views: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Views per day of the last ``days``."""
    first = F.date_sub(F.lit(as_of).cast("date"), days)
    return views.where((F.to_date("ts") > first) & (F.to_date("ts") <= F.lit(as_of).cast("date"))).groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("views"), F.count_distinct("session_id").alias("sessions"))


def monthly_usage(events: DataFrame, unmetered: str = "dedup_reuse") -> DataFrame:
    """Events and pages per user and month, reuse left out."""
    rows = events.where(F.col("event_type") != unmetered)
    return rows.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("events"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))


def budget_alerts(costs: DataFrame, budget: float, levels: tuple[float, ...] = (0.5, 0.8)) -> DataFrame:
    """First event of each month at which running cost reaches each share of ``budget``.

    Costs are added up per day first, so the window per month is at most 31 rows.
    """
    by_day = costs.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), F.to_date("ts").alias("date")).agg(F.sum(F.col("cost").cast("decimal(18,4)")).alias("cost"))
    running = by_day.withColumn("spent", F.sum("cost").over(Window.partitionBy("month").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    rows = running.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).where(F.col("spent") >= F.col("level") * budget)
    return rows.groupBy("month", "level").agg(F.min("date").alias("reached_on"))


def user_stats(events: DataFrame, kinds: list[str]) -> DataFrame:
    """One column of counts per kind, for every user."""
    return events.groupBy("user_id").agg(*[F.count(F.when(F.col("event_type") == k, 1)).alias(k) for k in kinds], F.max("ts").alias("last_activity"))


def finance_summary(revenue: DataFrame, expenses: DataFrame) -> DataFrame:
    """Revenue, expense and profit of each month either has."""
    money = "decimal(18,2)"
    parts = [
        df.select(F.date_format("date", "yyyy-MM").alias("month"), *[(F.col("amount").cast(money) if n == own else F.lit(0).cast(money)).alias(n) for n in ("revenue", "expense")]) for df, own in ((revenue, "revenue"), (expenses, "expense"))
    ]
    sums = reduce(DataFrame.unionByName, parts).groupBy("month").agg(F.sum("revenue").alias("r"), F.sum("expense").alias("e"))
    return sums.select("month", F.col("r").cast("double").alias("revenue"), F.col("e").cast("double").alias("expense"), (F.col("r") - F.col("e")).cast("double").alias("profit"))


def over_rate(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """Events with ``most`` or more earlier ones of their key within ``seconds`` (V3): denied hits count too.

    A pure function of arrivals, so a range window gives it.  A key's events are cut
    into spans of that length, each beside the one before it, so that a key with
    many events is dealt to many tasks.
    """
    width, name = seconds * 1_000_000, "__span"
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    own = F.floor(at / F.lit(width))
    near = F.when(own.isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(own, own + 1))
    copies = events.select("*", F.explode(near).alias(name))
    earlier = Window.partitionBy("user_id", name).orderBy(at).rangeBetween(-width + 1, -1)
    counted = copies.withColumn("earlier", F.count("*").over(earlier)).where(F.col(name).eqNullSafe(own)).drop(name)
    return counted.withColumn("limited", F.col("earlier") >= most)


def unread(messages: DataFrame, reads: DataFrame) -> DataFrame:
    """Unread messages per thread and reader; threads without any do not appear."""
    joined = messages.join(reads, "thread_id").where((F.col("sender") != F.col("reader")) & (F.col("last_read").isNull() | (F.col("sent") > F.col("last_read"))))
    return joined.groupBy("thread_id", "reader").agg(F.count("*").alias("unread"))


def shared_threads(participants: DataFrame, a: str, b: str) -> DataFrame:
    """Threads that both people take part in."""
    rows = participants.select("thread_id", "person").distinct()
    return rows.where(F.col("person") == a).select("thread_id").join(rows.where(F.col("person") == b).select("thread_id"), "thread_id")


def latest_threads(messages: DataFrame) -> DataFrame:
    """Threads with their last message."""
    return messages.groupBy("thread_id").agg(F.max("sent").alias("last_sent"), F.max_by("sender", "sent").alias("last_sender"), F.count("*").alias("messages"))


def new_since(rows: DataFrame, viewed: DataFrame) -> DataFrame:
    """Rows first detected after their user's last view; without a view, all."""
    return rows.join(viewed, "user_id", "left").where(F.col("last_viewed_at").isNull() | (F.col("ts") > F.col("last_viewed_at"))).drop("last_viewed_at")


def team_overview(teams: DataFrame, users: DataFrame, leases: DataFrame, activity: DataFrame) -> DataFrame:
    """Users, leases and last activity of each team, none lost (J16): three grouped sides joined."""
    u = users.groupBy("team_id").agg(F.count("*").alias("users"))
    n = leases.groupBy("team_id").agg(F.count("*").alias("leases"))
    a = activity.groupBy("team_id").agg(F.max("at").alias("last_activity"))
    return teams.join(u, "team_id", "left").join(n, "team_id", "left").join(a, "team_id", "left").fillna(0, ["users", "leases"])


def tasks_in_order(tasks: DataFrame) -> DataFrame:
    """High priority first, then by due date, undated last (O2)."""
    return tasks.orderBy(F.col("priority") != "high", F.asc_nulls_last("due_date"), "created_at", "task_id")


def today_counts(sources: dict[str, DataFrame]) -> DataFrame:
    """How many open items each source holds."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("source"), "n") for k, df in sources.items()])
