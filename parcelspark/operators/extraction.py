"""Quality of extracted values against truth, edits and earlier rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.functions import keys, parse


def values_match(field: Column, found: Column, expected: Column) -> Column:
    """Equality by kind of field: money within a dollar, dates, areas, rates and schedules; else keys that contain each other (X11)."""
    money = F.abs(parse.currency(found) - parse.currency(expected)) <= 1
    dates = parse.date(found) == parse.date(expected)
    area = parse.square_feet(found) == parse.square_feet(expected)
    rate = F.coalesce(F.abs(parse.percent(found) - parse.percent(expected)) < 0.01, parse.escalation_schedule(found) == parse.escalation_schedule(expected))
    a, b = keys.name_key(found), keys.name_key(expected)
    text = (a == b) | a.contains(b) | b.contains(a)
    by_kind = F.when(field.isin("rent_amount", "security_deposit", "cam_charges"), money).when(field.isin("lease_start_date", "lease_end_date"), dates).when(field == "square_footage", area).when(field == "rent_escalation", rate).otherwise(text)
    return F.when(found.isNull() & expected.isNull(), True).otherwise(F.coalesce(by_kind, F.lit(False)))


def accuracy(scores: DataFrame) -> DataFrame:
    """Correct shares by field, by confidence, and over all, in one pass of grouping sets.

    ``scores``: field, confidence, correct (boolean).
    """
    out = scores.groupingSets([["field"], ["confidence"], []], "field", "confidence").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    scope = F.when(F.col("gid") == 1, "field").when(F.col("gid") == 2, "confidence").otherwise("all")
    name = F.when(F.col("gid") == 1, F.col("field")).when(F.col("gid") == 2, F.col("confidence"))
    return out.select(scope.alias("scope"), name.alias("name"), "n", "n_correct", F.round(F.col("n_correct") * 100.0 / F.col("n"), 1).alias("accuracy_pct"))


def field_reliability(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """How often a field was found, and on how many leases people then changed it."""
    found = fields.where("value IS NOT NULL").groupBy("field").agg(F.count_distinct("lease_id").alias("had_value"))
    changed = edits.groupBy("field").agg(F.count_distinct("lease_id").alias("edited_leases"))
    rows = found.join(changed, "field", "left").fillna(0, ["edited_leases"])
    rate = F.round(F.col("edited_leases") * 100.0 / F.col("had_value"), 1)
    return rows.withColumn("edit_rate_pct", rate).withColumn("reliability", F.when(rate <= 5, "strong").when(rate <= 20, "mixed").otherwise("weak"))


def quality_trend(runs: DataFrame) -> DataFrame:
    """Runs, failures, mean latency of timed runs and change from the day before.

    ``runs``: day, failed (boolean), latency_ms.
    """
    timed = F.when(F.col("latency_ms") > 0, F.col("latency_ms"))
    by_day = runs.groupBy("day").agg(F.count("*").alias("runs"), F.round(F.count_if("failed") * 100.0 / F.count("*"), 2).alias("error_pct"), F.round(F.sum(timed.cast("decimal(18,3)")).cast("double") / F.count(timed), 1).alias("mean_latency_ms"))
    # Days are few after grouping: the one-partition window holds a row per day.
    return by_day.withColumn("error_change", F.round(F.col("error_pct") - F.lag("error_pct").over(Window.partitionBy(F.lit(0)).orderBy("day")), 2))


def merge_chunks(values: DataFrame) -> DataFrame:
    """Best value of each field over a document's chunks.

    By confidence, then the earliest page.  Values that differ lower the
    confidence and are listed.  ``values``: doc_id, field, value, confidence, page.
    """
    canon = F.regexp_replace(F.regexp_replace(F.lower(F.trim("value")), r"[$,]", ""), r"\.00$", "")
    rank = F.array_position(F.array(*map(F.lit, ("high", "medium", "low"))), F.col("confidence"))
    rows = values.where("value IS NOT NULL").withColumn("canon", canon).withColumn("rank", F.coalesce(F.nullif(rank, F.lit(0)), F.lit(9)))
    out = rows.groupBy("doc_id", "field").agg(F.min_by("value", F.struct("rank", "page", "value")).alias("value"), F.min_by("confidence", F.struct("rank", "page", "value")).alias("best"), F.array_sort(F.collect_set("canon")).alias("distinct_values"))
    many = F.size("distinct_values") > 1
    return out.select("doc_id", "field", "value", F.when(many, "low").otherwise(F.col("best")).alias("confidence"), F.when(many, F.array_join("distinct_values", " | ")).alias("alternatives"))


def scored(values: DataFrame) -> DataFrame:
    """Each extracted value beside the truth (A20, X11): ``correct``, what kind of outcome it is, and whether a claim was wrong.

    ``values``: doc_id, field, found, expected, confidence.
    """
    right = values_match(F.col("field"), F.col("found"), F.col("expected"))
    kind = (
        F.when(F.col("correct"), F.when(F.col("expected").isNotNull(), "correct_found").otherwise("correct_absent"))
        .when(F.col("expected").isNull(), "spurious").when(F.col("found").isNull(), "missed").otherwise("wrong")
    )
    return values.withColumn("correct", right).withColumn("kind", kind).withColumn("asserted_wrong", F.col("kind").isin("wrong", "spurious"))


def calibration(scores: DataFrame) -> DataFrame:
    """Shares of right claims by confidence, their gap from high to low, and the wrong claims (A20), over all and by field.

    Only values that were found are claims.  ``scope`` is ``all`` or a field's name.
    """
    claims = scores.where("found IS NOT NULL")

    def share(level):
        of = F.col("confidence") == level
        return F.round(F.try_divide(F.count_if(of & F.col("correct")), F.count_if(of)), 4)

    rows = claims.groupingSets([["field"], []], "field").agg(F.count("*").alias("claims"), F.count_if(~F.col("correct")).alias("wrong"), F.count_if(~F.col("correct") & (F.col("confidence") == "high")).alias("confident_wrong"), *[share(c).alias(f"p_{c}") for c in ("high", "medium", "low")], F.grouping_id().alias("g"))
    return rows.select(F.when(F.col("g") == 1, "all").otherwise(F.col("field")).alias("scope"), "claims", "wrong", "confident_wrong", "p_high", "p_medium", "p_low", F.round(F.col("p_high") - F.col("p_low"), 4).alias("calibration_gap"))


def confident_mistakes(scores: DataFrame) -> DataFrame:
    """Claims of high confidence that are wrong, for people to read."""
    return scores.where("found IS NOT NULL AND confidence = 'high' AND NOT correct").select("doc_id", "field", "found", "expected", "kind")
