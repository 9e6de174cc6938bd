"""Plain questions about leases, answered for a whole table of them.

What a question asks is read by column expressions; the answers are joins with
figures that are computed once, whatever the number of questions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions import keys
from parcelspark.operators import clauses
from parcelspark.operators.portfolio import day

#: Field -> words that name it, first match first.
FIELDS = {"rent": "rent", "deposit": "security deposit|deposit", "cam": "cam charges|cam", "sqft": "square footage|square feet|sqft|area", "end_date": "end date|expiration|expires?", "start_date": "start date|commencement|start", "tenant": "tenant"}
MONEY = ("rent", "deposit", "cam", "sqft")
HOW = {"sum": "total|sum", "avg": "average|mean", "max": "highest|largest|max(?:imum)?", "min": "lowest|smallest|min(?:imum)?"}
NUMBERS = {"a": 1} | {w: int(n) for w, n in clauses.NUMBERS.items() if n >= 1}


def _first_named(text: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(text.rlike(rf"\b(?:{p})\b"), F.lit(k)) for k, p in names.items()])


def timeframe(text: Column, as_of: str) -> Column:
    """``struct<first,last>`` of "next 18 months", "within 90 days", "this year", "next year", "in 2027"; null fields where there is none."""
    today = day(as_of)
    span = r"\b(?:next|within)\s+(?:the\s+next\s+)?(\d{1,4}|" + "|".join(sorted(NUMBERS, key=len, reverse=True)) + r")\s+(day|week|month|year)s?\b"
    said, unit = F.regexp_extract(text, span, 1), F.regexp_extract(text, span, 2)
    n = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in NUMBERS.items() for v in kv]), said), said.try_cast("int"))
    later = F.when(unit == "day", F.date_add(today, n)).when(unit == "week", F.date_add(today, n * 7)).when(unit == "month", F.add_months(today, n)).when(unit == "year", F.add_months(today, n * 12))
    year = F.when(text.contains("this year"), F.year(today)).when(text.contains("next year"), F.year(today) + 1).otherwise(F.regexp_extract(text, r"\bin (20\d\d)\b", 1).try_cast("int"))
    first = F.when(later.isNotNull() | text.contains("this year"), today).otherwise(F.make_date(year, F.lit(1), F.lit(1)))
    return F.struct(first.alias("first"), F.coalesce(later, F.make_date(year, F.lit(12), F.lit(31))).alias("last"))


def classified(questions: DataFrame, as_of: str) -> DataFrame:
    """``question_id, kind, field, how, first, last, who`` of ``questions (question_id, question)``.

    ``kind``: count, list, aggregate, lookup or unsupported; a null question is unsupported.
    """
    text = F.trim(F.lower(F.coalesce("question", F.lit(""))))
    rows = questions.select("question_id", text.alias("q"), _first_named(text, FIELDS).alias("field"), _first_named(text, HOW).alias("how"), timeframe(text, as_of).alias("t"))
    named = F.regexp_extract("q", r"\b(?:for|of) ([\w#&.' -]+)", 1)
    who = F.nullif(F.trim(F.regexp_replace(F.when(named != "", named).otherwise(F.regexp_extract("q", r"([\w#&.' -]+)'s\b", 1)), r"[^\w\s]", "")), F.lit(""))
    kind = (
        F.when(F.col("q").rlike(r"\bhow many\b|\bnumber of\b"), "count")
        .when(F.col("q").rlike(r"\bexpir|\bend(?:s|ing)?\b") & F.col("t.last").isNotNull(), "list")
        .when(F.col("how").isNotNull() & F.col("field").isin(*MONEY), "aggregate")
        .when(F.col("field").isNotNull() & who.isNotNull(), "lookup")
        .otherwise("unsupported")
    )
    return rows.select("question_id", kind.alias("kind"), "field", "how", "t.first", "t.last", who.alias("who"))


def _by_day(asked: DataFrame, leases: DataFrame) -> DataFrame:
    """``question_id, end_date, n`` for each day in a question's span: a join with days, which are few, not with leases."""
    days = leases.where("end_date IS NOT NULL").groupBy("end_date").agg(F.count("*").alias("n"))
    return asked.where("last IS NOT NULL").join(days, F.col("end_date").between(F.col("first"), F.col("last"))).select("question_id", "end_date", "n")


def answers(questions: DataFrame, leases: DataFrame, as_of: str) -> DataFrame:
    """``question_id, kind, value, leases`` of every question that has a figure for an answer; ``value`` is null for the others."""
    asked = classified(questions, as_of)
    spans = _by_day(asked.where("kind = 'count'"), leases).groupBy("question_id").agg(F.sum("n").alias("in_span"))
    figures = [F.struct(F.lit(f).alias("field"), F.lit(h).alias("how"), F.round(getattr(F, h)(F.col(f).cast("double")), 2).alias("figure"), F.count(f).alias("of")) for f in MONEY for h in HOW]
    whole = leases.agg(F.count("*").alias("everything"), F.array(*figures).alias("x"))
    table = whole.select("everything", F.explode("x").alias("x")).select(F.col("x.field").alias("f"), F.col("x.how").alias("h"), "x.figure", "x.of")
    rows = asked.join(spans, "question_id", "left").join(table, (F.col("kind") == "aggregate") & (F.col("field") == F.col("f")) & (F.col("how") == F.col("h")), "left")
    every = whole.select(F.lit("count").alias("k"), "everything")
    rows = rows.join(every, F.col("kind") == F.col("k"), "left")
    counted = F.when(F.col("last").isNotNull(), F.coalesce("in_span", F.lit(0))).otherwise(F.col("everything")).cast("double")
    return rows.select("question_id", "kind", F.when(F.col("kind") == "count", counted).otherwise(F.col("figure")).alias("value"), F.when(F.col("kind") == "aggregate", F.col("of")).alias("leases"))


def _source(leases: DataFrame) -> Column:
    """The file that an answer stands in, where leases know theirs."""
    return (F.col("filename") if "filename" in leases.columns else F.lit(None).cast("string")).alias("source")


def listed(questions: DataFrame, leases: DataFrame, as_of: str) -> DataFrame:
    """``question_id, lease_id, tenant, end_date, source``: the leases that questions of kind list ask for, with the file that says so."""
    days = _by_day(classified(questions, as_of).where("kind = 'list'"), leases).select("question_id", "end_date")
    return days.join(leases.select("lease_id", "tenant", "end_date", _source(leases)), "end_date").select("question_id", "lease_id", "tenant", "end_date", "source")


def looked_up(questions: DataFrame, leases: DataFrame, as_of: str) -> DataFrame:
    """``question_id, lease_id, tenant, value, source``: the asked field of leases whose tenant is, or begins with, the name in question."""
    asked = classified(questions, as_of).where("kind = 'lookup'").withColumn("word", F.substring_index("who", " ", 1))
    rows = leases.withColumn("key", keys.name_key("tenant")).withColumn("word", F.substring_index("key", " ", 1))
    values = {f: F.col(f).cast("string") for f in FIELDS}
    value = reduce(lambda out, f: out.when(F.col("field") == f, values[f]), list(FIELDS)[1:], F.when(F.col("field") == "rent", values["rent"]))
    joined = asked.select("question_id", "field", "who", "word").join(rows, "word").where((F.col("key") == F.col("who")) | F.col("key").startswith(F.concat("who", F.lit(" "))))
    return joined.select("question_id", "lease_id", "tenant", value.alias("value"), _source(leases))
