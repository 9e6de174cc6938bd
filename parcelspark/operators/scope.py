"""Scans with optional clauses, exclusions, edits, orders and small ledgers over lease records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.functions import keys

RESTRICTED = r"(?i)(?:^|_)(?:ssn|social_security|dob|birth)"
STALE_MINUTES = {"queued": 180, "processing": 20}


def in_scope(rows: DataFrame, equal: dict | None = None, at_least: dict | None = None, at_most: dict | None = None) -> DataFrame:
    """Rows that meet every clause whose value is given; a value of None is no clause."""
    tests = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    tests += [F.col(c) >= v for c, v in (at_least or {}).items() if v is not None]
    tests += [F.col(c) <= v for c, v in (at_most or {}).items() if v is not None]
    return reduce(DataFrame.where, tests, rows)


def touching(findings: DataFrame, ids: list[int]) -> DataFrame:
    """Findings with one of ``ids`` on either side (P5)."""
    return findings.where(F.col("lease_id").isin(ids) | F.col("related_lease_id").isin(ids))


def excluding(findings: DataFrame, done: DataFrame, key: str = "finding_id") -> DataFrame:
    """Findings whose id is not in ``done`` (P7); nulls in ``done`` exclude nothing, unlike NOT IN."""
    return findings.join(done.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def by_folded(rows: DataFrame, key: str) -> DataFrame:
    """Rows per value of ``key`` with case left aside, and the spelling that sorts first."""
    return rows.groupBy(F.lower(key).alias("folded")).agg(F.min(key).alias("spelling"), F.count("*").alias("n"))


def unrestricted(fields: DataFrame, name: str = "field") -> DataFrame:
    """Fields without those that hold personal numbers or birth dates."""
    return fields.where(~F.col(name).rlike(RESTRICTED))


def blank_as_null(c: Column) -> Column:
    """The empty text is NULL; white space stays."""
    return F.nullif(c, F.lit(""))


def looks_like_lease(leases: DataFrame) -> DataFrame:
    """Records with a tenant or a landlord."""
    return leases.where("tenant IS NOT NULL OR landlord IS NOT NULL")


def search(leases: DataFrame, text: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Leases that hold ``text`` in a name or address, of a known end between the bounds that are given."""
    wanted = F.lit(text.lower())
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(wanted), F.lit(False)) for c in ("filename", "tenant", "landlord", "property_address")])
    return in_scope(leases.where(hit), at_least={"end_date": first and F.lit(first).cast("date")}, at_most={"end_date": last and F.lit(last).cast("date")})


def pending_invites(invites: DataFrame, people: DataFrame, sent: DataFrame) -> DataFrame:
    """Invites not yet taken, with who invited and when last."""
    last = sent.groupBy("invite_id").agg(F.max("sent_at").alias("last_sent_at"))
    return invites.where("accepted_at IS NULL").join(people.select("person_id", "name"), F.col("invited_by") == F.col("person_id"), "left").join(last, "invite_id", "left").select("invite_id", F.col("name").alias("inviter"), "last_sent_at")


def placed(rows: DataFrame, within: list[str], *order: Column) -> DataFrame:
    """``nth`` of each row within its group, in a stated order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))


def severity_order(c: str = "severity") -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("high", "medium", "low"))), F.col(c)), F.lit(0)), F.lit(9))


def feed(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows, each with the number of all."""
    return rows.orderBy(*order).limit(most).withColumn("total", F.lit(rows.count()).cast("long"))


def supersede(leases: DataFrame, newer: DataFrame) -> DataFrame:
    """``status`` of leases that a newer one replaces becomes superseded (U5); ``newer``: supersedes_lease_id."""
    gone = newer.where("supersedes_lease_id IS NOT NULL").select(F.col("supersedes_lease_id").alias("__gone")).distinct()
    out = leases.join(gone, F.col("lease_id") == F.col("__gone"), "left")
    return out.withColumn("status", F.when(F.col("__gone").isNotNull(), "superseded").otherwise(F.col("status"))).drop("__gone")


def new_tasks(findings: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks for findings that have none yet (U9): title and priority come from the finding."""
    made = findings.select("finding_id", F.concat_ws(" ", F.lit("Review"), F.replace("category", F.lit("_"), F.lit(" "))).alias("title"), F.when(F.col("severity") == "high", "high").otherwise("normal").alias("priority"), F.lit("open").alias("status"))
    return made.join(tasks.select("finding_id"), "finding_id", "left_anti")


def decoded(records: DataFrame, column: str = "fields") -> DataFrame:
    """JSON records as maps; what is no JSON object is NULL."""
    return records.withColumn(column, F.from_json(column, "map<string,string>"))


def edited(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Records with the last edit of each field in place, and how many fields changed (Y2).

    ``records``: lease_id, fields map; ``edits``: lease_id, field, value, at, edit_id.
    The log is replayed by a grouped ``max_by``; an edit to NULL takes the field out.
    """
    last = edits.groupBy("lease_id", "field").agg(F.max_by(F.struct("value"), F.struct("at", "edit_id")).alias("x"))
    new = last.groupBy("lease_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("x.value").alias("value")))).alias("new"))
    none = F.create_map().cast("map<string,string>")
    rows = records.join(new, "lease_id", "left").withColumn("new", F.coalesce("new", none)).withColumn("old", F.coalesce("fields", none))
    kept = F.map_filter("old", lambda k, v: ~F.map_contains_key("new", k))
    changed = F.size(F.filter(F.map_keys("new"), lambda k: ~F.try_element_at("old", k).eqNullSafe(F.try_element_at("new", k))))
    return rows.select("lease_id", F.map_filter(F.map_concat(kept, "new"), lambda k, v: v.isNotNull()).alias("fields"), changed.alias("changed"))


def edit_audit(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Each edit with the value before it: the edit before, else the record's (Y2)."""
    order = Window.partitionBy("lease_id", "field").orderBy("at", "edit_id")
    rows = edits.select("*", F.lag(F.struct("value")).over(order).alias("before"))
    joined = rows.join(records.select("lease_id", "fields"), "lease_id", "left")
    old = F.when(F.col("before").isNotNull(), F.col("before.value")).otherwise(F.try_element_at("fields", "field"))
    return joined.select("edit_id", "lease_id", "field", old.alias("old_value"), F.col("value").alias("new_value"))


def job_states(events: DataFrame, as_of: str) -> DataFrame:
    """Where each job stands (V8): its last event; queued or processing for too long is stale.

    ``events``: job_id, state, at (timestamp).
    """
    last = events.groupBy("job_id").agg(F.max_by(F.struct("state", "at"), F.struct("at", "state")).alias("x")).select("job_id", "x.*")
    minutes = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("at").cast("timestamp"))) / 60
    limit = F.try_element_at(F.create_map(*[F.lit(v) for kv in STALE_MINUTES.items() for v in kv]), F.col("state"))
    return last.select("job_id", F.when(minutes > limit, "stale").otherwise(F.col("state")).alias("state"))


def word_rows(words: DataFrame, gap: float = 0.7) -> DataFrame:
    """Words of a page put into rows (S10): a step down of more than ``gap`` of the median height begins one.

    ``words``: page_id, word_id, x, y, height, text.  Gaps and islands: a lag,
    then a running count.
    """
    down = Window.partitionBy("page_id").orderBy("y", "x", "word_id")
    height = words.groupBy("page_id").agg(F.percentile("height", 0.5).alias("median"))
    rows = words.join(height, "page_id").withColumn("starts", F.coalesce((F.col("y") - F.lag("y").over(down) > F.col("median") * gap).cast("int"), F.lit(0)))
    rows = rows.withColumn("row", F.sum("starts").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("page_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "word_id", "text"))), lambda w: w["text"]).alias("cells"))


def looks_like_table(rows: DataFrame) -> DataFrame:
    """Pages with two rows of two filled cells, and a row with both a word and a number."""
    filled = F.size(F.filter("cells", lambda c: F.trim(c) != ""))
    mixed = F.exists("cells", lambda c: c.rlike("[A-Za-z]")) & F.exists("cells", lambda c: c.rlike("[0-9]"))
    return rows.groupBy("page_id").agg((F.count_if(filled >= 2) >= 2).alias("wide"), F.bool_or(mixed).alias("mixed")).select("page_id", (F.col("wide") & F.col("mixed")).alias("is_table"))


def block_cells(c: Column) -> Column:
    """Lines of a text block, cut at tabs and wide gaps (S12), cells cleaned."""
    lines = F.filter(F.split(c, r"\r?\n"), lambda x: F.trim(x) != "")
    return F.transform(lines, lambda line: F.transform(F.split(F.trim(line), r"\t|\s{2,}"), clean_cell))


def clean_cell(c: Column) -> Column:
    """A cell without stray rules and marks at its edges; white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^[\s|_~`]+|[\s|_~`]+$", ""), r"\s+", " "))


def tenant_alias(c: Column) -> Column:
    """Short form of a tenant (X8): no company suffix, first two words, of six characters or more."""
    words = F.filter(F.split(keys.name_key(c), " "), lambda w: ~w.isin("inc", "llc", "ltd", "corp", "co", "company", "lp"))
    alias = F.array_join(F.slice(words, 1, 2), " ")
    return F.when(F.length(alias) >= 6, alias)


def shown_money(c: Column, signed: bool = False) -> Column:
    """``$1,234.50``; with ``signed``, a sign before it."""
    plain = F.concat(F.lit("$"), F.format_number(F.abs(c), 2))
    return F.concat(F.when(c < 0, "-").otherwise("+" if signed else ""), plain)


def flattened(tables: DataFrame) -> DataFrame:
    """Cells of nested tables under dotted names (Y5): ``<table>.<row>.<column>``."""
    rows = tables.select("doc_id", "name", F.posexplode("rows").alias("row", "cells")).select("doc_id", "name", "row", F.explode("cells").alias("column", "value"))
    return rows.select("doc_id", F.concat_ws(".", "name", F.col("row").cast("string"), "column").alias("field"), "value")
