"""Queries of concessions, statements and questions, and SQL for folds of ``catalog``; see there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.operators import concessions, questions, reconcile
from parcelspark.plans import catalog
from parcelspark.plans.catalog import FINDING_SQL, SQL, clause, conceded, query
from parcelspark.plans.project import AS_OF, LEASE_SQL, leases, read

#: A day by which most terms have ended.
LATER = "2001-06-01"


@query(FINDING_SQL.replace(AS_OF, LATER) + " SELECT * FROM gone")
def expired_but_occupied_later(spark, sf_dir):
    return reconcile.expired_but_occupied(leases(spark, sf_dir), LATER)


# --- concessions ---------------------------------------------------------------------------------

CONCEDED = f"""c0 AS (SELECT *, lease_id % 5 AS c, rent::DOUBLE AS base, greatest(1, round_even((date_diff('day', start_date, end_date) + 1) / 30.4375::DOUBLE, 0)) AS term FROM leases),
 c1 AS (SELECT *, CASE c WHEN 1 THEN round(2 * base, 2) WHEN 2 THEN 900.0::DOUBLE WHEN 3 THEN 500.0::DOUBLE WHEN 4 THEN round(base, 2) END AS total, CASE WHEN c = 4 THEN CAST(CAST(end_date - INTERVAL 1 MONTH AS DATE) + 1 AS DATE) ELSE start_date END AS begins,
   CASE WHEN c = 4 THEN end_date ELSE CAST(CAST(start_date + to_months(CASE c WHEN 1 THEN 2 WHEN 2 THEN 6 ELSE 1 END) AS DATE) - 1 AS DATE) END AS ends FROM c0 WHERE c <> 0),
 c2 AS (SELECT *, coalesce(begins <= DATE '{AS_OF}' AND DATE '{AS_OF}' <= ends, FALSE) AS active FROM c1),
 eff AS (SELECT *, CASE WHEN total IS NOT NULL AND base IS NOT NULL THEN round(CAST(base - total / term AS DECIMAL(18,6)), 2)::DOUBLE END AS net, CASE WHEN total IS NOT NULL AND base IS NOT NULL THEN round(greatest(base - CASE WHEN NOT active THEN 0 WHEN c IN (1, 4) THEN base WHEN c = 2 THEN 150 ELSE 0 END, 0), 2) END AS cur,
   CASE WHEN total IS NOT NULL THEN round(CAST(total / term * 12 AS DECIMAL(18,6)), 2)::DOUBLE END AS yearly, CASE WHEN total IS NOT NULL THEN round(CAST(total / term AS DECIMAL(18,6)), 2)::DOUBLE END AS monthly FROM c2)"""

SQL["effective_rents"] = "WITH " + LEASE_SQL + ", " + CONCEDED + " SELECT team_id, lease_id, 1::BIGINT AS items, CASE WHEN total IS NOT NULL THEN round(total, 2) END AS total_concession, round(base, 2) AS base_rent, net AS net_effective_rent, cur AS current_rent, yearly AS annualized_value, monthly AS monthly_value FROM eff"

SQL["concessions_ending"] = "WITH " + LEASE_SQL + ", " + CONCEDED + f""" SELECT team_id, lease_id, 0 AS item_no, CASE c WHEN 2 THEN 'recurring_discount' WHEN 3 THEN 'one_time_credit' ELSE 'free_rent' END AS kind, ends, CAST(date_diff('day', DATE '{AS_OF}', ends) AS INTEGER) AS days_left,
 round(CASE c WHEN 2 THEN 150.0::DOUBLE WHEN 3 THEN 500.0::DOUBLE ELSE base END, 2) AS monthly_change FROM eff WHERE active AND date_diff('day', DATE '{AS_OF}', ends) BETWEEN 0 AND 90"""


def deal(spark, sf_dir) -> DataFrame:
    """Documents with clauses, each the only one of its unit, and rolls for a third of them with rents and concession columns of their own."""
    k = F.col("lease_id")
    none = F.lit(None).cast("double")
    docs = conceded(spark, sf_dir).where("NOT is_rent_roll").withColumn("unit_key", F.concat(F.lit("u"), k.cast("string"))).withColumn("roll_concession", none)
    rent = F.when(k % 4 == 1, F.col("rent") - 150).when(k % 4 == 3, F.col("rent") * 2).otherwise(F.col("rent")).cast("decimal(18,2)")
    shown = F.when(k % 7 == 1, 0.0).when(k % 7 == 2, 150.0).when(k % 7 == 3, 75.0).when(k % 7 == 5, 40.0)
    rolls = docs.where(k % 3 == 1).withColumns({"rent": rent, "roll_concession": shown, "is_rent_roll": F.lit(True), "items": F.lit(None).cast(concessions.ITEM)})
    return docs.unionByName(rolls.withColumn("lease_id", k + 1_000_000_000))


def _differs(a: str, b: str) -> str:
    return f"(abs({a} - {b}) > 5 AND coalesce(abs({a} - {b}) * 100 / nullif(greatest(abs({a}), abs({b})), 0), 0) > 1)"


def _severity(m: str) -> str:
    return f"CASE WHEN {m} IS NULL THEN 'medium' WHEN {m} >= 1000 THEN 'high' WHEN {m} >= 250 THEN 'medium' ELSE 'low' END"


PAIRED = CONCEDED + f""", p AS (SELECT d.team_id, 'u' || d.lease_id AS unit_key, d.lease_id + 1000000000 AS roll_lease_id, d.lease_id AS doc_lease_id, d.end_date, CASE d.lease_id % 4 WHEN 1 THEN d.rent - 150 WHEN 3 THEN d.rent * 2 ELSE d.rent END::DOUBLE AS rr,
   CASE d.lease_id % 7 WHEN 1 THEN 0.0 WHEN 2 THEN 150.0 WHEN 3 THEN 75.0 WHEN 5 THEN 40.0 END::DOUBLE AS rc, e.c, e.base, e.net, e.cur, e.yearly, e.monthly, e.active, e.ends FROM leases d LEFT JOIN eff e USING (lease_id) WHERE NOT d.is_rent_roll AND d.lease_id % 3 = 1 AND coalesce(d.end_date >= DATE '{AS_OF}', TRUE))"""
HEAD = "team_id, unit_key, roll_lease_id, doc_lease_id"


@query(PAIRED + f""" SELECT {HEAD}, 'concession_missing' AS discrepancy_type, 'concessions' AS field, round(monthly, 2) AS monthly_impact, round(yearly, 2) AS annual_impact, 'overstate' AS income_direction, {_severity('monthly')} AS severity FROM p
 WHERE c IS NOT NULL AND coalesce(rc, 0) = 0 AND NOT coalesce(({_differs('rr', 'base')} AND (NOT {_differs('rr', 'net')} OR NOT {_differs('rr', 'cur')})) OR (rr < base AND {_differs('rr', 'base')}), FALSE)""")
def concession_missing(spark, sf_dir):
    return concessions.missing(deal(spark, sf_dir), AS_OF)


@query(PAIRED + f""", m AS (SELECT *, CASE WHEN c IS NULL THEN 0.0 ELSE monthly END AS share, round(base - cur, 2) AS off FROM p WHERE rc <> 0) SELECT {HEAD}, 'concession_mismatch' AS discrepancy_type, 'concessions' AS field, round(abs(share - rc), 2) AS monthly_impact, round(abs(share - rc) * 12, 2) AS annual_impact,
 CASE WHEN share > rc THEN 'overstate' WHEN share - rc IS NOT NULL THEN 'understate' END AS income_direction, {_severity('abs(share - rc)')} AS severity FROM m WHERE NOT coalesce(NOT {_differs('rc', 'share')} OR (off <> 0 AND NOT {_differs('rc', 'off')}), FALSE)""")
def concession_mismatch(spark, sf_dir):
    return concessions.mismatched(deal(spark, sf_dir), AS_OF)


@query(PAIRED + f""", x AS (SELECT *, 150.0::DOUBLE * greatest(0, least(12, least(1999 * 12 + 12, coalesce(year(end_date) * 12 + month(end_date), 1999 * 12 + 12)) - (year(ends) * 12 + month(ends)))) AS lost FROM p WHERE c = 2 AND active AND coalesce(ends < end_date, TRUE))
 SELECT {HEAD}, 'concession_expiring' AS discrepancy_type, 'concessions' AS field, 150.0::DOUBLE AS monthly_impact, round(lost, 2) AS annual_impact, 'understate' AS income_direction, 'low' AS severity FROM x WHERE cur < base AND NOT {_differs('rr', 'cur')} AND lost > 0""")
def concession_expiring(spark, sf_dir):
    return concessions.expiring(deal(spark, sf_dir), AS_OF)


# --- statements ----------------------------------------------------------------------------------


def yearly_statements(spark, sf_dir) -> DataFrame:
    rows = leases(spark, sf_dir).groupBy("team_id", "building_key").agg(F.sum(F.when(F.col("is_rent_roll"), F.col("rent"))).cast("double").alias("r"), F.sum("deposit").cast("double").alias("gross_potential"), F.sum("cam").cast("double").alias("c"))
    t = F.col("team_id")
    return rows.select("team_id", "building_key", (F.col("r") * 12 * (0.9 + (t % 3) * 0.06)).alias("rental_income"), "gross_potential", (F.col("gross_potential") * -0.02 * (1 + t)).alias("vacancy_loss"), F.when(t != 2, -F.col("c")).otherwise(0.0).alias("concessions"))


YEARLY = """y AS (SELECT team_id, building_key, (sum(rent) FILTER (is_rent_roll))::DOUBLE * 12 * (0.9::DOUBLE + (team_id % 3) * 0.06::DOUBLE) AS income, sum(deposit)::DOUBLE AS gross, sum(deposit)::DOUBLE * -0.02::DOUBLE * (1 + team_id) AS vacancy, CASE WHEN team_id <> 2 THEN -(sum(cam)::DOUBLE) ELSE 0.0 END AS given FROM leases GROUP BY team_id, building_key),
 u AS (SELECT team_id, building_key, (sum(rent) * 12)::DOUBLE AS roll, count(tenant) AS occ, count(*) AS units FROM leases WHERE is_rent_roll GROUP BY team_id, building_key)"""


@query(YEARLY + f""" SELECT team_id, building_key, round(roll, 2) AS roll_annual, round(income, 2) AS stated_annual, round((roll - income) / 12, 2) AS monthly_impact, round(roll - income, 2) AS annual_impact, 'overstate' AS income_direction, {_severity('(roll - income) / 12')} AS severity FROM u JOIN y USING (team_id, building_key) WHERE roll > income AND (roll - income) / greatest(roll, income) * 100 > 5""")
def t12_income_gap(spark, sf_dir):
    return reconcile.t12_income_gap(leases(spark, sf_dir), yearly_statements(spark, sf_dir))


@query(YEARLY + """, g AS (SELECT team_id, building_key, occ::DOUBLE / units * 100 AS a, (1 - abs(vacancy) / abs(gross)) * 100 AS b FROM u JOIN y USING (team_id, building_key) WHERE vacancy IS NOT NULL AND gross <> 0) SELECT team_id, building_key, round(a, 1) AS roll_pct, round(b, 1) AS stated_pct, 'medium' AS severity FROM g WHERE abs(a - b) > 5""")
def t12_occupancy_gap(spark, sf_dir):
    return reconcile.t12_occupancy_gap(leases(spark, sf_dir), yearly_statements(spark, sf_dir))


@query(YEARLY + " SELECT team_id, building_key, round(abs(given), 2) AS stated_annual, 'low' AS severity FROM y WHERE round(abs(given), 2) > 0")
def t12_concessions(spark, sf_dir):
    return reconcile.t12_concessions(yearly_statements(spark, sf_dir))


# --- the whole report ----------------------------------------------------------------------------


def reported(spark, sf_dir) -> DataFrame:
    """Documents, each the only one of its unit, with clauses of five shapes; rolls for a third of them, and some alone.

    Rolls write the same household in another way than documents, but for some
    that name another; their rents and dates agree, or are off in several ways.
    """
    k = F.col("lease_id")
    stranger = F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    stated = F.when(k % 10 == 0, "Concessions as agreed between the parties.").otherwise(clause())
    docs = leases(spark, sf_dir).where("NOT is_rent_roll").withColumns({"unit_key": F.concat(F.lit("u"), k.cast("string")), "roll_concession": F.lit(None).cast("double"), "concessions": stated})
    rent = F.when(k % 4 == 1, F.col("rent") - 150).when(k % 4 == 3, F.col("rent") * 2).otherwise(F.col("rent")).cast("decimal(18,2)")
    shown = F.when(k % 7 == 1, 0.0).when(k % 7 == 2, 150.0).when(k % 7 == 3, 75.0).when(k % 7 == 5, 40.0)
    tenant = F.when(k % 11 == 1, stranger).when(F.col("team_id") % 2 == 0, F.coalesce("tenant", stranger)).otherwise(F.col("tenant"))
    dates = {"start_date": F.date_add("start_date", (k % 13 == 1).cast("int")), "end_date": F.date_add("end_date", (k % 17 == 1).cast("int"))}
    rolls = docs.withColumns({"rent": rent, "tenant": tenant, "roll_concession": shown, "is_rent_roll": F.lit(True), "concessions": F.lit(None).cast("string"), **dates})
    met = rolls.where(k % 3 == 1).withColumn("lease_id", k + 1_000_000_001)
    alone = rolls.where((k % 3 == 2) & (k % 5 == 1)).withColumns({"lease_id": k + 2_000_000_001, "unit_key": F.concat(F.lit("x"), k.cast("string"))})
    return concessions.with_items(catalog.households(docs.unionByName(met).unionByName(alone)))


def bad_debts(spark, sf_dir) -> DataFrame:
    """Twelve months of a building's bad debt, rising in some teams."""
    rows = leases(spark, sf_dir).groupBy("team_id", "building_key", F.month("start_date").alias("month_idx")).agg(F.sum("cam").cast("double").alias("c"))
    return rows.select("team_id", "building_key", "month_idx", (F.col("c") * (1 + F.col("month_idx") * F.col("team_id") * 0.08)).alias("amount"))


_ROLL = """'u' || lease_id AS unit_key, lease_id + 1000000001 AS lease_id, TRUE AS is_rent_roll, CASE WHEN lease_id % 11 = 1 OR (team_id % 2 = 0 AND tenant IS NULL) THEN 'Customer#' || lpad(CAST(lease_id AS VARCHAR), 9, '0') ELSE tenant END AS tenant,
   CASE lease_id % 4 WHEN 1 THEN rent - 150 WHEN 3 THEN CAST(rent * 2 AS DECIMAL(18,2)) ELSE rent END AS rent, start_date + (lease_id % 13 = 1)::INT AS start_date, end_date + (lease_id % 17 = 1)::INT AS end_date"""
_REFLECTS = f"(coalesce(cur IS NOT NULL AND {_differs('cur', 'base')} AND NOT {_differs('rr', 'cur')}, FALSE) OR coalesce(net IS NOT NULL AND {_differs('net', 'base')} AND NOT {_differs('rr', 'net')}, FALSE))"
REPORT_SQL = CONCEDED + f""", deal_leases AS (SELECT * REPLACE ('u' || lease_id AS unit_key) FROM leases WHERE NOT is_rent_roll UNION ALL SELECT * REPLACE ({_ROLL}) FROM leases WHERE NOT is_rent_roll AND lease_id % 3 = 1
   UNION ALL SELECT * REPLACE ({_ROLL.replace("'u' ||", "'x' ||").replace("+ 1000000001", "+ 2000000001")}) FROM leases WHERE NOT is_rent_roll AND lease_id % 3 = 2 AND lease_id % 5 = 1),
 """ + catalog.HOUSEHOLD_SQL.replace("FROM leases", "FROM deal_leases") + f""", p AS (SELECT pairs.*, CASE doc_lease_id % 7 WHEN 1 THEN 0.0 WHEN 2 THEN 150.0 WHEN 3 THEN 75.0 WHEN 5 THEN 40.0 ELSE 0.0 END::DOUBLE AS rc, doc_lease_id % 10 = 0 AS unread, coalesce(de >= DATE '{AS_OF}', TRUE) AS runs, e.c, e.base, e.net, e.cur, e.yearly, e.monthly, e.active, e.ends, CASE WHEN e.c IS NOT NULL THEN e.monthly WHEN doc_lease_id % 10 <> 0 THEN 0.0 END AS share, round(e.base - e.cur, 2) AS off FROM pairs LEFT JOIN eff e ON doc_lease_id = e.lease_id),
 y2 AS (SELECT *, CASE WHEN c = 2 AND active AND coalesce(ends < de, TRUE) THEN 150.0 ELSE 0.0 END AS step FROM p),
 z AS (SELECT *, step * greatest(0, least(12, least(1999 * 12 + 12, coalesce(year(de) * 12 + month(de), 1999 * 12 + 12)) - (year(ends) * 12 + month(ends)))) AS lost FROM y2),
 """ + YEARLY + """, u2 AS (SELECT team_id, building_key, (sum(rent) * 12)::DOUBLE AS roll, count(tenant) AS occ, count(*) AS units FROM deal_leases WHERE is_rent_roll GROUP BY team_id, building_key),
 bm AS (SELECT team_id, building_key, month(start_date) AS mo, sum(cam)::DOUBLE * (1 + month(start_date) * team_id * 0.08::DOUBLE) AS amount FROM leases WHERE cam IS NOT NULL GROUP BY team_id, building_key, month(start_date)),
 bd AS (SELECT team_id, building_key, avg(amount) AS mean, avg(amount) FILTER (mo > 9) AS last FROM bm GROUP BY team_id, building_key HAVING count(*) >= 12),
 tw AS (SELECT team_id, building_key, roll, income, given, gross, occ, units, occ * 100.0::DOUBLE / units - (1 - abs(vacancy) / nullif(abs(gross), 0)) * 100 AS shares, mean, last FROM y JOIN u2 USING (team_id, building_key) LEFT JOIN bd USING (team_id, building_key)),
 every AS (SELECT team_id, 'rent_mismatch' AS kind, round(abs(rr - dn), 2) AS m, round(round(abs(rr - dn), 2) * 12, 2) AS a, CASE WHEN rr > dn THEN 'overstate' ELSE 'understate' END AS dir, NULL AS sev FROM z WHERE """ + f"""{_differs('rr', 'dn')} AND NOT {_REFLECTS}
   UNION ALL SELECT team_id, 'expired_but_occupied', rr, round(rr * 12, 2), 'overstate', NULL FROM z WHERE de < DATE '{AS_OF}' AND rt IS NOT NULL
   UNION ALL SELECT team_id, 'unit_no_lease', rent::DOUBLE, round(rent::DOUBLE * 12, 2), NULL, NULL FROM deal_leases WHERE unit_key[1] = 'x'
   UNION ALL SELECT team_id, 'lease_no_unit', rent::DOUBLE, round(rent::DOUBLE * 12, 2), CASE WHEN rent IS NOT NULL THEN 'understate' END, NULL FROM deal_leases WHERE NOT is_rent_roll AND lease_id % 3 <> 1
   UNION ALL SELECT team_id, 'concession_missing', monthly, round(yearly, 2), 'overstate', NULL FROM z WHERE runs AND c IS NOT NULL AND rc = 0 AND NOT {_REFLECTS} AND NOT coalesce(rr < base AND {_differs('rr', 'base')}, FALSE)
   UNION ALL SELECT team_id, 'concession_missing', NULL, NULL, 'overstate', 'medium' FROM z WHERE runs AND unread AND rc = 0
   UNION ALL SELECT team_id, 'concession_mismatch', round(abs(share - rc), 2), round(abs(share - rc) * 12, 2), CASE WHEN share > rc THEN 'overstate' WHEN share <= rc THEN 'understate' END, NULL FROM z WHERE runs AND rc <> 0 AND NOT coalesce(NOT {_differs('rc', 'share')}, FALSE) AND NOT coalesce(off <> 0 AND NOT {_differs('rc', 'off')}, FALSE)
   UNION ALL SELECT team_id, 'concession_expiring', step, round(lost, 2), 'understate', NULL FROM z WHERE runs AND cur < base AND NOT {_differs('rr', 'cur')} AND lost > 0
   UNION ALL SELECT team_id, 'dates_mismatch', NULL, NULL, NULL, 'medium' FROM z WHERE rs <> ds UNION ALL SELECT team_id, 'dates_mismatch', NULL, NULL, NULL, 'medium' FROM z WHERE re <> de UNION ALL SELECT team_id, 'tenant_mismatch', NULL, NULL, NULL, 'high' FROM z WHERE rt <> dt
   UNION ALL SELECT team_id, 't12_income_gap', (roll - income) / 12, round(roll - income, 2), 'overstate', NULL FROM tw WHERE roll > income AND (roll - income) / greatest(roll, income) * 100 > 5
   UNION ALL SELECT team_id, 't12_occupancy_mismatch', NULL, NULL, NULL, 'medium' FROM tw WHERE abs(shares) > 5 UNION ALL SELECT team_id, 't12_concession_gap', NULL, NULL, NULL, 'low' FROM tw WHERE round(abs(given), 2) > 0
   UNION ALL SELECT team_id, 't12_bad_debt_trend', NULL, NULL, NULL, 'medium' FROM tw WHERE mean > 0 AND (last - mean) / mean * 100 > 25 AND occ >= units),
 rated AS (SELECT *, coalesce(sev, {_severity('m')}) AS severity FROM every)"""


@query(REPORT_SQL + """ SELECT team_id, kind AS discrepancy_type, count(*) AS n, count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'low') AS n_low, CAST(sum(CAST(a AS DECIMAL(18,2))) AS DOUBLE) AS annual_impact,
 CAST(sum(CASE dir WHEN 'overstate' THEN CAST(a AS DECIMAL(18,2)) WHEN 'understate' THEN -CAST(a AS DECIMAL(18,2)) END) AS DOUBLE) AS signed_impact FROM rated GROUP BY team_id, kind""")
def mismatch_report_totals(spark, sf_dir):
    """Counts and impacts of all thirteen kinds of findings."""
    rows = reconcile.report(reported(spark, sf_dir), AS_OF, yearly_statements(spark, sf_dir), bad_debts(spark, sf_dir))
    return reconcile.impact_totals(rows)


# --- questions -----------------------------------------------------------------------------------


@query(f"""q AS (SELECT c_custkey AS question_id, c_custkey % 4 AS kd, CAST(1 + c_custkey % 24 AS INTEGER) AS n, c_custkey % 3 AS h FROM customer), s AS (SELECT count(*) AS everything, count(rent) AS priced, round(sum(rent::DOUBLE), 2) AS total, round(avg(rent::DOUBLE), 2) AS mean, round(max(rent::DOUBLE), 2) AS top FROM leases)
 SELECT question_id, CASE kd WHEN 1 THEN 'aggregate' WHEN 3 THEN 'unsupported' ELSE 'count' END AS kind, CASE kd WHEN 0 THEN (SELECT count(*) FROM leases WHERE end_date >= DATE '{AS_OF}' AND end_date <= CAST(DATE '{AS_OF}' + to_months(n) AS DATE))::DOUBLE WHEN 2 THEN everything::DOUBLE WHEN 1 THEN CASE h WHEN 0 THEN total WHEN 1 THEN mean ELSE top END END AS value, CASE WHEN kd = 1 THEN priced END AS leases FROM q, s""")
def question_answers(spark, sf_dir):
    k = F.col("c_custkey")
    months = F.concat(F.lit("How many leases expire in the next "), (1 + k % 24).cast("string"), F.lit(" months?"))
    how = F.when(k % 3 == 0, "total").when(k % 3 == 1, "average").otherwise("highest")
    text = F.when(k % 4 == 0, months).when(k % 4 == 1, F.concat(F.lit("What is the "), how, F.lit(" rent?"))).when(k % 4 == 2, "How many leases are there?").otherwise("Tell me a story")
    return questions.answers(read(spark, sf_dir, "customer").select(k.alias("question_id"), text.alias("question")), leases(spark, sf_dir), AS_OF)


# --- folds in order ------------------------------------------------------------------------------

SQL["page_chunks"] = """WITH RECURSIVE p AS (SELECT doc_id // 20 AS d, CAST(doc_id % 20 AS INTEGER) AS page, length(text) AS n, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id % 20) AS i FROM documents),
 c AS (SELECT d, page, i, 0 AS chunk, 1 AS cnt, n AS chars FROM p WHERE i = 1 UNION ALL SELECT p.d, p.page, p.i, CASE WHEN cnt >= 8 OR chars + n > 10000 THEN chunk + 1 ELSE chunk END, CASE WHEN cnt >= 8 OR chars + n > 10000 THEN 1 ELSE cnt + 1 END, CASE WHEN cnt >= 8 OR chars + n > 10000 THEN n ELSE chars + n END FROM c JOIN p ON p.d = c.d AND p.i = c.i + 1)
 SELECT d AS doc_id, page, chunk FROM c"""

SQL["rate_limit_admissions"] = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 r AS (SELECT user_id, event_id, ts, i, TRUE AS admitted, [t] AS held FROM e WHERE i = 1 UNION ALL SELECT user_id, event_id, ts, i, len(h) < 3, CASE WHEN len(h) < 3 THEN list_append(h, t) ELSE h END FROM (SELECT e.user_id, e.event_id, e.ts, e.i, e.t, list_filter(r.held, lambda x: x > e.t - 3600000000) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
 SELECT user_id, event_id, ts, admitted FROM r"""

SQL["located_quotes"] = r"""WITH f AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents), q AS (SELECT doc_id, substring(t, 101, 80) AS raw, t FROM f WHERE length(t) >= 180), w AS (SELECT doc_id, trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) AS q, t FROM q),
 p AS (SELECT doc_id, q, array_to_string(list_slice(string_split(q, ' '), 1, 6), ' ') AS six, unnest([0, 1, 2]) AS page, trim(unnest([substring(t, 1, 90), substring(t, 91, 80), substring(t, 101)])) AS x FROM w), k AS (SELECT doc_id, page, CASE WHEN contains(x, q) THEN 1 WHEN contains(x, substring(q, 1, 60)) THEN 2 WHEN contains(x, six) THEN 3 END AS rank FROM p)
 SELECT doc_id, 1 AS quote_id, min({'r': rank, 'p': page}).p AS page, min({'r': rank, 'p': page}).r AS rank FROM k WHERE rank IS NOT NULL GROUP BY doc_id"""


def _as_stated(f):
    """Times without a zone, as the tables have them."""

    def run(spark, sf_dir):
        return f(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    run.__name__ = f.__name__
    return run


catalog.QUERIES["rate_limit_admissions"] = _as_stated(catalog.QUERIES["rate_limit_admissions"])
