"""Queries of scans, exclusions, orders, edits and ledgers; see ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.operators import activity, extraction, history, identity, overlay, portfolio, risks, scope, state
from parcelspark.plans.catalog import ALERT_SQL, FLAG_SQL, flag_rows, query
from parcelspark.plans.project import AS_OF, leases, read

DAY = "CAST(o_orderdate AS DATE)"


def findings(spark, sf_dir) -> DataFrame:
    """Orders as findings about a lease and a related one."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("finding_id"), F.col("o_custkey").alias("lease_id"), (F.col("o_custkey") + 10).alias("related_lease_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"),
                    F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").alias("severity"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("impact"), F.to_date("o_orderdate").alias("seen"))


FINDINGS = f"""f AS (SELECT o_orderkey AS finding_id, o_custkey AS lease_id, o_custkey + 10 AS related_lease_id, o_orderpriority AS category, o_orderstatus AS status, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS severity, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS impact, {DAY} AS seen FROM orders)"""


@query("SELECT lease_id, uploaded_at FROM leases WHERE team_id = 1 AND NOT is_rent_roll AND uploaded_at >= DATE '1997-01-01'")
def scoped_leases(spark, sf_dir):
    rows = scope.in_scope(leases(spark, sf_dir), {"team_id": 1, "is_rent_roll": False, "landlord": None}, {"uploaded_at": F.lit("1997-01-01").cast("date")}, {"end_date": None})
    return rows.select("lease_id", "uploaded_at")


@query("SELECT lease_id, unit_key FROM leases WHERE building_key = '105 main st'")
def property_scope(spark, sf_dir):
    return scope.in_scope(leases(spark, sf_dir), {"building_key": "105 main st"}).select("lease_id", "unit_key")


@query("WITH " + FINDINGS + " SELECT finding_id, category FROM f WHERE status = 'O' AND finding_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')", lease=False)
def open_findings_excluding(spark, sf_dir):
    done = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("finding_id"))
    return scope.excluding(scope.in_scope(findings(spark, sf_dir), {"status": "O"}), done).select("finding_id", "category")


@query("WITH " + FINDINGS + " SELECT finding_id, lease_id FROM f WHERE lease_id IN (3, 14, 25) OR related_lease_id IN (3, 14, 25)", lease=False)
def findings_touching(spark, sf_dir):
    return scope.touching(findings(spark, sf_dir), [3, 14, 25]).select("finding_id", "lease_id")


@query("WITH c AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS s FROM customer) SELECT lower(s) AS folded, min(s) AS spelling, count(*) AS n FROM c GROUP BY 1", lease=False)
def segments_without_case(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("s"))
    return scope.by_folded(c, "s")


@query("SELECT c_custkey AS id, f AS field FROM customer, (SELECT unnest(['tenant', 'tenant_ssn', 'dob', 'household_size', 'birth_date', 'dobson']) AS f) WHERE f IN ('tenant', 'household_size')", lease=False)
def unrestricted_fields(spark, sf_dir):
    names = F.explode(F.array(*map(F.lit, ("tenant", "tenant_ssn", "dob", "household_size", "birth_date", "dobson")))).alias("field")
    return scope.unrestricted(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), names))


@query("SELECT lease_id FROM leases WHERE tenant IS NOT NULL OR landlord IS NOT NULL")
def lease_like_records(spark, sf_dir):
    return scope.looks_like_lease(leases(spark, sf_dir)).select("lease_id")


@query("SELECT lease_id, end_date FROM leases WHERE lower(landlord) LIKE '%owner of%' AND end_date >= DATE '1998-01-01' AND end_date <= DATE '1999-12-31'")
def lease_search(spark, sf_dir):
    rows = leases(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in ("filename", "property_address", "tenant")})
    return scope.search(rows, "OWNER OF", "1998-01-01", "1999-12-31").select("lease_id", "end_date")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 1 THEN ' ' WHEN 2 THEN 'x' END AS value FROM orders", lease=False)
def blanks_as_null(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("id"), scope.blank_as_null(F.when(k % 3 == 1, " ").when(k % 3 == 2, "x").otherwise("")).alias("value"))


@query("SELECT c_custkey AS invite_id, s_name AS inviter, max(o_orderdate) AS last_sent_at FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 15 LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 4 <> 0 GROUP BY 1, 2", lease=False)
def pending_invites(spark, sf_dir):
    k = F.col("c_custkey")
    invites = read(spark, sf_dir, "customer").select(k.alias("invite_id"), (k % 15).alias("invited_by"), F.when(k % 4 == 0, F.lit("1999-01-01")).alias("accepted_at"))
    people = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"))
    return scope.pending_invites(invites, people, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("invite_id"), F.col("o_orderdate").alias("sent_at")))


# --- orders --------------------------------------------------------------------------------------

SEVERITY = "CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END"


@query(FLAG_SQL + f" SELECT lease_id, category, field, severity, row_number() OVER (PARTITION BY team_id, lease_id ORDER BY {SEVERITY}, check_no, field) AS nth FROM flags")
def flags_in_order(spark, sf_dir):
    return scope.placed(flag_rows(spark, sf_dir), ["team_id", "lease_id"], scope.severity_order(), F.col("check_no"), F.col("field")).select("lease_id", "category", "field", "severity", "nth")


@query("WITH " + FINDINGS + f" SELECT finding_id, row_number() OVER (PARTITION BY category ORDER BY impact DESC NULLS LAST, finding_id) AS by_impact, row_number() OVER (PARTITION BY category ORDER BY {SEVERITY}, impact DESC NULLS LAST, seen DESC, finding_id) AS by_severity FROM f", lease=False)
def findings_in_order(spark, sf_dir):
    impact, k = F.desc_nulls_last("impact"), F.col("finding_id")
    rows = scope.placed(findings(spark, sf_dir), ["category"], impact, k).withColumnRenamed("nth", "by_impact")
    return scope.placed(rows, ["category"], scope.severity_order(), impact, F.desc("seen"), k).select("finding_id", "by_impact", F.col("nth").alias("by_severity"))


@query("SELECT lease_id, row_number() OVER (PARTITION BY team_id ORDER BY end_date ASC NULLS LAST, lease_id) AS first_ending, row_number() OVER (PARTITION BY team_id ORDER BY end_date DESC NULLS LAST, lease_id) AS last_ending FROM leases")
def leases_by_end(spark, sf_dir):
    rows = scope.placed(leases(spark, sf_dir).select("team_id", "lease_id", "end_date"), ["team_id"], F.asc_nulls_last("end_date"), F.col("lease_id")).withColumnRenamed("nth", "first_ending")
    return scope.placed(rows, ["team_id"], F.desc_nulls_last("end_date"), F.col("lease_id")).select("lease_id", "first_ending", F.col("nth").alias("last_ending"))


@query("WITH " + FINDINGS + " SELECT finding_id, impact, (SELECT count(*) FROM f) AS total FROM f WHERE impact IS NOT NULL ORDER BY impact DESC, finding_id LIMIT 100", lease=False)
def finding_feed(spark, sf_dir):
    return scope.feed(findings(spark, sf_dir), 100, F.desc_nulls_last("impact"), F.col("finding_id")).select("finding_id", "impact", "total")


def tasks(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("task_id"), F.col("o_custkey").alias("team_id"), F.when(k % 4 == 0, "high").otherwise("normal").alias("priority"), F.when(k % 5 != 0, F.to_date("o_orderdate")).alias("due_date"), F.col("o_orderdate").alias("created_at"))


@query(f"SELECT o_orderkey AS task_id FROM orders ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END, CASE WHEN o_orderkey % 5 <> 0 THEN {DAY} END ASC NULLS LAST, o_orderdate, o_orderkey LIMIT 50", lease=False)
def first_tasks(spark, sf_dir):
    return activity.tasks_in_order(tasks(spark, sf_dir)).select("task_id").limit(50)


# --- changes of state ----------------------------------------------------------------------------


@query("SELECT o_orderkey AS lease_id, CASE WHEN o_orderkey IN (SELECT o_orderkey - 7 FROM orders WHERE o_orderkey % 3 = 0) THEN 'superseded' ELSE 'active' END AS status FROM orders", lease=False)
def superseded_leases(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lease_id"), F.lit("active").alias("status"))
    return scope.supersede(rows, rows.where("lease_id % 3 = 0").select((F.col("lease_id") - 7).alias("supersedes_lease_id")))


@query("WITH " + FINDINGS + " SELECT finding_id, 'Review ' || category AS title, CASE WHEN severity = 'high' THEN 'high' ELSE 'normal' END AS priority, 'open' AS status FROM f WHERE finding_id % 4 <> 0", lease=False)
def tasks_from_findings(spark, sf_dir):
    rows = findings(spark, sf_dir)
    return scope.new_tasks(rows, rows.where("finding_id % 4 = 0"))


def edits(spark, sf_dir) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max("l_shipdate").alias("at"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    edit_id = F.col("l_orderkey") * 3 + F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag"))
    return li.select(F.col("l_orderkey").alias("lease_id"), F.when(F.col("l_returnflag") == "A", "status").otherwise("note").alias("field"), F.when(F.col("q") % 5 != 0, F.col("q").cast("string")).alias("value"), "at", edit_id.alias("edit_id"))


def records(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lease_id"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))).alias("fields"))
    return scope.decoded(rows)


EDITS = """e AS (SELECT l_orderkey AS lease_id, CASE WHEN l_returnflag = 'A' THEN 'status' ELSE 'note' END AS field, CASE WHEN sum(CAST(l_quantity AS BIGINT)) % 5 <> 0 THEN CAST(sum(CAST(l_quantity AS BIGINT)) AS VARCHAR) END AS value, max(l_shipdate) AS "at", l_orderkey * 3 + CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS edit_id FROM lineitem GROUP BY l_orderkey, l_returnflag)"""


@query("WITH " + EDITS + """, l AS (SELECT lease_id, field, last(value ORDER BY "at", edit_id) AS value, count(*) AS n FROM e GROUP BY lease_id, field), j AS (SELECT o_orderkey AS lease_id, s.n AS sn, s.value AS sv, t.n AS tn, t.value AS tv, o_orderstatus AS os, o_orderpriority AS op FROM orders LEFT JOIN l s ON s.lease_id = o_orderkey AND s.field = 'status' LEFT JOIN l t ON t.lease_id = o_orderkey AND t.field = 'note')
 SELECT lease_id, CASE WHEN sn IS NOT NULL THEN sv ELSE os END AS status, op AS priority, tv AS note, (CASE WHEN sn IS NOT NULL AND sv IS DISTINCT FROM os THEN 1 ELSE 0 END + CASE WHEN tn IS NOT NULL AND tv IS NOT NULL THEN 1 ELSE 0 END)::INT AS changed FROM j""", lease=False)
def edited_records(spark, sf_dir):
    out = scope.edited(records(spark, sf_dir), edits(spark, sf_dir))
    return out.select("lease_id", *[F.try_element_at("fields", F.lit(f)).alias(f) for f in ("status", "priority", "note")], "changed")


@query("WITH " + EDITS + """, w AS (SELECT *, row_number() OVER x AS n, lag(value) OVER x AS before FROM e WINDOW x AS (PARTITION BY lease_id, field ORDER BY "at", edit_id)) SELECT edit_id, lease_id, field, CASE WHEN n > 1 THEN before WHEN field = 'status' THEN o_orderstatus END AS old_value, value AS new_value FROM w JOIN orders ON o_orderkey = lease_id""", lease=False)
def edit_audit(spark, sf_dir):
    known = records(spark, sf_dir)
    return scope.edit_audit(known, edits(spark, sf_dir).join(known.select("lease_id"), "lease_id", "left_semi"))


@query("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_type)) AS e, max(ts) AS "at" FROM events GROUP BY user_id), s AS (SELECT user_id AS job_id, CASE e WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS st, date_diff('second', "at", TIMESTAMP '2024-01-30 12:00:00') / 60.0 AS m FROM l)
 SELECT job_id, CASE WHEN st = 'queued' AND m > 180 OR st = 'processing' AND m > 20 THEN 'stale' ELSE st END AS state FROM s""", lease=False)
def job_states(spark, sf_dir):
    e = F.col("event_type")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), e.alias("raw"), F.col("ts").alias("at"))
    last = rows.groupBy("job_id").agg(F.max_by("raw", F.struct("at", "raw")).alias("raw"), F.max("at").alias("at"))
    named = last.select("job_id", F.when(F.col("raw") == "click", "queued").when(F.col("raw") == "view", "processing").when(F.col("raw") == "purchase", "complete").otherwise("failed").alias("state"), "at")
    return scope.job_states(named, "2024-01-30 12:00:00")


@query("""WITH l AS (SELECT o_custkey AS finding_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s, max(o_orderdate) AS "at" FROM orders GROUP BY 1) SELECT finding_id, CASE WHEN s = 'F' THEN 'resolve' ELSE 'reopen' END AS last_action, "at", CASE WHEN s = 'F' THEN 'resolved' ELSE 'open' END AS status FROM l""", lease=False)
def finding_states(spark, sf_dir):
    log = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("finding_id"), F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "F", "resolve").otherwise("reopen").alias("action"), F.col("o_orderdate").alias("at"))
    return state.latest_resolution(log)


@query("SELECT 'flag:' || CASE WHEN o_custkey % 2 = 0 THEN o_custkey + 1000000 ELSE o_custkey END || ':' || o_orderkey || ':0' AS natural_key FROM orders", lease=False)
def moved_keys(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.concat_ws(":", F.lit("flag"), "o_custkey", "o_orderkey", F.lit(0)).alias("natural_key"))
    moved = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") + 1_000_000).alias("new_id"))
    return state.repoint_keys(rows, moved)


@query("""WITH o AS (SELECT c_nationkey AS team_id, c_custkey AS k, c_name AS a, c_mktsegment AS n FROM customer WHERE c_custkey % 3 <> 0), w AS (SELECT c_nationkey AS team_id, c_custkey AS k, 'p' || c_custkey AS a, CASE WHEN c_custkey % 4 <> 0 THEN 'n' END AS n FROM customer WHERE c_custkey % 2 = 0)
 SELECT coalesce(w.team_id, o.team_id) AS team_id, 'finding' AS item_type, CAST(coalesce(w.k, o.k) AS VARCHAR) AS item_key, coalesce(w.a, o.a) AS assignee, CASE WHEN w.k IS NOT NULL THEN w.n ELSE o.n END AS note, CASE WHEN w.k IS NOT NULL THEN 'assigned' ELSE 'done' END AS status FROM o FULL JOIN w ON o.team_id = w.team_id AND o.k = w.k""", lease=False)
def assignments(spark, sf_dir):
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").withColumns({"team_id": F.col("c_nationkey"), "item_type": F.lit("finding"), "item_key": k.cast("string")})
    old = c.where(k % 3 != 0).select("team_id", "item_type", "item_key", F.col("c_name").alias("assignee"), F.col("c_mktsegment").alias("note"), F.lit("done").alias("status"))
    new = c.where(k % 2 == 0).select("team_id", "item_type", "item_key", F.concat(F.lit("p"), k.cast("string")).alias("assignee"), F.when(k % 4 != 0, "n").alias("note"))
    return identity.assign(old, new)


@query("SELECT 'tasks' AS source, count(*) AS n FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'views', count(*) FROM events WHERE event_type = 'view'", lease=False)
def today_counts(spark, sf_dir):
    return activity.today_counts({"tasks": read(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), "views": read(spark, sf_dir, "events").where("event_type = 'view'")})


# --- joins ---------------------------------------------------------------------------------------


@query("WITH " + FINDINGS + """, r AS (SELECT l_orderkey * 8 + l_linenumber AS resolution_id, min(l_orderkey) AS finding_id, max(l_shipdate) AS "at" FROM lineitem GROUP BY l_orderkey * 8 + l_linenumber), g AS (SELECT * FROM f WHERE finding_id % 50 = 0),
 j AS (SELECT a.finding_id, r.resolution_id, r.finding_id AS other_id, row_number() OVER (PARTITION BY a.finding_id ORDER BY r."at" DESC, r.resolution_id DESC) AS nth FROM g a JOIN g b ON a.category = b.category AND a.status = b.status AND a.finding_id <> b.finding_id JOIN r ON r.finding_id = b.finding_id) SELECT * FROM j WHERE nth <= 3""", lease=False)
def resolution_history(spark, sf_dir):
    """The findings and resolutions are projections of orders and lines; every fiftieth order stands for a finding."""
    found = findings(spark, sf_dir).where("finding_id % 50 = 0").select("finding_id", "category", F.col("status").alias("field"))
    res = read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("resolution_id")).agg(F.min("l_orderkey").alias("finding_id"), F.max("l_shipdate").alias("at"))
    return identity.recent_resolutions(found, res, 3).withColumn("nth", F.col("nth").cast("long"))


@query("""WITH c AS (SELECT event_id AS comment_id, ts AS "at", user_id AS lease_id, event_id % 997 AS finding_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 40) SELECT comment_id, "at", c_name AS filename, o_orderpriority AS category FROM c LEFT JOIN customer ON c_custkey = lease_id LEFT JOIN orders ON o_orderkey = finding_id""", lease=False)
def recent_comments(spark, sf_dir):
    comments = read(spark, sf_dir, "events").select(F.col("event_id").alias("comment_id"), F.col("ts").alias("at"), F.col("user_id").alias("lease_id"), (F.col("event_id") % 997).alias("finding_id"))
    known = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lease_id"), F.col("c_name").alias("filename"))
    return identity.recent_comments(comments, known, findings(spark, sf_dir), 40).select("comment_id", "at", "filename", "category")


@query("""WITH s AS (SELECT s_nationkey AS b, l_returnflag AS file, l_shipdate AS "at", l_orderkey * 8 + l_linenumber AS id, CAST(l_quantity AS BIGINT) AS occ FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), n AS (SELECT b, file, arg_max(occ, ("at", id, occ)) AS occ FROM s GROUP BY b, file) SELECT CAST(b AS VARCHAR) AS building_key, CAST(sum(occ) AS BIGINT) AS occupied, CAST(sum(60) AS BIGINT) AS total FROM n GROUP BY b""", lease=False)
def unit_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    q = F.col("l_quantity").cast("long")
    summary_id = F.struct((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), q.alias("q"))
    out = identity.latest_unit_counts(rows.select(F.col("s_nationkey").cast("string").alias("building_key"), F.col("l_returnflag").alias("file"), F.col("l_shipdate").alias("at"), summary_id.alias("summary_id"), q.alias("occupied"), F.lit(60).cast("long").alias("total")))
    return out


@query(FLAG_SQL + """, a AS (SELECT team_id, lease_id, category, field, severity FROM flags), s AS (SELECT l.team_id, l.lease_id AS ia, m.lease_id AS ib, l.psf AS pa, m.psf AS pb, l.sqft AS sa, m.sqft AS sb FROM leases l JOIN leases m ON l.team_id = m.team_id AND l.unit_key = m.unit_key AND l.lease_id < m.lease_id),
 x AS (SELECT team_id, ia, ib, 'rent_amount' AS field, CASE WHEN pa <> 0 AND pb <> 0 THEN abs(pa - pb) / greatest(pa, pb) * 100 END AS d, 25 AS hi, 10 AS mid FROM s UNION ALL SELECT team_id, ia, ib, 'square_footage', CASE WHEN sa <> 0 AND sb <> 0 THEN abs(sa - sb) / greatest(sa, sb) * 100 END, 15, 5 FROM s),
 y AS (SELECT team_id, unnest([ia, ib]) AS lease_id, field, CASE WHEN d >= hi THEN 'high' ELSE 'medium' END AS severity FROM x WHERE d >= mid), z AS (SELECT * FROM a UNION ALL SELECT team_id, lease_id, 'cross_lease_mismatch', field, severity FROM y) SELECT category, field, severity, count(*) AS n, count(DISTINCT lease_id) AS leases FROM z GROUP BY ALL""")
def all_risk_flags(spark, sf_dir):
    return risks.all_flags(leases(spark, sf_dir)).groupBy("category", "field", "severity").agg(F.count("*").alias("n"), F.count_distinct("lease_id").alias("leases"))


@query("""WITH d AS (SELECT DISTINCT o_custkey AS lease_id, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus <> 'P') SELECT lease_id, 'lease_start_date' AS field, string_agg(CAST(d AS VARCHAR), ', ' ORDER BY d) AS dates FROM d GROUP BY lease_id HAVING count(*) >= 2""", lease=False)
def conflicting_dates(spark, sf_dir):
    """Each order states a start date of its customer's lease, in one of two shapes; those of status P cannot be read."""
    d = F.col("o_orderdate")
    value = F.when(F.col("o_orderstatus") == "P", "soon").when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "MMMM d, yyyy"))
    rows = read(spark, sf_dir, "orders").select(F.lit(1).alias("team_id"), F.col("o_custkey").alias("lease_id"), F.lit("start").alias("role"), value.alias("value"))
    return risks.date_conflicts(rows).select("lease_id", "field", "dates")


@query(ALERT_SQL + f""", x AS (SELECT lease_id, 'renewal_notice_deadline' AS item, end_date - notice_days AS due_date FROM leases WHERE notice_days IS NOT NULL AND end_date IS NOT NULL UNION ALL SELECT lease_id, 'termination_notice_deadline', CAST(CAST(start_date + INTERVAL 3 YEAR AS DATE) - 1 - termination_notice_days AS DATE) FROM leases WHERE termination_year IS NOT NULL
 UNION ALL SELECT lease_id, 'expiring', due_date FROM ex WHERE kind = 'expiring' UNION ALL SELECT o_orderkey, 'task', {DAY} FROM orders WHERE o_orderkey % 5 <> 0) SELECT lease_id, item, due_date FROM x""")
def action_items(spark, sf_dir):
    rows = leases(spark, sf_dir)
    due = risks.obligations(rows, AS_OF).where("obligation_type IN ('renewal_notice_deadline', 'termination_notice_deadline')")
    ending = portfolio.expiration_alerts(rows, AS_OF).where("kind = 'expiring'").select("lease_id", "kind").join(rows.select("team_id", "lease_id", F.col("end_date").alias("due_date")), "lease_id").select("team_id", "lease_id", "kind", "due_date")
    todo = tasks(spark, sf_dir).select("team_id", F.col("task_id").alias("lease_id"), F.lit("task").alias("title"), "due_date")
    return risks.action_items(due, ending, todo).select("lease_id", "item", "due_date")


@query("WITH " + FINDINGS + " SELECT category, coalesce(severity, 'none') AS severity, count(*) AS n, round(sum(CAST(impact AS DECIMAL(18,2)))::DOUBLE, 2) AS impact FROM f WHERE status = 'O' GROUP BY ALL", lease=False)
def severity_context(spark, sf_dir):
    """Open findings by type and severity, as an assistant's context states them."""
    rows = findings(spark, sf_dir).where("status = 'O'")
    return rows.groupBy("category", F.coalesce("severity", F.lit("none")).alias("severity")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("impact").cast("decimal(18,2)")).cast("double"), 2).alias("impact"))


# --- histories -----------------------------------------------------------------------------------


@query("SELECT team_id, unit_key, lease_id, uploaded_at, rent::DOUBLE AS rent, row_number() OVER (PARTITION BY team_id, unit_key ORDER BY uploaded_at, lease_id) AS nth FROM leases")
def property_history(spark, sf_dir):
    return history.property_history(leases(spark, sf_dir))


@query("""h AS (SELECT team_id, building_key, lease_id, uploaded_at, rent::DOUBLE AS rent, lag(rent::DOUBLE) OVER (PARTITION BY team_id, unit_key ORDER BY uploaded_at, lease_id) AS b FROM leases), s AS (SELECT *, round((rent - b) / b * 100, 2) AS pct FROM h WHERE rent IS NOT NULL AND b <> 0)
 SELECT team_id, count(*) AS changes, round(CAST(sum(CAST(pct AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS mean_pct, count(*) FILTER (uploaded_at >= DATE '1998-01-01') AS recent FROM s GROUP BY team_id""")
def rent_change_summary(spark, sf_dir):
    return history.rent_change_summary(leases(spark, sf_dir), "1998-01-01")


@query("""SELECT DISTINCT o_custkey AS doc_id, p AS start_page, lead(p, 1, 41) OVER (PARTITION BY o_custkey ORDER BY p) - 1 AS end_page FROM (SELECT DISTINCT o_custkey, CAST(1 + o_orderkey % 40 AS INTEGER) AS p FROM orders)""", lease=False)
def lease_boundaries(spark, sf_dir):
    starts = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (1 + F.col("o_orderkey") % 40).cast("int").alias("start_page"), F.lit(40).alias("pages")).distinct()
    return overlay.segments(starts)


@query("""WITH v AS (SELECT o_custkey AS doc_id, o_orderpriority AS value, o_orderkey AS page, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS r FROM orders), g AS (SELECT doc_id, arg_min(value, (r, page, value)) AS value, min(r) AS r, list_sort(list(DISTINCT lower(value))) AS d FROM v GROUP BY doc_id)
 SELECT doc_id, 'priority' AS field, value, CASE WHEN len(d) > 1 THEN 'low' ELSE ['high', 'medium', 'low'][r] END AS confidence, CASE WHEN len(d) > 1 THEN array_to_string(d, ' | ') END AS alternatives FROM g""", lease=False)
def merged_values(spark, sf_dir):
    s = F.col("o_orderstatus")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value"), F.when(s == "F", "high").when(s == "O", "medium").otherwise("low").alias("confidence"), F.col("o_orderkey").alias("page"))
    return extraction.merge_chunks(rows)
