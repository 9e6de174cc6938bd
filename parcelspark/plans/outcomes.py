"""Queries of changes, limits, scores, file types, clauses and answers; see ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelspark.functions import parse
from parcelspark.operators import clauses, concessions, documents, extraction, identity, memo, questions, state
from parcelspark.plans import catalog
from parcelspark.plans.catalog import KEYED_SQL, clause, query
from parcelspark.plans.project import AS_OF, dealt_out, leases, read, text_leases
from parcelspark.sources import sinks
from parcelspark.streaming import limits
from parcelspark.streaming.alerts import AlertStore


# --- findings and alerts -------------------------------------------------------------------------

SNAPSHOT_SQL = KEYED_SQL + """, before AS (SELECT natural_key, 'low' AS severity, CASE WHEN lease_id % 2 = 0 THEN 'resolved' ELSE 'open' END AS status, lease_id FROM keyed WHERE lease_id % 3 <> 0),
 after AS (SELECT natural_key, CASE WHEN lease_id % 5 <> 0 THEN severity ELSE 'low' END AS severity, CASE WHEN lease_id % 3 <> 0 AND lease_id % 2 = 0 THEN 'resolved' ELSE 'open' END AS status FROM keyed WHERE lease_id % 3 <> 0 OR lease_id % 5 <> 0)"""


@query(SNAPSHOT_SQL + """ SELECT natural_key, a.severity, CASE WHEN b.status IS NULL THEN 'opened' ELSE 'changed' END AS change FROM after a LEFT JOIN before b USING (natural_key) WHERE a.status = 'open' AND (b.status IS NULL OR a.severity <> b.severity)""")
def finding_changes(spark, sf_dir):
    return state.finding_changes(*catalog._snapshots(spark, sf_dir))


@query(SNAPSHOT_SQL + """, c AS (SELECT 'status' AS scope, status AS name, count(*) AS n FROM after GROUP BY status UNION ALL SELECT 'severity', severity, count(*) FROM after GROUP BY severity UNION ALL SELECT 'type', split_part(natural_key, ':', 3), count(*) FROM after GROUP BY ALL),
 d(scope, name) AS (VALUES ('status', 'open'), ('status', 'resolved'), ('severity', 'high'), ('severity', 'medium'), ('severity', 'low')) SELECT scope, name, coalesce(n, 0) AS n FROM c FULL JOIN d USING (scope, name)""")
def finding_summary(spark, sf_dir):
    after = catalog._snapshots(spark, sf_dir)[1]
    return state.finding_summary(after.withColumn("discrepancy_type", F.split("natural_key", ":")[2]))


@query("""SELECT 'o:' || o_orderkey AS natural_key, o_orderstatus AS alert_type, CASE WHEN o_orderkey % 3 = 0 THEN 'low' ELSE 'high' END AS severity, CASE WHEN o_orderkey % 3 = 0 THEN 'auto_resolved' ELSE 'active' END AS status,
 CASE WHEN o_orderkey % 3 = 0 THEN 'auto_resolved' WHEN o_orderkey % 2 = 0 THEN 'refreshed' ELSE 'created' END AS change FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0""", lease=False)
def stored_alerts(spark, sf_dir):
    """Two runs through the store (V6): half of all orders, then those that three does not divide."""
    store = AlertStore(spark, sinks.scratch(spark))
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), k.cast("string")).alias("natural_key"), F.col("o_orderstatus").alias("alert_type"), k)
    store.apply(rows.where(k % 2 == 0).withColumn("severity", F.lit("low")), 0, "1999-01-01")
    store.apply(rows.where(k % 3 != 0).withColumn("severity", F.lit("high")), 1, "1999-02-01")
    return store.snapshot(1).drop("created_at")


# --- limits --------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id AS account, strftime(ts, '%Y-%m') AS month, event_id, ts, sum(event_id % 7) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events),
 l AS (SELECT *, unnest([0.5, 0.8]) AS level FROM e) SELECT account, month, level::DOUBLE AS level, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM l WHERE spent >= level * 60 GROUP BY account, month, level""", lease=False)
def threshold_crossings(spark, sf_dir):
    """First events at half and four fifths of an account's month (V5)."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("account"), "event_id", "ts", (F.col("event_id") % 7).alias("units"))
    return limits.thresholds(e, 60.0).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("level", F.col("level").cast("double"))


@query("SELECT user_id, date_trunc('month', ts)::TIMESTAMP AS month, count(*) AS events FROM events GROUP BY ALL", lease=False)
def monthly_quota(spark, sf_dir):
    return limits.monthly_quota(read(spark, sf_dir, "events")).withColumn("month", F.col("month").cast("timestamp_ntz"))


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents", lease=False)
def distinct_uploads(spark, sf_dir):
    return limits.distinct_uploads(read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"))).select("content_hash")


@query("""WITH e AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT, 1) AS cut FROM events), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
 SELECT user_id, min(ts) AS begins, count(*) AS events FROM s GROUP BY user_id, n""", lease=False)
def user_sessions(spark, sf_dir):
    return limits.sessions(read(spark, sf_dir, "events")).withColumn("begins", F.col("begins").cast("timestamp_ntz"))


# --- scores of extracted values ------------------------------------------------------------------


def extracted(spark, sf_dir):
    """Rents and start dates as read, some of them wrong, missing or out of nothing, beside what the orders say."""
    k, t = F.col("lease_id"), text_leases(spark, sf_dir)
    level = F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low")
    rent = F.when(k % 7 == 1, F.concat(F.lit("$"), (k + 10_000_000).cast("string"))).when(k % 7 != 2, F.col("rent_amount"))
    start = F.when(k % 11 == 1, "1980-01-01").when(k % 11 != 2, F.col("lease_start_date"))
    use = F.when(k % 5 == 1, "RETAIL, and more").when(k % 5 == 2, "Office").when(k % 5 != 3, F.col("permitted_use"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("found"), F.col(f).alias("expected")) for f, v in (("rent_amount", rent), ("lease_start_date", start), ("permitted_use", use))])
    return extraction.scored(t.select(k.alias("doc_id"), level.alias("confidence"), F.explode(pairs).alias("x")).select("doc_id", "confidence", "x.*"))


SCORED = """k AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM orders),
 v AS (SELECT k, confidence, 'rent_amount' AS field, CASE WHEN k % 7 = 1 THEN 1 WHEN k % 7 <> 2 AND k % 29 <> 0 THEN 0 END AS bad, k % 29 <> 0 AS has FROM k UNION ALL SELECT k, confidence, 'lease_start_date', CASE WHEN k % 11 = 1 THEN 1 WHEN k % 11 <> 2 THEN 0 END, TRUE FROM k
   UNION ALL SELECT k, confidence, 'permitted_use', CASE WHEN k % 5 = 1 THEN CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END WHEN k % 5 = 2 THEN 1 WHEN k % 5 <> 3 AND k % 8 <> 0 THEN 0 END, k % 8 <> 0 FROM k),
 s AS (SELECT *, bad IS NOT NULL AS claim, CASE WHEN bad IS NULL THEN NOT has ELSE bad = 0 END AS correct, CASE WHEN bad IS NULL THEN CASE WHEN has THEN 'missed' ELSE 'correct_absent' END WHEN bad = 0 THEN 'correct_found' WHEN has THEN 'wrong' ELSE 'spurious' END AS kind FROM v)"""


@query("WITH " + SCORED + " SELECT k AS doc_id, field, kind, correct, kind IN ('wrong', 'spurious') AS asserted_wrong FROM s", lease=False)
def scored_values(spark, sf_dir):
    return extracted(spark, sf_dir).select("doc_id", "field", "kind", "correct", "asserted_wrong")


@query("WITH " + SCORED + """, c AS (SELECT coalesce(field, 'all') AS scope, count(*) AS claims, count(*) FILTER (NOT correct) AS wrong, count(*) FILTER (NOT correct AND confidence = 'high') AS confident_wrong,
 round(count(*) FILTER (correct AND confidence = 'high') / count(*) FILTER (confidence = 'high'), 4) AS p_high, round(count(*) FILTER (correct AND confidence = 'medium') / count(*) FILTER (confidence = 'medium'), 4) AS p_medium, round(count(*) FILTER (correct AND confidence = 'low') / count(*) FILTER (confidence = 'low'), 4) AS p_low FROM s WHERE claim GROUP BY GROUPING SETS ((field), ()))
 SELECT *, round(p_high - p_low, 4) AS calibration_gap FROM c""", lease=False)
def extraction_calibration(spark, sf_dir):
    return extraction.calibration(extracted(spark, sf_dir))


@query("WITH " + SCORED + " SELECT k AS doc_id, field, kind FROM s WHERE claim AND NOT correct AND confidence = 'high'", lease=False)
def confident_mistakes(spark, sf_dir):
    return extraction.confident_mistakes(extracted(spark, sf_dir)).select("doc_id", "field", "kind")


# --- files, clauses, answers ---------------------------------------------------------------------

_FILES = (
    ("255044462D312E37", "pdf"), ("504B0304FF776F72642F646F63756D656E742E786D6C", "docx"), ("504B0304FF786C2F776F726B626F6F6B2E786D6C", "xlsx"), ("504B030400", "archive"), ("FFD8FFE0", "jpg"), ("89504E470D0A1A0A", "png"),
    ("49492A00", "tiff"), ("000000186674797068656963", "heic"), ("524946460000000057454250", "webp"), ("474946383961", "gif"), ("4D5A9000", "program"), ("7B5C72746631", "rtf"), ("3C68746D6C3E", "markup"), ("00FF00FF01020304", None),
    ("D0CF11E0A1B11AE1", "office"), ("", "empty"),
)


@query("""WITH f AS (SELECT o_orderkey AS id, CASE o_orderkey % 18 WHEN 0 THEN 'txt' WHEN 1 THEN 'csv' """ + " ".join(f"WHEN {i} THEN {repr(t) if t else 'NULL'}" for i, (_, t) in enumerate(_FILES, 2)) + """ END AS type FROM orders)
 SELECT id, type, coalesce(type IN ('pdf', 'xlsx', 'xls', 'docx', 'csv', 'txt', 'jpg', 'png', 'tiff', 'heic', 'webp', 'bmp'), FALSE) AS taken FROM f""", lease=False)
def sniffed_types(spark, sf_dir):
    """Files whose first bytes are those of sixteen kinds, or lines of the orders' own values."""
    k = F.col("o_orderkey")
    body = F.encode(F.concat_ws(" ", k.cast("string"), "o_orderpriority", F.lit("was ordered\nonce")), "UTF-8")
    table = F.encode(F.concat_ws(",", k.cast("string"), "o_orderpriority", F.lit("x\n1"), "o_orderstatus", "o_orderpriority"), "UTF-8")
    content = F.when(k % 18 == 0, body).when(k % 18 == 1, table)
    for i, (raw, _) in enumerate(_FILES, 2):
        content = content.when(k % 18 == i, F.unhex(F.lit(raw)) if raw.endswith("04") or not raw else F.concat(F.unhex(F.lit(raw)), F.encode(k.cast("string"), "UTF-8")))
    kind = documents.sniffed(F.col("content"))
    return read(spark, sf_dir, "orders").select(k.alias("id"), content.alias("content")).select("id", kind.alias("type")).withColumn("taken", documents.taken(F.col("type"), F.lit("rent_roll")))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(^|[^\pL\pN_])(no|sec|inc|co|st|ste|apt|approx|mo)\.(\s|$)', '\1\2' || chr(2) || '\3', 'gi'), '(^|[^\pL\pN_])(no|sec|inc|co|st|ste|apt|approx|mo)\.(\s|$)', '\1\2' || chr(2) || '\3', 'gi'), '\n\s*\n', '\0' || chr(1), 'g') AS t FROM documents),
 p AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.;])(\s|$)', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM t) SELECT doc_id, count(*) FILTER (regexp_matches(s, '\S')) AS sentences, max(length(s)) FILTER (regexp_matches(s, '\S')) AS longest FROM p GROUP BY doc_id""", lease=False)
def sentences(spark, sf_dir):
    """How many sentences a text has, and the characters of the longest."""
    rows = dealt_out(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("s", clauses.sentences(F.col("text")))
    return rows.select("doc_id", F.size("s").cast("long").alias("sentences"), F.array_max(F.transform("s", lambda x: F.length(x["text"]))).cast("long").alias("longest"))


@query("""SELECT lease_id, CASE WHEN lease_id % 5 IN (1, 4) THEN 'free_rent' WHEN lease_id % 5 = 2 THEN 'recurring_discount' ELSE 'one_time_credit' END AS kind, CASE lease_id % 5 WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 4 THEN 1 END::DOUBLE AS months, CASE lease_id % 5 WHEN 2 THEN 150 WHEN 3 THEN 500 END::DOUBLE AS amount, CASE WHEN lease_id % 5 = 4 THEN 'last' ELSE 'first' END AS position FROM leases WHERE lease_id % 5 <> 0""")
def concession_items(spark, sf_dir):
    """What each lease's clause grants."""
    rows = concessions.with_items(text_leases(spark, sf_dir).select("lease_id").withColumn("concessions", clause()))
    return rows.select("lease_id", F.explode("items").alias("x")).select("lease_id", "x.kind", "x.months", "x.amount", "x.position")


@query("SELECT o_orderkey AS lease_id, CAST(1 + o_orderkey % 3 AS INT) AS num_options, 5 AS term_years, CAST(15 + o_orderkey % 12 * 30 AS INT) AS notice_days, 'fair market value' AS basis FROM orders WHERE o_orderkey % 4 <> 0", lease=False)
def renewal_terms(spark, sf_dir):
    """Options, years, notice and basis of renewal clauses."""
    rows = text_leases(spark, sf_dir).where("renewal_options IS NOT NULL").select("lease_id", parse.renewal_options("renewal_options").alias("r"))
    return rows.select("lease_id", "r.*")


@query("SELECT DISTINCT o_orderkey AS lease_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'", lease=False)
def leases_with_tag(spark, sf_dir):
    tags = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lease_id"), F.col("l_returnflag").alias("tag"))
    return identity.tagged(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lease_id")), tags, "R").distinct()


@query(f"""q AS (SELECT n_nationkey AS question_id, CAST(10 + n_nationkey * 3 AS INT) AS n FROM nation) SELECT question_id, lease_id, tenant, end_date, 'lease_' || lease_id || CASE WHEN lease_id % 3 = 0 THEN '.csv' ELSE '.pdf' END AS source FROM q JOIN leases ON end_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + n""")
def question_lists(spark, sf_dir):
    """Which leases end in the spans that questions ask for, with their files."""
    k = F.col("n_nationkey")
    asked = read(spark, sf_dir, "nation").select(k.alias("question_id"), F.concat(F.lit("Which leases expire in the next "), (10 + k * 3).cast("string"), F.lit(" days?")).alias("question"))
    return questions.listed(asked, leases(spark, sf_dir), AS_OF)


@query("""SELECT c_custkey AS question_id, lease_id, tenant, CASE c_custkey % 2 WHEN 0 THEN CAST(rent AS VARCHAR) ELSE CAST(end_date AS VARCHAR) END AS value, 'lease_' || lease_id || CASE WHEN lease_id % 3 = 0 THEN '.csv' ELSE '.pdf' END AS source FROM customer JOIN leases ON tenant = c_name""")
def question_lookups(spark, sf_dir):
    """Rents and end dates of tenants that questions name, with their files."""
    k = F.col("c_custkey")
    text = F.concat(F.when(k % 2 == 0, "What is the rent for ").otherwise("What is the end date for "), "c_name", F.lit("?"))
    return questions.looked_up(read(spark, sf_dir, "customer").select(k.alias("question_id"), text.alias("question")), leases(spark, sf_dir), AS_OF)


# --- the memo ------------------------------------------------------------------------------------


@query(f"""r AS (SELECT *, row_number() OVER (PARTITION BY team_id, unit_key ORDER BY is_rent_roll, uploaded_at DESC, lease_id DESC) AS place FROM leases),
 s AS (SELECT *, unnest([team_id || '|', team_id || '|' || building_key]) AS scope FROM r), n AS (SELECT scope, count(*) AS record_count, count(*) FILTER (lease_id % 7 = 0) AS open_findings, count(*) FILTER (lease_id % 7 = 1) AS resolved_findings, count(*) FILTER (lease_id % 7 = 0 AND lease_id % 2 = 0) AS open_high FROM s GROUP BY scope),
 m AS (SELECT scope, count(*) AS lease_count, CAST(sum(rent) AS DOUBLE) AS total_monthly_rent, round(avg(psf), 2) AS avg_rent_per_sqft, round(sum(sqft), 2) AS total_square_footage,
   round(CAST(sum(date_diff('day', DATE '{AS_OF}', end_date) * rent) FILTER (rent > 0 AND end_date >= DATE '{AS_OF}') AS DOUBLE) / CAST(sum(rent) FILTER (rent > 0 AND end_date >= DATE '{AS_OF}') AS DOUBLE) / 365.25, 2) AS walt_years,
   round(coalesce(CAST(sum(rent) FILTER (rent > 0 AND date_diff('day', DATE '{AS_OF}', end_date) BETWEEN 0 AND 365) AS DOUBLE) / nullif(CAST(sum(rent) FILTER (rent > 0 AND end_date >= DATE '{AS_OF}') AS DOUBLE), 0), 0) * 100, 2) AS year_1_pct,
   CAST(coalesce(sum(rent) FILTER (rent > 0 AND end_date < DATE '{AS_OF}'), 0) AS DOUBLE) AS expired_rent, bool_or(rent > 0 AND end_date IS NOT NULL) AS rolls FROM s WHERE place = 1 GROUP BY scope)
 SELECT scope, record_count, lease_count, total_monthly_rent, avg_rent_per_sqft, total_square_footage, walt_years, CASE WHEN rolls THEN year_1_pct END AS year_1_pct, CASE WHEN rolls THEN expired_rent END AS expired_rent, open_findings, resolved_findings, open_high FROM n LEFT JOIN m USING (scope)""")
def deal_memo(spark, sf_dir):
    """Figures of a memo for each property and each portfolio."""
    rows, k = leases(spark, sf_dir), F.col("lease_id")
    status = F.when(k % 7 == 0, "open").when(k % 7 == 1, "resolved")
    findings = rows.select("team_id", "building_key", status.alias("status"), F.when(k % 2 == 0, "high").otherwise("low").alias("severity")).where("status IS NOT NULL")
    return memo.deal_memo(rows, findings, AS_OF).withColumn("expired_rent", F.col("rollover")["expired"]).drop("rollover")
