"""Every operator applied to the driver's tables, beside the same in plain SQL.

``QUERIES`` maps names to functions of (spark, sf_dir); ``SQL`` has, for those
that SQL can express, a statement that another engine runs on the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions import keys
from parcelspark.operators import activity, concessions, documents, extraction, history, identity, lease_text, overlay, portfolio, reconcile, risks, state
from parcelspark.plans.project import AS_OF, FIELDS, LEASE_SQL, leases, read
from parcelspark.sources import sinks
from parcelspark.streaming import limits

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, lease: bool = True):
    """Registers a query under its function's name, with its SQL (``lease``: over the lease records)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH " + LEASE_SQL + (", " + sql.strip() if sql.strip()[:6].upper() != "SELECT" else sql)) if lease else sql
        return f

    return add


# --- portfolio -----------------------------------------------------------------------------------


@query("""SELECT team_id, count(*) AS lease_count, CAST(sum(rent) AS DOUBLE) AS total_monthly_rent, round(CAST(sum(rent) AS DOUBLE) / count(rent), 2) AS avg_monthly_rent,
 round(avg(psf), 2) AS avg_rent_per_sqft, CAST(sum(cam) AS DOUBLE) AS total_cam_exposure, round(CAST(sum(cam) AS DOUBLE) / count(cam), 2) AS avg_cam,
 round(CAST(sum(deposit) AS DOUBLE) / count(deposit), 2) AS avg_security_deposit,
 round(avg(CASE WHEN has_schedule THEN round(((y2 - y1)::DOUBLE / y1::DOUBLE * 100 + (y3 - y2)::DOUBLE / y2::DOUBLE * 100 + (y4 - y3)::DOUBLE / y3::DOUBLE * 100) / 3, 2) ELSE stated_pct END), 2) AS avg_escalation_pct,
 round(avg(notice_days), 2) AS avg_notice_days, round(sum(sqft), 2) AS total_square_footage FROM leases GROUP BY team_id""")
def portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.metrics(leases(spark, sf_dir))


HAS = {
    "tenant": "tenant IS NOT NULL", "landlord": "landlord IS NOT NULL", "rent_amount": "rent IS NOT NULL", "lease_start_date": "TRUE", "lease_end_date": "end_date IS NOT NULL", "property_address": "TRUE",
    "security_deposit": "deposit IS NOT NULL", "cam_charges": "cam IS NOT NULL", "rent_escalation": "NOT no_escalation", "renewal_options": "notice_days IS NOT NULL", "termination_options": "termination_year IS NOT NULL",
    "permitted_use": "has_use", "exclusivity_clause": "has_exclusivity", "insurance_requirements": "has_insurance", "default_cure_period": "cure_days IS NOT NULL", "square_footage": "sqft IS NOT NULL",
}
FIELD_SQL = (
    "raw_fields AS (" + " UNION ALL ".join(f"SELECT team_id, lease_id, '{f}' AS field, {i} AS idx, {HAS[f]} AS has FROM leases" for i, f in enumerate(FIELDS)) + "),"
    " fields AS (SELECT team_id, lease_id, field, has, CASE WHEN has THEN CASE WHEN (lease_id + idx * 7) % 5 < 2 THEN 'high' WHEN (lease_id + idx * 7) % 5 = 2 THEN 'medium' WHEN (lease_id + idx * 7) % 5 = 3 THEN 'low' END END AS confidence,"
    " CASE WHEN (lease_id + idx) % 17 = 0 THEN 'check' END AS validation_note FROM raw_fields)"
)


def lease_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field records with confidence tiers, of one scan of the leases."""
    rows = leases(spark, sf_dir)
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("idx"), F.col(f).alias("value")) for i, f in enumerate(FIELDS)])
    rows = rows.select("team_id", "lease_id", F.explode(items).alias("x")).select("team_id", "lease_id", "x.*")
    tier = (F.col("lease_id") + F.col("idx") * 7) % 5
    confidence = F.when(F.col("value").isNotNull(), F.when(tier < 2, "high").when(tier == 2, "medium").when(tier == 3, "low"))
    return rows.select("team_id", "lease_id", "field", "value", confidence.alias("confidence"), F.when((F.col("lease_id") + F.col("idx")) % 17 == 0, "check").alias("validation_note"))


@query(FIELD_SQL + " SELECT team_id, field, count(*) FILTER (NOT has) AS n_missing FROM fields GROUP BY team_id, field")
def missing_fields(spark, sf_dir):
    return portfolio.missing_fields(leases(spark, sf_dir))


CONFIDENCE_SQL = FIELD_SQL + """, by_lease AS (SELECT team_id, lease_id, count(*) AS total_fields, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium,
 count(*) FILTER (confidence = 'low') AS low, count(*) FILTER (confidence IS NULL) AS not_found, count(validation_note) AS flagged_for_review FROM fields GROUP BY team_id, lease_id)"""


@query(CONFIDENCE_SQL + " SELECT * FROM by_lease")
def confidence_by_lease(spark, sf_dir):
    return portfolio.confidence_by_lease(lease_fields(spark, sf_dir))


@query(CONFIDENCE_SQL + """ SELECT team_id, count(*) AS lease_count, CAST(sum(total_fields) AS BIGINT) AS total_fields, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(low) AS BIGINT) AS low,
 CAST(sum(not_found) AS BIGINT) AS not_found, CAST(sum(flagged_for_review) AS BIGINT) AS flagged_for_review, round(sum(high) * 100.0 / sum(total_fields), 1)::DOUBLE AS high_confidence_pct FROM by_lease GROUP BY team_id""")
def confidence_summary(spark, sf_dir):
    return portfolio.confidence(lease_fields(spark, sf_dir)).withColumn("high_confidence_pct", F.col("high_confidence_pct").cast("double"))


SHARE_SQL = """shares AS (SELECT team_id, tenant_key_raw AS tenant_key, min(tenant) AS tenant, sum(rent) AS rent_sum, sum(sum(rent)) OVER (PARTITION BY team_id) AS team_rent
 FROM leases WHERE tenant_key_raw IS NOT NULL AND rent >= 0 GROUP BY team_id, tenant_key_raw)"""


@query(SHARE_SQL + " SELECT team_id, tenant, tenant_key, CAST(rent_sum AS DOUBLE) AS rent, round(rent_sum::DOUBLE / team_rent::DOUBLE * 100, 2) AS pct_of_total FROM shares")
def tenant_shares(spark, sf_dir):
    return portfolio.tenant_shares(leases(spark, sf_dir)).select("team_id", "tenant", "tenant_key", F.col("rent_sum").cast("double").alias("rent"), F.round("pct", 2).alias("pct_of_total"))


@query(SHARE_SQL + """, ranked AS (SELECT *, rent_sum::DOUBLE / team_rent::DOUBLE * 100 AS pct, row_number() OVER (PARTITION BY team_id ORDER BY rent_sum DESC, tenant_key) AS place FROM shares),
 sums AS (SELECT team_id, count(*) AS tenant_count, CAST(max(team_rent) AS DOUBLE) AS total_rent, round(sum(pct) FILTER (place <= 1), 2) AS top_1_pct, round(sum(pct) FILTER (place <= 3), 2) AS top_3_pct,
 round(sum(pct) FILTER (place <= 5), 2) AS top_5_pct, round(sum(pct * pct), 1) AS hhi FROM ranked GROUP BY team_id)
 SELECT *, CASE WHEN hhi >= 2500 OR top_1_pct >= 25 THEN 'high' WHEN hhi >= 1500 OR top_1_pct >= 15 THEN 'moderate' ELSE 'low' END AS concentration_level FROM sums""")
def tenant_concentration(spark, sf_dir):
    return portfolio.concentration(leases(spark, sf_dir))


@query(f"""ok AS (SELECT team_id, CASE WHEN rent > 0 AND end_date >= DATE '{AS_OF}' THEN rent END AS r, date_diff('day', DATE '{AS_OF}', end_date) AS d FROM leases)
 SELECT team_id, round(CAST(sum(d * r) AS DOUBLE) / CAST(sum(r) AS DOUBLE) / 365.25, 2) AS walt_years, count(r) AS lease_count, count(*) - count(r) AS excluded_lease_count, CAST(sum(r) AS DOUBLE) AS total_weighted_rent FROM ok GROUP BY team_id""")
def weighted_remaining_term(spark, sf_dir):
    return portfolio.walt(leases(spark, sf_dir), AS_OF)


ROLLOVER_SQL = f"""ok AS (SELECT team_id, rent, date_diff('day', DATE '{AS_OF}', end_date) AS d FROM leases WHERE rent > 0 AND end_date IS NOT NULL),
 b AS (SELECT team_id, CASE WHEN d < 0 THEN 'expired' ELSE CASE least(floor(d / 365.25), 5)::INT WHEN 0 THEN 'year_1' WHEN 1 THEN 'year_2' WHEN 2 THEN 'year_3' WHEN 3 THEN 'year_4' WHEN 4 THEN 'year_5' ELSE 'year_6_plus' END END AS bucket, rent FROM ok),
 g AS (SELECT team_id, bucket, sum(rent) AS rent, count(*) AS n FROM b GROUP BY team_id, bucket),
 dense AS (SELECT team_id, bucket FROM (SELECT DISTINCT team_id FROM g), (SELECT unnest(['year_1','year_2','year_3','year_4','year_5','year_6_plus','expired']) AS bucket)),
 f AS (SELECT team_id, bucket, coalesce(rent, 0) AS rent, coalesce(n, 0) AS n FROM dense LEFT JOIN g USING (team_id, bucket)),
 roll AS (SELECT team_id, bucket, rent::DOUBLE AS rent, n AS lease_count, CASE WHEN bucket <> 'expired' THEN round(coalesce(rent::DOUBLE / nullif((sum(rent) FILTER (bucket <> 'expired') OVER (PARTITION BY team_id))::DOUBLE, 0), 0) * 100, 2) END AS pct_of_total_rent,
 CASE WHEN bucket <> 'expired' THEN round(coalesce(n::DOUBLE / nullif((sum(n) FILTER (bucket <> 'expired') OVER (PARTITION BY team_id))::DOUBLE, 0), 0) * 100, 2) END AS pct_of_total_leases FROM f)"""


@query(ROLLOVER_SQL + " SELECT * FROM roll")
def rollover_schedule(spark, sf_dir):
    return portfolio.rollover(leases(spark, sf_dir), AS_OF)


@query(ROLLOVER_SQL + """ SELECT team_id, year_1_pct, lease_count, CASE WHEN lease_count = 0 OR year_1_pct >= 25 THEN 'high' WHEN year_1_pct >= 15 THEN 'moderate' ELSE 'low' END AS rollover_risk_level
 FROM (SELECT team_id, max(pct_of_total_rent) FILTER (bucket = 'year_1') AS year_1_pct, CAST(sum(lease_count) FILTER (bucket <> 'expired') AS BIGINT) AS lease_count FROM roll GROUP BY team_id)""")
def rollover_risk(spark, sf_dir):
    return portfolio.rollover_risk(leases(spark, sf_dir), AS_OF)


@query(f"""m AS (SELECT team_id, lease_id, tenant, round(date_diff('day', DATE '{AS_OF}', end_date) / 30.4375, 1) AS months_remaining FROM leases)
 SELECT *, CASE WHEN months_remaining IS NULL THEN 'unknown_expiration' WHEN months_remaining < 0 THEN 'already_expired' WHEN months_remaining < 6 THEN 'expiring_0_6_months' WHEN months_remaining < 12 THEN 'expiring_6_12_months'
 WHEN months_remaining < 24 THEN 'expiring_12_24_months' ELSE 'expiring_24_plus_months' END AS bucket FROM m""")
def expiration_timeline(spark, sf_dir):
    return portfolio.timeline(leases(spark, sf_dir), AS_OF).drop("filename")


ALERT_SQL = f"""alive AS (SELECT *, date_diff('day', DATE '{AS_OF}', end_date) AS d FROM leases WHERE end_date >= DATE '{AS_OF}'),
 due AS (SELECT *, end_date - notice_days AS due, d - notice_days AS dd FROM alive WHERE notice_days IS NOT NULL),
 ex AS (SELECT team_id, lease_id, 'expiring' AS kind, end_date AS due_date, d AS days_remaining, CASE WHEN d <= 30 THEN '30' WHEN d <= 60 THEN '60' ELSE '90' END AS bucket FROM alive WHERE d <= 90 UNION ALL
 SELECT team_id, lease_id, 'renewal_deadline', due, dd, CASE WHEN dd < 0 THEN 'overdue' WHEN dd <= 30 THEN '30' WHEN dd <= 60 THEN '60' ELSE '90' END FROM due WHERE dd <= 90)"""


@query(ALERT_SQL + " SELECT * FROM ex")
def expiration_alerts(spark, sf_dir):
    return portfolio.expiration_alerts(leases(spark, sf_dir), AS_OF)


LOSS_SQL = """v AS (SELECT * FROM leases WHERE psf > 0), best AS (SELECT team_id, building_key, max(psf) AS top FROM v GROUP BY team_id, building_key HAVING count(*) >= 2),
 loss AS (SELECT team_id, lease_id, tenant, round(psf, 2) AS rent_per_sqft, round(top, 2) AS property_top_rent_per_sqft, round((top - psf) / top * 100, 2) AS loss_pct, round((top - psf) * sqft, 2) AS monthly_upside FROM v JOIN best USING (team_id, building_key))"""


@query(LOSS_SQL + " SELECT * FROM loss")
def loss_to_lease(spark, sf_dir):
    return portfolio.loss_to_lease(leases(spark, sf_dir))


MEANS_SQL = """means AS (SELECT team_id, round(avg(psf), 2) AS avg_psf, round(sum(rent)::DOUBLE / count(rent), 2) AS avg_rent, round(sum(cam)::DOUBLE / count(cam), 2) AS avg_cam, round(sum(deposit)::DOUBLE / count(deposit), 2) AS avg_deposit, round(avg(notice_days), 2) AS avg_notice FROM leases GROUP BY team_id)"""


@query(MEANS_SQL + """ SELECT team_id, lease_id, round(psf, 2) AS rent_per_sqft, avg_psf AS portfolio_avg, round((psf - avg_psf) / avg_psf * 100, 1) AS diff_pct, CASE WHEN psf > avg_psf THEN 'above' ELSE 'below' END AS direction
 FROM leases JOIN means USING (team_id) WHERE avg_psf > 0 AND psf > 0 AND abs((psf - avg_psf) / avg_psf * 100) >= 20""")
def rent_variance_outliers(spark, sf_dir):
    return portfolio.variance_outliers(leases(spark, sf_dir))


@query(MEANS_SQL + """, items AS (SELECT team_id, lease_id, 'rent' AS metric, rent::DOUBLE AS v, avg_rent AS a FROM leases JOIN means USING (team_id) UNION ALL SELECT team_id, lease_id, 'rent_per_sqft', psf, avg_psf FROM leases JOIN means USING (team_id)
 UNION ALL SELECT team_id, lease_id, 'cam', cam::DOUBLE, avg_cam FROM leases JOIN means USING (team_id) UNION ALL SELECT team_id, lease_id, 'deposit', deposit::DOUBLE, avg_deposit FROM leases JOIN means USING (team_id)
 UNION ALL SELECT team_id, lease_id, 'notice_days', notice_days::DOUBLE, avg_notice FROM leases JOIN means USING (team_id)), d AS (SELECT team_id, lease_id, metric, CASE WHEN a <> 0 THEN (v - a) / a * 100 END AS diff FROM items WHERE v IS NOT NULL)
 SELECT team_id, lease_id, metric, round(diff, 1) AS diff_pct, CASE WHEN diff IS NULL THEN 'unknown' WHEN abs(diff) <= 10 THEN 'in_line' WHEN diff > 0 THEN 'above' ELSE 'below' END AS status FROM d""")
def lease_benchmark(spark, sf_dir):
    return portfolio.benchmark(leases(spark, sf_dir))


CORE_SQL = "CASE WHEN tenant IS NULL THEN 'tenant' END, CASE WHEN landlord IS NULL THEN 'landlord' END, CASE WHEN rent IS NULL THEN 'rent_amount' END, CASE WHEN end_date IS NULL THEN 'lease_end_date' END"

FLAG_SQL = MEANS_SQL + """, j AS (SELECT *, CASE WHEN avg_psf > 0 AND psf IS NOT NULL THEN (avg_psf - psf) / avg_psf * 100 WHEN avg_rent > 0 AND rent IS NOT NULL THEN (avg_rent - rent::DOUBLE) / avg_rent * 100 END AS below,
 CASE WHEN has_schedule THEN greatest((y2-y1)::DOUBLE/y1::DOUBLE*100, (y3-y2)::DOUBLE/y2::DOUBLE*100, (y4-y3)::DOUBLE/y3::DOUBLE*100) - least((y2-y1)::DOUBLE/y1::DOUBLE*100, (y3-y2)::DOUBLE/y2::DOUBLE*100, (y4-y3)::DOUBLE/y3::DOUBLE*100) END AS spread,
 CASE WHEN end_date > start_date THEN date_diff('day', start_date, end_date) / 365.25 END AS years FROM leases JOIN means USING (team_id)),
 flags AS (SELECT team_id, lease_id, 1 AS check_no, CASE WHEN below >= 25 THEN 'high' ELSE 'medium' END AS severity, 'below_market_rent' AS category, 'rent_amount' AS field FROM j WHERE below >= 10
 UNION ALL SELECT team_id, lease_id, 2, 'medium', 'missing_clause', 'insurance_requirements' FROM j WHERE NOT has_insurance UNION ALL SELECT team_id, lease_id, 3, 'medium', 'missing_clause', 'default_cure_period' FROM j WHERE cure_days IS NULL
 UNION ALL SELECT team_id, lease_id, 4, 'medium', 'missing_clause', 'security_deposit' FROM j WHERE deposit IS NULL
 UNION ALL SELECT team_id, lease_id, 5, CASE WHEN notice_days < 30 THEN 'medium' ELSE 'low' END, 'notice_period_outlier', 'renewal_options' FROM j WHERE notice_days < 30 OR notice_days > 270
 UNION ALL SELECT team_id, lease_id, 6, 'low', 'notice_period_outlier', 'renewal_options' FROM j WHERE avg_notice > 0 AND abs(notice_days - avg_notice) / avg_notice * 100 > 50
 UNION ALL SELECT team_id, lease_id, 7, 'medium', 'one_sided_terms', 'rent_escalation' FROM j WHERE no_escalation AND years > 2 UNION ALL SELECT team_id, lease_id, 8, 'medium', 'one_sided_terms', 'default_cure_period' FROM j WHERE cure_days > 30
 UNION ALL SELECT team_id, lease_id, 9, CASE WHEN spread > 5 THEN 'high' ELSE 'medium' END, 'escalation_inconsistency', 'rent_escalation' FROM j WHERE spread > 2
 UNION ALL SELECT team_id, lease_id, 10, 'high', 'date_inconsistency', 'lease_end_date' FROM j WHERE end_date <= start_date)"""


@query(FLAG_SQL + " SELECT * FROM flags")
def risk_flags(spark, sf_dir):
    return risks.lease_flags(leases(spark, sf_dir))


@query("""s AS (SELECT team_id, unit_key, lease_id, psf, sqft FROM leases), p AS (SELECT a.team_id, a.lease_id AS la, b.lease_id AS lb, CASE WHEN a.psf <> 0 AND b.psf <> 0 THEN abs(a.psf - b.psf) / greatest(a.psf, b.psf) * 100 END AS d1,
 CASE WHEN a.sqft <> 0 AND b.sqft <> 0 THEN abs(a.sqft - b.sqft) / greatest(a.sqft, b.sqft) * 100 END AS d2 FROM s a JOIN s b ON a.team_id = b.team_id AND a.unit_key = b.unit_key AND a.lease_id < b.lease_id),
 f AS (SELECT team_id, la, lb, 'rent_amount' AS field, CASE WHEN d1 >= 25 THEN 'high' ELSE 'medium' END AS severity, round(d1, 1) AS diff_pct FROM p WHERE d1 >= 10 UNION ALL
 SELECT team_id, la, lb, 'square_footage', CASE WHEN d2 >= 15 THEN 'high' ELSE 'medium' END, round(d2, 1) FROM p WHERE d2 >= 5)
 SELECT team_id, la AS lease_id, lb AS other_id, field, severity, diff_pct FROM f UNION ALL SELECT team_id, lb, la, field, severity, diff_pct FROM f""")
def cross_lease_mismatches(spark, sf_dir):
    return risks.cross_lease(leases(spark, sf_dir))


@query(f"""o AS (SELECT team_id, lease_id, 'renewal_notice_deadline' AS obligation_type, end_date - notice_days AS due_date, 'overdue' AS past FROM leases WHERE notice_days IS NOT NULL AND end_date IS NOT NULL
 UNION ALL SELECT team_id, lease_id, 'termination_notice_deadline', CAST(start_date + to_years(3) AS DATE) - 1 - 90, 'overdue' FROM leases WHERE termination_year IS NOT NULL
 UNION ALL SELECT team_id, lease_id, 'rent_escalation', CAST(start_date + to_years(CAST(n AS INTEGER)) AS DATE), 'already_in_effect' FROM leases, range(1, 4) r(n) WHERE has_schedule
 UNION ALL SELECT team_id, lease_id, 'rent_escalation', CAST(start_date + to_years(CAST(n AS INTEGER)) AS DATE), 'already_in_effect' FROM leases, range(1, 41) r(n) WHERE stated_pct IS NOT NULL AND CAST(start_date + to_years(CAST(n AS INTEGER)) AS DATE) <= coalesce(end_date, DATE '2004-01-01')
 UNION ALL SELECT team_id, lease_id, 'insurance_certificate', NULL, 'overdue' FROM leases WHERE has_insurance)
 SELECT team_id, lease_id, obligation_type, due_date, date_diff('day', DATE '{AS_OF}', due_date) AS days_remaining, CASE WHEN due_date IS NULL THEN 'not_date_computable' WHEN due_date < DATE '{AS_OF}' THEN past ELSE 'upcoming' END AS status FROM o""")
def lease_obligations(spark, sf_dir):
    return risks.obligations(leases(spark, sf_dir), AS_OF)


@query(FLAG_SQL + ", " + FIELD_SQL + f""", a AS (SELECT team_id, lease_id, 'expiring_soon' AS reason, CAST(date_diff('day', DATE '{AS_OF}', end_date) AS VARCHAR) AS detail FROM leases WHERE end_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 90
 UNION ALL SELECT team_id, lease_id, 'missing_data', d FROM (SELECT team_id, lease_id, concat_ws(',', {CORE_SQL}) AS d FROM leases) WHERE d <> ''
 UNION ALL SELECT team_id, lease_id, 'needs_verification', string_agg(field, ',' ORDER BY field) FROM fields WHERE confidence = 'medium' AND field IN ('tenant','landlord','rent_amount','lease_start_date','lease_end_date') GROUP BY team_id, lease_id
 UNION ALL SELECT team_id, lease_id, 'unusual_terms', CAST(count(*) AS VARCHAR) FROM flags WHERE severity IN ('high','medium') GROUP BY team_id, lease_id) SELECT * FROM a""")
def attention_items(spark, sf_dir):
    rows = leases(spark, sf_dir)
    return portfolio.attention(rows, lease_fields(spark, sf_dir), risks.lease_flags(rows), AS_OF)


@query(FLAG_SQL + f""", review AS (SELECT team_id, count(*) AS n FROM (SELECT team_id, lease_id FROM leases WHERE tenant IS NULL OR landlord IS NULL OR rent IS NULL OR end_date IS NULL UNION SELECT team_id, lease_id FROM flags WHERE severity IN ('high','medium')) GROUP BY team_id),
 x AS (SELECT team_id, rent, date_diff('day', DATE '{AS_OF}', end_date) AS d FROM leases),
 s AS (SELECT team_id, count(*) AS total_leases, round(avg(CASE WHEN d >= 0 THEN d END), 0) AS avg_days_to_expiration, CAST(sum(rent) FILTER (d BETWEEN 0 AND 182) AS DOUBLE) AS monthly_rent_expiring_6mo, CAST(sum(rent) FILTER (d BETWEEN 0 AND 365) AS DOUBLE) AS monthly_rent_expiring_12mo FROM x GROUP BY team_id)
 SELECT s.*, coalesce(n, 0) AS needs_review_count, total_leases - coalesce(n, 0) AS fully_verified_count, round((total_leases - coalesce(n, 0)) * 100.0 / total_leases, 1)::DOUBLE AS fully_verified_pct FROM s LEFT JOIN review USING (team_id)""")
def portfolio_health(spark, sf_dir):
    rows = leases(spark, sf_dir)
    return portfolio.health(rows, risks.lease_flags(rows), AS_OF).withColumn("fully_verified_pct", F.col("fully_verified_pct").cast("double"))


@query(FLAG_SQL + ", " + CONFIDENCE_SQL + f""", c AS (SELECT team_id, round((sum(high) + 0.6::DOUBLE * sum(medium) + 0.3::DOUBLE * sum(low)) / sum(total_fields) * 100, 1)::DOUBLE AS confidence_score FROM by_lease GROUP BY team_id),
 o AS (SELECT team_id, count(*) AS n, count(*) FILTER (tenant IS NOT NULL AND landlord IS NOT NULL AND rent IS NOT NULL AND end_date IS NOT NULL AND flagged_for_review = 0) AS v, count(*) FILTER (date_diff('day', uploaded_at, DATE '{AS_OF}') <= 6 * 30.4375) AS f FROM leases JOIN by_lease USING (team_id, lease_id) GROUP BY team_id),
 d AS (SELECT team_id, count(*) AS k FROM flags WHERE severity = 'high' GROUP BY team_id),
 r AS (SELECT team_id, n AS lease_count, confidence_score, round(v * 100.0 / n, 1)::DOUBLE AS verification_score, round(100 / (1 + coalesce(k, 0)::DOUBLE / n), 1) AS findings_score, round(f * 100.0 / n, 1)::DOUBLE AS freshness_score FROM o JOIN c USING (team_id) LEFT JOIN d USING (team_id)),
 t AS (SELECT *, round(0.30::DOUBLE * confidence_score + 0.25::DOUBLE * verification_score + 0.25::DOUBLE * findings_score + 0.20::DOUBLE * freshness_score, 1) AS score FROM r)
 SELECT *, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair' WHEN score >= 40 THEN 'Poor' ELSE 'Critical' END AS rating FROM t""")
def portfolio_health_score(spark, sf_dir):
    rows = leases(spark, sf_dir)
    out = portfolio.health_score(rows, lease_fields(spark, sf_dir), risks.lease_flags(rows).where("severity = 'high'"), AS_OF)
    return out.select("team_id", "lease_count", *[F.col(c).cast("double").alias(c) for c in ("confidence_score", "verification_score", "findings_score", "freshness_score", "score")], "rating")


# --- history -------------------------------------------------------------------------------------

LAG_SQL = """h AS (SELECT team_id, unit_key, building_key, lease_id, uploaded_at, end_date, tenant_key_raw AS tk, rent::DOUBLE AS rent, lag(rent::DOUBLE) OVER w AS before, lag(lease_id) OVER w AS from_id, lag(tenant_key_raw) OVER w AS tb FROM leases WINDOW w AS (PARTITION BY team_id, unit_key ORDER BY uploaded_at, lease_id))"""


@query(LAG_SQL + " SELECT team_id, unit_key, from_id AS from_lease_id, lease_id AS to_lease_id, round((rent - before) / before * 100, 2) AS pct_change, tk IS DISTINCT FROM tb AS tenant_changed FROM h WHERE rent IS NOT NULL AND before <> 0")
def rent_growth(spark, sf_dir):
    return history.rent_growth(leases(spark, sf_dir))


@query("""g AS (SELECT team_id, unit_key, count(*) AS data_points, count(rent) AS priced, arg_min(rent::DOUBLE, (uploaded_at, lease_id)) FILTER (rent IS NOT NULL) AS f, arg_max(rent::DOUBLE, (uploaded_at, lease_id)) FILTER (rent IS NOT NULL) AS l FROM leases GROUP BY team_id, unit_key)
 SELECT team_id, unit_key, data_points, CASE WHEN priced >= 2 AND f <> 0 THEN round((l - f) / f * 100, 2) END AS total_pct_change FROM g""")
def unit_growth(spark, sf_dir):
    return history.unit_growth(leases(spark, sf_dir))


@query(LAG_SQL + " SELECT team_id, unit_key, from_id AS old_lease_id, lease_id AS new_lease_id, uploaded_at AS detected_at FROM h WHERE tk <> tb")
def tenant_turnover(spark, sf_dir):
    return history.turnover(leases(spark, sf_dir))


@query("""m AS (SELECT DISTINCT team_id, lpad(CAST(n AS VARCHAR), 2, '0') AS month FROM leases, range(1, 13) r(n)), c AS (SELECT team_id, strftime(end_date, '%m') AS month, count(*) AS n FROM leases WHERE end_date IS NOT NULL GROUP BY ALL)
 SELECT team_id, month, coalesce(n, 0) AS n FROM m LEFT JOIN c USING (team_id, month)""")
def expirations_by_month(spark, sf_dir):
    return history.expirations_by_month(leases(spark, sf_dir))


@query(LAG_SQL + """ SELECT team_id, coalesce(building_key, '(all)') AS building_key, count(*) AS record_count, count(DISTINCT unit_key) AS units, count(*) FILTER (tk <> tb) AS turnover_count, count(end_date) AS expirations FROM h GROUP BY ROLLUP (team_id, building_key) HAVING team_id IS NOT NULL""")
def building_trends(spark, sf_dir):
    return history.building_trends(leases(spark, sf_dir))


# --- reconciliation ------------------------------------------------------------------------------

OPERATIVE_SQL = f"""d0 AS (SELECT *, count(*) OVER (PARTITION BY team_id, unit_key) AS n0, row_number() OVER (PARTITION BY team_id, unit_key, tenant, rent, start_date, end_date, has_schedule, stated_pct, lease_id % 3 ORDER BY lease_id) AS copy FROM leases WHERE NOT is_rent_roll),
 d1 AS (SELECT *, count(*) OVER (PARTITION BY team_id, unit_key) AS n, coalesce(start_date <= DATE '{AS_OF}' AND DATE '{AS_OF}' <= end_date, FALSE) AS covers FROM d0),
 d2 AS (SELECT *, bool_or(covers) OVER (PARTITION BY team_id, unit_key) AS any_cover, row_number() OVER (PARTITION BY team_id, unit_key ORDER BY start_date DESC NULLS LAST, lease_id) AS latest FROM d1),
 d3 AS (SELECT *, max(lease_id) OVER (PARTITION BY team_id, unit_key, tenant, start_date, end_date) AS newest FROM d2 WHERE n = 1 OR CASE WHEN any_cover THEN covers ELSE latest = 1 END),
 lyear AS (SELECT *, CASE WHEN year(DATE '{AS_OF}') - year(start_date) - (month(DATE '{AS_OF}') * 100 + day(DATE '{AS_OF}') < month(start_date) * 100 + day(start_date))::INT + 1 IS NULL THEN 1 ELSE year(DATE '{AS_OF}') - year(start_date) - (month(DATE '{AS_OF}') * 100 + day(DATE '{AS_OF}') < month(start_date) * 100 + day(start_date))::INT + 1 END AS ly FROM d3 WHERE NOT (any_cover AND n > 1) OR lease_id = newest),
 operative AS (SELECT *, CASE WHEN DATE '{AS_OF}' >= start_date AND has_schedule THEN CASE WHEN ly >= 4 THEN y4 WHEN ly = 3 THEN y3 WHEN ly = 2 THEN y2 ELSE y1 END::DOUBLE WHEN DATE '{AS_OF}' >= start_date AND stated_pct IS NOT NULL THEN round(CAST(rent::DOUBLE * pow(1 + stated_pct / 100, ly - 1) AS DECIMAL(18,6)), 2)::DOUBLE ELSE rent::DOUBLE END AS rent_now FROM lyear),
 pairs AS (SELECT r.team_id, r.unit_key, r.lease_id AS roll_lease_id, o.lease_id AS doc_lease_id, r.tenant AS rt, o.tenant AS dt, r.rent::DOUBLE AS rr, o.rent::DOUBLE AS dr, o.rent_now AS dn, r.start_date AS rs, o.start_date AS ds, r.end_date AS re, o.end_date AS de
   FROM leases r JOIN operative o ON r.team_id = o.team_id AND r.unit_key = o.unit_key WHERE r.is_rent_roll)"""


@query(OPERATIVE_SQL + " SELECT team_id, unit_key, lease_id, rent_now FROM operative")
def operative_documents(spark, sf_dir):
    docs = reconcile.operative_documents(leases(spark, sf_dir), AS_OF)
    return docs.select("team_id", "unit_key", "lease_id", reconcile.rent_in_effect(AS_OF)["rent"].alias("rent_now"))


def households(rows: DataFrame) -> DataFrame:
    """The same leases with their tenants written in four ways, by the lease: in order, by surname, with an initial, and beside a partner."""
    digits = F.regexp_extract("tenant", "([0-9]+)$", 1)
    first, last = (F.initcap(F.concat(F.lit(p), F.translate(digits, "0123456789", letters))) for p, letters in (("mo", "abcdefghij"), ("ra", "klmnoprstu")))
    k = F.col("lease_id") % 4
    name = F.when(k == 0, F.concat_ws(" ", first, last)).when(k == 1, F.concat_ws(", ", last, first)).when(k == 2, F.upper(F.concat_ws(" ", first, F.lit("Q."), last))).otherwise(F.concat(first, F.lit(" "), last, F.lit(" & Zoe Partner")))
    return rows.withColumn("tenant", F.when(F.col("tenant").isNotNull(), name)).withColumn("tenant_key", keys.name_key("tenant"))


#: Versions of a lease are of one way to write its tenant; the names in ``pairs`` stay those of the customers, each a household.
HOUSEHOLD_SQL = OPERATIVE_SQL.replace("unit_key, tenant, ", "unit_key, tenant, lease_id % 4, ")


@query(HOUSEHOLD_SQL + """ SELECT team_id, unit_key, roll_lease_id, doc_lease_id, 'tenant' AS field FROM pairs WHERE rt <> dt UNION ALL SELECT team_id, unit_key, roll_lease_id, doc_lease_id, 'rent_amount' FROM pairs WHERE abs(rr - dr) > 5 AND abs(rr - dr) * 100 / greatest(rr, dr) > 1
 UNION ALL SELECT team_id, unit_key, roll_lease_id, doc_lease_id, 'lease_end_date' FROM pairs WHERE re <> de""")
def rent_roll_reconciliation(spark, sf_dir):
    return reconcile.roll_mismatches(households(leases(spark, sf_dir)), AS_OF)


FINDING_SQL = OPERATIVE_SQL + """, found AS (SELECT team_id, unit_key, roll_lease_id, doc_lease_id, 'rent_mismatch' AS discrepancy_type, 'rent_amount' AS field, round(abs(rr - dn), 2) AS monthly_impact, round(round(abs(rr - dn), 2) * 12, 2) AS annual_impact,
   CASE WHEN rr > dn THEN 'overstate' ELSE 'understate' END AS income_direction, CASE WHEN abs(rr - dn) >= 1000 THEN 'high' WHEN abs(rr - dn) >= 250 THEN 'medium' ELSE 'low' END AS severity FROM pairs WHERE abs(rr - dn) > 5 AND abs(rr - dn) * 100 / greatest(rr, dn) > 1),
 gone AS (SELECT team_id, unit_key, roll_lease_id, doc_lease_id, 'expired_but_occupied' AS discrepancy_type, 'lease_end_date' AS field, rr AS monthly_impact, round(rr * 12, 2) AS annual_impact, 'overstate' AS income_direction,
   CASE WHEN rr IS NULL THEN 'medium' WHEN rr >= 1000 THEN 'high' WHEN rr >= 250 THEN 'medium' ELSE 'low' END AS severity FROM pairs WHERE de < DATE '""" + AS_OF + """' AND rt IS NOT NULL),
 dated AS (SELECT team_id, unit_key, roll_lease_id, doc_lease_id, 'dates_mismatch' AS discrepancy_type, 'lease_start_date' AS field, NULL::DOUBLE AS monthly_impact, NULL::DOUBLE AS annual_impact, NULL::VARCHAR AS income_direction, 'medium' AS severity FROM pairs WHERE rs <> ds
   UNION ALL SELECT team_id, unit_key, roll_lease_id, doc_lease_id, 'dates_mismatch', 'lease_end_date', NULL, NULL, NULL, 'medium' FROM pairs WHERE re <> de UNION ALL SELECT team_id, unit_key, roll_lease_id, doc_lease_id, 'tenant_mismatch', 'tenant', NULL, NULL, NULL, 'high' FROM pairs WHERE rt <> dt),
 alone AS (SELECT team_id, unit_key, lease_id, 'unit_no_lease' AS discrepancy_type FROM leases l WHERE is_rent_roll AND NOT EXISTS (SELECT 1 FROM leases m WHERE NOT m.is_rent_roll AND m.team_id = l.team_id AND m.unit_key = l.unit_key)
   UNION ALL SELECT team_id, unit_key, lease_id, 'lease_no_unit' FROM leases l WHERE NOT is_rent_roll AND NOT EXISTS (SELECT 1 FROM leases m WHERE m.is_rent_roll AND m.team_id = l.team_id AND m.unit_key = l.unit_key))"""


@query(FINDING_SQL + " SELECT * FROM found")
def rent_mismatches(spark, sf_dir):
    return reconcile.rent_findings(leases(spark, sf_dir), AS_OF)


@query(FINDING_SQL + " SELECT * FROM gone")
def expired_but_occupied(spark, sf_dir):
    return reconcile.expired_but_occupied(leases(spark, sf_dir), AS_OF)


@query(FINDING_SQL.replace(OPERATIVE_SQL, HOUSEHOLD_SQL) + " SELECT * FROM dated")
def date_and_tenant_mismatches(spark, sf_dir):
    return reconcile.date_and_tenant_findings(households(leases(spark, sf_dir)), AS_OF)


@query(FINDING_SQL + " SELECT * FROM alone")
def presence_check(spark, sf_dir):
    return reconcile.presence(leases(spark, sf_dir))


@query("""r AS (SELECT *, row_number() OVER (PARTITION BY team_id, unit_key ORDER BY is_rent_roll, uploaded_at DESC, lease_id DESC) AS place FROM leases) SELECT team_id, unit_key, lease_id, is_rent_roll FROM r WHERE place = 1""")
def financial_scope(spark, sf_dir):
    return reconcile.financial_scope(leases(spark, sf_dir)).select("team_id", "unit_key", "lease_id", "is_rent_roll")


def building_income(spark, sf_dir) -> DataFrame:
    """Statement income per building: line amounts of its orders, added up before the join as line keys repeat."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"))
    keyed = leases(spark, sf_dir).select("lease_id", "team_id", "building_key").join(lines, F.col("lease_id") == F.col("l_orderkey"))
    return keyed.groupBy("team_id", "building_key").agg((F.sum("amount") / 40).cast("double").alias("annual_income"))


@query("""li AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem GROUP BY l_orderkey), inc AS (SELECT team_id, building_key, round(sum(amount)::DOUBLE / 40, 2) AS stated FROM leases JOIN li ON lease_id = l_orderkey GROUP BY team_id, building_key),
 roll AS (SELECT team_id, building_key, sum(rent) AS s, count(rent) AS n, count(*) - count(rent) AS x FROM leases WHERE is_rent_roll GROUP BY team_id, building_key), docs AS (SELECT team_id, building_key, sum(rent) AS s, count(rent) AS n, count(*) - count(rent) AS x FROM leases WHERE NOT is_rent_roll GROUP BY team_id, building_key),
 j AS (SELECT inc.team_id, inc.building_key, stated, CASE WHEN roll.n IS NOT NULL THEN roll.n ELSE docs.n END AS n, CASE WHEN roll.n IS NOT NULL THEN roll.x ELSE docs.x END AS x, round((CASE WHEN roll.n IS NOT NULL THEN roll.s ELSE docs.s END)::DOUBLE * 12, 2) AS annual FROM inc LEFT JOIN roll USING (team_id, building_key) LEFT JOIN docs USING (team_id, building_key)),
 d AS (SELECT *, round(annual - stated, 2) AS diff FROM j), p AS (SELECT *, CASE WHEN annual IS NOT NULL THEN round(coalesce(abs(diff) / nullif(greatest(abs(annual), abs(stated)), 0), 0) * 100, 2) END AS pct FROM d)
 SELECT team_id, building_key, coalesce(n, 0) AS matched_lease_count, coalesce(x, 0) AS excluded_lease_count, annual AS rent_roll_annual_rent, stated AS t12_annual_rental_income, diff AS difference, pct AS difference_pct,
 CASE WHEN diff > 0 THEN 'rent_roll_higher' WHEN diff < 0 THEN 't12_higher' WHEN diff = 0 THEN 'agree' END AS direction, CASE WHEN annual IS NOT NULL THEN abs(diff) > 3000 AND pct > 5 END AS flagged FROM p""")
def t12_reconciliation(spark, sf_dir):
    return reconcile.t12_reconciliation(leases(spark, sf_dir), building_income(spark, sf_dir))


@query("""WITH l AS (SELECT n_regionkey AS team_id, n_name AS building_key, l_returnflag AS category, month(l_shipdate) AS month_idx, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE year(l_shipdate) = 1998 GROUP BY ALL),
 m AS (SELECT *, max(month_idx) OVER (PARTITION BY team_id, building_key, category) AS last FROM l), s AS (SELECT team_id, building_key, category, (sum(amount) FILTER (month_idx > last - 3))::DOUBLE AS s3, sum(amount)::DOUBLE AS s12, (sum(amount) FILTER (month_idx > last - 3))::DOUBLE / 3 AS t3, sum(amount)::DOUBLE / count(amount) AS t12, count(*) AS n FROM m GROUP BY team_id, building_key, category)
 SELECT team_id, building_key, category, s3 AS last_3_total, s12 AS total, round((t3 - t12) / abs(t12) * 100, 1) AS change_pct, (t3 - t12) / abs(t12) * 100 > 25 AS flagged FROM s WHERE n >= 6 AND t12 <> 0""", lease=False)
def trailing_trend(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1998-01-01' AND l_shipdate < TIMESTAMP_NTZ '1999-01-01'")
    rows = lines.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    by_month = rows.groupBy(F.col("n_regionkey").alias("team_id"), F.col("n_name").alias("building_key"), F.col("l_returnflag").alias("category"), F.month("l_shipdate").alias("month_idx")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"))
    return reconcile.trailing_trend(by_month)


@query("""u AS (SELECT DISTINCT team_id, building_key, CAST(year(uploaded_at) AS VARCHAR) AS file, year(uploaded_at) AS y, unit_key FROM leases WHERE is_rent_roll), z AS (SELECT team_id, building_key, file, y, count(*) AS units FROM u GROUP BY ALL),
 s AS (SELECT a.team_id, a.building_key, a.file, b.file AS new_file, count(*) AS shared FROM u a JOIN u b ON a.team_id = b.team_id AND a.building_key = b.building_key AND a.unit_key = b.unit_key AND b.y > a.y GROUP BY ALL)
 SELECT team_id, building_key, file, min(new_file) AS replaced_by, max(round(shared * 100.0::DOUBLE / units, 1)) AS overlap_pct FROM z JOIN s USING (team_id, building_key, file) WHERE shared >= units * 0.5 GROUP BY team_id, building_key, file""")
def superseded_files(spark, sf_dir):
    rolls = leases(spark, sf_dir).where("is_rent_roll").select("team_id", "building_key", F.year("uploaded_at").cast("string").alias("file"), F.year("uploaded_at").alias("uploaded_at"), "unit_key")
    return reconcile.superseded_files(rolls).withColumn("overlap_pct", F.col("overlap_pct").cast("double"))


# --- amendments and versions ---------------------------------------------------------------------


def amendment_fields(spark, sf_dir) -> DataFrame:
    """A customer's orders as a base lease and its amendments."""
    o = read(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 29 != 0, F.floor("o_totalprice").cast("string"))
    values = {"rent": price, "status": F.col("o_orderstatus"), "priority": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))}
    items = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in values.items()]))
    return o.select(F.col("o_custkey").alias("base_lease_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("uploaded_at"), items.alias("x")).select("base_lease_id", "doc_id", "uploaded_at", "x.*")


AMEND_SQL = """WITH f AS (SELECT o_custkey AS base_lease_id, o_orderkey AS doc_id, o_orderdate AS seen, 'rent' AS field, CASE WHEN o_orderkey % 29 <> 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS value FROM orders UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, 'status', o_orderstatus FROM orders
 UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, 'priority', CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END FROM orders) """


@query(AMEND_SQL + """SELECT base_lease_id, field, arg_max(value, (seen, doc_id)) FILTER (value IS NOT NULL) AS value, arg_max(doc_id, (seen, doc_id)) FILTER (value IS NOT NULL) AS source_doc_id, count(DISTINCT doc_id) AS documents FROM f GROUP BY base_lease_id, field""", lease=False)
def effective_fields(spark, sf_dir):
    return overlay.effective_fields(amendment_fields(spark, sf_dir))


@query(AMEND_SQL + "SELECT base_lease_id, field, doc_id, value, row_number() OVER (PARTITION BY base_lease_id, field ORDER BY seen DESC, doc_id DESC) = 1 AS is_effective FROM f WHERE value IS NOT NULL", lease=False)
def field_provenance(spark, sf_dir):
    return overlay.provenance(amendment_fields(spark, sf_dir))


@query("""SELECT o_orderkey AS lease_id, first_value(o_orderkey) OVER w AS root_id, CAST(row_number() OVER w - 1 AS INTEGER) AS depth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""", lease=False)
def version_chains(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lease_id"), F.lag("o_orderkey").over(order).alias("supersedes_lease_id"))
    return overlay.version_chain(o)


# --- state ---------------------------------------------------------------------------------------


def flag_rows(spark, sf_dir) -> DataFrame:
    return risks.lease_flags(leases(spark, sf_dir))


KEYED_SQL = FLAG_SQL + """, keyed AS (SELECT *, 'lease_risk_flag:' || lease_id || ':' || category || ':' || field || ':' || (row_number() OVER (PARTITION BY team_id, lease_id, category, field ORDER BY check_no, severity) - 1) AS natural_key FROM flags)"""


@query(KEYED_SQL + " SELECT natural_key, severity, team_id FROM keyed")
def finding_keys(spark, sf_dir):
    return state.finding_keys(flag_rows(spark, sf_dir)).select("natural_key", "severity", "team_id")


@query(KEYED_SQL + """, old AS (SELECT natural_key, 'low' AS severity, 1.0 AS impact, CASE WHEN lease_id % 2 = 0 THEN 'resolved' ELSE 'open' END AS status FROM keyed WHERE lease_id % 3 <> 0), new AS (SELECT natural_key, severity, lease_id::DOUBLE AS impact FROM keyed WHERE lease_id % 5 <> 0)
 SELECT natural_key, coalesce(n.severity, o.severity) AS severity, CASE WHEN n.severity IS NOT NULL THEN n.impact ELSE o.impact END AS impact, coalesce(o.status, 'open') AS status, CASE WHEN o.status IS NULL THEN TIMESTAMP '1999-02-01' ELSE TIMESTAMP '1999-01-01' END AS first_detected_at,
 CASE WHEN n.severity IS NOT NULL THEN TIMESTAMP '1999-02-01' ELSE TIMESTAMP '1999-01-01' END AS last_seen_at FROM old o FULL JOIN new n USING (natural_key)""")
def findings_upsert(spark, sf_dir):
    return _snapshots(spark, sf_dir)[1].withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_detected_at", "last_seen_at")})


def _snapshots(spark, sf_dir, keyed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings before and after a run."""
    keyed = state.finding_keys(flag_rows(spark, sf_dir)) if keyed is None else keyed
    time = F.lit("1999-01-01").cast("timestamp")
    old = keyed.where("lease_id % 3 <> 0").select("natural_key", F.lit("low").alias("severity"), F.lit(1.0).alias("impact"), F.when(F.col("lease_id") % 2 == 0, "resolved").otherwise("open").alias("status"), time.alias("first_detected_at"), time.alias("last_seen_at"))
    new = keyed.where("lease_id % 5 <> 0").select("natural_key", "severity", F.col("lease_id").cast("double").alias("impact"))
    return old, state.upsert_findings(old, new, "1999-02-01")


CANDIDATE_SQL = KEYED_SQL + ", " + ALERT_SQL + ", " + LOSS_SQL + ", " + SHARE_SQL + """, cand AS (SELECT 'lease_expiration:' || lease_id AS natural_key, 'lease_expiration' AS alert_type, CASE bucket WHEN '30' THEN 'high' WHEN '60' THEN 'medium' ELSE 'low' END AS severity, lease_id FROM ex WHERE kind = 'expiring'
 UNION ALL SELECT 'below_market_rent:' || lease_id, 'below_market_rent', CASE WHEN loss_pct >= 20 THEN 'high' ELSE 'medium' END, lease_id FROM loss WHERE loss_pct >= 10
 UNION ALL SELECT 'tenant_concentration:team' || team_id || ':' || lower(tenant), 'tenant_concentration', 'high', NULL FROM shares WHERE round(rent_sum::DOUBLE / team_rent::DOUBLE * 100, 2) >= 25
 UNION ALL SELECT 'new_discrepancy:' || natural_key, 'new_discrepancy', severity, lease_id FROM keyed WHERE lease_id % 3 = 0 AND lease_id % 5 <> 0)"""


#: What alerts and flags read of the leases.
ALERTED = (
    "team_id", "lease_id", "tenant", "tenant_key", "building_key", "uploaded_at", "rent", "cam", "deposit", "psf", "sqft", "notice_days", "start_date", "end_date", "schedule", "escalation_pct", "cure_days",
    "insurance_requirements", "default_cure_period", "security_deposit", "rent_escalation",
)


def alert_candidates(spark, sf_dir) -> DataFrame:
    """Expiring leases, rents below their building's best, dominant tenants, and findings that a run opened."""
    rows = sinks.kept(leases(spark, sf_dir).select(*ALERTED))  # read a dozen times, parsed once
    ex = portfolio.expiration_alerts(rows, AS_OF).where("kind = 'expiring'").select(F.concat(F.lit("lease_expiration:"), "lease_id").alias("natural_key"), F.lit("lease_expiration").alias("alert_type"), F.when(F.col("bucket") == "30", "high").when(F.col("bucket") == "60", "medium").otherwise("low").alias("severity"), "lease_id")
    low = portfolio.loss_to_lease(rows).where("loss_pct >= 10").select(F.concat(F.lit("below_market_rent:"), "lease_id").alias("natural_key"), F.lit("below_market_rent").alias("alert_type"), F.when(F.col("loss_pct") >= 20, "high").otherwise("medium").alias("severity"), "lease_id")
    big = portfolio.tenant_shares(rows).where(F.round("pct", 2) >= 25).select(F.concat(F.lit("tenant_concentration:team"), "team_id", F.lit(":"), F.lower("tenant")).alias("natural_key"), F.lit("tenant_concentration").alias("alert_type"), F.lit("high").alias("severity"), F.lit(None).cast("long").alias("lease_id"))
    opened = state.discrepancy_alerts(state.finding_changes(*_snapshots(spark, sf_dir, sinks.kept(state.finding_keys(risks.lease_flags(rows))))))
    return ex.unionByName(low).unionByName(big).unionByName(opened)


@query(CANDIDATE_SQL + " SELECT * FROM cand")
def alerts_raised(spark, sf_dir):
    return alert_candidates(spark, sf_dir)


RUN_SQL = CANDIDATE_SQL + """, old AS (SELECT natural_key, alert_type, 'low' AS severity, CASE lease_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'auto_resolved' ELSE 'active' END AS status FROM cand WHERE lease_id % 3 <> 0), new AS (SELECT * FROM cand WHERE lease_id IS NULL OR lease_id % 5 <> 0),
 run AS (SELECT natural_key, coalesce(n.alert_type, o.alert_type) AS alert_type, coalesce(n.severity, o.severity) AS severity, CASE WHEN o.status IS NULL THEN 'active' WHEN n.alert_type IS NOT NULL AND o.status = 'auto_resolved' THEN 'active' WHEN n.alert_type IS NULL AND o.status = 'active' THEN 'auto_resolved' ELSE o.status END AS status,
 CASE WHEN o.status IS NULL THEN 'created' WHEN n.alert_type IS NOT NULL THEN 'refreshed' WHEN o.status = 'active' THEN 'auto_resolved' ELSE 'kept' END AS change FROM old o FULL JOIN new n USING (natural_key))"""


def _alert_run(spark, sf_dir) -> DataFrame:
    found = sinks.kept(alert_candidates(spark, sf_dir))
    k = F.col("lease_id") % 4
    old = found.where("lease_id % 3 <> 0").select("natural_key", "alert_type", F.lit("low").alias("severity"), F.when(k == 1, "dismissed").when(k == 2, "auto_resolved").otherwise("active").alias("status"), F.lit("1999-01-01").cast("timestamp").alias("created_at"))
    return state.run_alerts(old, found.where("lease_id IS NULL OR lease_id % 5 <> 0"), "1999-02-01")


@query(RUN_SQL + " SELECT * FROM run")
def alert_run(spark, sf_dir):
    return _alert_run(spark, sf_dir).drop("created_at")


@query(RUN_SQL + " SELECT alert_type, count(*) AS active, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM run WHERE status = 'active' GROUP BY alert_type")
def alert_digest(spark, sf_dir):
    return state.digest(_alert_run(spark, sf_dir))


@query(FLAG_SQL + """, p AS (SELECT category, field, count(DISTINCT lease_id) AS lease_count, count(*) AS discrepancy_count, CAST(sum(CASE WHEN lease_id % 2 = 0 THEN CAST(lease_id AS DECIMAL(18,2)) END) AS DOUBLE) AS total_impact FROM flags GROUP BY category, field) SELECT 'lease_risk_flag' AS discrepancy_type, * FROM p WHERE lease_count >= 3""")
def discrepancy_patterns(spark, sf_dir):
    rows = flag_rows(spark, sf_dir).withColumn("discrepancy_type", F.lit("lease_risk_flag")).withColumn("related_lease_id", F.col("lease_id")).withColumn("impact", F.when(F.col("lease_id") % 2 == 0, F.col("lease_id").cast("double")))
    return state.patterns(rows)


@query(FLAG_SQL + """ SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(severity) = 0 THEN 'severity' ELSE 'field' END AS scope, coalesce(category, severity, field) AS name, count(*) AS n FROM flags GROUP BY GROUPING SETS ((category), (severity), (field))""")
def discrepancy_summary(spark, sf_dir):
    rows = flag_rows(spark, sf_dir).groupingSets([["category"], ["severity"], ["field"]], "category", "severity", "field").agg(F.count("*").alias("n"))
    scope = F.when(F.col("category").isNotNull(), "category").when(F.col("severity").isNotNull(), "severity").otherwise("field")
    return rows.select(scope.alias("scope"), F.coalesce("category", "severity", "field").alias("name"), "n")


# --- activity ------------------------------------------------------------------------------------


def views(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("path"), F.col("user_id").alias("session_id"), "ts")


@query("SELECT event_type AS path, count(*) AS views, count(DISTINCT user_id) AS sessions FROM events GROUP BY event_type ORDER BY views DESC, path LIMIT 20", lease=False)
def traffic_by_path(spark, sf_dir):
    return activity.traffic(views(spark, sf_dir), "path")


@query("""SELECT lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host, count(*) AS views, count(DISTINCT page_id) AS sessions FROM pages GROUP BY 1 HAVING host IS NOT NULL ORDER BY views DESC, host LIMIT 20""", lease=False)
def traffic_by_host(spark, sf_dir):
    return activity.traffic(read(spark, sf_dir, "pages").select(activity.host_of(F.col("url")).alias("host"), F.col("page_id").alias("session_id")), "host")


@query("""SELECT CAST(list_position(t, event_type) AS BIGINT) AS step, event_type AS path, count(DISTINCT user_id) AS sessions FROM events, (SELECT list(DISTINCT event_type ORDER BY event_type) AS t FROM events) WHERE list_position(t, event_type) <= 3 GROUP BY 1, 2""", lease=False)
def traffic_funnel(spark, sf_dir):
    rows = views(spark, sf_dir)
    steps = [r.path for r in rows.where("path IS NOT NULL").select("path").distinct().orderBy("path").limit(3).collect()]
    return activity.funnel(rows, steps)


@query("SELECT CAST(ts AS DATE) AS date, count(*) AS views, count(DISTINCT user_id) AS sessions FROM events WHERE CAST(ts AS DATE) > DATE '2023-12-31' AND CAST(ts AS DATE) <= DATE '2024-01-30' GROUP BY 1", lease=False)
def daily_views(spark, sf_dir):
    return activity.daily(views(spark, sf_dir), "2024-01-30", 30)


@query("SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS events, CAST(coalesce(sum(event_id % 50), 0) AS BIGINT) AS pages FROM events WHERE event_type <> 'dedup_reuse' GROUP BY 1, 2", lease=False)
def monthly_usage(spark, sf_dir):
    return activity.monthly_usage(read(spark, sf_dir, "events").withColumn("pages", F.col("event_id") % 50))


@query("""WITH d AS (SELECT strftime(ts, '%Y-%m') AS month, CAST(ts AS DATE) AS date, sum(CAST(value AS DECIMAL(18,4))) AS cost FROM events GROUP BY 1, 2), r AS (SELECT *, sum(cost) OVER (PARTITION BY month ORDER BY date) AS spent FROM d)
 SELECT month, level, min(date) AS reached_on FROM r, (SELECT unnest([0.5::DOUBLE, 0.8::DOUBLE]) AS level) WHERE spent >= level * 100000 GROUP BY month, level""", lease=False)
def budget_alerts(spark, sf_dir):
    return activity.budget_alerts(read(spark, sf_dir, "events").withColumnRenamed("value", "cost"), 100_000)


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase, max(ts) AS last_activity FROM events GROUP BY user_id""", lease=False)
def user_statistics(spark, sf_dir):
    return activity.user_stats(read(spark, sf_dir, "events"), ["click", "view", "purchase"])


@query("""WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1), e AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1)
 SELECT month, CAST(coalesce(r.v, 0) AS DOUBLE) AS revenue, CAST(coalesce(e.v, 0) AS DOUBLE) AS expense, CAST(coalesce(r.v, 0) - coalesce(e.v, 0) AS DOUBLE) AS profit FROM r FULL JOIN e USING (month)""", lease=False)
def finance_summary(spark, sf_dir):
    return activity.finance_summary(read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("amount")), read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("date"), F.col("l_extendedprice").alias("amount")))


@query("""SELECT event_id, user_id, count(*) OVER w - count(*) OVER s AS earlier, count(*) OVER w - count(*) OVER s >= 3 AS limited FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW), s AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND CURRENT ROW)""", lease=False)
def arrivals_over_rate(spark, sf_dir):
    return activity.over_rate(read(spark, sf_dir, "events"), 3, 3600).select("event_id", "user_id", "earlier", "limited")


def messages(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("role").alias("sender"), F.col("turn").alias("sent"))


@query("""WITH r AS (SELECT conv_id, role AS reader, CASE WHEN conv_id % 3 <> 0 THEN min(turn) END AS last_read FROM conversations GROUP BY 1, 2) SELECT m.conv_id AS thread_id, reader, count(*) AS unread FROM conversations m JOIN r ON m.conv_id = r.conv_id WHERE m.role <> reader AND (last_read IS NULL OR turn > last_read) GROUP BY 1, 2""", lease=False)
def unread_messages(spark, sf_dir):
    m = messages(spark, sf_dir)
    reads = m.groupBy("thread_id", F.col("sender").alias("reader")).agg(F.min("sent").alias("first")).select("thread_id", "reader", F.when(F.col("thread_id") % 3 != 0, F.col("first")).alias("last_read"))
    return activity.unread(m, reads)


@query("SELECT conv_id AS thread_id, max(turn) AS last_sent, arg_max(role, turn) AS last_sender, count(*) AS messages FROM conversations GROUP BY 1", lease=False)
def latest_threads(spark, sf_dir):
    return activity.latest_threads(messages(spark, sf_dir))


@query("SELECT conv_id AS thread_id FROM conversations WHERE role = 'system' INTERSECT SELECT conv_id FROM conversations WHERE role = 'user'", lease=False)
def shared_threads(spark, sf_dir):
    return activity.shared_threads(messages(spark, sf_dir).withColumnRenamed("sender", "person"), "system", "user")


@query("""SELECT n_nationkey AS team_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS users, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS leases, (SELECT max(o_orderdate) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS last_activity FROM nation""", lease=False)
def team_overview(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    acts = read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("team_id"), F.col("o_orderdate").alias("at"))
    return activity.team_overview(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team_id")), c.select(F.col("c_nationkey").alias("team_id")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("team_id")), acts)


@query("SELECT event_id, user_id FROM events WHERE user_id % 4 = 0 OR ts > TIMESTAMP '2024-01-15'", lease=False)
def new_since_view(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    viewed = e.select("user_id").distinct().where("user_id % 4 <> 0").withColumn("last_viewed_at", F.lit("2024-01-15").cast("timestamp_ntz"))
    return activity.new_since(e, viewed).select("event_id", "user_id")


# --- extraction quality and documents ------------------------------------------------------------


@query("""WITH s AS (SELECT d.lang AS field, CASE WHEN n_chars > 2000 THEN 'high' WHEN n_chars > 800 THEN 'medium' ELSE 'low' END AS confidence, quality = 1 AS correct FROM labels JOIN documents d USING (doc_id)), g AS (SELECT CASE WHEN grouping(field) = 0 THEN 'field' WHEN grouping(confidence) = 0 THEN 'confidence' ELSE 'all' END AS scope, coalesce(field, confidence) AS name, count(*) AS n, count(*) FILTER (correct) AS n_correct FROM s GROUP BY GROUPING SETS ((field), (confidence), ()))
 SELECT *, round(n_correct * 100.0 / n, 1)::DOUBLE AS accuracy_pct FROM g""", lease=False)
def extraction_accuracy(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    n = F.col("n_chars")
    out = extraction.accuracy(rows.select(F.col("lang").alias("field"), F.when(n > 2000, "high").when(n > 800, "medium").otherwise("low").alias("confidence"), (F.col("quality") == 1).alias("correct")))
    return out.withColumn("accuracy_pct", F.col("accuracy_pct").cast("double"))


@query(FIELD_SQL + """, f AS (SELECT field, count(DISTINCT lease_id) AS had_value FROM fields WHERE has GROUP BY field), e AS (SELECT field, count(DISTINCT lease_id) AS edited_leases FROM fields WHERE lease_id % 11 = 0 AND confidence = 'low' GROUP BY field), r AS (SELECT field, had_value, coalesce(edited_leases, 0) AS edited_leases, round(coalesce(edited_leases, 0) * 100.0 / had_value, 1)::DOUBLE AS edit_rate_pct FROM f LEFT JOIN e USING (field))
 SELECT *, CASE WHEN edit_rate_pct <= 5 THEN 'strong' WHEN edit_rate_pct <= 20 THEN 'mixed' ELSE 'weak' END AS reliability FROM r""")
def field_reliability(spark, sf_dir):
    fields = lease_fields(spark, sf_dir)
    return extraction.field_reliability(fields, fields.where("lease_id % 11 = 0 AND confidence = 'low'")).withColumn("edit_rate_pct", F.col("edit_rate_pct").cast("double"))


@query("""WITH g AS (SELECT CAST(ts AS DATE) AS day, count(*) AS runs, round(count(*) FILTER (event_id % 13 = 0) * 100.0 / count(*), 2)::DOUBLE AS error_pct, round(CAST(sum(CASE WHEN value > 0 THEN CAST(value AS DECIMAL(18,3)) END) AS DOUBLE) / count(*) FILTER (value > 0), 1) AS mean_latency_ms FROM events GROUP BY 1) SELECT *, round(error_pct - lag(error_pct) OVER (ORDER BY day), 2) AS error_change FROM g""", lease=False)
def quality_trend(spark, sf_dir):
    runs = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), (F.col("event_id") % 13 == 0).alias("failed"), F.col("value").alias("latency_ms"))
    out = extraction.quality_trend(runs)
    return out.withColumns({c: F.col(c).cast("double") for c in ("error_pct", "error_change")})


@query("""SELECT doc_id, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS alnum_chars FROM documents WHERE length(text) < 50 OR length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) / greatest(length(text), 1)::DOUBLE < 0.3""", lease=False)
def low_text_documents(spark, sf_dir):
    return documents.low_text(read(spark, sf_dir, "documents")).select("doc_id", "alnum_chars")


@query("""WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents), f AS (SELECT content_hash, min(doc_id) AS first_id FROM h GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, first_id, content_hash FROM h JOIN f USING (content_hash) WHERE doc_id <> first_id""", lease=False)
def duplicate_uploads(spark, sf_dir):
    return documents.duplicates(read(spark, sf_dir, "documents"))


FORM_PHRASES = [("license", "released under", 1.0), ("license", "licensed under", 1.0), ("license", "version", 0.5), ("insult", "idiot", 1.0), ("insult", "moron", 1.0), ("insult", "worthless", 0.7), ("contact", "@", 0.6), ("contact", "http", 0.4)]


@query("""WITH s AS (SELECT doc_id, unnest([{'score': round(CASE WHEN contains(lower(text), 'released under') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(text), 'licensed under') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(text), 'version') THEN 0.5 ELSE 0 END, 4)::DOUBLE, 'form': 'license'},
 {'score': round(CASE WHEN contains(lower(text), 'idiot') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(text), 'moron') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(text), 'worthless') THEN 0.7 ELSE 0 END, 4)::DOUBLE, 'form': 'insult'},
 {'score': round(CASE WHEN contains(lower(text), '@') THEN 0.6 ELSE 0 END + CASE WHEN contains(lower(text), 'http') THEN 0.4 ELSE 0 END, 4)::DOUBLE, 'form': 'contact'}]) AS x FROM documents)
 SELECT doc_id, max(x).form AS form, max(x).score AS score FROM s WHERE x.score >= 0.5 GROUP BY doc_id""", lease=False)
def detected_forms(spark, sf_dir):
    return documents.detect_forms(read(spark, sf_dir, "documents"), FORM_PHRASES, 0.5)


@query()
def located_quotes(spark, sf_dir):
    flat = read(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).alias("t"))
    quotes = flat.where(F.length("t") >= 180).select("doc_id", F.lit(1).alias("quote_id"), F.substring("t", 101, 80).alias("quote"))
    parts = F.posexplode(F.array(F.substring("t", 1, 90), F.substring("t", 91, 80), F.substr("t", F.lit(101)))).alias("page", "text")
    return documents.locate_quotes(quotes, flat.select("doc_id", parts))


@query("SELECT lease_id, team_id, is_rent_roll, tenant_key_raw AS tenant_key, unit_key, building_key, rent::DOUBLE AS rent, deposit::DOUBLE AS deposit, cam::DOUBLE AS cam, sqft, start_date, end_date, notice_days, termination_year, cure_days FROM leases")
def typed_leases(spark, sf_dir):
    money = {c: F.col(c).cast("double") for c in ("rent", "deposit", "cam")}
    return leases(spark, sf_dir).withColumns(money).select("lease_id", "team_id", "is_rent_roll", "tenant_key", "unit_key", "building_key", "rent", "deposit", "cam", "sqft", "start_date", "end_date", "notice_days", "termination_year", "cure_days")


@query("""SELECT team_id, count(*) AS leases, sum(sqft) AS total_sqft, sum(rent)::DOUBLE AS total_rent, round((sum(rent) FILTER (rent IS NOT NULL AND sqft > 0))::DOUBLE / sum(sqft) FILTER (rent IS NOT NULL AND sqft > 0), 2) AS weighted_psf FROM leases GROUP BY team_id""")
def rent_roll_totals(spark, sf_dir):
    return sinks.rent_roll_totals(leases(spark, sf_dir))


@query(f"""SELECT lease_id, tenant, rent::DOUBLE AS rent, round(psf, 2) AS psf, (year(end_date) - 1999) * 12 + month(end_date) - 1 - (day(end_date) < 1)::INT AS months_left, notice_days, is_rent_roll FROM leases""")
def rent_roll_export(spark, sf_dir):
    return sinks.rent_roll(leases(spark, sf_dir), AS_OF).select("lease_id", "tenant", F.col("rent").cast("double").alias("rent"), "psf", "months_left", "notice_days", "is_rent_roll")


@query("""u AS (SELECT o_orderkey AS upload_id, tenant_key_raw, building_key, team_id FROM orders JOIN leases ON o_orderkey = lease_id WHERE o_orderstatus = 'F'), old AS (SELECT * FROM leases WHERE is_rent_roll)
 SELECT upload_id, min(lease_id) AS lease_id FROM u JOIN old USING (team_id, tenant_key_raw, building_key) GROUP BY upload_id HAVING count(*) = 1""")
def resubmissions(spark, sf_dir):
    rows = leases(spark, sf_dir)
    filed = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("lease_id"))
    uploads = rows.join(filed, "lease_id").select("team_id", F.col("lease_id").alias("upload_id"), "tenant_key", "building_key")
    return identity.resubmissions(uploads, rows.where("is_rent_roll"))


@query("""t AS (SELECT o_orderkey AS lease_id, o_orderpriority AS tag FROM orders UNION ALL SELECT l_orderkey, l_returnflag FROM lineitem), g AS (SELECT lease_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM t GROUP BY lease_id) SELECT l.lease_id, coalesce(tags, '') AS tags FROM leases l LEFT JOIN g USING (lease_id)""")
def tagged_leases(spark, sf_dir):
    tags = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lease_id"), F.col("o_orderpriority").alias("tag")).union(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"))
    return identity.with_tags(leases(spark, sf_dir).select("lease_id"), tags).select("lease_id", F.array_join("tags", ",").alias("tags"))


@query("""f AS (SELECT o_orderkey AS finding_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 7 END AS lease_id, CASE WHEN o_orderkey % 3 = 1 THEN 'customer' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') END AS tk, CASE WHEN o_orderkey % 3 = 2 THEN (90 + o_orderkey % 40) || ' main st' END AS bk FROM orders)
 SELECT finding_id FROM f WHERE CASE WHEN lease_id IS NOT NULL THEN lease_id IN (SELECT lease_id FROM leases) WHEN tk IS NOT NULL THEN tk IN (SELECT tenant_key_raw FROM leases WHERE tenant_key_raw IS NOT NULL) ELSE bk IN (SELECT building_key FROM leases) END""")
def relevant_findings(spark, sf_dir):
    k = F.col("o_orderkey")
    found = read(spark, sf_dir, "orders").select(
        k.alias("finding_id"), F.when(k % 3 == 0, k + 7).alias("lease_id"), F.when(k % 3 == 1, F.concat(F.lit("customer"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0"))).alias("tenant_key"), F.when(k % 3 == 2, F.concat((90 + k % 40).cast("string"), F.lit(" main st"))).alias("building_key")
    )
    return identity.still_relevant(found, leases(spark, sf_dir)).select("finding_id")


# --- not expressible in SQL: held against small fixtures in the tests ------------------------------


@query()
def rate_limit_admissions(spark, sf_dir):
    return limits.admissions(read(spark, sf_dir, "events"), 3, 3600.0)


def clause() -> F.Column:
    """Clauses of four shapes, by the lease."""
    k = F.col("lease_id") % 5
    return F.when(k == 1, "Landlord grants two (2) months free rent.").when(k == 2, "Tenant receives a monthly rent credit of $150.00 for the first 6 months.").when(k == 3, "One-time concession of $500 at move-in. No months of free rent apply.").when(k == 4, "Last 1 month free.")


def conceded(spark, sf_dir) -> DataFrame:
    return concessions.with_items(leases(spark, sf_dir).withColumn("concessions", clause()))


@query()
def effective_rents(spark, sf_dir):
    return concessions.effective_rents(conceded(spark, sf_dir), AS_OF)


@query()
def concessions_ending(spark, sf_dir):
    return concessions.ending_soon(conceded(spark, sf_dir), AS_OF)


@query()
def page_chunks(spark, sf_dir):
    """Documents of a source as the pages of one file."""
    pages = read(spark, sf_dir, "documents").select((F.col("doc_id") / 20).cast("long").alias("doc_id"), (F.col("doc_id") % 20).cast("int").alias("page"), "text")
    return lease_text.page_chunks(pages, 8, 10_000)


# Registers further queries; last, as they use what is above.
from parcelspark.plans import deal, intake, ledger, outcomes, pages  # noqa: E402, F401
