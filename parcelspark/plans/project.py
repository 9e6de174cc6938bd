"""Lease-shaped projections of the driver's tables.

``text_leases`` renders orders as lease records whose values are display
strings, and ``typed_leases`` parses them; ``LEASE_SQL`` states the same
records from the numbers for checks by another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions import keys, parse

AS_OF = "1999-01-01"

FIELDS = (
    "tenant", "landlord", "rent_amount", "lease_start_date", "lease_end_date", "property_address", "security_deposit", "cam_charges",
    "rent_escalation", "renewal_options", "termination_options", "permitted_use", "exclusivity_clause", "insurance_requirements", "default_cure_period", "square_footage",
)
CORE_FIELDS = ("tenant", "landlord", "rent_amount", "lease_start_date", "lease_end_date")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_out(rows: DataFrame) -> DataFrame:
    """Rows of a small file dealt to all cores, as parsing is bound by CPU; a scan of many splits stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _money(cents: F.Column, style: F.Column) -> F.Column:
    dollars = F.format_number(cents / 100, 2)
    return F.when(style == 0, F.concat(F.lit("$"), dollars)).when(style == 1, F.concat(F.lit("$ "), F.replace(dollars, F.lit(","), F.lit("")), F.lit(" per month"))).otherwise(
        F.concat(F.lit("USD $"), dollars, F.lit("/mo"))
    )


def _date(d: F.Column, style: F.Column) -> F.Column:
    return F.when(style == 0, F.date_format(d, "yyyy-MM-dd")).when(style == 1, F.date_format(d, "MM/dd/yyyy")).when(style == 2, F.date_format(d, "MMMM d, yyyy")).otherwise(F.date_format(d, "d-MMM-yy"))


def text_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lease record per order, values as text.  Customers and nations are small dimensions; the planner broadcasts them by size."""
    orders = dealt_out(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    cents = F.when(key % 29 != 0, F.floor("o_totalprice"))
    start = F.col("o_orderdate").cast("date")
    end = F.when(key % 31 != 0, F.date_sub(F.add_months(start, (6 + key % 60).cast("int")), 1))
    style3, style4 = key % 3, key % 4
    sqft = 500 + F.col("o_custkey") % 4500
    street = F.concat((100 + F.col("n_nationkey")).cast("string"), F.lit(" Main "))
    unit = (100 + F.floor(F.col("o_custkey") / 60)).cast("string")  # a few customers share a unit over time
    address = (
        F.when(style3 == 0, F.concat(street, F.lit("Street, Suite "), unit))
        .when(style3 == 1, F.concat(street, F.lit("St., Apt. 0"), unit))
        .otherwise(F.concat(F.lit("Harbor Plaza, "), street, F.lit("Street #"), unit))
    )
    steps = [cents, F.floor(cents * 1.03), F.floor(cents * F.when(key % 2 == 0, 1.0609).otherwise(1.18)), F.floor(cents * F.when(key % 2 == 0, 1.0927).otherwise(1.21))]
    schedule = F.concat_ws("; ", *[F.concat(F.lit(f"Year {i}: $"), F.format_number(c / 100, 2)) for i, c in enumerate(steps, 1)])
    escalation = F.when(key % 5 == 0, None).when((key % 5 == 3) & cents.isNotNull(), schedule).otherwise(F.concat((2 + key % 4).cast("string"), F.lit("% annually")))
    renewal = F.when(key % 4 != 0, F.concat((1 + key % 3).cast("string"), F.lit(" option(s) of 5 year(s); "), (15 + key % 12 * 30).cast("string"), F.lit(" days notice; renewal rent based on fair market value")))
    return rows.select(
        key.alias("lease_id"),
        F.col("n_regionkey").alias("team_id"),
        F.concat(F.lit("lease_"), key.cast("string"), F.when(style3 == 0, ".csv").otherwise(".pdf")).alias("filename"),
        F.when(key % 11 == 0, None).when(style3 == 0, "rent_roll").otherwise("document").alias("source_kind"),
        F.date_add(start, (key % 97).cast("int")).alias("uploaded_at"),
        F.when(key % 53 != 0, F.col("c_name")).alias("tenant"),
        F.when(key % 41 != 0, F.concat(F.lit("Owner of "), F.col("n_name"))).alias("landlord"),
        _money(cents, style3).alias("rent_amount"),
        _date(start, style4).alias("lease_start_date"),
        _date(end, style4).alias("lease_end_date"),
        address.alias("property_address"),
        F.when(key % 5 != 0, _money(cents * 2, style3)).alias("security_deposit"),
        F.when(key % 2 == 0, _money(F.floor(cents / 10), style3)).alias("cam_charges"),
        escalation.alias("rent_escalation"),
        renewal.alias("renewal_options"),
        F.when(key % 6 == 1, F.lit("Tenant may terminate in year 3 of the term with 90 days notice")).alias("termination_options"),
        F.when(key % 8 != 0, F.lit("Retail")).alias("permitted_use"),
        F.when(key % 9 == 0, F.lit("No other grocer")).alias("exclusivity_clause"),
        F.when(key % 2 == 1, F.lit("General liability of $1,000,000")).alias("insurance_requirements"),
        F.when(key % 3 == 0, F.concat((10 + key % 40).cast("string"), F.lit(" days"))).alias("default_cure_period"),
        F.when(key % 7 != 0, F.concat(F.format_number(sqft, 0), F.lit(" sq ft"))).alias("square_footage"),
    )


def typed_leases(leases: DataFrame) -> DataFrame:
    """Adds parsed columns and keys to text leases; money as exact decimals."""
    money = "decimal(18,2)"
    return leases.select(
        "*",
        F.coalesce(F.col("source_kind") == "rent_roll", F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).isin("csv", "xlsx")).alias("is_rent_roll"),
        keys.name_key("tenant").alias("tenant_key"),
        keys.unit_key("property_address").alias("unit_key"),
        keys.building_key("property_address").alias("building_key"),
        parse.currency("rent_amount").cast(money).alias("rent"),
        parse.currency("security_deposit").cast(money).alias("deposit"),
        parse.currency("cam_charges").cast(money).alias("cam"),
        parse.square_feet("square_footage").alias("sqft"),
        parse.date("lease_start_date").alias("start_date"),
        parse.date("lease_end_date").alias("end_date"),
        parse.escalation_percent("rent_escalation").alias("escalation_pct"),
        parse.escalation_schedule("rent_escalation").alias("schedule"),
        parse.notice_days("renewal_options").alias("notice_days"),
        parse.termination_year("termination_options").alias("termination_year"),
        parse.notice_days("termination_options").alias("termination_notice_days"),
        parse.days("default_cure_period").alias("cure_days"),
    ).withColumn("psf", parse.per_square_foot(F.col("rent").cast("double"), F.col("sqft")))


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table.  It is not kept: each query parses only the columns that it reads, so pruning reaches the scan."""
    return typed_leases(text_leases(spark, sf_dir))


LEASE_SQL = """
lease_base AS (
  SELECT o_orderkey AS k, o_custkey AS ck, n_regionkey AS team_id, c_name, n_name, n_nationkey,
    CASE WHEN o_orderkey % 29 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS cents,
    CAST(o_orderdate AS DATE) AS start_date,
    CASE WHEN o_orderkey % 31 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + to_months(CAST(6 + o_orderkey % 60 AS INTEGER)) AS DATE) - 1 END AS end_date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
leases AS (
  SELECT k AS lease_id, team_id, start_date, end_date,
    k % 3 = 0 AS is_rent_roll,
    start_date + CAST(k % 97 AS INTEGER) AS uploaded_at,
    CASE WHEN k % 53 <> 0 THEN c_name END AS tenant,
    CASE WHEN k % 53 <> 0 THEN lower(replace(c_name, '#', '')) END AS tenant_key_raw,
    CASE WHEN k % 41 <> 0 THEN 'Owner of ' || n_name END AS landlord,
    (100 + n_nationkey) || ' main st' AS building_key,
    (100 + n_nationkey) || ' main st #' || (100 + ck // 60) AS unit_key,
    CAST(cents / 100.0 AS DECIMAL(18,2)) AS rent,
    CASE WHEN k % 5 <> 0 THEN CAST(cents * 2 / 100.0 AS DECIMAL(18,2)) END AS deposit,
    CASE WHEN k % 2 = 0 THEN CAST(floor(cents / 10) / 100.0 AS DECIMAL(18,2)) END AS cam,
    CASE WHEN k % 7 <> 0 THEN CAST(500 + ck % 4500 AS DOUBLE) END AS sqft,
    CASE WHEN k % 7 <> 0 THEN CAST(CAST(cents / 100.0 AS DECIMAL(18,2)) AS DOUBLE) / (500 + ck % 4500) END AS psf,
    CASE WHEN k % 4 <> 0 THEN CAST(15 + k % 12 * 30 AS INTEGER) END AS notice_days,
    CASE WHEN k % 6 = 1 THEN 3 END AS termination_year,
    CASE WHEN k % 6 = 1 THEN 90 END AS termination_notice_days,
    CASE WHEN k % 3 = 0 THEN CAST(10 + k % 40 AS INTEGER) END AS cure_days,
    k % 5 = 3 AND cents IS NOT NULL AS has_schedule,
    CASE WHEN k % 5 <> 0 AND NOT (k % 5 = 3 AND cents IS NOT NULL) THEN CAST(2 + k % 4 AS DOUBLE) END AS stated_pct,
    CAST(cents / 100.0 AS DECIMAL(18,2)) AS y1, CAST(floor(cents * 1.03::DOUBLE) / 100.0 AS DECIMAL(18,2)) AS y2,
    CAST(floor(cents * (CASE WHEN k % 2 = 0 THEN 1.0609 ELSE 1.18 END)::DOUBLE) / 100.0 AS DECIMAL(18,2)) AS y3,
    CAST(floor(cents * (CASE WHEN k % 2 = 0 THEN 1.0927 ELSE 1.21 END)::DOUBLE) / 100.0 AS DECIMAL(18,2)) AS y4,
    k % 5 = 0 AS no_escalation, k % 2 = 1 AS has_insurance, k % 8 <> 0 AS has_use, k % 9 = 0 AS has_exclusivity
  FROM lease_base)
"""
