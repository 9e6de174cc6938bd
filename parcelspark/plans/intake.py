"""Queries of parsing, sources, sinks and texts; see ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.functions import parse
from parcelspark.operators import documents, identity, lease_text, portfolio, scope
from parcelspark.plans.catalog import query
from parcelspark.plans.project import leases, read
from parcelspark.sources import delimited, sinks, statements
from parcelspark.streaming import limits


def keyed(spark, sf_dir) -> tuple[DataFrame, F.Column]:
    return read(spark, sf_dir, "orders"), F.col("o_orderkey")


def kinds(k: F.Column, *values) -> F.Column:
    """The value at ``k`` modulo their number."""
    out = F.when(k % len(values) == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(k % len(values) == i, v)
    return out


# --- values --------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 2 THEN -floor(o_totalprice) / 100 WHEN 3 THEN -floor(o_totalprice) / 100 WHEN 5 THEN NULL ELSE floor(o_totalprice) / 100 END AS amount FROM orders", lease=False)
def parsed_amounts(spark, sf_dir):
    o, k = keyed(spark, sf_dir)
    us = F.format_number(F.floor("o_totalprice") / 100, 2)
    text = kinds(k, us, F.translate(us, ",.", ".,"), F.concat(F.lit("("), us, F.lit(")")), F.concat(us, F.lit("-")), F.concat(F.lit("$"), us), F.lit("n/a"))
    return o.select(k.alias("id"), parse.import_currency(text).alias("amount"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 8 THEN CAST(o_orderdate AS DATE) END AS date FROM orders", lease=False)
def parsed_dates(spark, sf_dir):
    o, k = keyed(spark, sf_dir)
    d = F.col("o_orderdate").cast("date")
    worded = F.concat(F.dayofmonth(d).cast("string"), F.lit("th day of "), F.date_format(d, "MMMM, yyyy"))
    serial = F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")
    shapes = [F.date_format(d, f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "d-MMM-yy", "d.M.yyyy", "MMMM d, yyyy", "yyyy/MM/dd")]
    return o.select(k.alias("id"), parse.excel_date(kinds(k, *shapes, worded, serial, F.lit("31/31/1999"))).alias("date"))


@query("SELECT lease_id, CAST(greatest(1, round_even((date_diff('day', start_date, end_date) + 1) / 30.4375::DOUBLE, 0)) AS INTEGER) AS months, CAST(date_trunc('month', start_date) + INTERVAL 5 MONTH AS DATE) AS sixth FROM leases")
def term_lengths(spark, sf_dir):
    return leases(spark, sf_dir).select("lease_id", parse.term_months(F.col("start_date"), F.col("end_date")).alias("months"), parse.month_shift("start_date", F.lit(5)).alias("sixth"))


@query("SELECT o_orderkey AS id, 'id [masked] and ' || lpad(CAST(o_orderkey AS VARCHAR), 10, '7') AS text FROM orders", lease=False)
def masked_numbers(spark, sf_dir):
    o, k = keyed(spark, sf_dir)
    number = F.concat_ws("-", *[F.lpad((k % 10**n).cast("string"), n, "0") for n in (3, 2, 4)])
    text = F.concat(F.lit("id "), kinds(k, number, F.replace(number, F.lit("-"), F.lit(""))), F.lit(" and "), F.lpad(k.cast("string"), 10, "7"))
    return documents.masked(o.select(k.alias("id"), text.alias("text")))


@query("SELECT o_orderkey AS id, o_orderkey % 5 <> 4 AS one_typo FROM orders", lease=False)
def one_typo_words(spark, sf_dir):
    o, k = keyed(spark, sf_dir)
    a = F.concat(F.lit("commencement "), k.cast("string"))
    b = F.concat(kinds(k, *map(F.lit, ("commencement ", "comencement ", "ocmmencement ", "commmencement ", "coxmexcement "))), k.cast("string"))
    return o.select(k.alias("id"), parse.one_typo_apart(a, b).alias("one_typo"))


@query("SELECT o_orderkey AS id, o_orderkey % 9 IN (0, 1, 2, 5, 6, 8) AS same FROM orders", lease=False)
def household_pairs(spark, sf_dir):
    o, k = keyed(spark, sf_dir)
    pairs = [("José Peña", "Jose Pena"), ("Smith, John", "John Smith"), ("J. Smith", "John Smith"), ("John Smith Jr", "John Smith"), ("John Smith", "Jane Smith"), ("Ann Lee & Bo Ek", "Bo Ek and Ann Lee"), ("Alexandra Montgomery", "Alexandra Montgomery-Wills"), (None, "x"), ("Søren  Kjær", "Soren Kjaer; Bo Ek")]
    a, b = (kinds(k, *[F.lit(p[i]) for p in pairs]) for i in (0, 1))
    return o.select(k.alias("id"), identity.same_household(a, b).alias("same"))


@query("SELECT c_custkey AS id, strip_accents(c_mktsegment || ' Çà É ñ ü ŷ ' || c_custkey) AS name FROM customer", lease=False)
def names_without_marks(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), identity.plain_letters(F.concat("c_mktsegment", F.lit(" Çà É ñ ü ŷ "), F.col("c_custkey").cast("string"))).alias("name"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE lower(c_mktsegment) || ' holdings' END AS alias FROM customer", lease=False)
def tenant_aliases(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 1, "Co X1, Inc.").otherwise(F.concat("c_mktsegment", F.lit(" Holdings, LLC West")))
    return read(spark, sf_dir, "customer").select(k.alias("id"), scope.tenant_alias(name).alias("alias"))


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN '-' ELSE '+' END || '$' || format('{:,.2f}', abs(s_acctbal)) AS shown FROM supplier", lease=False)
def shown_amounts(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), scope.shown_money(F.col("s_acctbal"), signed=True).alias("shown"))


MONTH_NAMES = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"


@query("""WITH m AS (SELECT o_orderkey AS id, month(o_orderdate) AS a, 1 + o_orderkey % 12 AS b FROM orders) SELECT id, CASE id % 3 WHEN 0 THEN array_to_string(list_transform(range(a, CASE WHEN b >= a THEN b ELSE b + 12 END + 1), lambda i: (i - 1) % 12 + 1), ',') WHEN 1 THEN CAST(a AS VARCHAR) ELSE '' END AS months FROM m""", lease=False)
def months_in_prose(spark, sf_dir):
    o, k = keyed(spark, sf_dir)
    a, b = F.date_format("o_orderdate", "MMMM"), F.date_format(F.make_date(F.lit(2000), (1 + k % 12).cast("int"), F.lit(1)), "MMM")
    text = kinds(k, F.concat(F.lit("Rent is free from "), a, F.lit(" through "), b), F.concat(F.lit("No rent in "), a, F.lit(" of each year")), F.lit("No free rent"))
    return o.select(k.alias("id"), F.array_join(parse.months_named(text).cast("array<string>"), ",").alias("months"))


# --- sources and sinks ---------------------------------------------------------------------------


def roll_rows(spark, sf_dir) -> DataFrame:
    """Cells of rent rolls, one roll for each nation's building."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    o, k = keyed(spark, sf_dir)
    rows = o.where(k % 3 == 0).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("c_nationkey").alias("b"), F.concat((100 + F.col("c_nationkey")).cast("string"), F.lit(" Main St")).alias("property"), k.cast("string").alias("unit"),
        F.when(k % 10 == 0, "VACANT").when(k % 17 == 0, "").otherwise(F.col("c_name")).alias("tenant"), F.when(k % 13 == 0, "Future - Applicant").otherwise("Current").alias("status"),
        F.when(k % 29 == 0, "").otherwise((F.floor("o_totalprice") / 100).cast("decimal(18,2)").cast("string")).alias("rent"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("start"), k.alias("k"),
    )


def rolls(spark, sf_dir) -> DataFrame:
    """Written as delimited files with a title and a header of their own, some misspelt, and read back."""
    rows, folder = roll_rows(spark, sf_dir), sinks.scratch(spark)
    d = kinds(F.col("b"), F.lit(";"), F.lit("\t"), F.lit("|"))
    parts = F.col("b") % 5 == 2  # these state what the tenant pays and the subsidy
    paid = F.when(F.col("rent") == "", "§").otherwise(F.concat((F.col("rent").try_cast("decimal(18,2)") - 10).cast("decimal(18,2)").cast("string"), F.lit("§$10.00")))
    line = F.concat_ws("§", "property", "unit", "tenant", "status", "start", F.when(parts, paid).otherwise(F.col("rent")))
    named = F.when(F.col("b") % 4 == 1, "Proprety§Apt.§Residnt§Unit Staatus§Laese From").otherwise("Property§Apt.§Resident§Unit Status§Lease From")
    header = F.concat(named, F.when(parts, "§Tenant Portion§HAP Amount").when(F.col("b") % 4 == 1, "§Rent Chrage").otherwise("§Rent Charge"))
    titles = F.array(F.struct(F.lit(-2).alias("place"), F.lit("Rent roll as of 01/01/1999").alias("line")), F.struct(F.lit(-1).alias("place"), header.alias("line")))
    head = rows.select("b").distinct().select("b", F.explode(titles).alias("x")).select("b", F.col("x.place").cast("long").alias("place"), "x.line")
    lines = rows.select("b", F.col("k").alias("place"), line.alias("line")).unionByName(head)
    sinks.write_files(lines.select(F.concat(F.lit("roll"), F.col("b").cast("string")).alias("name"), "place", F.replace("line", F.lit("§"), d).alias("line")), folder)
    return delimited.read_rent_rolls(spark, folder)


ROLLS = """r AS (SELECT c_nationkey AS b, (100 + c_nationkey) || ' Main St' AS property, CAST(o_orderkey AS VARCHAR) AS unit, CASE WHEN o_orderkey % 10 = 0 THEN 'VACANT' WHEN o_orderkey % 17 = 0 THEN NULL ELSE c_name END AS tenant,
 CASE WHEN o_orderkey % 13 = 0 THEN 'Future - Applicant' ELSE 'Current' END AS status, CASE WHEN o_orderkey % 29 <> 0 THEN CAST(CAST(floor(o_totalprice) / 100 AS DECIMAL(18,2)) AS VARCHAR) END AS rent, strftime(o_orderdate, '%m/%d/%Y') AS start FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0),
 s AS (SELECT *, CASE WHEN tenant IS NULL OR tenant = 'VACANT' THEN 'no tenant' WHEN status <> 'Current' THEN 'future resident' WHEN rent IS NULL THEN 'no rent' END AS skip_reason FROM r)"""


@query("WITH " + ROLLS + " SELECT property, unit, tenant, status, start, rent, skip_reason FROM s", lease=False)
def rent_roll_files(spark, sf_dir):
    return rolls(spark, sf_dir).select("property", "unit", "tenant", "status", "start", "rent", "skip_reason")


@query("WITH " + ROLLS + " SELECT property, count(*) FILTER (skip_reason IS NULL) AS occupied, coalesce(string_agg(unit, ',' ORDER BY unit) FILTER (tenant = 'VACANT'), '') AS vacant_units FROM s GROUP BY property", lease=False)
def unit_states(spark, sf_dir):
    rows = rolls(spark, sf_dir)
    names = rows.groupBy("file").agg(F.first("property").alias("property"))
    return delimited.unit_states(rows).join(names, "file").select("property", "occupied", F.array_join("vacant_units", ",").alias("vacant_units"))


@query("WITH " + ROLLS + " SELECT property, count(*) AS n FROM s GROUP BY property", lease=False)
def rows_without_copies(spark, sf_dir):
    rows = rolls(spark, sf_dir)
    return delimited.without_copies(rows.unionByName(rows.withColumn("row_num", F.col("row_num") + 1000))).groupBy("property").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT l_suppkey AS s, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS n FROM lineitem)
 SELECT CAST(s AS VARCHAR) AS file, 'u' || ((n + 2) // 3 * 3 - 2) AS unit, round(sum(amount) FILTER (n % 3 <> 0)::DOUBLE, 2) AS rent, round(sum(amount) FILTER (n % 3 = 0)::DOUBLE, 2) AS concession FROM l GROUP BY 1, 2""", lease=False)
def charge_lines(spark, sf_dir):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    n = F.col("n")
    rows = read(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order))
    lines = rows.select(F.col("l_suppkey").cast("string").alias("file"), n.alias("row_num"), F.when(n % 3 == 1, F.concat(F.lit("u"), n.cast("string"))).alias("unit"), kinds(n, F.lit("CONCESSION"), F.lit("RENT"), F.lit("Pet rent")).alias("code"), (F.col("l_extendedprice") * F.when(n % 3 == 0, -1).otherwise(1)).alias("amount"))
    return delimited.collapse_charges(lines).select("file", "unit", "rent", "concession")


LABELS = {"A": "Gross Potential Rent", "N": "Vacancy Loss", "R": "Rental Income"}


def statement_lines(spark, sf_dir) -> DataFrame:
    """Statements of one year, one file a nation, written and read back; those of odd nations have a wrong total."""
    rows = read(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1997-01-01' AND l_shipdate < TIMESTAMP_NTZ '1998-01-01'").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    months = [F.sum(F.when(F.month("l_shipdate") == m, F.col("l_extendedprice").cast("decimal(18,2)"))) for m in range(1, 13)]
    total = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")) * F.when(F.col("s_nationkey") % 2 == 1, 2).otherwise(1)
    cells = [F.coalesce(m.cast("string"), F.lit("")) for m in months]
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("l_returnflag")]
    lines = rows.groupBy("s_nationkey", "l_returnflag").agg(F.concat_ws(",", label, *cells, total.cast("decimal(18,2)").cast("string")).alias("line"))
    head = lines.select("s_nationkey").distinct().select("s_nationkey", F.lit("0").alias("place"), F.lit("Line Item," + ",".join(statements.MONTHS).title() + ",Total").alias("line"))
    every = lines.select("s_nationkey", F.col("l_returnflag").alias("place"), "line").unionByName(head)
    folder = sinks.scratch(spark)
    sinks.write_files(every.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("name"), "place", "line"), folder)
    return statements.read_statements(spark, folder).withColumn("nation", F.regexp_extract("file", r"name=n(\d+)/", 1).cast("int"))


T12 = """l AS (SELECT s_nationkey AS nation, CASE l_returnflag WHEN 'A' THEN 'gross_potential_rent' WHEN 'N' THEN 'vacancy_loss' ELSE 'rental_income_collected' END AS category, month(l_shipdate) AS m, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE year(l_shipdate) = 1997)"""


@query("WITH " + T12 + ", g AS (SELECT DISTINCT nation, category FROM l) SELECT g.nation, g.category, CAST(i AS INTEGER) AS month_idx, (SELECT sum(v)::DOUBLE * CASE WHEN i = 0 AND g.nation % 2 = 1 THEN 2 ELSE 1 END FROM l WHERE l.nation = g.nation AND l.category = g.category AND (i = 0 OR m = i)) AS amount FROM g, range(0, 13) r(i)", lease=False)
def statement_files(spark, sf_dir):
    return statement_lines(spark, sf_dir).select("nation", "category", "month_idx", "amount")


@query("WITH " + T12 + " SELECT nation, category, round(sum(v)::DOUBLE, 2) AS annual FROM l WHERE nation % 2 = 0 GROUP BY 1, 2 HAVING count(DISTINCT m) = 12", lease=False)
def consistent_statements(spark, sf_dir):
    lines = statement_lines(spark, sf_dir)
    names = lines.groupBy("file").agg(F.first("nation").alias("nation"))
    return statements.consistent_lines(lines).join(names, "file").select("nation", "category", "annual")


@query("SELECT CAST(ts AS DATE) AS day, 2 * count(*) AS n, CAST(sum(2 * event_id) AS BIGINT) AS ids FROM events GROUP BY 1", lease=False)
def audit_log(spark, sf_dir):
    folder, rows = sinks.scratch(spark), read(spark, sf_dir, "events").select("event_id", "ts")
    for _ in range(2):
        sinks.append_log(rows, folder)
    return spark.read.parquet(folder).groupBy("day").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority || ', \"x\"' END AS note FROM orders", lease=False)
def csv_export(spark, sf_dir):
    o, k = keyed(spark, sf_dir)
    folder = sinks.scratch(spark)
    sinks.write_csv(o.select(k.alias("id"), F.when(k % 7 != 0, F.concat("o_orderpriority", F.lit(', "x"'))).alias("note")), folder)
    return spark.read.schema("id long, note string").option("header", True).csv(folder)


# --- texts ---------------------------------------------------------------------------------------


@query(r"SELECT doc_id, trim(regexp_replace(substring(text, 51, 120), '\s+', ' ', 'g')) AS quoted FROM documents", lease=False)
def quote_windows(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", documents.quote_window(F.col("text"), F.lit(101), F.lit(20)).alias("quoted"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 60 >= 40 OR o_orderkey % 20 >= 15", lease=False)
def rent_roll_shapes(spark, sf_dir):
    o, k = keyed(spark, sf_dir)
    text = F.concat(F.repeat(F.lit("$1,250.00 "), (k % 60).cast("int")), F.repeat(F.lit("1/28/2024 "), (k % 20).cast("int")))
    return o.select(k.alias("id"), text.alias("t")).where(documents.looks_like_rent_roll(F.col("t"))).select("id")


@query("SELECT o_orderkey AS id, 'Unit' || o_orderkey || ';Name;12/second;line' AS cells FROM orders", lease=False)
def text_blocks(spark, sf_dir):
    o, k = keyed(spark, sf_dir)
    text = F.concat(F.lit("Unit"), k.cast("string"), F.lit("  | Name \t12 _\n\n  second   line"))
    return o.select(k.alias("id"), F.array_join(F.transform(scope.block_cells(text), lambda r: F.array_join(r, ";")), "/").alias("cells"))


def words(spark, sf_dir) -> DataFrame:
    n = F.col("l_linenumber")
    word_id = F.col("l_partkey") * 1000 + F.col("l_suppkey")
    text = F.when(n % 2 == 0, F.concat(F.lit("w"), n.cast("string"))).otherwise(F.col("l_suppkey").cast("string"))
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), word_id.alias("word_id"), (n * 10 + F.col("l_suppkey") % 7).alias("x"), (F.col("l_partkey") % 5 * 8).alias("y"), F.lit(10).alias("height"), text.alias("text"))


WORDS = """w AS (SELECT l_orderkey AS page_id, l_partkey * 1000 + l_suppkey AS word_id, l_linenumber * 10 + l_suppkey % 7 AS x, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 5) - 1 AS row, CASE WHEN l_linenumber % 2 = 0 THEN 'w' || l_linenumber ELSE CAST(l_suppkey AS VARCHAR) END AS text FROM lineitem),
 r AS (SELECT page_id, row, string_agg(text, ' ' ORDER BY x, word_id, text) AS cells, count(*) AS n, bool_or(text LIKE 'w%') AS word, bool_or(text SIMILAR TO '.*[0-9].*') AS digit FROM w GROUP BY page_id, row)"""


@query("WITH " + WORDS + " SELECT page_id, CAST(row AS BIGINT) AS row, cells FROM r", lease=False)
def words_in_rows(spark, sf_dir):
    return scope.word_rows(words(spark, sf_dir)).select("page_id", "row", F.array_join("cells", " ").alias("cells"))


@query("WITH " + WORDS + " SELECT page_id, count(*) FILTER (n >= 2) >= 2 AND bool_or(word AND digit) AS is_table FROM r GROUP BY page_id", lease=False)
def pages_with_tables(spark, sf_dir):
    return scope.looks_like_table(scope.word_rows(words(spark, sf_dir)))


@query("""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders) SELECT doc_id, 'orders.' || n || '.key' AS field, CAST(k AS VARCHAR) AS value FROM o UNION ALL SELECT doc_id, 'orders.' || n || '.status', s FROM o""", lease=False)
def flattened_tables(spark, sf_dir):
    o, k = keyed(spark, sf_dir)
    rows = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), F.col("o_orderstatus").alias("s")))).alias("x"))
    tables = rows.select("doc_id", F.lit("orders").alias("name"), F.transform("x", lambda r: F.create_map(F.lit("key"), r["k"].cast("string"), F.lit("status"), r["s"])).alias("rows"))
    return scope.flattened(tables)


def lease_pages(spark, sf_dir) -> DataFrame:
    """A first page of prose for each order, and its place among its customer's pages."""
    o, k = keyed(spark, sf_dir)
    d = F.col("o_orderdate")
    text = F.concat(
        F.lit("LEASE AGREEMENT\nLandlord: Elm Holdings LLC\nTenant: Acme "), F.col("o_custkey").cast("string"), F.lit(" Foods\nPremises: "), (k % 900 + 1).cast("string"), F.lit(" Oak Street, Suite 5\nMonthly Rent: $"), F.format_number(F.floor("o_totalprice") / 100, 2),
        F.lit(". Commencement Date: "), F.date_format(d, "MMMM d, yyyy"), F.lit(". Expiration Date: "), F.date_format(F.add_months(d, 24), "MM/dd/yyyy"), F.lit(". Common area maintenance charges of $"), F.format_number(k % 500 + 1, 2),
        F.lit(" per month. Permitted Use: retail bakery. Tenant shall have "), (1 + k % 3).cast("string"), F.lit(" options to renew for 5 years each. Tenant shall maintain general liability insurance of $1,000,000."),
    )
    return o.select(k.alias("doc_id"), F.lit(1).alias("page"), text.alias("text"), "o_custkey")


@query("""SELECT o_orderkey AS doc_id, unnest([{'field': 'tenant', 'value': 'Acme ' || o_custkey || ' Foods', 'confidence': 'high'}, {'field': 'landlord', 'value': 'Elm Holdings LLC', 'confidence': 'high'}, {'field': 'rent_amount', 'value': '$' || format('{:,.2f}', floor(o_totalprice) / 100), 'confidence': 'high'},
 {'field': 'lease_start_date', 'value': strftime(o_orderdate, '%B %-d, %Y'), 'confidence': 'high'}, {'field': 'lease_end_date', 'value': strftime(o_orderdate + INTERVAL 24 MONTH, '%m/%d/%Y'), 'confidence': 'high'},
 {'field': 'property_address', 'value': (o_orderkey % 900 + 1) || ' Oak Street, Suite 5', 'confidence': 'high'}, {'field': 'cam_charges', 'value': '$' || format('{:,.2f}', CAST(o_orderkey % 500 + 1 AS DOUBLE)), 'confidence': 'high'}, {'field': 'permitted_use', 'value': 'retail bakery', 'confidence': 'high'},
 {'field': 'renewal_options', 'value': (1 + o_orderkey % 3) || ' options to renew for 5 years', 'confidence': 'high'}, {'field': 'insurance_requirements', 'value': 'general liability insurance of $1,000,000', 'confidence': 'high'}], recursive := true) FROM orders""", lease=False)
def lease_text_fields(spark, sf_dir):
    return lease_text.extract(lease_pages(spark, sf_dir)).select("doc_id", "field", "value", "confidence")


@query("SELECT o_orderkey AS doc_id, 'start' AS role, strftime(o_orderdate, '%B %-d, %Y') AS value FROM orders UNION ALL SELECT o_orderkey, 'end', strftime(o_orderdate + INTERVAL 24 MONTH, '%m/%d/%Y') FROM orders", lease=False)
def date_candidates(spark, sf_dir):
    return lease_text.date_candidates(lease_pages(spark, sf_dir)).select("doc_id", "role", "value")


@query("""WITH p AS (SELECT o_orderkey // 40 AS doc_id, o_orderkey % 40 AS page, o_custkey FROM orders), s AS (SELECT doc_id, o_custkey, min(page) AS start FROM p GROUP BY 1, 2) SELECT CAST(doc_id AS BIGINT) AS doc_id, 'tenant' AS field, count(*) AS n, string_agg(CAST(start AS VARCHAR), ',' ORDER BY start) AS start_pages FROM s GROUP BY doc_id HAVING count(*) > 1""", lease=False)
def several_leases(spark, sf_dir):
    pages = lease_pages(spark, sf_dir).select(F.floor(F.col("doc_id") / 40).alias("doc_id"), (F.col("doc_id") % 40).cast("int").alias("page"), "text")
    return lease_text.several_leases(pages).select("doc_id", "field", "n", F.array_join(F.col("start_pages").cast("array<string>"), ",").alias("start_pages"))


@query("SELECT user_id, date_trunc('hour', ts) AS begins, count(*) AS hits FROM events GROUP BY 1, 2", lease=False)
def fixed_window_hits(spark, sf_dir):
    return limits.fixed_window_counts(read(spark, sf_dir, "events"), 3600).withColumn("begins", F.col("begins").cast("timestamp_ntz"))


@query("""SELECT f AS field, max(v) FILTER (lease_id = 1) AS "1", max(v) FILTER (lease_id = 2) AS "2", max(v) FILTER (lease_id = 3) AS "3" FROM (SELECT lease_id, 'tenant' AS f, tenant AS v FROM leases UNION ALL SELECT lease_id, 'landlord', landlord FROM leases UNION ALL SELECT lease_id, 'permitted_use', CASE WHEN has_use THEN 'Retail' END FROM leases) WHERE lease_id IN (1, 2, 3) GROUP BY f""")
def side_by_side(spark, sf_dir):
    return portfolio.side_by_side(leases(spark, sf_dir), [1, 2, 3]).where("field IN ('tenant', 'landlord', 'permitted_use')")
