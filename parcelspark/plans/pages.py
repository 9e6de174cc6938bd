"""Queries of words on pages and phrases in texts; see ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.operators import forms, layout, lease_text, phrases
from parcelspark.plans import intake
from parcelspark.plans.catalog import query
from parcelspark.plans.project import AS_OF, dealt_out, read


def roll_words(spark, sf_dir) -> DataFrame:
    """A page for each customer: a title, a header, and a line for each order with a name of two words, a unit, a rent and a date."""
    k = F.col("o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = dealt_out(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select("o_custkey", k, place.alias("n"))

    def word(x, text):
        return F.struct(x.cast("int").alias("x"), text.alias("text"))

    name = F.concat(F.lit("T"), (k % 1000).cast("string"))
    cells = F.array(
        word(10 + k % 2, name), word(14 + 6 * F.length(name) + k % 3, F.lit("Holder")), word(150 + k % 3, F.concat(F.lit("A"), (k % 97).cast("string"))),
        word(220 + k % 4, (1000 + k % 9000).cast("string")), word(320 + k % 2, F.lit("2024-01-31")),
    )
    lines = orders.select(F.col("o_custkey").alias("page_id"), (F.col("n") * 20 + 20 + k % 3).alias("y"), F.posexplode(cells).alias("i", "w"), (F.col("n") * 10).alias("at"))
    heads = F.array(*[word(F.lit(x), F.lit(t)) for x, t in ((10, "Tenant"), (150, "Unit"), (220, "Monthly"), (266, "Rent"), (320, "End"))])
    titles = F.array(*[word(F.lit(x), F.lit(t)) for x, t in ((10, "Rent"), (38, "roll"))])
    pages = orders.select(F.col("o_custkey").alias("page_id")).distinct()
    upper = [pages.select("page_id", F.lit(y).cast("long").alias("y"), F.posexplode(a).alias("i", "w"), F.lit(at).alias("at")) for y, a, at in ((0, titles, -20), (20, heads, -10))]
    every = lines.unionByName(upper[0]).unionByName(upper[1])
    return every.select("page_id", (F.col("at") + F.col("i")).alias("word_id"), F.col("w.x").alias("x"), F.col("y").cast("int").alias("y"), (6 * F.length("w.text")).alias("width"), F.lit(10).alias("height"), F.col("w.text").alias("text"))


@query("""WITH o AS (SELECT o_custkey AS page_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS row FROM orders),
 c AS (SELECT page_id, row, unnest([0, 1, 2, 3]) AS col, unnest(['T' || k % 1000 || ' Holder', 'A' || k % 97, CAST(1000 + k % 9000 AS VARCHAR), '2024-01-31']) AS text FROM o),
 p AS (SELECT DISTINCT page_id FROM o)
 SELECT page_id, row::BIGINT AS row, col, text FROM c UNION ALL SELECT page_id, 1, unnest([0, 1, 2, 3]), unnest(['Tenant', 'Unit', 'Monthly Rent', 'End']) FROM p UNION ALL SELECT page_id, 0, 0, 'Rent roll' FROM p""", lease=False)
def words_in_cells(spark, sf_dir):
    """Rows and columns of positioned words."""
    return layout.page_cells(roll_words(spark, sf_dir)).withColumn("row", F.col("row").cast("long"))


def labels(spark, sf_dir) -> DataFrame:
    """The first six words of each benchmark text as a phrase, some of them misspelt, run together or cut apart."""
    k = F.col("item_id")
    start = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 6), " ")
    n = F.length(start)
    wrong = F.when(k % 4 == 1, F.concat(F.substr(start, F.lit(1), F.floor(n / 2).cast("int")), F.lit("q"), F.substr(start, F.floor(n / 2).cast("int") + 2, n)))
    wrong = wrong.when(k % 4 == 2, F.regexp_replace(start, " ", "")).when(k % 4 == 3, F.concat(F.substr(start, F.lit(1), F.lit(4)), F.lit(" "), F.substr(start, F.lit(5), n))).otherwise(start)
    return read(spark, sf_dir, "benchmark").select(k.alias("phrase_id"), wrong.alias("phrase"))


@query()
def fuzzy_phrases(spark, sf_dir):
    """Misread labels in the texts of all documents."""
    return phrases.fuzzy_phrases(dealt_out(read(spark, sf_dir, "documents").select("doc_id", "text")), labels(spark, sf_dir))


# --- forms ---------------------------------------------------------------------------------------

#: Form, field, which label is tried first, label, whether the box is measured from its right edge, box, type.
RULES = (
    ("approval", "rent_amount", 0, "Contract Rent to Owner", True, 2, -3, 120, 11, "money"),
    ("approval", "bedrooms", 0, "No. of Bedrooms", False, -5, 12, 120, 24, "int"),
    ("approval", "effective_date", 0, "Effective Date of Contract", True, 2, -3, 140, 11, "date"),
    ("approval", "tenant", 0, "Name of Tenant (last, first)", False, -5, 12, 260, 24, "text"),
    ("approval", "subsidy_share", 0, "Share paid by agency", True, 2, -3, 90, 11, "percent"),
    ("approval", "utilities", 0, "Utilities included", True, 2, -3, 40, 11, "checkbox"),
    ("approval", "rent_amount", 1, "Rent approved by agency", True, 2, -3, 120, 11, "money"),
)


def form_rules(spark) -> DataFrame:
    return spark.createDataFrame([(*r[:5], *map(float, r[5:9]), r[9]) for r in RULES], "form string, field string, nth int, phrase string, from_end boolean, x0 double, y0 double, x1 double, y1 double, kind string")


def _placed(n: int, x, y):
    return lambda z: F.struct(F.lit(n).alias("n"), (x + 6 * z["b"]).cast("int").alias("x"), y.alias("y"), z["w"].alias("text"))


def form_words(spark, sf_dir) -> DataFrame:
    """A filled form for each customer; some labels are misread, some boxes hold print only, and some rents stand in another place."""
    k = F.col("c_custkey")
    money = F.format_number(500 + k % 4000, 0)
    rent = F.when(k % 9 == 1, F.replace(money, F.lit("0"), F.lit("O"))).when(k % 9 == 2, F.concat(F.lit("$"), money)).otherwise(money)
    lines = [
        (20, F.when(k % 4 == 1, "Contract Rnet to Owner").otherwise("Contract Rent to Owner"), 0, F.when(k % 7 != 0, rent).otherwise("(amount)"), 10),
        (50, F.when(k % 5 == 1, "No.of Bedrooms").otherwise("No. of Bedrooms"), 14, (1 + k % 4).cast("string"), -1),
        (90, F.when(k % 6 == 1, "Efective Date of Contract").otherwise("Effective Date of Contract"), 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "M/d/yyyy"), 10),
        (120, F.lit("Name of Tenant (last, first)"), 14, F.when(k % 8 == 0, "Last, First Middle").otherwise(F.concat(F.lit("Tenant"), k.cast("string"), F.lit(", Jo"))), -1),
        (160, F.lit("Share paid by agency"), 0, F.concat((k % 90 + 10).cast("string"), F.lit(" %")), 10),
        (190, F.lit("Utilities included"), 0, F.when(k % 3 == 0, "[ X ]").otherwise("[ ]"), 10),
        (220, F.lit("Rent approved by agency"), 0, F.when(k % 14 == 0, F.concat(F.lit("$ "), money)), 10),
    ]
    placed = []
    for n, (y, label, down, said, gap) in enumerate(lines):
        right = 10 + 6 * F.length(label)
        for part, text, x, at in ((0, label, F.lit(10), F.lit(y)), (1, said, (right + gap) if gap > 0 else F.lit(12), F.lit(y + down))):
            words = F.split(text, " ")
            before = F.transform(words, lambda w, i: F.length(F.array_join(F.slice(words, 1, i), " ")) + (i > 0).cast("int"))
            placed.append(F.transform(F.arrays_zip(words.alias("w"), before.alias("b")), _placed(n * 2 + part, x, at)))
    every = F.flatten(F.filter(F.array(*placed), lambda a: a.isNotNull()))
    rows = dealt_out(read(spark, sf_dir, "customer").select("c_custkey")).select(k.alias("page_id"), F.posexplode(every).alias("word_id", "w"))
    return rows.select("page_id", F.col("word_id").cast("long").alias("word_id"), F.col("w.x").alias("x"), F.col("w.y").alias("y"), (6 * F.length("w.text")).alias("width"), F.lit(8).alias("height"), F.col("w.text").alias("text"))


@query("""WITH c AS (SELECT c_custkey AS k, CAST(500 + c_custkey % 4000 AS INT) AS m FROM customer),
 f AS (SELECT k AS page_id, 'rent_amount' AS field, '$' || format('{:,.2f}', m::DOUBLE) AS value FROM c WHERE k % 7 <> 0 OR k % 14 = 0 UNION ALL SELECT k, 'bedrooms', CAST(1 + k % 4 AS VARCHAR) FROM c UNION ALL SELECT k, 'effective_date', strftime(DATE '2024-01-01' + CAST(k % 300 AS INT), '%m/%d/%Y') FROM c
   UNION ALL SELECT k, 'tenant', 'Tenant' || k || ', Jo' FROM c WHERE k % 8 <> 0 UNION ALL SELECT k, 'subsidy_share', (k % 90 + 10) || '%' FROM c UNION ALL SELECT k, 'utilities', 'X' FROM c WHERE k % 3 = 0)
 SELECT page_id, 'approval' AS form, field, value FROM f""", lease=False)
def form_fields(spark, sf_dir):
    """Typed fields of filled forms."""
    return forms.form_fields(form_words(spark, sf_dir), form_rules(spark)).select("page_id", "form", "field", "value")


@query("""WITH o AS (SELECT o_orderkey AS k, o_totalprice AS t FROM orders), f AS (SELECT k, t, unnest(['tenant', 'landlord', 'rent_amount', 'lease_start_date', 'lease_end_date', 'property_address', 'cam_charges', 'permitted_use', 'renewal_options', 'insurance_requirements']) AS field FROM o),
 d AS (SELECT k, field, list_filter([CASE WHEN field = 'rent_amount' AND (k % 8 = 0 OR floor(t) / 100 < 50) THEN 'range' END, CASE WHEN field = 'lease_start_date' AND k % 10 = 0 THEN 'date' END, CASE WHEN field = 'lease_end_date' AND k % 9 = 0 AND k % 10 <> 0 THEN 'order' END, CASE WHEN k % 6 = 0 THEN 'ocr' END], lambda x: x IS NOT NULL) AS doubts FROM f)
 SELECT k AS doc_id, field, ['high', 'medium', 'low'][least(len(doubts), 2) + 1] AS confidence, array_to_string(doubts, ',') AS doubts FROM d""", lease=False)
def doubtful_fields(spark, sf_dir):
    """Confidence of lease fields after doubts about amounts, dates, their order and hardly legible pages."""
    k, text = F.col("doc_id"), F.col("text")
    text = F.when(k % 8 == 0, F.regexp_replace(text, r"Monthly Rent: \$[0-9,]+\.[0-9]{2}", r"Monthly Rent: \$20.00")).otherwise(text)
    text = F.when(k % 9 == 0, F.regexp_replace(text, "Expiration Date: [0-9/]+", "Expiration Date: 01/01/1990")).otherwise(text)
    text = F.when(k % 10 == 0, F.regexp_replace(text, "Commencement Date: [A-Za-z]+ [0-9]+, [0-9]{4}", "Commencement Date: January 2, 1950")).otherwise(text)
    pages = intake.lease_pages(spark, sf_dir).withColumn("text", text)
    clarity = pages.select("doc_id", "page", F.when(k % 6 == 0, 40).otherwise(90).alias("clarity"))
    return lease_text.validated(lease_text.extract(pages), AS_OF, clarity).select("doc_id", "field", "confidence", F.array_join("doubts", ",").alias("doubts"))
