"""A truth table of concession sentences, and sentences by a plain reading."""

import re

import pytest
from pyspark.sql import functions as F

from parcelspark.operators import clauses, concessions

FREE, OFF, ONCE = "free_rent", "recurring_discount", "one_time_credit"
TRUTH = {
    # free months
    "Landlord grants two (2) months free rent.": [(FREE, 2.0, None, "first", None, None)],
    "One (1) month of Base Rent (the first full calendar month) is abated.": [(FREE, 1.0, None, "first", None, None)],
    "The last 1 month is free.": [(FREE, 1.0, None, "last", None, None)],
    "Last twenty-four months rent-free": [(FREE, 24.0, None, "last", None, None)],
    "Free rent for the first two (2) months": [(FREE, 2.0, None, "first", None, None)],
    "A rent abatement of one-half (1/2) month applies.": [(FREE, 0.5, None, "first", None, None)],
    "Base Rent shall be abated for the first three (3) months.": [(FREE, 3.0, None, "first", None, None)],
    "The first month's rent is waived.": [(FREE, 1.0, None, "first", None, None)],
    "The final month's rent will be free.": [(FREE, 1.0, None, "last", None, None)],
    "Provided Tenant is not then in default, one month free.": [(FREE, 1.0, None, "first", None, None)],
    # discounts of every month
    "Base Rent is reduced by $100.00 per month.": [(OFF, None, 100.0, "first", None, None)],
    "$75/mo off for the first 6 months": [(OFF, 6.0, 75.0, "first", None, None)],
    "$50 off the monthly base rent each month": [(OFF, None, 50.0, "first", None, None)],
    "Resident gets a discount of $1,050 per month during the last two months.": [(OFF, 2.0, 1050.0, "first", None, None)],
    "A monthly rent credit of $150.00 for the first 6 months.": [(OFF, 6.0, 150.0, "first", None, None)],
    "5% off for the full lease term": [(OFF, None, None, "first", 5.0, None)],
    "First month 50% off": [(OFF, 1.0, None, "first", 50.0, None)],
    "Rent is discounted by 12.5 %.": [(OFF, None, None, "first", 12.5, None)],
    # single credits
    "The first month's rent is reduced to $500.": [(ONCE, None, None, "first", None, 500.0)],
    "$300 off the first month's rent": [(ONCE, None, 300.0, "first", None, None)],
    "One-time concession of $500 at signing. No months free.": [(ONCE, None, 500.0, "first", None, None)],
    "A $250 move-in credit applies": [(ONCE, None, 250.0, "first", None, None)],
    "A renewal credit in the amount of $90 is given": [(ONCE, None, 90.0, "first", None, None)],
    # several, and one twice
    "One month free and $50/mo off for the first 3 months; a $99 signing credit.": [(FREE, 1.0, None, "first", None, None), (OFF, 3.0, 50.0, "first", None, None), (ONCE, None, 99.0, "first", None, None)],
    "One month free. ONE MONTH FREE.": [(FREE, 1.0, None, "first", None, None)],
    "Two\nmonths free": [(FREE, 2.0, None, "first", None, None)],
    # no concessions
    "Tenant shall not receive two months free.": [],
    "If Tenant defaults, Tenant is not entitled to one month free.": [],
    "Rent shall increase by $50 per month discount notwithstanding.": [],
    "In case of fire, rent shall be abated for three months.": [],
    "Parking is $50 per month, discounted by $10 per month.": [],
    "A $200 credit, applied toward the security deposit.": [],
    "One month's rent as a prepaid deposit is credited toward the last month.": [],
    "$40 per month credit card": [],
    "A $20 utility credit applies": [],
    "Rent is $5.": [], "36 months free": [], "": [], "No.": [], None: [],
}


def test_truth_table(spark):
    rows = spark.createDataFrame(list(enumerate(TRUTH)), "i int, concessions string")
    got = {r.i: [tuple(x) for x in r["items"]] for r in concessions.with_items(rows).collect()}
    for i, (text, want) in enumerate(TRUTH.items()):
        assert got[i] == want, text


def test_no_python_in_the_plan(spark):
    plan = concessions.with_items(spark.createDataFrame([("x",)], "concessions string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain(text):
    out, at = [], 0
    for m in re.finditer(r"[.;](?=\s|$)|\n\s*\n", text):
        word = re.search(r"\b([A-Za-z]+)$", text[:m.start()])
        if m[0] == "." and word and word[1].lower() in clauses.ABBREVIATIONS:
            continue
        out.append((at, text[at : m.end()]))
        at = m.end()
    return [x for x in [*out, (at, text[at:])] if x[1].strip()]


@pytest.mark.parametrize("where", ["written", "documents"])
def test_sentences_equal_a_plain_reading(spark, small, where):
    texts = ["One. Two; three\n\nfour", "Apt. 5 of No. 7 St. James Co. Ltd. ends.", "$1,075.00 is due. 3.5 too.", "", " \n\n ", "a.b;c", "x\n \n\ny. ", "Ünï. 漢字; 😀. end", None, "....", "; ;"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string") if where == "written" else spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    for r in df.withColumn("s", clauses.sentences(F.col("text"))).collect():
        assert [tuple(x) for x in r.s or []] == (plain(r.text) if r.text else []), r.text
