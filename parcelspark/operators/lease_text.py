"""Fields out of lease prose by ordered patterns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.functions import parse

_NAME = r"([A-Z][\w&.,'’ -]{1,80}?)"
_DAY = r"([A-Z][a-z]+\.? \d{1,2},? \d{4}|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}(?:st|nd|rd|th)? day of [A-Z][a-z]+,? \d{4})"
_MONEY = r"(\$\s?[\d,]+(?:\.\d{2})?)"
#: Field -> patterns with their confidence, surest first.
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "tenant": [(r"\b(?:Tenant|Lessee)\s*:\s*" + _NAME + r"\s*(?:\n|;|$|,? a )", "high"), (r"\band\s+" + _NAME + r",?\s*\(?[\"“]?(?:the\s+)?[\"“]?(?:Tenant|Lessee)", "medium")],
    "landlord": [(r"\b(?:Landlord|Lessor)\s*:\s*" + _NAME + r"\s*(?:\n|;|$|,? a )", "high"), (r"\bbetween\s+" + _NAME + r",?\s*\(?[\"“]?(?:the\s+)?[\"“]?(?:Landlord|Lessor)", "medium")],
    "rent_amount": [(r"\b(?:Monthly|Base)\s+Rent\s*(?::|of|is|shall be)\s*" + _MONEY, "high"), (r"\brent\b[^.$]{0,60}" + _MONEY + r"\s*(?:per|a|each)\s+month", "medium"), (r"\brent\b[^.$]{0,60}" + _MONEY, "low")],
    "security_deposit": [(r"\bSecurity\s+Deposit\s*(?::|of|is|in the amount of)\s*" + _MONEY, "high"), (r"\bdeposit\b[^.$]{0,60}" + _MONEY, "medium")],
    "lease_start_date": [(r"\b(?:Commencement|Start)\s+Date\s*(?::|is|shall be)?\s*" + _DAY, "high"), (r"\b(?:commenc|begin)\w*\s+(?:on\s+)?(?:the\s+)?" + _DAY, "medium")],
    "lease_end_date": [(r"\b(?:Expiration|End|Termination)\s+Date\s*(?::|is|shall be)?\s*" + _DAY, "high"), (r"\b(?:expir|end|terminat)\w*\s+(?:on\s+)?(?:the\s+)?" + _DAY, "medium")],
    "square_footage": [(r"\b([\d,]{3,9})\s*(?:rentable\s+)?(?:square\s+feet|sq\.?\s*ft\.?)", "high")],
    "rent_escalation": [(r"\b(\d+(?:\.\d+)?\s*%\s*(?:annually|per year|each year))", "high"), (r"\bincrease\w*\s+by\s+(\d+(?:\.\d+)?\s*%)", "medium")],
    "property_address": [(r"\b(?:Premises|Property|Address)\s*:\s*(\d[^\n;]{4,100}?)\s*(?:\n|;|$)", "high"), (r"\b(?:premises|property)\s+(?:located\s+)?at\s+(\d[^\n;.]{4,100}?)\s*(?:[\n;.]|$)", "medium")],
    "cam_charges": [(r"\b(?:[Cc]ommon [Aa]rea [Mm]aintenance|CAM)\b[^.$]{0,40}" + _MONEY, "high")],
    "renewal_options": [(r"\b(\d+\s+options?\s+to\s+(?:renew|extend)[^.;]{0,40}?\d+\s+years?)", "high"), (r"\b(?:renewal|extension)\s+options?\s*:?\s*([^.;\n]{4,80})", "medium")],
    "termination_options": [(r"\b((?:[Tt]enant|[Ll]andlord|[Ee]ither party)\s+may\s+terminate[^.;\n]{4,120})", "high")],
    "permitted_use": [(r"\b[Pp]ermitted\s+[Uu]se\s*(?::|is|shall be)\s*([^.;\n]{3,80})", "high"), (r"\bused?\s+(?:only|solely|exclusively)\s+(?:as|for)\s+([^.;\n]{3,80})", "medium")],
    "exclusivity_clause": [(r"\b[Ee]xclusiv\w+\s*(?::|clause)\s*([^.;\n]{4,120})", "high"), (r"\b([Ll]andlord\s+shall\s+not\s+(?:lease|rent)[^.;\n]{4,120})", "medium")],
    "insurance_requirements": [(r"\bmaintain\s+([^.;\n]{0,60}?insurance[^.;\n]{0,60}?\$\s?[\d,]+)", "high"), (r"\b([^.;\n]{0,60}liability\s+insurance[^.;\n]{0,60})", "medium")],
    "default_cure_period": [(r"\b(\d+\s+days?)\b[^.]{0,40}\bcure", "medium"), (r"\bcure\b[^.]{0,40}?\b(\d+\s+days?)", "medium")],
}
COMPILED = {f: [(re.compile(p), c) for p, c in ps] for f, ps in PATTERNS.items()}
OUT = "doc_id long, field string, value string, confidence string, page int, quote string"
ROLES = {"start": COMPILED["lease_start_date"], "end": COMPILED["lease_end_date"]}


def read_page(text: str | None) -> list[tuple[str, str, str, str]]:
    """``(field, value, confidence, quote)`` of the surest match of each field on one page."""
    out = []
    for field, patterns in COMPILED.items():
        for pattern, confidence in patterns:
            if m := pattern.search(text or ""):
                around = text[max(0, m.start() - 50) : m.end() + 50]
                out.append((field, m[1].strip(" ,."), confidence, " ".join(around.split())))
                break
    return out


def page_values(pages: DataFrame) -> DataFrame:
    """``doc_id, field, value, confidence, page, quote`` of each page (doc_id, page, text)."""

    def run(batches):
        for batch in batches:
            rows = [(d, f, v, c, p, q) for d, p, t in zip(batch["doc_id"], batch["page"], batch["text"]) for f, v, c, q in read_page(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "field", "value", "confidence", "page", "quote"])

    return pages.select("doc_id", "page", "text").mapInPandas(run, OUT)


def extract(pages: DataFrame) -> DataFrame:
    """One value of each field per document: by confidence, then page (R32).  Grouped, so pages need not meet."""
    rank = F.array_position(F.array(*map(F.lit, ("high", "medium", "low"))), F.col("confidence"))
    best = page_values(pages).groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "confidence", "page", "quote"), F.struct(rank, "page", "value")).alias("x"))
    return best.select("doc_id", "field", "x.*")


#: What a field's amount lies between, and below which clarity (of 100) a scanned page is hardly legible.
RANGES = {"rent_amount": (50, 1_000_000), "security_deposit": (1, 2_000_000), "cam_charges": (1, 500_000), "square_footage": (50, 2_000_000)}
CLEAR, FIRST_YEAR, YEARS_AHEAD = 60, 1980, 30


def validated(fields: DataFrame, as_of: str, clarity: DataFrame | None = None) -> DataFrame:
    """Extracted fields with their confidence lowered a tier for each doubt, and the doubts.

    ``range``: an amount or area outside what is usual; ``date``: a start or end in
    another age; ``order``: an end that is not after the start; ``ocr``: a page that
    is hardly legible (``clarity``: doc_id, page, clarity).  Doubts never raise a tier.
    """
    number = F.when(F.col("field") == "square_footage", parse.square_feet("value")).otherwise(parse.currency("value"))
    bounds = [F.when(F.col("field") == f, ~number.between(low, high)) for f, (low, high) in RANGES.items()]
    dated = F.when(F.col("field").isin("lease_start_date", "lease_end_date"), parse.date("value"))
    rows = fields.withColumn("d", dated)
    of = Window.partitionBy("doc_id")
    start, end = (F.max(F.when(F.col("field") == f, F.col("d"))).over(of) for f in ("lease_start_date", "lease_end_date"))
    last = F.year(F.lit(as_of).cast("date")) + YEARS_AHEAD
    rows = rows.withColumn("ends_early", (F.col("field") == "lease_end_date") & (end <= start))
    if clarity is not None:
        rows = rows.join(clarity.select("doc_id", "page", "clarity"), ["doc_id", "page"], "left")
    unclear = F.col("clarity") < CLEAR if clarity is not None else F.lit(False)
    tests = {"range": F.coalesce(*bounds), "date": ~F.year("d").between(FIRST_YEAR, last), "order": F.col("ends_early"), "ocr": unclear}
    doubts = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    tiers = F.array(*map(F.lit, ("high", "medium", "low")))
    rows = rows.withColumn("doubts", doubts)
    lowered = F.get(tiers, F.least(F.array_position(tiers, F.col("confidence")).cast("int") - 1 + F.size("doubts"), F.lit(2)))
    return rows.withColumn("confidence", F.when(F.col("confidence").isNotNull(), lowered)).select(*fields.columns, "doubts")


def several_leases(pages: DataFrame) -> DataFrame:
    """Documents with more than one tenant or landlord, and the pages where each begins."""
    found = page_values(pages).where("field IN ('tenant', 'landlord') AND confidence = 'high'").withColumn("name", F.lower("value"))
    starts = found.groupBy("doc_id", "field", "name").agg(F.min("page").alias("start_page"))
    many = starts.groupBy("doc_id", "field").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("start_page")).alias("start_pages"))
    return many.where("n > 1")


def date_candidates(pages: DataFrame) -> DataFrame:
    """Every date in a start or end role, for conflict checks."""

    def run(batches):
        for batch in batches:
            rows = [(d, role, m[1], p) for d, p, t in zip(batch["doc_id"], batch["page"], batch["text"]) for role, ps in ROLES.items() for pat, _ in ps for m in pat.finditer(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "role", "value", "page"])

    return pages.select("doc_id", "page", "text").mapInPandas(run, "doc_id long, role string, value string, page int").distinct()


def page_chunks(pages: DataFrame, most_pages: int = 20, most_chars: int = 40_000) -> DataFrame:
    """Chunk numbers of pages, cut before a page that would pass a bound.

    Each cut depends on the one before, so a document's page lengths (not its
    texts) stream past in order; what is held is the chunk at hand.
    """
    sizes = pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    ordered = sizes.repartition("doc_id").sortWithinPartitions("doc_id", "page")

    def fold(batches):
        import pyarrow as pa

        of, no, count, chars = None, 0, 0, 0
        for batch in batches:
            out = []
            for doc, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if (doc,) != of:
                    of, no, count, chars = (doc,), 0, 0, 0
                if count and (count >= most_pages or chars + n > most_chars):
                    no, count, chars = no + 1, 0, 0
                count, chars = count + 1, chars + n
                out.append(no)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=["doc_id", "page", "chunk"])

    return ordered.mapInArrow(fold, "doc_id long, page int, chunk int")
