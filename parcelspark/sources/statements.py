"""Trailing-twelve-month statements out of delimited files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions import parse
from parcelspark.sources.delimited import decode, grid, header_key, name_in

MONTHS = [m[:3] for m in parse.MONTHS]
CATEGORIES = {
    "gross_potential_rent": ("gross potential rent", "market rent", "potential rent"),
    "vacancy_loss": ("vacancy loss", "vacancy", "loss to vacancy"),
    "concessions": ("concessions", "rent concessions", "concession"),
    "bad_debt": ("bad debt", "write offs", "uncollected rent"),
    "rental_income_collected": ("total rental income", "rental income", "rent collected", "net rental income"),
    "operating_expenses": ("total operating expenses", "operating expenses", "total expenses"),
    "net_operating_income": ("net operating income", "noi"),
}
OUT = "file string, category string, row_num int, month_idx int, raw string"


def month_of(cell: str) -> tuple[int, int] | None:
    """Year (0 if unstated) and month of a header cell; other periods' columns are not months."""
    text = header_key(cell)
    if re.search(r"\b(budget|variance|prior|ytd)\b", text):
        return None
    if m := re.fullmatch(r"([a-z]{3})[a-z]* ?(\d{4}|\d{2})?", text):
        if m[1] in MONTHS:
            year = int(m[2] or 0)
            return (year + 2000 if 0 < year < 100 else year), MONTHS.index(m[1]) + 1
    if m := re.fullmatch(r"(\d{1,2})[ ](\d{4})", text):
        return (int(m[2]), int(m[1])) if 1 <= int(m[1]) <= 12 else None
    if m := re.fullmatch(r"(\d{4})[ ](\d{1,2})", text):
        return (int(m[1]), int(m[2])) if 1 <= int(m[2]) <= 12 else None
    return None


def category_of(label: str) -> str | None:
    text = header_key(label)
    return next((k for k, names in CATEGORIES.items() if text in names), None)


def parse_statement(name: str, raw: bytes) -> list[dict]:
    text = decode(raw)
    rows = grid(text) if text else []
    for at, (_, row) in enumerate(rows[:20]):
        months = {i: m for i, c in enumerate(row) if (m := month_of(c))}
        if len(months) >= 3:
            break
    else:
        return []
    newest: dict[int, int] = {}  # of two columns for a month, the later year counts
    for i, (year, month) in months.items():
        if month not in newest or months[newest[month]][0] < year:
            newest[month] = i
    total = next((i for i, c in enumerate(row) if header_key(c) in ("total", "annual", "t12 total")), None)
    order = sorted(newest.values())
    out, seen = [], set()
    for number, cells in rows[at + 1 :]:
        k = category_of(next((c for c in cells if c), ""))
        if k is None or k in seen or not any(re.search(r"\d", c) for c in cells[1:]):
            continue
        seen.add(k)
        for idx, i in enumerate(order, 1):
            out.append({"file": name, "category": k, "row_num": number, "month_idx": idx, "raw": cells[i] if i < len(cells) else None})
        if total is not None and total < len(cells):
            out.append({"file": name, "category": k, "row_num": number, "month_idx": 0, "raw": cells[total]})
    return out


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """``file, category, row_num, month_idx, amount`` (S13, S21, R28); month 0 is the stated total."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"]) for r in parse_statement(name_in(path, p), bytes(c))]
            yield pd.DataFrame(rows, columns=["file", "category", "row_num", "month_idx", "raw"])

    return files.mapInPandas(run, OUT).withColumn("amount", parse.import_currency("raw")).drop("raw")


def consistent_lines(lines: DataFrame) -> DataFrame:
    """Lines whose twelve months add up to the stated total within 1 and 1 percent."""
    sums = lines.groupBy("file", "category").agg(F.sum(F.when(F.col("month_idx") > 0, F.col("amount"))).alias("months"), F.max(F.when(F.col("month_idx") == 0, F.col("amount"))).alias("stated"), F.count(F.when(F.col("month_idx") > 0, F.col("amount"))).alias("n"))
    off = F.abs(F.col("months") - F.col("stated"))
    return sums.where((F.col("n") == 12) & (off <= F.greatest(F.lit(1.0), F.abs("stated") * 0.01))).select("file", "category", F.round("months", 2).alias("annual"))
