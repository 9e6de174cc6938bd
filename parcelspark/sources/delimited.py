"""Grids out of delimited files whose encoding, delimiter and header are unknown."""

from __future__ import annotations

import csv
import io
import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canonical column -> header spellings, in our own words.
ALIASES = {
    "tenant": ("tenant", "tenants", "tenant name", "resident", "occupant", "lessee", "name", "household"),
    "rent": ("rent", "monthly rent", "base rent", "rent charge", "actual rent", "contract rent", "current rent", "lease rent"),
    "start": ("lease start", "lease from", "start", "commence", "start date", "commencement", "from", "move in"),
    "end": ("lease end", "lease to", "end", "expire", "expiration", "end date", "expires", "to"),
    "unit": ("unit", "suite", "apt", "space", "unit no", "bldg unit"),
    "property": ("property", "property address", "address", "building", "location"),
    "sqft": ("sf", "sqft", "sq ft", "unit sf", "square feet", "area"),
    "deposit": ("deposit", "security dep", "security deposit", "deposit held"),
    "status": ("status", "occupancy", "unit status"),
    "portion": ("tenant portion", "tenant share", "tenant payment", "tenant rent", "resident portion"),
    "subsidy": ("subsidy", "subsidy amount", "hap", "hap amount", "housing assistance payment", "assistance payment"),
    "concession": ("concession", "concessions", "monthly concession", "concession amount"),
    "code": ("charge code", "code", "charge type"),
    "amount": ("amount", "charge amount"),
}
#: Charge codes that are the rent itself, and those that take something off it.
RENT_CODE, OFF_CODE = re.compile(r"^(?:base |monthly |contract )?re?nt(?:al)?(?: charge)?$"), re.compile(r"^(?:conc|disc)|concession")
#: Words of so many letters may be misspelt in a header.
MISSPELT = 5
#: Headers that hold other figures: market, yearly and per-foot rents, and people of the owner.
DENIED = re.compile(r"\b(?:market|asking|annual|yearly|per year|psf|per sq|sq ft rent|manager|prior|budget)\b")
NOT_TENANT = re.compile(r"(?i)^\s*(?:$|-+\s*$|(?:vacant|vacancy|totals?|sub ?totals?|grand total|n/?a|none|down|model|office)\b)")
FUTURE = re.compile(r"(?i)\b(?:future|applicant)\b|\bpending\b.*\bmove|\bmove.*\bpending\b")
HEADER_ROWS = 50


def decode(raw: bytes) -> str | None:
    """UTF-16 by mark or by zero bytes, else UTF-8, else cp1252; binary content is None."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    if len(raw) > 3 and raw[1::2][:200].count(0) > len(raw[1::2][:200]) * 0.6:
        return raw.decode("utf-16-le", "replace")
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = raw.decode("cp1252", "replace")
    odd = sum(1 for c in text if ord(c) < 32 and c not in "\t\r\n")
    return None if "\0" in text or odd > len(text) * 0.01 else text


def delimiter(text: str) -> str:
    """The one that splits most of the first eight lines with text, by its fewest fields."""
    lines = [x for x in text.splitlines() if x.strip()][:8]
    best, found = 0, ","
    for d in ",;\t|":
        counts = [len(row) - 1 for row in csv.reader(lines, delimiter=d)]
        split = [c for c in counts if c > 0]
        if len(split) * 2 >= len(lines) and split and min(split) > best:
            best, found = min(split), d
    return found


def header_key(cell: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", cell.lower())).strip()


def cut_forms(word: str) -> set[str]:
    """The word, and the word without any one of its letters: words one slip apart have one in common."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) >= MISSPELT else {word}


def one_slip(a: str, b: str) -> bool:
    """Whether a letter was left out, added, changed, or swapped with the next."""
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) < len(b):
        return len(b) - len(a) == 1 and a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _slips() -> dict[tuple[str, ...], list[tuple[int, str, str]]]:
    """Spellings of columns under every tuple of cut forms of their words."""
    out: dict[tuple[str, ...], list[tuple[int, str, str]]] = {}
    for column, spellings in ALIASES.items():
        for alias in spellings:
            for forms in itertools.product(*map(cut_forms, alias.split())):
                out.setdefault(forms, []).append((len(alias), column, alias))
    return out


_SLIPS = _slips()


def misspelt(name: str) -> set[tuple[int, str]]:
    """Columns whose spelling has as many words, each the same or one slip away; with the spelling's length."""
    words = name.split()
    near = {x for forms in itertools.product(*map(cut_forms, words)) for x in _SLIPS.get(forms, ())} if len(words) <= 4 else set()
    return {(n, column) for n, column, alias in near if alias != name and all(w == a or (min(len(w), len(a)) >= MISSPELT and one_slip(w, a)) for w, a in zip(words, alias.split()))}


def denied(name: str) -> bool:
    """Whether a header is of another figure, even if it is misspelt."""
    return bool(DENIED.search(name)) or any(len(w) >= MISSPELT and one_slip(w, d) for w in name.split() for d in ("market", "asking", "annual", "yearly", "budget"))


def map_header(cells: list[str]) -> dict[str, int]:
    """Canonical columns to positions: exact spelling first, then the longest whole phrase, then the longest misspelt one; each position once."""
    names = [header_key(c) for c in cells]
    out: dict[str, int] = {}
    free = {i: n for i, n in enumerate(names) if n and not denied(n)}
    options = sorted(((len(a), k, a) for k, spellings in ALIASES.items() for a in spellings), key=lambda x: -x[0])
    for exact in (True, False):
        for _, k, alias in options:
            if k in out:
                continue
            at = next((i for i, n in free.items() if (n == alias if exact else re.search(rf"\b{re.escape(alias)}\b", n))), None)
            if at is not None:
                out[k] = at
                del free[at]
    for _, k, i in sorted(((n, k, i) for i, name in free.items() for n, k in misspelt(name)), key=lambda x: (-x[0], x[2])):
        if k not in out and i in free:
            out[k] = i
            del free[i]
    return out


def _has_rent(columns: dict[str, int]) -> bool:
    """A rent, a tenant's part of it, or charges that it can be added up from."""
    return "rent" in columns or "portion" in columns or {"code", "amount", "unit"} <= columns.keys()


def find_header(rows: list[list[str]]) -> tuple[int, dict[str, int]] | None:
    """First row that names both tenant and rent; else two rows read as one."""
    for i, row in enumerate(rows[:HEADER_ROWS]):
        found = map_header(row)
        if "tenant" in found and _has_rent(found):
            return i, found
    for i in range(min(len(rows) - 1, HEADER_ROWS)):
        width = max(len(rows[i]), len(rows[i + 1]))
        upper, filled = rows[i] + [""] * (width - len(rows[i])), []
        for c in upper:
            filled.append(c or (filled[-1] if filled else ""))
        lower = rows[i + 1] + [""] * (width - len(rows[i + 1]))
        found = map_header([f"{a} {b}".strip() for a, b in zip(filled, lower)])
        if "tenant" in found and _has_rent(found):
            return i + 1, found
    return None


def grid(text: str) -> list[tuple[int, list[str]]]:
    """Rows with text, under their line numbers."""
    d = delimiter(text)
    return [(i, [c.strip() for c in row]) for i, row in enumerate(csv.reader(io.StringIO(text), delimiter=d), 1) if any(c.strip() for c in row)]


ROW = "file string, row_num int, tenant string, rent string, start string, end string, unit string, property string, sqft string, deposit string, status string, portion string, subsidy string, concession string, skip_reason string"


def _dollars(cell: str | None) -> float | None:
    digits = re.sub(r"[^0-9.]", "", cell or "")
    return float(digits) if re.fullmatch(r"[0-9]+\.?[0-9]*|\.[0-9]+", digits) else None


def whole_rent(cell: dict[str, str | None], columns: dict[str, int]) -> str | None:
    """A row's rent (R27): what the tenant pays and the subsidy together, where the rent column lacks or only repeats the tenant's part."""
    rent, portion, subsidy = cell.get("rent"), cell.get("portion"), cell.get("subsidy")
    paid, helped = _dollars(portion), _dollars(subsidy)
    if "portion" in columns and "subsidy" in columns:
        if ("rent" not in columns or (paid is not None and _dollars(rent) == paid)) and (paid is not None or helped is not None):
            return f"{(paid or 0) + (helped or 0):.2f}"
        return rent
    return rent or portion


def folded_charges(numbered: list[tuple[int, list[str]]], columns: dict[str, int]) -> list[tuple[int, dict[str, str | None]]]:
    """Charge lines folded under the line of their unit (A31): its rent codes added up, its concession codes by size."""

    def cell(row, name):
        i = columns.get(name)
        return (row[i] or None) if i is not None and i < len(row) else None

    out: list[tuple[int, dict[str, str | None]]] = []
    sums: list[dict[str, float]] = []
    for number, row in numbered:
        if cell(row, "unit") or not out:
            out.append((number, {k: cell(row, k) for k in columns}))
            sums.append({})
        code, amount = re.sub("[^a-z ]", "", (cell(row, "code") or "").lower()).strip(), _dollars(cell(row, "amount"))
        if amount is not None and code and not code.startswith("total"):
            held = sums[-1]
            held["rent"] = held.get("rent", 0.0) + (amount * (-1 if re.match(r"\s*[-(]", cell(row, "amount") or "") else 1) if RENT_CODE.match(code) else 0.0)
            held["concession"] = held.get("concession", 0.0) + (amount if OFF_CODE.search(code) else 0.0)
    for (_, cells), held in zip(out, sums):
        cells |= {k: f"{held[k]:.2f}" if k in held else None for k in ("rent", "concession")}
    return out


def parse_file(name: str, raw: bytes) -> list[dict]:
    """Rows of one rent roll as text, with the reason where a row is no lease."""
    text = decode(raw)
    if text is None:
        return []
    numbered = grid(text)
    header = find_header([r for _, r in numbered])
    if header is None:
        return []
    at, columns = header
    out = []
    if "rent" not in columns and {"code", "amount", "unit"} <= columns.keys():
        rows = folded_charges(numbered[at + 1 :], columns)
        columns = columns | {"rent": -1}
    else:
        rows = [(n, {k: (row[i] or None) if i < len(row) else None for k, i in columns.items()}) for n, row in numbered[at + 1 :]]
    for number, cell in rows:
        cell["rent"] = whole_rent(cell, columns)
        tenant, status = cell.get("tenant") or "", cell.get("status") or ""
        reason = None
        if NOT_TENANT.match(tenant):
            reason = "no tenant"
        elif FUTURE.search(status) and "renew" not in status.lower():
            reason = "future resident"
        elif not cell.get("rent"):
            reason = "no rent"
        out.append({"file": name, "row_num": number, **{k: cell.get(k) for k in ALIASES}, "skip_reason": reason})
    return out


def name_in(folder: str, path: str) -> str:
    """A file's path below ``folder``, so that files of one name in several folders stay apart."""
    bare, base = (re.sub(r"^[a-z0-9]+:/*", "/", x) for x in (path, folder.rstrip("/") + "/"))
    return bare.removeprefix(base)


def read_rent_rolls(spark: SparkSession, path: str) -> DataFrame:
    """All rent rolls under ``path``: one row per grid row below the header.

    Header discovery needs a file's rows in order, so a file is one unit of
    work; the number of files is what scales.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"]) for r in parse_file(name_in(path, p), bytes(c))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROW.split(", ")])

    return files.mapInPandas(run, ROW)


def unit_states(rows: DataFrame) -> DataFrame:
    """Occupied, vacant and down units per file (A32, P12, A25): status first, then the tenant cell."""
    said = F.lower(F.concat_ws(" ", "status", "tenant"))
    state = F.when(said.rlike(r"\b(down|model|office|offline)\b"), "down").when(said.rlike(r"\bvacan"), "vacant").when(F.col("skip_reason").isNull(), "occupied")
    named = rows.withColumn("state", state).where("state IS NOT NULL AND (unit IS NOT NULL OR state = 'occupied')")
    return named.groupBy("file").agg(F.count_if(F.col("state") == "occupied").alias("occupied"), *[F.array_sort(F.collect_set(F.when(F.col("state") == s, F.col("unit")))).alias(f"{s}_units") for s in ("vacant", "down")])


def without_copies(rows: DataFrame) -> DataFrame:
    """Exact repeats of a row within a file count once, the first."""
    values = [c for c in rows.columns if c != "row_num"]
    return rows.groupBy(*values).agg(F.min("row_num").alias("row_num")).select(*rows.columns)


def collapse_charges(rows: DataFrame) -> DataFrame:
    """Charge lines folded under the unit line above them.

    ``rows``: file, row_num, unit, code, amount.  A line with a unit starts a
    group (running count over the file); rent codes add up, concession codes by size.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("row_num")
    grouped = rows.withColumn("grp", F.sum(F.when(F.col("unit").isNotNull(), 1).otherwise(0)).over(order))
    code = F.lower("code")
    return grouped.where("grp > 0").groupBy("file", "grp").agg(
        F.min_by("unit", "row_num").alias("unit"),
        F.round(F.sum(F.when(code.rlike("rent"), F.col("amount"))), 2).alias("rent"),
        F.round(F.sum(F.when(code.rlike("conc|credit|discount"), F.abs("amount"))), 2).alias("concession"),
    )
