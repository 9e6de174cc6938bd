"""Operators over document texts and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions import parse


def low_text(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages of fewer than 50 characters, or of which under 0.3 are letters or digits."""
    n = F.length(text)
    alnum = F.length(F.regexp_replace(F.col(text), "[^A-Za-z0-9]", ""))
    return pages.withColumn("alnum_chars", alnum).where((n < 50) | (alnum / F.greatest(n, F.lit(1)) < 0.3))


def looks_like_rent_roll(text: Column) -> Column:
    """40 currency amounts or 15 dates."""
    return (F.regexp_count(text, F.lit(r"\$\s?\d[\d,]*(?:\.\d{2})?")) >= 40) | (F.regexp_count(text, F.lit(r"\b(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12]\d|3[01])/(?:\d{4}|\d{2})\b")) >= 15)


def duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose content hash an earlier one has (J11, V9): the first and the copies.

    Grouping combines per hash on the map side, so thousands of copies are a handful of rows.
    """
    hashed = docs.select(key, F.sha2("text", 256).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min(key).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return hashed.join(first, "content_hash").where(F.col(key) != F.col("first_id")).select(key, "first_id", "content_hash")


def masked(docs: DataFrame) -> DataFrame:
    """Texts with social-security numbers masked."""
    return docs.withColumn("text", parse.mask_ssn("text"))


def detect_forms(docs: DataFrame, phrases: list[tuple[str, str, float]], least: float) -> DataFrame:
    """The form whose phrases weigh most in a text, from ``least`` up.

    ``phrases``: (form, phrase, weight).  The rule table is a literal array, so no join is needed.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    forms = sorted({f for f, _, _ in phrases})

    def score(form):
        out = F.lit(0.0)
        for f, phrase, weight in phrases:
            if f == form:
                out = out + F.when(text.contains(phrase.lower()), weight).otherwise(0.0)
        return out

    scored = F.array(*[F.struct(F.round(score(f), 4).alias("score"), F.lit(f).alias("form")) for f in forms])
    best = F.array_max(F.filter(scored, lambda x: x["score"] >= least))
    return docs.select("doc_id", best.alias("x")).where("x IS NOT NULL").select("doc_id", "x.form", "x.score")


def quote_window(text: Column, at: Column, length: Column, around: int = 50) -> Column:
    """``around`` characters on each side, white space collapsed."""
    begin = F.greatest(at - around, F.lit(1))
    return F.trim(F.regexp_replace(F.substr(text, begin, at - begin + length + around), r"\s+", " "))


def locate_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """First page of a quote's own document that holds it: whole, its first 60 characters, or its first six words.

    An equi-join on the document comes first, so a quote meets its own pages only.
    ``quotes``: doc_id, quote_id, quote; ``pages``: doc_id, page, text.
    """

    def flat(c):
        return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))

    q = quotes.withColumn("q", flat("quote")).withColumn("six", F.array_join(F.slice(F.split("q", " "), 1, 6), " "))
    rows = q.join(pages.withColumn("t", flat("text")), "doc_id")
    rank = F.when(F.col("t").contains(F.col("q")), 1).when(F.col("t").contains(F.substring("q", 1, 60)), 2).when(F.col("t").contains(F.col("six")), 3)
    return rows.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("doc_id", "quote_id").agg(F.min(F.struct("rank", "page")).alias("x")).select("doc_id", "quote_id", "x.page", "x.rank")


# How files of these kinds begin: bytes from the first, in hex.
SIGNATURES = {
    "pdf": "255044462D", "zip": "504B0304", "ole": "D0CF11E0A1B11AE1", "jpg": "FFD8FF", "png": "89504E470D0A1A0A", "gif": "474946383",
    "program": "4D5A", "program (elf)": "7F454C46", "rtf": "7B5C727466", "archive": "1F8B", "archive (7z)": "377ABCAF", "archive (rar)": "52617221", "bmp": "424D",
}
TIFF, RIFF, BOX = ("49492A00", "4D4D002A"), ("52494646", "57454250"), "66747970"
HEIF, AVIF = ("heic", "heix", "heim", "heis", "hevc", "mif1", "msf1"), ("avif", "avis")
#: What each kind of upload takes.
TAKEN = {"lease": ("pdf", "docx", "doc", "jpg", "png", "tiff", "heic", "webp", "bmp", "txt"), "rent_roll": ("pdf", "xlsx", "xls", "docx", "csv", "txt", "jpg", "png", "tiff", "heic", "webp", "bmp")}
#: Bytes of a file that say whether it is text, and the share of control characters that text may have.
HEAD, ODD = 4096, 0.01


def sniffed(c: Column) -> Column:
    """The type of a file by what it holds, not by its name (S16); NULL where nothing is known, ``empty`` for no bytes.

    Office files are told by the names of their parts, which a ZIP holds in plain bytes.
    """
    head = F.hex(F.substring(c, 1, 16))
    brand = F.decode(F.substring(c, 9, 4), "ISO-8859-1")
    boxed = F.substring(head, 9, 8) == BOX
    text = F.decode(F.substring(c, 1, HEAD), "ISO-8859-1")
    whole = F.decode(c, "ISO-8859-1")
    office = F.when(whole.contains("word/document"), "docx").when(whole.contains("xl/workbook"), "xlsx").when(whole.contains("ppt/"), "slides").otherwise("archive")
    legacy = F.when(whole.contains("W\0o\0r\0d\0D\0o\0c"), "doc").when(whole.contains("W\0o\0r\0k\0b\0o\0o\0k") | whole.contains("B\0o\0o\0k"), "xls").otherwise("office")
    low = F.lower(F.ltrim(text))
    markup = low.startswith("<?xml") | low.startswith("<!doctype html") | low.startswith("<html")
    odd = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0E-\x1F]", ""))
    lines = F.regexp_replace(text, r"[^\n]", "")
    delimited = F.length(F.regexp_replace(text, "[^,;\t|]", "")) >= F.greatest(F.length(lines), F.lit(1))
    by_head = F.coalesce(*[F.when(head.startswith(h), F.regexp_replace(F.lit(k), r" \(.*", "")) for k, h in SIGNATURES.items()])
    kind = F.when(by_head == "zip", office).when(by_head == "ole", legacy).otherwise(by_head)
    kind = F.coalesce(
        kind,
        F.when(F.substring(head, 1, 8).isin(*TIFF), "tiff"),
        F.when((F.substring(head, 1, 8) == RIFF[0]) & (F.substring(head, 17, 8) == RIFF[1]), "webp"),
        F.when(boxed & brand.isin(*HEIF), "heic").when(boxed & brand.isin(*AVIF), "avif"),
        F.when(markup, "markup"),
        F.when(odd <= F.length(text) * ODD, F.when(delimited, "csv").otherwise("txt")),
    )
    return F.when(F.octet_length(c) == 0, "empty").otherwise(kind)


def taken(kind: Column, upload: Column) -> Column:
    """Whether an upload of that kind takes files of this type."""
    return F.coalesce(*[F.when(upload == u, kind.isin(*types)) for u, types in TAKEN.items()], F.lit(False))
