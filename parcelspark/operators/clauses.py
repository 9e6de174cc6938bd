"""Concession clauses read by built-in expressions.

A sentence is cut into words, numbers, amounts and marks, and each becomes one
letter that says what it is: ``n`` a number, ``m`` a month, ``r`` rent, ``f`` free.
Phrases are then patterns over those letters, and a letter's place is its word's
place, so what a phrase says (its number, its amount) is looked up there.  Phrases
are taken in order; one that overlaps an earlier one is left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelspark.functions.parse import let

#: Words that end with a full stop without ending a sentence.
ABBREVIATIONS = ("no", "sec", "inc", "co", "st", "ste", "apt", "approx", "mo")
ITEM = "array<struct<kind:string,months:double,amount:double,position:string,percent:double,reduced_to:double>>"

_COUNT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one twenty-two twenty-three twenty-four"
NUMBERS = {w: float(i) for i, w in enumerate(_COUNT.split(), 1)} | {"half": 0.5, "one-half": 0.5}
TOKEN = r"\$\s?[0-9][0-9,]*(?:\.[0-9]{1,2})?|[0-9]+(?:\.[0-9]+)?\s?%|[0-9]+/[0-9]+|[0-9]+(?:\.[0-9]+)?(?:st|nd|rd|th)?|[A-Za-z]+(?:['’][A-Za-z]*)?(?:-[A-Za-z]+)*|[(),;/]"
#: What a word is.  Words that are not here are ``x``.
LETTERS = {
    "n": " ".join(NUMBERS), "m": "month months month's months' mo", "r": "rent rents rental", "f": "free abated abate waived forgiven rent-free", "b": "base", "l": "monthly", "u": "full calendar",
    "i": "first initial 1st", "e": "last final", "a": "abatement waiver", "k": "discount discounts concession concessions reduction reductions credit credits rebate special", "C": "card",
    "w": "reduced discounted lowered decreased", "O": "off", "y": "by", "t": "to toward towards against", "v": "of", "g": "for during", "P": "per each every", "A": "a an", "T": "the",
    "B": "is are shall will be was been", "S": "move-in look-and-lease leasing renewal retention signing one-time upfront single", "N": "not never nor without", "o": "no", "z": "charge",
    "Q": "casualty condemned condemnation eminent untenantable destroyed destruction fire damage damaged damages interruption", "E": "increase increases increased increasing escalation escalations escalate escalates escalated",
    "D": "deposit deposits prepaid pre-paid prepayment", "X": "parking garage carport storage utility utilities water electric electricity cable internet pet amenity processing convenience fee fees late interest",
    "L": "applied credited", "Z": "default defaults defaulted breach breached delinquent", "&": "and", "W": "term", "<": "(", ">": ")", "p": ", ;", "/": "/",
}
_NUM, _MONTHS, _RENT, _EACH = "nA?(?:<n>)?", "u*m", "[bl]*r", "(?:[PA]m|l|/m)"
#: Phrases by kind, in the order in which they are taken.
PHRASES = {
    "free_rent": (
        f"{_NUM}{_MONTHS}v?f?{_RENT}[^p]{{0,25}}?(?:f|xoz)",  # one month of base rent ... is abated
        f"{_NUM}{_MONTHS}B{{0,2}}v?f",  # two months free
        f"(?:fr?|r?a(?:v{_RENT})?)x?[gv]T?[ie]?{_NUM}{_MONTHS}",  # free rent for the first two months
        f"{_RENT}B{{1,3}}x?fgT?[ie]?{_NUM}{_MONTHS}",  # rent shall be abated for three months
        f"[ie]{_MONTHS}{_RENT}B{{0,2}}x?f",  # the first month's rent is free
    ),
    "recurring_discount": (
        f"wyd{_EACH}",  # reduced by $100 per month
        f"d{_EACH}[xSlr]{{0,2}}?(?:k(?!C)|O)",  # $75/mo off
        "dOT?l?b?rPm",  # $50 off rent each month
        f"k(?!C)vd{_EACH}",  # a discount of $50 per month
        "lr?k(?!C)vd",  # monthly concession of $100
        "q[xSlr]{0,2}?(?:O|k(?!C))",  # 5% off
        "wyq",  # reduced by 5%
    ),
    "one_time_credit": (
        f"i{_MONTHS}{_RENT}B{{0,2}}wtd",  # the first month's rent is reduced to $500
        f"dOT?i{_MONTHS}(?:b?r)?",  # $300 off the first month's rent
        "S*r?k(?!C)(?:xTxv|v)?d",  # a move-in credit of $500
        "dS*r?S*k(?!C)",  # a $500 move-in credit
    ),
}


def sentences(c: Column) -> Column:
    """``array<struct<start,text>>``: where each sentence begins (from 0) and what it says, with its end.

    One ends at a full stop or semicolon before white space, but for a stop after an
    abbreviation, or at a blank line.  White space alone is no sentence.
    """
    stop = r"(?i)(?<!\b(?:" + "|".join(ABBREVIATIONS) + r"))\.(?=\s|$)|;(?=\s|$)|\n\s*\n"
    pieces = F.split(F.regexp_replace(c, stop, "$0\u0001"), "\u0001")

    def placed(parts):
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.length(p)))
        every = let(ends, lambda e: F.transform(parts, lambda p, i: F.struct(F.get(e, i).alias("start"), p.alias("text"))))
        return F.filter(every, lambda x: x["text"].rlike(r"\S"))

    return let(pieces, placed)


def _letters(tokens: Column) -> Column:
    table = F.create_map(*[F.lit(x) for letter, words in LETTERS.items() for w in words.split() for x in (w, letter)])

    def letter(t):
        low = F.replace(F.lower(t), F.lit("’"), F.lit("'"))
        other = F.when(low.startswith("$"), "d").when(low.endswith("%"), "q").when(low.between("0", ":"), "n").otherwise("x")
        return F.coalesce(F.try_element_at(table, low), other)

    return F.array_join(F.transform(tokens, letter), "")


def _number(token: Column) -> Column:
    table = F.create_map(*[F.lit(x) for w, n in NUMBERS.items() for x in (w, n)])
    return F.coalesce(F.try_element_at(table, F.lower(token)), F.regexp_replace(token, "[^0-9.]", "").try_cast("double"))


def _matches(said: Column, kind: str, phrase: str, nth: int) -> Column:
    """``array<struct<kind,nth,at,size>>`` of a phrase in a string of letters: the gaps between matches say where they are."""

    def placed(x):
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,nth:int,at:int,size:int>>").alias("out"))

        def step(acc, i):
            at, size = acc["at"] + F.length(F.get(x["gaps"], i)), F.length(F.get(x["hits"], i))
            one = F.struct(F.lit(kind).alias("kind"), F.lit(nth).alias("nth"), at.alias("at"), size.alias("size"))
            return F.struct((at + size).alias("at"), F.array_append(acc["out"], one).alias("out"))

        return F.when(F.size(x["hits"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(x["hits"]) - 1), start, step, lambda acc: acc["out"])).otherwise(start["out"])

    return let(F.struct(F.split(said, phrase).alias("gaps"), F.regexp_extract_all(said, F.lit(phrase), F.lit(0)).alias("hits")), placed)


def _stands(said: Column, m: Column) -> Column:
    """Whether a match grants something about rent: not negated, and no charge other than rent."""
    before, inside, after = F.substr(said, F.lit(1), m["at"]), F.substr(said, m["at"] + 1, m["size"]), F.substr(said, m["at"] + m["size"] + 1)
    negated = before.rlike("N(?![xABT]{0,6}Z)[^p]{0,12}$") | before.rlike("o(?:(?:k|fr)[^p]{0,10})?$")
    clause = F.regexp_extract(before, "[^&]{0,12}$", 0)
    to_deposit = F.regexp_extract(after, "^[^&]*", 0).rlike("Lt.*D")
    other = to_deposit | (~inside.rlike("[Sr]") & (F.regexp_extract(after, "^[^p]*", 0).rlike("[XD]") | clause.rlike("[XD][^r]*$")))
    monthly = (m["kind"] == "one_time_credit") & after.rlike(f"^{_EACH}")
    return ~negated & ((m["kind"] == "free_rent") | (~other & ~monthly))


def _months_after(x: Column, m: Column) -> Column:
    """For how many months a discount runs: as stated after it, else anywhere in the sentence; NULL for the whole term."""
    stated, single = f"gT?[ie]?{_NUM}{_MONTHS}|[ie]{_NUM}{_MONTHS}", f"[ie]{_MONTHS}"

    def within(offset):
        part = F.substr(x["said"], offset + 1)
        hit = F.regexp_extract(part, stated, 0)
        place = offset + F.length(F.get(F.split(part, stated, 2), F.lit(0))) + F.locate("n", hit) - 1
        return F.when(hit != "", _number(F.get(x["tokens"], place))).when(part.rlike(single), 1.0)

    after = m["at"] + m["size"]
    return F.when(F.substr(x["said"], after + 1).rlike(f"{stated}|{single}|W"), within(after)).otherwise(within(F.lit(0)))


def _item(x: Column, m: Column) -> Column:
    inside, before = F.substr(x["said"], m["at"] + 1, m["size"]), F.substr(x["said"], F.lit(1), m["at"])

    def first(letter):
        return F.when(inside.contains(letter), F.get(x["tokens"], m["at"] + F.locate(letter, inside) - 1))

    dollars, share = _number(first("d")), _number(first("q"))
    reduced = (m["kind"] == "one_time_credit") & (m["nth"] == 0)
    months = F.when(m["kind"] == "free_rent", F.coalesce(_number(first("n")), F.lit(1.0))).when(m["kind"] == "recurring_discount", _months_after(x, m))
    return F.struct(
        m["kind"].alias("kind"),
        months.alias("months"),
        F.when(~reduced, dollars).alias("amount"),
        F.when(inside.contains("e") | before.rlike("e[^pi]{0,3}$"), "last").otherwise("first").alias("position"),
        F.when(m["kind"] == "recurring_discount", share).alias("percent"),
        F.when(reduced, dollars).alias("reduced_to"),
    )


def _of_sentence(text: Column) -> Column:
    def read(x):
        said = x["said"]
        every = F.concat(*[_matches(said, kind, p, i) for kind, each in PHRASES.items() for i, p in enumerate(each)])
        rises = said.contains("E")
        standing = F.filter(every, lambda m: _stands(said, m) & ~(rises & (m["kind"] == "recurring_discount")))
        none = F.array().cast("array<struct<kind:string,nth:int,at:int,size:int>>")
        taken = F.aggregate(standing, none, lambda acc, m: F.when(F.exists(acc, lambda t: (t["at"] < m["at"] + m["size"]) & (m["at"] < t["at"] + t["size"])), acc).otherwise(F.array_append(acc, m)))
        items = F.transform(F.array_sort(taken, lambda a, b: a["at"] - b["at"]), lambda m: _item(x, m))
        sound = F.filter(items, lambda i: F.when(i["kind"] == "free_rent", i["months"].between(0.01, 24)).otherwise(F.coalesce(i["amount"], i["percent"], i["reduced_to"]) > 0))
        own_money = said.rlike("D[^p]{0,30}Lt") & ~said.rlike("[kfa]")
        return F.when(said.rlike("[fkawO]") & ~said.contains("Q") & ~own_money, sound).otherwise(F.array().cast(ITEM))

    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return let(let(tokens, lambda t: F.struct(t.alias("tokens"), _letters(t).alias("said"))), read)


def items(c: Column) -> Column:
    """The concessions of a text in order, each stated once; a null text has none."""
    said = F.regexp_replace(c, r"(?<!\n)\n(?!\n)", " ")
    found = F.flatten(F.transform(sentences(said), lambda s: _of_sentence(s["text"])))
    return F.when(c.isNotNull(), F.array_distinct(found)).otherwise(F.array().cast(ITEM))
