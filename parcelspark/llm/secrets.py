"""Operator 8: secret scans in built-in expressions only (no Python on the data path).

Base kinds come from three patterns.  The method adds the kind ``entropy``:
over each candidate string, a window slides by one character.  Its character
counts are kept in a few longs, and a step changes two of them, that of the
character that enters and that of the one that leaves, and by them the
window's sum of ``c * log2(c)``.  The entropy
``log2(W) - sum / W`` is held against a threshold per character class.
Candidates on the allow-list, windows that touch an allowed sample, and spans
wholly inside a base span are suppressed.

Rows: a null text counts as empty and gives no spans; one row per input row,
repeated rows included; positions are code points, ends exclusive; columns
other than ``doc_id`` and ``text`` are not read.  Work grows in proportion to a
text's length and its number of matches: no step copies or recounts more than
a bounded block, whatever the length of a candidate.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of 16 or more is what remains of the runs once shorter ones are dropped; so for hex.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Candidate strings: whole runs of 20 or more, with a digit or both cases.
RUN = "A-Za-z0-9+/_=-"
CANDIDATE = rf"(?<![{RUN}])(?=[A-Za-z+/_=-]*+[0-9]|[a-z+/_=-]*+[A-Z][A-Z+/_=-]*+[a-z]|[A-Z+/_=-]*+[a-z]++[A-Z+/_=-])[{RUN}]{{{WINDOW},}}+"
#: Character class -> (pattern of the whole candidate, least entropy of a window in bits).
CLASSES = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("alnum", r"[0-9]", 3.7),
    ("letters", r".", 4.1),
)
#: Candidates that are no secrets as a whole: identifiers, dates, paths of words.
ALLOW = (
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^[0-9_/=+-]+$",
    r"^/?(?:[A-Za-z]++[/_=+-])++[A-Za-z]*+[0-9]{0,4}$",
)

#: Stretches of a candidate that are none: counting runs, samples, repeats.  The rest of it is scanned.
SAMPLE = r"(?i:0123456789|abcdefghij|qwertyuiop|example|sample|dummy|placeholder|changeme|lorem)|(.)\1{7,}"

SPAN = "struct<start:int,end:int,hit:string,value:string>"
#: Elements folded before their results join those of earlier blocks.
FOLD = 256
#: Code points of a piece when a text is cut at many places.
CUT = 1024


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once and not copied."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, use)


def fold(items: Column, state: Column, step, item: str) -> Column:
    """Walks ``items`` with ``state`` and collects what ``step(state, x)`` emits, in linear time.

    ``step`` returns the new state, whether to emit, and the emitted value of
    type ``item``.  Values are appended within a block of ``FOLD`` elements, and
    blocks to a list of blocks, so no long array is copied for each element.
    """
    none = F.array().cast(f"array<{item}>")

    def walk(all_items):
        last = F.size(all_items) - 1

        def inner(acc, i):
            new, emit, value = step(acc["state"], F.get(all_items, i))
            return F.struct(new.alias("state"), F.when(emit, F.concat(acc["out"], F.array(value))).otherwise(acc["out"]).alias("out"))

        def outer(acc, at):
            # Elements are taken by index: ``slice`` walks an array from its start.
            return F.aggregate(
                F.sequence(at, F.least(at + (FOLD - 1), last)),
                F.struct(acc["state"].alias("state"), none.alias("out")),
                inner,
                lambda b: F.struct(b["state"].alias("state"), F.concat(acc["out"], F.array(b["out"])).alias("out")),
            )

        starts = F.sequence(F.lit(0), last, F.lit(FOLD))
        return F.aggregate(starts, F.struct(state.alias("state"), F.array().cast(f"array<array<{item}>>").alias("out")), outer, lambda acc: F.flatten(acc["out"]))

    return let(items, lambda v: F.when(F.size(v) > 0, walk(v)).otherwise(none))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches with code-point positions, in one pass.

    The text between matches comes from ``split`` with the same pattern, so a
    running length gives every start.
    """
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def step(pos, x):
        start = pos + F.char_length(x["gap"])
        end = start + F.char_length(F.coalesce(x["hit"], F.lit("")))
        return end, x["hit"].isNotNull(), F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["value"].alias("value"))

    return F.when(text.rlike(pattern), fold(zipped, F.lit(0), step, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))


def least_entropy(candidate: Column) -> Column:
    """The threshold of the candidate's class."""
    return F.coalesce(*[F.when(candidate.rlike(p), F.lit(least)) for _, p, least in CLASSES])


def pieces(candidate: Column, pattern: str) -> Column:
    """``array<struct<at,piece>>``: what lies between the matches of ``pattern``, if it is a window or longer."""
    zipped = F.arrays_zip(F.split(candidate, pattern, -1).alias("gap"), F.regexp_extract_all(candidate, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(pos, x):
        end = pos + F.char_length(x["gap"]) + F.char_length(F.coalesce(x["hit"], F.lit("")))
        return end, F.char_length(x["gap"]) >= WINDOW, F.struct(pos.alias("at"), x["gap"].alias("piece"))

    return fold(zipped, F.lit(0), step, "struct<at:int,piece:string>")


def stretch(candidate: Column, sample: str = SAMPLE) -> Column:
    """``first, last`` of the candidate's high-entropy windows that touch no match of ``sample``; ``first`` is -1 if there are none."""

    def parts(least):
        def step(acc, x):
            return let(
                window_span(x["piece"], least),
                lambda w: F.struct(
                    F.when((w["first"] >= 0) & (acc["first"] < 0), x["at"] + w["first"]).otherwise(acc["first"]).alias("first"),
                    F.when(w["first"] >= 0, x["at"] + w["last"]).otherwise(acc["last"]).alias("last"),
                ),
            )

        return F.aggregate(pieces(candidate, sample), F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last")), step)

    return let(least_entropy(candidate), lambda least: F.when(candidate.rlike(sample), parts(least)).otherwise(window_span(candidate, least)))


#: Letters of candidates are 43 (+) to 122 (z).  A window's counts are held in
#: longs: 5 bits for a letter, 12 letters to a long.
LETTER, BITS, PER = 43, 5, 12
LONGS = (122 - LETTER) // PER + 1
#: ``c * log2(c)`` in fixed point, so sums are exact however long a candidate is.
FIXED = 1 << 32
CLOG = [round(k * math.log2(k) * FIXED) if k else 0 for k in range(WINDOW + 2)]


def window_span(candidate: Column, threshold: Column) -> Column:
    """``first, last`` position of the windows of ``candidate`` that reach the threshold; ``first`` is -1 if none does.

    A step changes two counts: that of the letter which enters the window and
    that of the letter which leaves it.
    """
    clog = F.array(*[F.lit(x).cast("long") for x in CLOG])
    units = F.array(*[F.lit(1 << BITS * i).cast("long") for i in range(PER)])
    # A window passes with a sum of this or less; 32 steps of the fixed point cover its rounding.
    most = F.floor((F.lit(math.log2(WINDOW)) - threshold) * F.lit(float(WINDOW * FIXED)) + 32)
    letters = F.transform(
        F.split(candidate, ""),
        lambda c: let(F.ascii(c) - LETTER, lambda k: F.struct(F.floor(k / PER).cast("int").alias("place"), F.get(units, k % PER).alias("unit"))),
    )

    def slide(letters, most):
        def step(acc, i):
            return let(F.struct(F.get(letters, i).alias("e"), F.get(letters, i - WINDOW).alias("l")), lambda x: moved(acc, i, x["e"], x["l"]))

        def held(acc, letter):
            return F.call_function("div", F.get(acc["counts"], letter["place"]), letter["unit"]) % (1 << BITS)

        def moved(acc, i, enters, leaves):
            k = held(acc, enters).cast("int")
            m = (held(acc, leaves) + F.when((leaves["place"] == enters["place"]) & (leaves["unit"] == enters["unit"]), 1).otherwise(0)).cast("int")
            more = F.get(clog, k + 1) - F.get(clog, k)
            less = F.coalesce(F.get(clog, m - 1) - F.get(clog, m), F.lit(0).cast("long"))
            counts = F.transform(
                acc["counts"],
                lambda c, j: c + F.when(j == enters["place"], enters["unit"]).otherwise(0) - F.when(j == leaves["place"], leaves["unit"]).otherwise(0),
            )
            return let(F.struct((acc["sum"] + more + less).alias("sum"), counts.alias("counts")), lambda new: judged(acc, i, new))

        def judged(acc, i, new):
            passes = (i >= WINDOW - 1) & (new["sum"] <= most)
            return F.struct(
                new["sum"].alias("sum"),
                new["counts"].alias("counts"),
                F.when(passes & (acc["first"] < 0), i - (WINDOW - 1)).otherwise(acc["first"]).alias("first"),
                F.when(passes, i + 1).otherwise(acc["last"]).alias("last"),
            )

        zero = F.lit(0).cast("long")
        start = F.struct(zero.alias("sum"), F.array(*[zero] * LONGS).alias("counts"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return let(F.struct(letters.alias("letters"), most.alias("most")), lambda v: slide(v["letters"], v["most"]))


def entropy_spans(text: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """``array<struct<start,end>>`` of high-entropy stretches of candidate strings."""
    candidates = matches(text, CANDIDATE)
    if allow:
        candidates = F.filter(candidates, lambda x: ~_any_rlike(x["hit"], allow))
    scored = F.transform(candidates, lambda x: F.struct(x["start"].alias("at"), stretch(x["hit"]).alias("w")))
    kept = F.filter(scored, lambda x: x["w"]["first"] >= 0)
    return F.transform(kept, lambda x: F.struct((x["at"] + x["w"]["first"]).alias("start"), (x["at"] + x["w"]["last"]).alias("end")))


def _any_rlike(column: Column, patterns: tuple[str, ...]) -> Column:
    out = column.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | column.rlike(p)
    return out


def _kind(spans: Column, order: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("kind"), x["end"].alias("end")))


def with_spans(docs: DataFrame, base: str = "base", every: str = "all", text_col: str = "text") -> DataFrame:
    """Adds ``base`` and ``every``: sorted ``array<struct<start,kind,end>>``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(matches(text, ASSIGN, 2), lambda x: F.char_length(x["value"]) >= 8)
    out = docs.withColumn(base, F.array_sort(F.concat(_kind(assign, 0), _kind(matches(text, ACCESS), 1), _kind(matches(text, HEX), 2))))

    def step(reach, x):
        """Of spans in order, base ones before entropy ones of the same start: those beyond all base spans so far."""
        own = x["kind"] < 3
        return F.when(own, F.greatest(reach, x["end"])).otherwise(reach), own | (x["end"] > reach), x

    both = F.array_sort(F.concat(F.col(base), _kind(entropy_spans(text), 3)))
    return out.withColumn(every, fold(both, F.lit(0), step, "struct<start:int,kind:int,end:int>"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    found = with_spans(docs.select("doc_id", "text")).select("doc_id", "base", "all")

    def n(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
    )


MASK = "[SECRET]"


def masked(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The same columns; secrets of ``text`` replaced by ``mask``, ``n_chars`` set anew where there is one.

    Overlapping spans are masked once.  A text without secrets, null included,
    stays as it is.
    """
    base, every = (f"__{uuid.uuid4().hex}" for _ in "ab")
    found = with_spans(docs, base, every)
    text, spans = F.col("text"), F.col(every)

    def step(pos, x):
        """Gaps before each span that overlaps none before it."""
        return F.greatest(pos, x["end"]), x["start"] >= pos, F.struct(pos.alias("start"), x["start"].alias("end"))

    def rebuilt(pieces):
        gaps = F.transform(fold(spans, F.lit(0), step, "struct<start:int,end:int>"), lambda g: cut_out(pieces, g["start"], g["end"]))
        rest = cut_out(pieces, F.array_max(F.transform(spans, lambda x: x["end"])), F.char_length(text))
        return F.concat(F.array_join(gaps, mask), F.lit(mask), rest)

    hit = F.size(spans) > 0
    out = found.withColumn("text", F.when(hit, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), rebuilt)).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def cut_out(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text given in pieces of ``CUT``; costs no more than the pieces it touches."""
    first = F.floor(start / CUT).cast("int")
    touched = F.sequence(first, F.floor((end - 1) / CUT).cast("int"))

    def part(i):
        skip = F.greatest(start - i * CUT, F.lit(0))
        return F.substring(F.get(pieces, i), skip + 1, F.least(end - i * CUT, F.lit(CUT)) - skip)

    return F.when(end > start, F.array_join(F.transform(touched, part), "")).otherwise("")
