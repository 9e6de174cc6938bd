"""Fields out of printed forms.

Rules are a table: a label, a box beside or below it, and the type of what stands
there.  Labels are found among a page's words, misread ones too; the words whose
middles lie in a label's box are joined to it by place, and read as that type.

``rules``: form, field, nth (which label of a field is tried first), phrase, from_end
(the box is measured from the label's right edge, not its left), x0, y0, x1, y1, kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.functions import parse
from parcelspark.functions.parse import let
from parcelspark.operators import layout, phrases

#: Points within which words stand on a label's own line.
SAME_LINE = 4.0
# Words that labels and instructions are made of; a text of these alone is no value.
LABEL_WORDS = tuple(
    "name names address street city state zip code county date dates unit number no bedrooms bedroom of the and or for to in if any enter print type signature apartment apt first last middle initial"
    " tenant owner family head household member members income rent amount total monthly annual contract lease term effective move phone email title agency property project form page see box check one yes other".split()
)


def _digits(c: Column) -> Column:
    """An ``O`` between digits or beside them is a zero."""
    return F.when(c.rlike("[0-9]"), F.replace(c, F.lit("O"), F.lit("0"))).otherwise(c)


def _date_in(c: Column) -> Column:
    """The first date in a text, in numbers (month first) or with a month's name."""
    numbers = r"(?<![0-9])[0-9]{1,4}\s?[/.-]\s?[0-9]{1,2}\s?[/.-]\s?[0-9]{2,4}(?![0-9])"
    said = F.regexp_replace(F.regexp_replace(F.regexp_extract(_digits(c), numbers, 0), r"\s", ""), "[.-]", "/")
    named = F.regexp_extract(c, r"[A-Za-z]{3,9}\.? [0-9]{1,2}(?:st|nd|rd|th)?,? [0-9]{4}", 0)
    return F.coalesce(parse.date(said), parse.date(named))


def value(raw: Column, kind: Column, labels: Column) -> Column:
    """What a box says, as a value of ``kind`` written for people; NULL where it says nothing of the kind.

    ``labels``: the form's own phrases, bare; a text that is one of them, or is made
    of label words only, is what was printed there, not a value.
    """

    def read(text):
        dollars = F.regexp_replace(_digits(text), r"(?<![0-9,.])[5S]\s+(?=[0-9])", r"\$")
        amount = F.replace(F.regexp_extract(dollars, r"[0-9][0-9,]*(?:\.[0-9]{1,2})?", 0), F.lit(",")).try_cast("decimal(18,2)")
        whole = F.nullif(F.regexp_extract(F.replace(text, F.lit(",")), r"(?<![0-9.])[0-9]{1,7}(?![.0-9])", 0), F.lit(""))
        share = F.regexp_extract(text, r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,4})?", 0).try_cast("double")
        words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "), " +"), lambda w: w != "")
        printed = F.forall(words, lambda w: w.isin(*LABEL_WORDS)) | F.array_contains(labels, F.array_join(words, ""))
        bare_date = F.regexp_replace(text, r"[\s,.]", "").rlike(r"^(?:[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{2,4}|[A-Za-z]{3,9}[0-9]{5,6})$") & _date_in(text).isNotNull()
        return (
            F.when(kind == "money", F.concat(F.lit("$"), F.format_number(amount, 2)))
            .when(kind == "int", whole.cast("int").cast("string"))
            .when(kind == "percent", F.concat(F.regexp_replace(share.cast("string"), r"\.0$", ""), F.lit("%")))
            .when(kind == "date", F.date_format(_date_in(text), "MM/dd/yyyy"))
            .when(kind == "checkbox", F.when(text.rlike("(?:^|[^A-Za-z0-9])(?:[xX]|✓|✔)(?:$|[^A-Za-z0-9])"), "X"))
            .when(~printed & ~bare_date & text.rlike("[A-Za-z0-9]"), text)
        )

    clean = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(raw, r"[_|]", " "), r"\s+", " ")), r"^[ :;,\-–—.|#()\[\]]+|[ :;,\-–—.|#()\[\]]+$", "")
    return let(clean, lambda t: F.when(t != "", read(t)))


def form_fields(words: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, form, field, value, raw, likeness`` of each field that a page states.

    Of several labels of a field the first by ``nth`` whose box holds a value counts;
    of several places of a label the uppermost.
    """
    rows = layout.with_rows(words).withColumn("w", F.struct("x", "word_id", "y", "width", "height", "text"))
    lines = rows.groupBy("page_id", "row").agg(F.array_sort(F.collect_list("w")).alias("words"))
    # A page is one row from here on, and pages meet labels by a merge: what a page holds is more than the planner expects, and no broadcast bears it.
    pages = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("row", "words"))).alias("lines"))
    said = F.transform("lines", lambda r: F.array_join(F.transform(r["words"], lambda w: F.regexp_replace(w["text"], r"\s", "")), " "))
    texts = pages.select(F.col("page_id").alias("doc_id"), F.array_join(said, "\n").alias("text"))

    asked = rules.withColumn("phrase_id", F.col("phrase"))
    hits = phrases.fuzzy_phrases(texts, asked.select("phrase_id", "phrase").distinct()).withColumnsRenamed({"doc_id": "page_id", "words": "n_words"})
    placed = hits.join(pages.hint("merge"), "page_id").withColumn("words", F.get("lines", F.col("line"))["words"])
    start, end = F.get("words", F.col("first")), F.get("words", F.col("first") + F.col("n_words") - 1)
    label = placed.select(
        "page_id", "phrase_id", "likeness", "lines", start["x"].alias("left"), (end["x"] + end["width"]).alias("right"), start["y"].alias("top"), (start["y"] + start["height"] / 2).alias("middle"),
        F.transform(F.slice("words", F.col("first") + 1, F.col("n_words")), lambda w: w["word_id"]).alias("own"),
    )
    uppermost = F.row_number().over(Window.partitionBy("page_id", "phrase_id").orderBy("top", "left"))
    label = label.withColumn("place", uppermost).where("place = 1").drop("place")
    edge = F.when(F.col("from_end"), F.col("right")).otherwise(F.col("left"))
    boxes = label.join(F.broadcast(asked.drop("phrase")), "phrase_id").withColumns({"bx0": edge + F.col("x0"), "bx1": edge + F.col("x1"), "by0": F.col("top") + F.col("y0"), "by1": F.col("top") + F.col("y1")})

    def stands(w):
        x, y = w["x"] + w["width"] / 2, w["y"] + w["height"] / 2
        below = (F.col("y0") < SAME_LINE) | (F.abs(y - F.col("middle")) > SAME_LINE)
        return x.between(F.col("bx0"), F.col("bx1")) & y.between(F.col("by0"), F.col("by1")) & below & ~F.array_contains("own", w["word_id"])

    # Rows and their words are in order.
    inside = F.filter(F.flatten(F.transform("lines", lambda r: r["words"])), stands)
    found = boxes.withColumn("inside", inside).where(F.size("inside") > 0).withColumn("raw", F.array_join(F.transform("inside", lambda w: w["text"]), " "))
    printed = asked.groupBy("form").agg(F.collect_set(phrases.bare(F.col("phrase"))).alias("labels"))
    found = found.join(F.broadcast(printed), "form").withColumn("value", value(F.col("raw"), F.col("kind"), F.col("labels"))).where("value IS NOT NULL")
    best = found.groupBy("page_id", "form", "field").agg(F.min_by(F.struct("value", "raw", "likeness"), F.struct("nth", "raw")).alias("x"))
    return best.select("page_id", "form", "field", "x.*")
