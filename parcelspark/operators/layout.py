"""Tables out of positioned words: rows by vertical steps, columns by the gutters between them.

``words``: page_id, word_id, x, y, width, height, text.  All windows are per page,
whose words are few; pages are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A row that names a tenant and a rent is the header; it is looked for in so many rows.
TENANT, RENT, HEADER_ROWS = "tenant|resident|lessee|name", "rent|amount|charge", 15
#: From so many rows of data on, one row may run across a gutter.
MANY_ROWS = 8
#: A gutter of fewer letters than this may be the space inside a cell.
NARROW = 1.5


def with_rows(words: DataFrame, gap: float = 0.7) -> DataFrame:
    """Words with ``row`` and their page's ``median`` height: a step down of more than ``gap`` of it begins a row."""
    down = Window.partitionBy("page_id").orderBy("y", "x", "word_id")
    rows = words.withColumn("median", F.percentile("height", 0.5).over(Window.partitionBy("page_id"))).withColumn("starts", F.coalesce((F.col("y") - F.lag("y").over(down) > F.col("median") * gap).cast("int"), F.lit(0)))
    return rows.withColumn("row", F.sum("starts").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def _letter(median: Column) -> Column:
    """The width of a letter on a page."""
    return F.greatest(F.lit(4.0), median * 0.5)


def _headers(rows: DataFrame) -> DataFrame:
    """For each page its header row, where that row's columns begin, the extents of its words, and how many rows follow.

    The first row that reads like a header, else that with the most parts.
    """
    across = Window.partitionBy("page_id", "row").orderBy("x", "word_id")
    after_gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(across) > 3 * _letter(F.col("median"))
    marked = rows.withColumn("part", F.coalesce(after_gap, F.lit(True)))
    lines = marked.groupBy("page_id", "row").agg(
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word_id", "text"))), lambda w: w["text"]), " ")).alias("line"),
        F.array_sort(F.collect_list(F.when(F.col("part"), F.col("x")))).alias("edges"),
        F.collect_list(F.struct("x", (F.col("x") + F.col("width")).alias("right"))).alias("extents"),
    )
    near = F.col("row") < HEADER_ROWS
    named = near & F.col("line").rlike(TENANT) & F.col("line").rlike(RENT)
    pages = lines.groupBy("page_id").agg(
        F.min_by(F.struct("row", "edges", "extents"), F.when(named, F.col("row"))).alias("named"),
        F.min_by(F.struct("row", "edges", "extents"), F.when(near, F.struct(-F.size("edges"), "row"))).alias("widest"),
        F.max("row").alias("last_row"),
    )
    return pages.select("page_id", F.coalesce("named", "widest").alias("header"), "last_row").select("page_id", F.col("header.row").alias("header_row"), F.col("header.edges").alias("edges"), F.col("header.extents").alias("extents"), (F.col("last_row") - F.col("header.row")).alias("data_rows"))


def column_starts(words: DataFrame, allowed: Column, gutter: Column, middle: bool = False) -> DataFrame:
    """``page_id, starts, blanks``: where columns begin and how wide a gutter each has before it, from a profile of the words' extents.

    A row's words become stretches; the ends of all stretches of a page, in order,
    say how many rows have ink in between.  Where that is more than ``allowed``,
    after ``gutter`` or more where it is not, a column begins (with ``middle``: in
    the middle of that gutter).  ``allowed`` and ``gutter`` are columns of ``words``.
    """
    across = Window.partitionBy("page_id", "row").orderBy("x", "word_id").rowsBetween(Window.unboundedPreceding, -1)
    right = F.col("x") + F.col("width")
    rows = words.withColumns({"allowed": allowed, "gutter": gutter}).withColumn("apart", (F.col("x") > F.max(right).over(across)).cast("int"))
    rows = rows.withColumn("stretch", F.sum(F.coalesce("apart", F.lit(1))).over(Window.partitionBy("page_id", "row").orderBy("x", "word_id").rowsBetween(Window.unboundedPreceding, 0)))
    stretches = rows.groupBy("page_id", "row", "stretch", "allowed", "gutter").agg(F.min("x").alias("x0"), F.max(right).alias("x1"))
    ends = stretches.select("page_id", "allowed", "gutter", F.explode(F.array(F.struct(F.col("x0").alias("at"), F.lit(1).alias("step")), F.struct(F.col("x1").alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = ends.groupBy("page_id", "allowed", "gutter", F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
    along = Window.partitionBy("page_id").orderBy("at")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    profile = steps.withColumns({"ink": F.sum("step").over(so_far) > F.col("allowed"), "next": F.lead("at").over(along), "first": F.min("at").over(so_far)})
    before = F.coalesce(F.last(F.when(F.col("ink"), F.col("next")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.col("first"))
    profile = profile.withColumn("blank", F.col("at") - before)
    begins = F.col("ink") & (F.col("blank") >= F.col("gutter")) & (F.col("at") > F.col("first"))
    place = F.col("at") - F.floor(F.col("blank") / 2) if middle else F.col("at")
    found = profile.groupBy("page_id").agg(F.min("at").alias("x_min"), F.array_sort(F.collect_set(F.when(begins, F.struct(place.cast("double").alias("at"), F.col("blank").cast("double").alias("blank"))))).alias("later"))
    first = F.struct(F.col("x_min").cast("double").alias("at"), F.lit(0.0).alias("blank"))
    return found.select("page_id", F.concat(F.array(first), "later").alias("s")).select("page_id", F.col("s.at").alias("starts"), F.col("s.blank").alias("blanks"))


def word_columns(words: DataFrame) -> DataFrame:
    """Words with their ``row`` and ``col``.

    Columns are the gutters of the rows of data, if there are two such rows and
    about as many columns as the header has parts; else the header's parts; on a
    page of one part, the widest gaps that no word covers.  A narrow gutter under
    a single word of the header is a space that all the names of a column share.
    """
    rows = with_rows(words)
    headers = _headers(rows)
    rows = rows.join(headers, "page_id")
    data = rows.where(F.col("row") > F.col("header_row"))
    profile = column_starts(data, F.when(F.col("data_rows") >= MANY_ROWS, 1).otherwise(0), F.greatest(F.lit(6.0), F.floor(F.col("median") * 0.3)))
    rows = rows.join(profile, "page_id", "left")
    space = F.zip_with("starts", "blanks", lambda at, blank: (blank > 0) & (blank < NARROW * _letter(F.col("median"))) & F.exists("extents", lambda w: (w["x"] <= at - blank) & (w["right"] >= at)))
    rows = rows.withColumn("space", space).withColumn("starts", F.filter("starts", lambda at, i: ~F.get("space", i))).drop("space", "blanks", "extents")
    parts = F.transform("edges", lambda x: x.cast("double"))
    read = (F.col("data_rows") >= 2) & (F.size("starts") >= F.greatest(F.lit(2), F.size("edges") - 1))
    first = F.least(F.element_at("starts", 1), F.element_at(parts, 1))
    anchors = F.when(F.coalesce(read, F.lit(False)), F.concat(F.array(first), F.slice("starts", 2, F.size("starts")))).otherwise(parts)
    rows = rows.withColumn("anchors", anchors).drop("starts")
    single = rows.where(F.size("anchors") < 2)
    gaps = column_starts(single.select(*words.columns, "row", "median"), F.lit(0), F.greatest(F.lit(8.0), F.floor(F.col("median") * 1.2)), middle=True).drop("blanks")
    rows = rows.join(gaps, "page_id", "left")
    slack = F.when(F.col("starts").isNull(), 2 * _letter(F.col("median"))).otherwise(0.0)
    reached = F.filter(F.coalesce("starts", "anchors"), lambda a: F.col("x") >= a - slack)
    return rows.withColumn("col", F.greatest(F.size(reached) - 1, F.lit(0))).select(*words.columns, "row", "col")


def page_cells(words: DataFrame) -> DataFrame:
    """``page_id, row, col, text``: the words of each cell from left to right; empty cells have no row."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word_id", "text"))), lambda w: w["text"]), " ")
    return word_columns(words).groupBy("page_id", "row", "col").agg(joined.alias("text"))
