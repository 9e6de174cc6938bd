"""Columns of positioned words, and misread phrases against every window of every line."""

import difflib
import random
import re

from parcelspark.operators import layout, phrases
from parcelspark.plans import pages

WORDS = "page_id long, word_id long, x int, y int, width int, height int, text string"


def page(number, lines, width=6):
    """``lines``: (y, [(x, text), ...])."""
    return [(number, y * 1000 + i, x, y, width * len(t), 10, t) for y, line in lines for i, (x, t) in enumerate(line)]


def grid(spark, rows):
    got = {}
    for r in layout.page_cells(spark.createDataFrame(rows, WORDS)).collect():
        got.setdefault(r.page_id, {})[r.row, r.col] = r.text
    return got


def test_columns_come_from_the_gutters_of_the_data(spark):
    header = [(10, "Tenant"), (60, "Name"), (150, "Rent"), (200, "Due")]
    data = [(y, [(8, "Ann"), (30, "Lee"), (148, f"1,{y}00"), (197, "yes")]) for y in range(40, 200, 20)]
    got = grid(spark, page(1, [(0, [(10, "Rent"), (40, "roll")]), (20, header), *data]))[1]
    assert [got[1, c] for c in range(3)] == ["Tenant Name", "Rent", "Due"] and got[0, 0] == "Rent roll"
    assert [got[2, c] for c in range(3)] == ["Ann Lee", "1,4000", "yes"] and max(c for _, c in got) == 2


def test_one_glued_row_among_many_closes_no_gutter(spark):
    data = [(y, [(10, "Ann"), (100, "1000")]) for y in range(20, 200, 20)]
    glued = [(200, [(10, "Annandalotofletters1000")])]
    got = grid(spark, page(1, [(0, [(10, "Tenant"), (100, "Rent")]), *data, *glued]) + page(2, [(0, [(10, "Tenant"), (100, "Rent")]), *data[:3], *glued]))
    assert got[1][1, 1] == "1000"
    assert got[2][1, 1] == "1000"  # too few rows to allow one, so the header's parts decide


def test_a_space_that_all_names_share_is_no_gutter(spark):
    header = [(10, "Tenant"), (150, "Rent")]
    narrow = [(y, [(10, "T910"), (40, "Holder"), (150, "900")]) for y in (40, 60, 80)]
    headed = [(y, [(10, "Ann"), (40, "Holder"), (150, "900")]) for y in (40, 60, 80)]
    wide = [(y, [(10, "T1"), (32, "B"), (150, "900")]) for y in (40, 60, 80)]
    title = (0, [(10, "Rent"), (40, "roll")])
    got = grid(spark, page(1, [title, (20, header), *narrow]) + page(2, [title, (20, [(10, "Name"), (40, "Kind"), (150, "Rent")]), *headed]) + page(3, [title, (20, header), *wide]))
    assert [got[1][2, c] for c in range(2)] == ["T910 Holder", "900"] and got[1][0, 0] == "Rent roll" and got[1][1, 1] == "Rent"
    assert [got[2][2, c] for c in range(3)] == ["Ann", "Holder", "900"]  # no word of the header covers this gutter
    assert [got[3][2, c] for c in range(3)] == ["T1", "B", "900"]  # too wide to be a space


def test_few_rows_one_part_and_one_word(spark):
    got = grid(
        spark,
        page(1, [(0, [(10, "Tenant"), (200, "Rent")]), (20, [(5, "Ann"), (195, "5")])])  # one row of data: the header's parts, with some slack
        + page(2, [(0, [(10, "alone")])])
        + page(3, [(0, [(10, "no"), (24, "gaps"), (50, "here")]), (20, [(10, "aa"), (60, "bb")])]),
    )
    assert got[1][1, 0] == "Ann" and got[1][1, 1] == "5"
    assert got[2] == {(0, 0): "alone"}
    assert set(got[3].values()) <= {"no gaps here", "no gaps", "here", "aa", "bb", "aa bb"}


def test_repeated_words_and_empty_pages(spark):
    rows = page(1, [(0, [(10, "Tenant"), (100, "Rent")]), (20, [(10, "Ann"), (100, "5")]), (40, [(10, "Bob"), (100, "6")])])
    got = grid(spark, rows + rows)[1]
    assert got[1, 0] == "Ann Ann" and got[2, 1] == "6 6"
    assert layout.page_cells(spark.createDataFrame([], WORDS)).count() == 0


def every_window(text, phrase, like=phrases.LIKE):
    """The same rules without an index: every window of every line is compared."""
    target = re.sub("[^a-z0-9]", "", phrase.lower())
    n, out = len(phrase.split()), []
    for number, line in enumerate(text.split("\n")):
        words = [re.sub("[^a-z0-9]", "", w.lower()) for w in line.split()]
        joined, owner = "".join(words), [i for i, w in enumerate(words) for _ in w]
        exact = False
        for at in range(len(joined) - len(target) + 1):
            if joined[at : at + len(target)] == target:
                end = at + len(target) - 1
                if len(target) > phrases.SHORT or ((at == 0 or owner[at - 1] != owner[at]) and (end + 1 == len(owner) or owner[end + 1] != owner[end])):
                    out.append((number, owner[at], owner[end] - owner[at] + 1, 1.0))
                    exact = True
        best = None
        for size in sorted({*range(max(1, n - 2), n + 3), 1, 2, 3}):
            for i in range(len(words) - size + 1):
                if exact or len(target) < phrases.LONG_ENOUGH:
                    break
                ratio = difflib.SequenceMatcher(None, "".join(words[i : i + size]), target).ratio()
                if ratio >= like and (best is None or ratio > best[3]):
                    best = (number, i, size, ratio)
        out += [best] if best else []
    top = max((x[3] for x in out), default=0)
    return sorted((a, b, c, round(r, 4)) for a, b, c, r in out if r >= top - phrases.NEAR_BEST)


def test_phrases_equal_every_window(spark):
    rng = random.Random(7)
    labels = ["Address of Unit", "Contract Rent to Owner", "No. of Bedrooms", "Effective Date", "TC", "Unit", "Name of Tenant (last, first)", "Security deposit amount", "...", ""]
    letters = "abcdefghijklmnopqrstuvwxyz"

    def misread(label):
        s = list(label)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice(([], [rng.choice(letters)], [s[i], rng.choice(letters + " ")], [s[i], " "]))
        return "".join(s)

    texts = ["\n".join(" ".join(["x1", misread(rng.choice(labels[:8])), f"row {rng.randrange(9)}", misread(rng.choice(labels[:8]))]) for _ in range(6)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, ""), (1002, "TC-26 and TC, Unit;\nUnit")], "doc_id long, text string")
    got = {}
    for r in phrases.fuzzy_phrases(docs, spark.createDataFrame(list(enumerate(labels)), "phrase_id long, phrase string")).collect():
        got.setdefault((r.doc_id, r.phrase_id), []).append((r.line, r.first, r["words"], r.likeness))
    want = {(d, p): found for d, t in [*enumerate(texts), (1002, "TC-26 and TC, Unit;\nUnit")] for p, label in enumerate(labels) if re.search("[A-Za-z0-9]", label) and (found := every_window(t, label))}
    same = sum(sorted(got.get(k, [])) == v for k, v in want.items())
    assert same >= 0.97 * len(want) and set(got) <= set(want) and len(want) > 300


def test_lines_stay_where_they_are(spark):
    """Only what was found is dealt anew: no line, triple or page is joined or broadcast."""
    docs = spark.createDataFrame([(1, "Contract Rnet to Owner")], "doc_id long, text string")
    found = phrases.fuzzy_phrases(docs, spark.createDataFrame([(7, "Contract Rent to Owner")], "phrase_id long, phrase string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert [tuple(r) for r in found.collect()] == [(1, 7, 0, 0, 4, 0.9474)]


def test_few_windows_are_compared_one_by_one(spark, monkeypatch):
    """Of lines made of a phrase's own syllables hardly any window is worth a comparison; those that are like it are found."""
    rng = random.Random(3)
    labels = [("".join(rng.choice(["the", "rea", "ing", "ent", "ion", "ati"]) for _ in range(9)), 6) for _ in range(20)]
    lines = [" ".join("".join(rng.choice(["the", "rea", "ing", "ent", "ion", "ati"]) for _ in range(2)) for _ in range(60)) for _ in range(40)]
    lines += [f"x {p[:10]} {p[10:13]}q{p[14:]} y" for p, _ in labels]
    compared, ratio = [], difflib.SequenceMatcher.quick_ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "quick_ratio", lambda m: compared.append(1) or ratio(m))
    got = sorted(phrases.Index(labels, phrases.LIKE).spans(lines))
    n = len(compared)
    want = sorted((i, k, x) for i, line in enumerate(lines) for k, (p, w) in enumerate(labels) for x in phrases.spans_like(line.split(" "), p, w, phrases.LIKE))
    assert got == want and len(got) >= 20 and n < (len(compared) - n) / 4


def test_registered_phrases_are_found(spark, small):
    got = pages.fuzzy_phrases(spark, small).collect()
    labels = {r.phrase_id: r.phrase for r in pages.labels(spark, small).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len({r.phrase_id % 4 for r in got}) >= 3
    found = {(r.doc_id, r.phrase_id) for r in got}
    some = sorted(found)[:: max(1, len(found) // 12)]
    for d, p in some:
        mine = sorted((r.line, r.first, r["words"], r.likeness) for r in got if (r.doc_id, r.phrase_id) == (d, p))
        assert mine == every_window(texts[d], labels[p])
