"""Pages that are malformed, oddly named, or of several body containers; all against plain expectations."""

import time

import pytest

from parcelspark.llm import html_text

LONG = "A sentence of running text that is long enough to count. " * 6


def one(spark, html, n=1):
    rows = [(i, "http://h.example/x", html) for i in range(n)]
    got = {r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 1
    return got.pop().replace(LONG.strip(), "long").split("\n\n")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<body><a name=top><div><h1>Title</h1><p>{LONG}</p></div></body>", ["Title", "long"]),
        (f"<body><article><p><a href=x>Open link<p>{LONG}</p><p>End.</p></article></body>", ["Open link", "long", "End."]),
        (f"<body><div class=a><p>{LONG}</p></div><div class=b><p>{LONG} Two.</p></div></body>", ["long", "long Two."]),
        ("<body><article><a href=x>The article is one link.</a></article></body>", ["The article is one link."]),
        ("<body><div><a href=x>No running text at all.</a></div><nav>menu</nav></body>", ["No running text at all."]),
        (f"<article><p class=related>Related work exists.</p><div class=login-guide><p>{LONG}</p></div><div class=related><p>Elsewhere.</p></div></article>", ["Related work exists.", "long"]),
        (f"<article><p>{LONG}</p><div class='related-work'><p>Others did it.</p></div><div class=related-posts><p>More.</p></div><div class=newsletter-teaser><p>Sign up.</p></div></article>", ["long", "Others did it."]),
        (f"<article><p title=\"don't>First.</p><p class=\"x\">{LONG}</p></article>", ["First.", "long"]),
        (f"<article><p title='a > b'>First.</p><p data-class=sidebar data-id='nav'>{LONG}</p></article>", ["First.", "long"]),
        (f"<article><p>{LONG}</p><!-- never closed > <p>After.</p></article>", ["long", "After."]),
        (f"<article><p>{LONG}</p><![CDATA[raw & text</article>", ["long", "raw & text"]),
        (f"<article>1 < 2 <p>{LONG}</p></article>", ["1 < 2", "long"]),
    ],
)
def test_shapes(spark, html, want):
    assert one(spark, html, 2) == want


@pytest.mark.parametrize("mark", ["<p title=\"don't>", "<!-- ", "<div>", "<div class=menu>", "<a href=x>", "<script>", "<svg>", "<", "</p", "<aside><main>", "<p class='", "<![CDATA[", "<li><ul>", "<span class=ad>"])
def test_malformed_pages_take_linear_time(mark):
    html = mark + "word "
    html *= 1_000_000 // len(html)
    began = time.perf_counter()
    blocks = html_text._blocks(html)
    html_text.text_under(blocks, html_text.main_path(blocks))
    assert time.perf_counter() - began < 20, mark


def test_hot_hosts_and_shuffled_winners_agree(spark, monkeypatch):
    page = "<body><div class=menu><a href=x>m</a></div><div class=t{}><p>{}</p></div><div class=o><p>Other.</p></div></body>"
    rows = [(i, f"http://h{i % 7 if i % 3 else 0}.example/{i}", page.format(i % 3, LONG)) for i in range(90)] + [(90, None, page.format(1, LONG))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, html_text.main_texts(pages).collect()))
    monkeypatch.setattr("parcelspark.llm.common.HOT", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = sorted(map(tuple, html_text.main_texts(pages).collect()))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and {r[2] for r in got} == {LONG.strip()}
