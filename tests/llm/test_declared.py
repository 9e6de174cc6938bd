"""Declared languages anywhere in a page, many labels, and the posterior by plain loops."""

import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from parcelspark.llm import langid

TWO = [(1, "the and of with that this", "en", "h"), (2, "der die das und nicht ein", "de", "h")] * 9


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_declared_anywhere(spark):
    far = "x" * 5000
    pages = [
        (1, f"<!--{far}--><html lang=de><p>der und nicht</p></html>"),
        (2, f"<head><style>{far}</style><script>'<html lang=en>'</script><meta http-equiv='content-language' content='de'></head>"),
        (3, "<!-- <html lang=en> --><html><script>'<html lang=en>'</script></html>"),
        (4, "<html data-lang=en xml:lang='fr' lang = \"de-AT\"><meta content='en' name=author>"),
    ]
    rows = pages_of(spark, [(i, None, h) for i, h in pages])
    got = {r.page_id: r.declared for r in langid.fuse(langid.page_evidence(rows), langid.text_model(docs_of(spark, TWO))).collect()}
    assert got == {1: "de", 2: "de", 3: None, 4: "de"}


def test_many_labels(spark):
    dirty = [(100 + i, "zz yy xx ww", f"label {i}", "h") for i in range(300)]
    langs, weights = langid.text_model(docs_of(spark, TWO + dirty))
    assert len(langs) == langid.MOST_LANGUAGES and {"en", "de"} <= set(langs) and weights.shape == (langid.BUCKETS, len(langs))
    found = langid.identify(docs_of(spark, TWO + dirty), pages_of(spark, []))
    assert found.count() == len(TWO) + 300
    assert {r.lang for r in found.where("doc_id = 1").collect()} == {"en"}


@pytest.mark.parametrize("mark", ["<!-- ", "<script>", "<", "<p title=\"don't>", "<a href='", "<style ", "<html lang=", "</p"])
def test_malformed_pages_take_linear_time(mark):
    began = time.perf_counter()
    langid.page_text((mark + "word ") * 100_000)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("hot", [1, 1000])
def test_posterior_by_hand(spark, monkeypatch, hot):
    """``hot`` 1: no key is broadcast but one on every row; all others take the second join."""
    monkeypatch.setattr("parcelspark.llm.common.HOT", hot)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if hot == 1 else "10485760")
    docs = docs_of(spark, [*TWO, (3, "the and of", "en", "b.example.de"), (4, "der die das", None, "b.example.de"), (5, None, "en", None), (6, "", "fr", "")])
    pages = [(1, "http://a.example.de/1", "<html lang=de>der die und"), (2, "http://a.example.de/2", "<html lang=en>"), (3, "http://c.example.com", "<p>the of and"), (4, None, None), (5, "http://c.example.com", "<html lang=de>x")]
    langs, weights = model = langid.text_model(docs)
    evidence = langid.document_evidence(docs).unionByName(langid.page_evidence(pages_of(spark, pages)))
    got = sorted(((r.doc_id or 0, r.page_id or 0), r.lang, r.confidence, r.declared or "") for r in langid.fuse(evidence, model).collect())
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    k, rows = len(langs), []
    for r in evidence.collect():
        text, declared = r.raw, None
        if r.is_html and r.raw:
            m = re.search("<html lang=(..)>", r.raw)
            declared, text = m[1] if m else None, re.sub("<[^>]*>", " ", r.raw)
        codes = langid.trigrams(text)
        score = [float(np.mean(weights[codes, i], dtype=np.float64)) * min(len(codes), langid.EFFECTIVE) for i in range(k)] if len(codes) else None
        dotted = r.host if r.host and "." in r.host else None
        rows.append({"key": (r.doc_id or 0, r.page_id or 0), "declared": declared, "score": score, "best": max(range(k), key=lambda i: score[i]) if score else None,
                     "host": r.host, "domain": ".".join(r.host.split(".")[-2:]) if r.host else None, "suffix": dotted.split(".")[-1] if dotted else None})
    tallies = {f: defaultdict(Counter) for f in ("host", "domain", "suffix", "declared")}
    for r in rows:
        for f, t in tallies.items():
            if r[f] is not None and r["best"] is not None:
                t[r[f]][r["best"]] += 1
    whole = Counter(r["best"] for r in rows if r["best"] is not None)
    corpus = [(whole[i] + 1) / (sum(whole.values()) + k) for i in range(k)]
    want = []
    for r in rows:
        def own(f):
            return [max(tallies[f][r[f]][i] - (r["best"] == i), 0) if r[f] is not None else 0 for i in range(k)]

        def smooth(n, towards):
            return [(n[i] + langid.ALPHA * towards[i]) / (sum(n) + langid.ALPHA) for i in range(k)]

        prior = smooth(own("host"), smooth(own("domain"), corpus))
        logs = [(r["score"][i] if r["score"] else 0) + math.log(prior[i]) for i in range(k)]
        for f, pseudo in (("suffix", lambda i: langid.SUFFIX_WEIGHT * (langid.SUFFIX_LANGUAGE.get(r["suffix"]) == langs[i])), ("declared", lambda i: 5.0 * (r["declared"] == langs[i]))):
            if r[f] is not None:
                for i in range(k):
                    logs[i] += math.log((tallies[f][r[f]][i] + pseudo(i) + 0.5) / (whole[i] + 0.5 * (len({x for x, c in tallies[f].items() if c}) + 1)))
        top = max(range(k), key=lambda i: logs[i])
        want.append((r["key"], langs[top], round(1 / sum(math.exp(x - logs[top]) for x in logs), 6), r["declared"] or ""))
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want)]
    assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, sorted(want)))
