"""Operator 2: language identification by Bayesian evidence fusion.

For each row the posterior over languages multiplies

* the text's likelihood under hashed byte-trigram models, which are counted
  over all labelled documents by a grouped sum and tempered, since trigrams of
  one text are not independent;
* the chance of its declared markup language given the language;
* the chance of its address suffix given the language;
* a prior of its host, smoothed towards its domain, and that towards the whole
  corpus.

The last three come from grouped counts of the languages that texts alone
suggest; a row's own vote is taken out of its host's counts first.

Labels may be dirty: the ``MOST_LANGUAGES`` most frequent ones of ``lang`` (of
equal counts the first in the alphabet) are the languages, and documents with
any other label count as unlabelled, so the model's size is bounded.

Rows: missing evidence (null or empty text, declaration, suffix or host) says
nothing and leaves the others to decide; with none, the corpus prior does.  One
row per input row.  Without labelled documents there are no languages, and
``lang`` is null throughout.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import cut, lookup, map_texts, small_batches
from parcelspark.llm.html_text import _tokens

BUCKETS = 1 << 15
#: Text evidence counts as at most this many independent trigrams.
EFFECTIVE = 40
ALPHA = 20.0
#: Most languages of a model, whose size is this times ``BUCKETS`` at most: 16 MB.
MOST_LANGUAGES = 128
#: Pseudo-counts for country suffixes whose main language is plain.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}
SUFFIX_WEIGHT = 50.0

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x41 or 0x5B <= b <= 0x60 or 0x7B <= b < 0x80 else b for b in range(256))
ATTRIBUTE = r"""(?:^|[\s"'/])NAME\s*=\s*["']?\s*([A-Za-z]{2,3})(?![A-Za-z])"""
LANG = re.compile(ATTRIBUTE.replace("NAME", "lang"), re.I)
CONTENT = re.compile(ATTRIBUTE.replace("NAME", "content"), re.I)
CONTENT_LANGUAGE = re.compile(r"content-language", re.I)


def page_text(html: str) -> tuple[str | None, str]:
    """The language that a page's markup declares first, and its whole text; comments, scripts and styles have no part in either."""
    declared, text = None, []
    for kind, value, raw in _tokens(html):
        if kind == "text":
            text.append(value)
            continue
        text.append(" ")
        if declared is None and kind == "start" and raw:
            m = LANG.search(raw) if value == "html" else CONTENT.search(raw) if value == "meta" and CONTENT_LANGUAGE.search(raw) else None
            declared = m[1].lower() if m else None
    return declared, unescape("".join(text))


def trigrams(text: str | None) -> np.ndarray:
    """Hash buckets of the byte trigrams of lower-cased text; digits and marks count as spaces."""
    raw = np.frombuffer(b" " + b" ".join((text or "").encode("utf-8").translate(_LOWER).split()) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return np.zeros(0, np.int64)
    code = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(32 - 15)).astype(np.int64)


def text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities ``[BUCKETS, languages]`` from all documents that are labelled with one of them.

    Each task adds up its own counts; the sums that reach the driver are at most
    ``MOST_LANGUAGES * BUCKETS``, however many documents and labels there are.
    """
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    most = rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(MOST_LANGUAGES).collect()
    langs = sorted(r.l for r in most)
    place = {x: i for i, x in enumerate(langs)}
    schema = pa.schema([("lang", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (i := place.get(lang)) is not None:
                    if i not in sums:
                        sums[i] = np.zeros(BUCKETS, np.int64)
                    sums[i] += np.bincount(trigrams(text), minlength=BUCKETS)
        for i, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(found[at])], schema=schema)

    small_batches(docs.sparkSession)
    totals = rows.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((BUCKETS, len(langs)), 0.5)
    counts[totals["bucket"].to_numpy(), totals["lang"].to_numpy()] += totals["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def page_evidence(pages: DataFrame) -> DataFrame:
    """``doc_id (null), page_id, raw, is_html, host`` of web pages."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long"), F.col("html").alias("raw"), F.lit(True).alias("is_html"), F.nullif(host, F.lit("")).alias("host"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """The same of plain documents, whose source stands for a host."""
    return docs.select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("page_id"), F.col("text").alias("raw"), F.lit(False).alias("is_html"), F.nullif(F.col("source").cast("string"), F.lit("")).alias("host"))


def fuse(evidence: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``doc_id, page_id, lang, confidence, text_lang, declared, suffix``."""
    langs, weights = model
    k = len(langs)
    if not k:
        none = F.lit(None).cast("string")
        return evidence.select("doc_id", "page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), none.alias("declared"), none.alias("suffix"))
    sent = evidence.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = sent.value

        def one(raw, is_html):
            declared = None
            if is_html and raw:
                declared, raw = page_text(raw)
            codes = trigrams(raw)
            if not len(codes):
                return declared, None
            return declared, (w[codes].mean(axis=0, dtype=np.float64) * min(len(codes), EFFECTIVE)).tolist()

        def step(doc, page, raw, is_html, host):
            declared, score = zip(*map(one, raw, is_html))
            return {"doc_id": doc, "page_id": page, "host": host, "declared": declared, "score": score}

        return step

    scored = map_texts(evidence, ["doc_id", "page_id", "raw", "is_html", "host"], make, "doc_id long, page_id long, host string, declared string, score array<double>")
    best = F.when(F.col("score").isNotNull(), F.array_position("score", F.array_max("score")).cast("int"))
    labels = F.regexp_extract("host", r"([^.]+)$", 1)
    scored = cut(
        scored.withColumn("best", best)
        .withColumn("suffix", F.when(F.col("host").contains("."), labels))
        .withColumn("domain", F.when(F.col("host").contains("."), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).otherwise(F.col("host")))
    )

    def counts(key: str) -> DataFrame:
        """``key``, and how many of its texts suggest each language."""
        tallies = F.array(*[F.count(F.when(F.col("best") == i + 1, 1)).cast("double") for i in range(k)])
        return cut(scored.where(F.col(key).isNotNull() & F.col("best").isNotNull()).groupBy(key).agg(F.count("*").alias("rows"), tallies.alias(f"{key}_n")))

    whole = scored.where("best IS NOT NULL").agg(*[F.count(F.when(F.col("best") == i + 1, 1)) for i in range(k)]).first()
    prior = (np.array(whole, float) + 1) / (sum(whole) + k)
    corpus = F.array(*map(F.lit, prior.tolist()))

    def smooth(n, towards):
        size = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, towards, lambda x, p: (x + ALPHA * p) / (size + ALPHA))

    zeros = F.array(*[F.lit(0.0)] * k)

    def chance(key: str, pseudo) -> F.Column:
        """Log chance of the row's ``key`` given each language; 0 where it has none."""
        values = distinct[key] + 1
        sizes = F.array(*[F.lit(float(c)) for c in whole])
        own = F.zip_with(f"{key}_n", pseudo, lambda x, y: x + y + 0.5)
        return F.when(F.col(key).isNotNull(), F.zip_with(own, sizes, lambda x, s: F.log(x / (s + 0.5 * values)))).otherwise(zeros)

    rows, distinct = scored, {}
    for key in ("host", "domain", "suffix", "declared"):
        found = counts(key)
        distinct[key] = found.count()
        rows = lookup(rows, found, key, "rows").withColumn(f"{key}_n", F.coalesce(f"{key}_n", zeros))
    mine = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(F.col("best") == i, 1.0).otherwise(0.0))
    for key in ("host", "domain"):
        rows = rows.withColumn(f"{key}_n", F.zip_with(f"{key}_n", mine, lambda n, m: F.greatest(n - m, F.lit(0.0))))
    names = F.array(*map(F.lit, langs))
    plain = F.transform(names, lambda x: F.when(F.create_map(*[F.lit(v) for kv in SUFFIX_LANGUAGE.items() for v in kv])[F.col("suffix")] == x, SUFFIX_WEIGHT).otherwise(0.0))
    stated = F.transform(names, lambda x: F.when(F.col("declared") == x, 5.0).otherwise(0.0))
    host_prior = F.transform(smooth(F.col("host_n"), smooth(F.col("domain_n"), corpus)), lambda p: F.log(p))
    logs = [F.coalesce("score", zeros), host_prior, chance("suffix", plain), chance("declared", stated)]
    total = logs[0]
    for more in logs[1:]:
        total = F.zip_with(total, more, lambda x, y: x + y)
    rows = rows.withColumn("log", total).withColumn("top", F.array_max("log"))
    share = F.aggregate(F.transform("log", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "doc_id",
        "page_id",
        F.get(names, F.array_position("log", F.col("top")).cast("int") - 1).alias("lang"),
        F.round(1 / share, 6).alias("confidence"),
        F.get(names, F.col("best") - 1).alias("text_lang"),
        "declared",
        "suffix",
    )


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Languages of all documents and pages; texts' models come from the documents' labels."""
    return fuse(document_evidence(docs).unionByName(page_evidence(pages)), text_model(docs))
