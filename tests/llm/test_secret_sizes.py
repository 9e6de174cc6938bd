"""Secret scans of very long candidates and of many matches, against plain counts."""

import math
import random
import re
import time

from parcelspark.llm import secrets

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"


def windows(text):
    """First and last position of 20-letter windows of 3.7 bits or more."""
    size, counts, hits = secrets.WINDOW, {}, []
    for i, c in enumerate(text):
        counts[c] = counts.get(c, 0) + 1
        if i >= size:
            counts[text[i - size]] -= 1
        if i >= size - 1 and -sum(n / size * math.log2(n / size) for n in counts.values() if n) >= 3.7 - 1e-9:
            hits.append(i - size + 1)
    return hits[0], hits[-1] + size


def test_one_long_candidate(spark):
    rng = random.Random(3)
    dull = "".join(rng.choice("zy1") for _ in range(5000))
    long = dull + "".join(rng.choice(LETTERS) for _ in range(300_000)) + dull
    docs = spark.createDataFrame([(1, f"see {long} here"), (2, f"see {dull} here")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r.spans for r in secrets.secret_report(docs).collect()}
    assert time.perf_counter() - began < 60
    first, last = windows(long)
    assert got == {1: f"entropy:{first + 4}:{last + 4}", 2: ""}


def test_many_matches(spark):
    rng = random.Random(4)
    parts = [f"token={i:08d}" if i % 2 else "".join(rng.choice(LETTERS) for _ in range(24)) + "a1B" for i in range(20_000)]
    text = "é😀 " + " ".join(parts)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    report, masked = secrets.secret_report(docs).first(), secrets.masked(docs).first().text
    assert time.perf_counter() - began < 60
    assert report.n_assign == 10_000
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in report.spans.split(","))
    want, at = [], 0
    for start, end in spans:
        want += [text[at:start], "[SECRET]"]
        at = end
    assert masked == "".join(want) + text[at:] and len(re.findall("entropy", report.spans)) > 9_900


def test_runs_of_words_and_repeats(spark):
    texts = ["a/" * 200_000 + "Zz9", "a" * 200_000 + "A1", "-" * 100_000, "token=" * 20_000, "AKIA" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.secret_report(docs).collect()}
    assert got[0].spans == got[2].spans == "" and got[1].n_hex == 1 and got[4].n_access == 1 and got[3].n_assign == 1
