"""Operator 3: benchmark decontamination by winnowing.

Both sides keep, of every ``WINNOW`` consecutive ``GRAM``-word hashes, the
smallest one.  A shared span of ``GRAM + WINNOW - 1`` = 10 words contains a
whole such window, so it leaves the same fingerprint on both sides: no shared
10-word window is missed.  Fingerprints that meet are extended to the windows
around them, which are then joined on their words, so a hash alone never
decides.  Items of fewer than 10 words are one window of their own length; for
these lengths every position of a document is looked up.

Scale: documents are read once per block of ``BLOCK`` distinct benchmark
fingerprints (one block up to some ten million benchmark words).  A block is
sent to the tasks as a sorted array of that bounded size; documents' own
fingerprints never leave their task.  Only windows around a hit are joined, by
broadcast up to ``BROADCAST_WINDOWS`` benchmark windows and by shuffle beyond.

Rows: null or empty texts have no words and no hits; a null or empty item has
no windows; one row comes back per input row, repeated rows included; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import map_texts, without
from parcelspark.llm.rank_bpe import Cache

SPAN = 10
GRAM = 5
WINNOW = SPAN - GRAM + 1
BLOCK = 4_000_000
BROADCAST_WINDOWS = 200_000
CACHE_WORDS = 500_000

_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_ODD = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(SPAN)]
_HASHES = Cache(xxhash.xxh3_64_intdigest, CACHE_WORDS)


def words_of(text: str | None) -> list[bytes]:
    """Words of lower-cased text: digits, a-z and everything beyond ASCII."""
    return (text or "").encode("utf-8").translate(_WORD_BYTES).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _ODD[0]
    for j in range(1, k):
        out += hashes[j : j + n] * _ODD[j]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def winnow(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept fingerprints of a text of ``SPAN`` words or more: hash and position, the last minimum of each window."""
    g = grams(hashes, GRAM)
    if len(g) < WINNOW:
        return g[:0], np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, WINNOW)[:, ::-1]
    at = np.arange(len(view)) + WINNOW - 1 - view.argmin(axis=1)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    return g[at], at


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, length, win, hash``: each window of each item, and the fingerprint hashes it adds.

    ``hash`` is null for windows that add none; short items add one with their length.
    """

    def make():
        def step(item, text):
            out = {"item_id": [], "length": [], "win": [], "hash": []}

            def add(*row):
                for k, v in zip(out, row):
                    out[k].append(v)

            for key, t in zip(item, text):
                words = words_of(t)
                if not words:
                    continue
                h = word_hashes(words)
                if len(words) < SPAN:
                    add(key, len(words), b" ".join(words).decode(), int(grams(h, len(words)).view(np.int64)[0]))
                    continue
                for s in range(len(words) - SPAN + 1):
                    add(key, SPAN, b" ".join(words[s : s + SPAN]).decode(), None)
                for x in winnow(h)[0].view(np.int64):
                    add(key, SPAN, None, int(x))
            return out

        return step

    return map_texts(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"), ["item_id", "text"], make, "item_id string, length int, win string, hash long")


def _candidates(docs: DataFrame, block: dict[int, np.ndarray]) -> DataFrame:
    """``doc_id, key, n_words, found array<struct<win, length, starts>>`` of windows around fingerprints of ``block``."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def lookup(values, known):
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return known[at] == values

    def make():
        known = sent.value

        def find(words):
            starts: dict[tuple[int, int], None] = {}
            n = len(words)
            h = word_hashes(words)
            for length, hashes in known.items():
                if length < SPAN:
                    for s in np.flatnonzero(lookup(grams(h, length), hashes)):
                        starts[length, int(s)] = None
                elif n >= SPAN:
                    g, at = winnow(h)
                    for p in at[lookup(g, hashes)].tolist():
                        for s in range(max(0, p - WINNOW + 1), min(p, n - SPAN) + 1):
                            starts[SPAN, s] = None
            wins: dict[tuple[int, bytes], list[int]] = {}
            for length, s in starts:
                wins.setdefault((length, b" ".join(words[s : s + length])), []).append(s)
            return [{"win": w.decode(), "length": k, "starts": s} for (k, w), s in wins.items()]

        def step(doc_id, key, text):
            words = [words_of(t) for t in text]
            return {"doc_id": doc_id, "key": key, "n_words": [len(w) for w in words], "found": [find(w) for w in words]}

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key("text").alias("key"), "text")
    return map_texts(rows, ["doc_id", "key", "text"], make, f"doc_id {kind}, key string, n_words long, found array<struct<win:string,length:int,starts:array<int>>>")


def text_key(column: str) -> F.Column:
    """A digest that stands for a text in grouping and joins."""
    return F.md5(F.coalesce(F.col(column), F.lit("")))


def _blocks(windows: DataFrame, size: int):
    """The distinct benchmark fingerprints, as sorted arrays by length, ``size`` at a time."""
    prints = windows.where("hash IS NOT NULL").select("length", "hash").distinct()
    n = prints.count()
    for b in range(max(1, -(-n // size))):
        part = prints.where(F.pmod(F.xxhash64("hash"), F.lit(max(1, -(-n // size)))) == b) if n > size else prints
        rows = part.toPandas()
        yield {int(k): np.sort(g["hash"].to_numpy().astype(np.int64).view(np.uint64)) for k, g in rows.groupby("length")}


def contamination(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and ``key``, one row per row of ``docs``.

    A key of the benchmark that many documents hold is not grouped: it is the
    build side of the join.  Rows are grouped per document only.
    """
    from functools import reduce

    windows = benchmark_windows(benchmark)
    tests = windows.where("win IS NOT NULL").groupBy("win", "length").agg(F.collect_set("item_id").alias("items"))
    if tests.count() <= broadcast_windows:
        tests = F.broadcast(tests)
    passes = []
    for i, known in enumerate(_blocks(windows, block)):
        head = F.struct(F.lit(None).cast("string").alias("win"), F.lit(None).cast("int").alias("length"), F.array().cast("array<int>").alias("starts"))
        rows = _candidates(docs, known)
        passes.append(rows.select("doc_id", "key", "n_words", F.explode(F.concat(F.array(head), "found") if i == 0 else "found").alias("x")))
    every = reduce(DataFrame.unionByName, passes).select("doc_id", "key", "n_words", "x.*")
    hit = F.col("items").isNotNull()
    places = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("length") - 1)))
    return (
        every.join(tests, ["win", "length"], "left")
        .groupBy("doc_id", "key", "n_words")
        .agg(
            F.count(F.when(F.col("win").isNull(), 1)).alias("copies"),
            F.size(F.array_distinct(F.flatten(F.collect_set(F.when(hit, places))))).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
            "key",
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, all columns as they are."""
    bad = contamination(docs, benchmark).where("contaminated").select("key")
    return without(docs, text_key("text"), bad)
