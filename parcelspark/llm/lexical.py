"""Operator 13: ranked lexical search as a blocked sparse matrix product.

Scores are the product of two sparse matrices in int64: how often an item holds
a term, times the term's weight, and a term's impact in a document.

1. Items are dealt into blocks of ``BLOCK`` entries; a block with its vocabulary
   is what tasks are sent, so it is bounded whatever the number of items.
2. ``postings`` reads every document once a block and writes its counts of the
   block's terms to the shared folder, as one packed row a document.
3. Document frequencies are summed a task at a time, then over tasks; they, the
   number of documents and of all terms are all that the driver sees: some
   numbers a term of the block.
4. ``product`` takes ``DOCS`` documents at once, turns them into rows by term, and
   merges the rows that an item asks for into one row of scores (Gustavson): each
   is added, times the item's entry, into a dense row of ``DOCS`` numbers.  Of
   every such row only the best ``k`` are kept, then of a task, of a few tasks,
   and of all.

No pair of item and document leaves a task but the best ``k``, and no term is a
key of a shuffle but in the sums of step 3, so a very frequent term is no hot key.

Rows: null and empty texts have no terms and are not counted; an item without
terms has no rows.  Each row of either table stands for itself, equal rows too;
among equal scores null ids come last.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.llm.common import cut, map_texts, small_batches
from parcelspark.llm.decontam import words_of

TOP = 10
#: Entries of a block of items, and documents of a block of the product.
BLOCK, DOCS = 200_000, 4096


def weight(docs: int, df: int) -> int:
    """A term's weight from the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def length_norm(n: int, docs: int, terms: int) -> int:
    """A document's ``m``, in unbounded integers, as the product may leave 64 bits."""
    return 10 + 90 * n * docs // terms


def item_terms(items: DataFrame) -> DataFrame:
    """``row, item_id, terms, times`` of each row of ``items`` that has terms, written to the shared folder."""

    def make():
        def step(row, text):
            found = [Counter(words_of(t)) for t in text]
            return {"row": row, "terms": [list(c) for c in found], "times": [list(c.values()) for c in found]}

        return step

    rows = cut(items.select(F.monotonically_increasing_id().alias("row"), "item_id", "text"))
    terms = map_texts(rows, ["row", "text"], make, "row long, terms array<binary>, times array<int>")
    return cut(rows.select("row", "item_id").join(terms.where(F.size("terms") > 0), "row"))


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms binary, times binary``: number of terms, places in ``vocabulary`` and counts (int32), written."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        place = sent.value

        def step(doc_id, text):
            out = {"doc_id": doc_id, "n": [], "terms": [], "times": []}
            for t in text:
                words = words_of(t)
                found = np.fromiter((p for p in map(place.get, words) if p is not None), np.int32)
                terms, times = np.unique(found, return_counts=True)
                out["n"].append(len(words))
                out["terms"].append(terms.astype("<i4").tobytes())
                out["times"].append(times.astype("<i4").tobytes())
            return out

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(map_texts(rows, ["doc_id", "text"], make, "doc_id long, n long, terms binary, times binary"))


def frequencies(rows: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Documents of each term; documents with terms; terms of all documents."""

    def count(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in rows.where(F.octet_length("terms") > 0).select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    whole = rows.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    return out, whole["docs"], whole["terms"] or 0


class Best:
    """The best ``k`` of each item so far, by score, then id, then null ids."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3] * items
        self.least = np.zeros(items, np.int64)

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """Rows of one item whose score is above 0."""
        at = np.flatnonzero(scores >= max(1, self.least[item]))
        if len(at) > self.k:  # all that equal the k-th stay for now
            at = at[scores[at] >= np.partition(scores[at], -self.k)[-self.k]]
        if not len(at):
            return
        held = [np.concatenate(x) for x in zip(self.rows[item], (scores[at], ids[at], nulls[at]))]
        order = np.lexsort((held[1], held[2], -held[0]))[: self.k]
        self.rows[item] = tuple(x[order] for x in held)
        if len(order) == self.k:
            self.least[item] = self.rows[item][0][-1]


def product(rows: DataFrame, entries: list[tuple[list[int], list[int]]], weights: np.ndarray, docs: int, terms: int, k: int, once: bool, block: int = DOCS) -> DataFrame:
    """``item int, doc_id, score``: the best ``k`` of each item (its terms and their times) in each task."""
    if once:
        entries = [(t, [1] * len(t)) for t, _ in entries]
    matrix = [(np.array(t, np.int64), np.array(n, np.int64) * weights[t]) for t, n in entries]
    sent = rows.sparkSession.sparkContext.broadcast(matrix)
    size = len(weights)

    def multiply(held: list[tuple], items, best: Best) -> None:
        ids = np.array([d or 0 for d, *_ in held], np.int64)
        nulls = np.array([d is None for d, *_ in held], np.int64)
        each = [np.frombuffer(t, "<i4") for _, _, t, _ in held]
        term, doc = np.concatenate(each).astype(np.int64), np.repeat(np.arange(len(held)), [len(t) for t in each])
        tf = np.frombuffer(b"".join([x for *_, x in held]), "<i4").astype(np.int64)
        norm = np.array([length_norm(n, docs, terms) for _, n, *_ in held], np.int64)
        order = np.argsort(term, kind="stable")  # from rows by document to rows by term
        term, doc, tf = term[order], doc[order], tf[order]
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[doc])
        first = np.searchsorted(term, np.arange(size + 1))
        for i, (wanted, entry) in enumerate(items):
            lo, hi = first[wanted], first[wanted + 1]
            scores = np.zeros(len(held), np.int64)
            for j in np.flatnonzero(hi > lo):
                scores[doc[lo[j] : hi[j]]] += entry[j] * impact[lo[j] : hi[j]]
            best.offer(i, scores, ids, nulls)

    def run(batches):
        items = sent.value
        best, held = Best(len(items), k), []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            if len(held) >= block:
                multiply(held, items, best)
                held = []
        if held:
            multiply(held, items, best)
        for i in range(0, len(items), 1024):
            out = [(i + j, *r) for j, x in enumerate(best.rows[i : i + 1024]) for r in zip(*(c.tolist() for c in x))]
            if out:
                item, score, ids, nulls = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array([None if z else d for d, z in zip(ids, nulls)], pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    small_batches(rows.sparkSession)
    return rows.where(F.octet_length("terms") > 0).select("doc_id", "n", "terms", "times").mapInArrow(run, "item int, doc_id long, score long")


def best_of(found: DataFrame, key: str, k: int) -> DataFrame:
    """``found`` with ``rank``, the best ``k`` of each ``key``: first of some tasks' rows, then of all."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("tasks", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy(key, "tasks").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "tasks")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, once: bool = True, block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0.

    With ``once`` an item's repeated term counts once, else as often as it is there.
    """
    terms = item_terms(items)
    blocks = max(1, -(-(terms.agg(F.sum(F.size("terms"))).first()[0] or 0) // block))
    out = None
    for b in range(blocks):
        of = terms.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "terms", "times").orderBy("row").collect()
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(bytes(t) for r in of for t in r["terms"]))}
        rows = postings(docs, vocabulary)
        df, n_docs, n_terms = frequencies(rows, len(vocabulary))
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        entries = [([vocabulary[bytes(t)] for t in r["terms"]], r["times"]) for r in of]
        found = product(rows, entries, weights, n_docs, n_terms, k, once)
        named = docs.sparkSession.createDataFrame([(i, r["row"]) for i, r in enumerate(of)], "item int, row long")
        part = cut(best_of(found, "item", k).join(F.broadcast(named), "item").select("row", "rank", "doc_id", "score"))
        out = part if out is None else out.unionByName(part)
    return out.join(terms.select("row", "item_id"), "row").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
