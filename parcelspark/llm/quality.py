"""Operator 1: quality rules by gradient-boosted trees over document statistics.

Two base rules reject outright (too few words; too much repeated).  The rest is
left to boosted trees over document statistics, fitted here on a bounded sample
of labelled documents.  Trees are flattened into numpy node arrays, so scoring
moves a whole batch of documents down all trees with a few array operations.
Chosen features carry a monotonic constraint: more symbols, repeats or shouting
can never raise a document's score.

Rows: a null text has no words and so fails the base rule; one row per input
row, repeated rows included; columns other than ``doc_id`` and ``text`` are not
read.  With fewer than ``LEAST_LABELS`` usable labels, or labels of one class,
the trees are empty and only the base rules reject.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import map_texts, small_batches

LEAST_WORDS = 20
MOST_REPEATED = 30  # percent
#: Bound of the fitting sample: labelled documents with the smallest hashes of their ids.
SAMPLE = 10_000
LEAST_LABELS = 50
KEEP_AT = 0.5
GRAM = 8

SYMBOLS = b"#*$%&|<>"
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_ODD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(GRAM)], np.uint64)
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_MARKS = re.compile(r"[^\w\s]")

#: name -> monotonic direction of the quality score (0: free).
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "mark_share": -1,
    "distinct_share": 0,
    "mean_line": 0,
    "bare_mark_share": -1,
    "longest_word": 0,
}
DIRECTIONS = np.array(list(FEATURES.values()))


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside 8-word windows that occur twice or more, and distinct words."""
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    n = len(ids) - GRAM + 1
    if n < 2 or len(seen) == len(ids):
        return 0, len(seen)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    hashes = np.zeros(n, np.uint64)
    for k in range(GRAM):
        hashes += mixed[k : k + n] * _ODD[k]
    order = np.sort(hashes)
    if not (order[1:] == order[:-1]).any():
        return 0, len(seen)
    # Equal windows have equal hashes; ranks of doubled lengths settle which are equal.
    rank, step = ids, 1
    while step < GRAM:
        m = len(rank) - step
        rank = np.unique(rank[:m] * np.int64(len(ids) + 1) + rank[step : step + m], return_inverse=True)[1]
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + GRAM, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), len(seen)


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five base counts, and the features in the order of ``FEATURES``."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat, distinct = repeated_words(words)
    c, w = max(chars, 1), max(n, 1)
    bare = sum(1 for x in words if x.translate(None, SYMBOLS) == b"") if symbols else 0
    features = [
        float(np.log1p(n)),
        chars / w,
        symbols / c,
        dup / max(len(lines), 1),
        repeat / w,
        len(_UPPER.findall(text)) / c,
        len(_DIGIT.findall(text)) / c,
        len(_MARKS.findall(text)) / c,
        distinct / w,
        n / max(len(lines), 1),
        bare / w,
        float(max(map(len, words), default=0)),
    ]
    return [n, chars, symbols, dup, repeat], features


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n_words


@dataclass(frozen=True)
class Trees:
    """All trees in shared node arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality for each row of ``x``."""
        if not len(self.roots):
            return np.full(len(x), self.bias)
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            down = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(down, self.left[at], self.right[at])
        return self.bias + self.value[at].sum(axis=1)


EMPTY = Trees(*[np.zeros(0, np.int64)] * 6, depth=0, bias=20.0)


def fit_trees(x: np.ndarray, y: np.ndarray, directions: np.ndarray = DIRECTIONS, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 5) -> Trees:
    """Second-order boosting of the logistic loss over binned features.

    A split on a constrained feature is refused where its leaves would point
    the wrong way, and the midpoint of its leaves bounds both subtrees.
    """
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    slot = binned + np.arange(width) * bins
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    score = np.full(n, bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        k = len(value)
        feature.append(0), threshold.append(np.inf), left.append(k), right.append(k), value.append(v)
        return k

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-score))
        g, h = y - prob, prob * (1 - prob)

        def leaf(rows, low, high):
            return float(np.clip(g[rows].sum() / (h[rows].sum() + l2), low, high))

        def grow(rows, level, low, high):
            k = node(rate * leaf(rows, low, high))
            if level == depth or len(rows) < 2 * least:
                return k
            flat = slot[rows].ravel()
            sums = [np.bincount(flat, np.repeat(v[rows], width), width * bins).reshape(width, bins).cumsum(axis=1) for v in (g, h, np.ones(n))]
            (gl, hl, cl), (gt, ht, ct) = sums, [s[:, -1:] for s in sums]
            wl, wr = np.clip(gl / (hl + l2), low, high), np.clip((gt - gl) / (ht - hl + l2), low, high)
            gain = gl * wl - (hl + l2) * wl**2 / 2 + (gt - gl) * wr - (ht - hl + l2) * wr**2 / 2
            wrong = (directions[:, None] * (wr - wl) < 0) | (cl < least) | (ct - cl < least)
            gain = np.where(wrong, -np.inf, gain)
            j, b = np.unravel_index(gain.argmax(), gain.shape)
            own = np.clip(gt[j, 0] / (ht[j, 0] + l2), low, high)
            if gain[j, b] <= gt[j, 0] * own - (ht[j, 0] + l2) * own**2 / 2 + 1e-6 or b >= len(edges[j]):
                return k
            mid = (wl[j, b] + wr[j, b]) / 2
            down = binned[rows, j] <= b
            bounds = [(low, high), (low, high)]
            if directions[j]:
                bounds = [(low, mid), (mid, high)] if directions[j] > 0 else [(mid, high), (low, mid)]
            feature[k], threshold[k] = int(j), float(edges[j][b])
            left[k] = grow(rows[down], level + 1, *bounds[0])
            right[k] = grow(rows[~down], level + 1, *bounds[1])
            return k

        roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
        one = Trees(np.array(roots[-1:]), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), depth, 0.0)
        score = score + one.score(x)
    return Trees(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), depth, bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most ``sample`` labelled documents.

    The sample is the labelled ids of smallest hash, so it is spread over the
    table and the same in every run.  Its ids are broadcast: at most ``sample``
    rows, whatever the size of the tables.  Null labels are left out; of several
    labels of one id the smallest counts, and of several documents of one id the
    one with the smallest statistics, so trees are the same in every run.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make():
        return lambda key, y, text: {"doc_id": key, "y": y, "x": [statistics(t)[1] for t in text]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    stated = map_texts(rows.select("doc_id", F.col("quality").cast("double").alias("y"), "text"), ["doc_id", "y", "text"], make, f"doc_id {kind}, y double, x array<double>")
    found = stated.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toPandas()
    if len(found) < LEAST_LABELS or found["y"].nunique() < 2:
        return EMPTY
    x = np.stack(found["x"].to_list())
    order = np.lexsort(x.T)
    return fit_trees(x[order], found["y"].to_numpy()[order])


REPORT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def _verdicts(text: list, trees: Trees) -> dict:
    found = [statistics(t) for t in text]
    base = np.array([b for b, _ in found])
    failed = [base_failed(b[0], b[4]) for b, _ in found]
    score = 1 / (1 + np.exp(-trees.score(np.array([f for _, f in found]))))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return {k: base[:, i].tolist() for i, k in enumerate(names)} | {
        "base_failed": failed,
        "kept": [not f and bool(s >= KEEP_AT) for f, s in zip(failed, score)],
        "score": score.tolist(),
    }


def assess(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and the trees' ``score`` of each document."""

    def make():
        return lambda key, text: {"doc_id": key} | _verdicts(text, trees)

    return map_texts(docs, ["doc_id", "text"], make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {REPORT}")


def keep(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_verdicts(batch.column(at).to_pylist(), trees)["kept"]))

    return docs.mapInArrow(run, docs.schema)
