"""Operator 7: near-duplicate groups by circulant MinHash, banding and exact checks.

One permutation spreads a document's shingle hashes over ``BINS`` places; a
second, circularly shifted by k, gives coordinate k of the signature.  So two
permutations make all ``COORDINATES``, and the shifts of one shingle are
neighbours in memory.

Steps, none of which brings rows of documents together beyond a bounded block:

1. Documents of equal shingle sets form a class; one node stands for each, so
   copies never meet in pairs.
2. Bands of the signature put nodes into buckets.  The number of rows of a band
   is the largest with a chance under ``MISS`` of losing a pair at the
   threshold.
3. Each bucket has two pivots.  A node is held against those of its two
   largest buckets (rows grow with the nodes, not with their pairs), and
   checked against the two of the closest signatures on the full shingle sets.
   Nodes that still stand apart from pivots of their largest open buckets are
   held against those too.  Components of the confirmed links follow.
4. Buckets that still hold several components are compared across components,
   in blocks of ``BLOCK`` members, each pair in the first bucket that it shares:
   by signature, and then by a finer sketch that only these nodes get (32-bit
   shingle hashes of sets up to ``SMALL``, ``WIDE`` coordinates of larger ones).
   Every pair that both allow (but for a chance under ``MISS``) is checked on
   its full sets.  Pairs within a component need no check, so every link
   between components is found.

Rows: a text without words, null or not, has no shingles and is linked with
nothing.  Repeated rows are members of one class and come back as often as
they came in.  ``component_id`` is the smallest non-null id of the component;
null if all are null, and then ``kept`` is true.  Only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import cut, lookup, map_texts, mark, maybe_in, release, without
from parcelspark.llm.decontam import grams, word_hashes

BINS = 1 << 20
COORDINATES = 192
MISS = 1e-6
BLOCK = 1500
WIDE = 1024
SMALL = 300
#: Open buckets of a node whose pivots it is held against in the second round.
MORE = 4
SEED = 20_011

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle."""
    found = (text or "").encode("utf-8").translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    return np.unique(grams(word_hashes(found), min(words, len(found))))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The spreading permutation, and all shifts of the second as rows of one view."""
    if SEED not in _TABLES:
        rng = np.random.Generator(np.random.PCG64(SEED))
        spread = rng.permutation(BINS).astype(np.int64)
        shifted = rng.permutation(BINS).astype(np.uint32)
        around = np.concatenate([shifted, shifted[: WIDE - 1]])
        _TABLES[SEED] = spread, np.lib.stride_tricks.sliding_window_view(around, WIDE)
    return _TABLES[SEED]


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Coordinate k is the least value, under the second permutation shifted by k, over the spread shingles."""
    spread, shifts = permutations()
    shifts = shifts[:, :coordinates]
    places = np.unique(spread[(shingles % np.uint64(BINS)).astype(np.int64)])
    out = np.full(coordinates, BINS, np.uint32)
    for i in range(0, len(places), 256):
        np.minimum(out, shifts[places[i : i + 256]].min(axis=0), out=out)
    return out


def band_rows(similarity: float) -> int:
    """Rows of a band: as many as lose a pair at ``similarity`` with a chance of ``MISS`` at most."""
    return max([1, *(r for r in range(1, 13) if (1 - similarity**r) ** (COORDINATES // r) <= MISS)])


def _signed(docs: DataFrame, words: int, rows: int) -> DataFrame:
    """``doc_id, text_key, n, digest, low, bands``; ``low`` has the low byte of each coordinate."""

    def make():
        def one(text):
            shingles = shingle_set(text, words)
            if not len(shingles):
                return 0, None, None, None
            sig = signature(shingles)
            used = COORDINATES // rows * rows
            cells = sig[:used].reshape(-1, rows)
            bands = [xxhash.xxh3_64_intdigest(c.tobytes(), seed=j) - (1 << 63) for j, c in enumerate(cells)]
            return len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), (sig & 0xFF).astype(np.uint8).tobytes(), bands

        def step(doc_id, key, text):
            n, digest, low, bands = zip(*map(one, text))
            return {"doc_id": doc_id, "text_key": key, "n": n, "digest": digest, "low": low, "bands": bands}

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return map_texts(source, ["doc_id", "text_key", "text"], make, f"doc_id {kind}, text_key long, n long, digest binary, low binary, bands array<long>")


def _map_arrow(df: DataFrame, per_batch, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield per_batch(batch)

    return df.mapInArrow(run, schema)


#: Rows of one key that a join deals to one task.
SHARE = 2000


def _both_sides(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with ``columns`` of both nodes, named ``<column>_a`` and ``<column>_b``.

    A pivot can be in a large share of all pairs: its pairs are dealt to several
    tasks, and so many copies of its columns are made.  Only nodes of the pairs
    travel; their join is a merge at every size.
    """
    out = pairs = cut(pairs)
    for side, other in (("a", "b"), ("b", "a")):
        count = pairs.groupBy(side).agg(F.count("*").alias("rows"))
        shares = cut(count.withColumn("shares", F.ceil(F.col("rows") / SHARE).cast("int")))
        most = shares.where("shares > 1")
        dealt = lookup(out, most, side, "rows").withColumn("share", F.pmod(F.xxhash64(other), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
        copies = shares.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select(side, "share")
        columns_of = nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        out = dealt.join(columns_of.join(copies, side).hint("merge"), [side, "share"]).drop("share")
    return out


def _with_low(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b, agree`` of pairs ``a, b``: set sizes and the number of equal coordinates."""
    joined = _both_sides(pairs.select("a", "b"), nodes, ["low", "n"])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("agree", pa.int32())])

    def count(batch):
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("low_a", "low_b"))
        agree = pa.array((left == right).sum(axis=1).astype(np.int32))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "n_a", "n_b")), agree], schema=schema)

    return _map_arrow(joined.select("a", "b", "n_a", "n_b", "low_a", "low_b"), count, "a long, b long, n_a long, n_b long, agree int")


def _plausible(percent: int, coordinates: int = COORDINATES) -> int:
    """Equal coordinates that a pair at the threshold has but for a chance under ``MISS``: 4.8 standard deviations less."""
    t = percent / 100
    return math.floor((t - 4.8 * math.sqrt(t * (1 - t) / coordinates)) * coordinates)


def _close_sizes(percent: int):
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _sets(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``node, shingles`` of each of ``nodes``: its full set; written.

    The one time that texts are read again.  A row that stands for a node is
    known by its id and text key.  Texts of other rows are left out by a filter of
    fixed size before the join, which is a merge at every size.
    """
    needed = cut(nodes.select("node", "rep_id", "rep_key"))
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")
    same = F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("key") == F.col("rep_key"))
    texts = maybe_in(keyed, "key", needed.select("rep_key")).join(needed.hint("merge"), same).select("node", "text")

    def make():
        return lambda node, text: {"node": node, "shingles": [shingle_set(t, words).tobytes() for t in text]}

    sets = cut(map_texts(texts, ["node", "text"], make, "node long, shingles binary"))
    # Rows that repeat both id and text give their node several times; only such nodes are brought together.
    again = cut(sets.groupBy("node").count().where("count > 1").select("node"))
    if again.isEmpty():
        return sets
    once = sets.join(again, "node", "left_anti")
    return cut(once.unionByName(sets.join(again, "node", "left_semi").dropDuplicates(["node"])))


def _sketches(labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, small, wide`` for the nodes still in question; written.

    ``small``: the low 32 bits of each shingle hash, for sets up to ``SMALL``.
    ``wide``: low bytes of ``WIDE`` coordinates, for sets that can meet larger ones.
    """

    def make():
        def step(node, shingles):
            small, wide = [], []
            for found in (np.frombuffer(x, np.uint64) for x in shingles):
                small.append(np.unique(found.astype(np.uint32)).tobytes() if len(found) <= SMALL else None)
                wide.append((signature(found, WIDE) & 0xFF).astype(np.uint8).tobytes() if 100 * len(found) > percent * SMALL else None)
            return {"node": node, "small": small, "wide": wide}

        return step

    wanted = sets.join(labelled.select("node").distinct().hint("merge"), "node", "left_semi")
    return cut(map_texts(wanted, ["node", "shingles"], make, "node long, small binary, wide binary"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets reach the threshold; written."""
    both = _both_sides(pairs.select("a", "b"), sets, ["shingles"])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batch):
        keep = []
        for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b")):
            left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            shared = len(np.intersect1d(left, right, assume_unique=True))
            keep.append(100 * shared >= percent * (len(left) + len(right) - shared))
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(keep))

    return cut(_map_arrow(both.select("a", "b", "shingles_a", "shingles_b"), check, "a long, b long").distinct())


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for the nodes of ``links (a, b)``; ``comp`` is the smallest node.

    Each round hooks every root to its smallest neighbouring root, then halves
    the paths; links contract to what still joins different roots.  Rounds are
    written, so lineage stays short and a lost executor costs one round; those
    of earlier rounds are deleted.
    """
    spark, since = links.sparkSession, mark()
    labels = cut(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")))
    while True:
        roots = labels.withColumnRenamed("node", "a").withColumnRenamed("comp", "x")
        others = labels.withColumnRenamed("node", "b").withColumnRenamed("comp", "y")
        open_links = links.join(roots, "a").join(others, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = cut(open_links)
        if links.isEmpty():
            return labels
        parent = cut(links.groupBy("b").agg(F.min("a").alias("up")).withColumnRenamed("b", "root"))
        while True:  # shorten paths until every parent is a root
            above = parent.select(F.col("root").alias("up"), F.col("up").alias("higher"))
            longer = parent.join(above, "up", "left")
            if longer.where("higher IS NOT NULL").isEmpty():
                break
            parent = cut(longer.select("root", F.coalesce("higher", "up").alias("up")))
        links = cut(links)
        labels = cut(labels.join(parent.withColumnRenamed("root", "comp"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))
        release(spark, since, keep=2)


def _closest(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (pivot ``a``, node ``b``), each node's two with the closest signatures; written."""
    from pyspark.sql import Window

    scored = _with_low(pairs.where("a <> b").distinct(), nodes).where(_close_sizes(percent) & (F.col("agree") >= _plausible(percent)))
    order = Window.partitionBy("b").orderBy(F.desc("agree"), "a")
    best = scored.withColumn("place", F.row_number().over(order)).where("place <= 2")
    return cut(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _first_pairs(members: DataFrame) -> DataFrame:
    """Nodes with the pivots of their two largest buckets.  A node is in one bucket per band at most."""
    own = members.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("size", "bucket", "pivot_1", "pivot_2")), asc=False).alias("buckets"))
    two = own.select("node", F.explode(F.slice("buckets", 1, 2)).alias("x"))
    return two.select(F.explode(F.array("x.pivot_1", "x.pivot_2")).alias("a"), F.col("node").alias("b"))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their components; written."""
    rows = cut(members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    still = rows.groupBy("bucket").agg(F.count("*").alias("rows"), (F.min("comp") != F.max("comp")).alias("open")).where("open")
    return cut(lookup(rows, cut(still), "bucket", "rows").where("open").drop("open"))


def _second_pairs(labelled: DataFrame) -> DataFrame:
    """Nodes with the pivots of their ``MORE`` largest open buckets that belong to other components; step 4 sees the rest."""
    comps = labelled.select(F.col("node").alias("a"), F.col("comp").alias("pivot_comp")).distinct()
    own = labelled.groupBy("node").agg(F.first("comp").alias("comp"), F.sort_array(F.collect_list(F.struct("size", "bucket", "pivot_1", "pivot_2")), asc=False).alias("buckets"))
    some = own.select("node", "comp", F.explode(F.slice("buckets", 1, MORE)).alias("x"))
    out = some.select(F.explode(F.array("x.pivot_1", "x.pivot_2")).alias("a"), F.col("node").alias("b"), "comp").distinct()
    return out.join(comps, "a").where("comp <> pivot_comp").select("a", "b")


def _cross_pairs(labelled: DataFrame, nodes: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """All plausible pairs of different components within a bucket; written."""
    still = cut(labelled.groupBy("bucket").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        lookup(labelled.select("bucket", "node", "comp"), still, "bucket", "size")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low_block", F.least("mine", "other"))
        .withColumn("high_block", F.greatest("mine", "other"))
        .join(nodes.select("node", "low", "n", "bands").join(sketches, "node").hint("merge"), "node")
    )
    n = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["bucket", "low_block", "high_block"]
    dealt = dealt.select(*order, "mine", "node", "comp", "n", "low", "bands", "small", "wide").repartition(n, *order).sortWithinPartitions(*order)
    least, wide_least = _plausible(percent), _plausible(percent, WIDE)

    def allowed(a, b) -> bool:
        """Whether the finer sketches allow the threshold; hashes that collide in 32 bits could hide two shingles."""
        if a["small"] is not None and b["small"] is not None:
            x, y = (np.frombuffer(r["small"], np.uint32) for r in (a, b))
            shared = len(np.intersect1d(x, y, assume_unique=True)) + 2
            return 100 * shared >= percent * (len(x) + len(y) - shared)
        x, y = (np.frombuffer(r["wide"], np.uint8) for r in (a, b))
        return int((x == y).sum()) >= wide_least

    def compare(rows):
        """Plausible pairs of one block pair: members of all but the largest component against the rest."""
        node, comp, size, mine = (np.array([r[k] for r in rows], np.int64) for k in ("node", "comp", "n", "mine"))
        low = np.frombuffer(b"".join(r["low"] for r in rows), np.uint8).reshape(-1, COORDINATES)
        bands = np.array([r["bands"] for r in rows], np.int64)
        band = int((bands[0] == rows[0]["bucket"]).argmax())
        comps, inverse, counts = np.unique(comp, return_inverse=True, return_counts=True)
        largest = counts.argmax()
        across = rows[0]["low_block"] != rows[0]["high_block"]
        for i in np.flatnonzero(inverse != largest):
            other = (inverse != inverse[i]) & ((inverse == largest) | (np.arange(len(node)) > i))
            other &= (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])) & (node != node[i])
            if across:
                other &= mine != mine[i]
            at = np.flatnonzero(other)
            at = at[(low[at] == low[i]).sum(axis=1) >= least]
            at = at[(bands[at] == bands[i]).argmax(axis=1) == band]
            for j in at:
                if allowed(rows[i], rows[j]):
                    yield min(node[i], node[j]), max(node[i], node[j])

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        rows, key, out = [], None, []
        for batch in batches:
            for r in batch.to_pylist():
                k = r["bucket"], r["low_block"], r["high_block"]
                if k != key:
                    if len(rows) > 1:
                        out.extend(compare(rows))
                    rows, key = [], k
                rows.append(r)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if len(rows) > 1:
            out.extend(compare(rows))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return cut(dealt.mapInArrow(run, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, survivors: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``.

    Links join documents whose sets of ``words``-word shingles have a Jaccard
    similarity of ``percent`` / 100 or more.  ``text_key`` (xxhash64 of the text)
    comes too, for callers that pick one row of a group; with ``survivors`` also
    ``survivor``, true for the one ``(doc_id, text_key)`` that stands for its group,
    whether its ids are null, repeated or neither.
    """
    signed = cut(_signed(docs, words, band_rows(percent / 100)))
    grouped = signed.where("n > 0").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("rep"),
        F.first("n").alias("n"),
        F.first("low").alias("low"),
        F.first("bands").alias("bands"),
    )
    # Node numbers are frozen by the write.
    nodes = cut(grouped.select("digest", F.monotonically_increasing_id().alias("node"), F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"), "n", "low", "bands"))
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = (
        placed.groupBy("bucket")
        .agg(
            F.count("*").alias("size"),
            F.min_by("node", F.xxhash64("bucket", "node")).alias("pivot_1"),
            F.max_by("node", F.xxhash64("bucket", "node")).alias("pivot_2"),
        )
        .where("size > 1")
    )
    found = lookup(placed, cut(buckets.withColumn("rows", F.col("size"))), "bucket", "rows")
    members = cut(found.where("size IS NOT NULL").select("bucket", "node", "size", "pivot_1", "pivot_2"))
    # All that follows is about nodes that share a bucket.
    shared = cut(nodes.join(members.select("node").distinct(), "node", "left_semi"))
    sets = _sets(shared, docs, words)
    links = _confirm(_closest(_first_pairs(members), shared, percent), sets, percent)
    labels = components(links)
    labelled = _labelled(members, labels)
    second = _confirm(_closest(_second_pairs(labelled), shared, percent), sets, percent)
    if not second.isEmpty():
        links = links.unionByName(second)
        labels = components(links)
        labelled = _labelled(labelled.drop("comp"), labels)
    sketches = _sketches(labelled, sets, percent)
    last = _confirm(_cross_pairs(labelled, shared, sketches, percent), sets, percent)
    if not last.isEmpty():
        labels = components(links.unionByName(last))
    marked = nodes.select("digest", "node", "rep_id", *(["rep_key"] if survivors else [])).join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = F.struct(F.col("rep_id").isNull().alias("no_id"), "rep_id", "rep_key")
    # Single nodes keep their own smallest id; only nodes with links meet in a group.
    smallest = marked.join(labels.select(F.col("comp").alias("c")).distinct(), marked["comp"] == F.col("c"), "left_semi").groupBy("comp").agg(F.min("rep_id").alias("least_id"), *([F.min(first).alias("first")] if survivors else []))
    ids = marked.join(smallest, "comp", "left").select("digest", F.coalesce("least_id", "rep_id").alias("component"), *([F.coalesce("first", first).alias("first")] if survivors else []))
    survivor = (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("first.rep_id")) & (F.col("text_key") == F.col("first.rep_key")))
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return (
        signed.select("doc_id", "text_key", "n", "digest")
        .join(cut(ids), "digest", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key", *([survivor.alias("survivor")] if survivors else []))
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate group, all columns as they are.

    It is the row of the group's smallest id, of the smallest text key among
    several texts of that id or where all ids are null; of rows that repeat id
    and text, the first.
    """
    found = cut(near_duplicates(docs, words, percent, survivors=True).select("doc_id", "text_key", F.col("survivor").alias("kept")))
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_key"))
    kept = without(docs, key, found.where("NOT kept").select(F.struct("doc_id", "text_key")))
    repeated = cut(found.where("kept").groupBy("doc_id", "text_key").count().where("count > 1").select(F.struct("doc_id", "text_key").alias("row")))
    if repeated.isEmpty():
        return kept
    name = f"__{uuid.uuid4().hex}"
    once = without(kept, key, repeated)
    again = without(kept, key, repeated, anti=False).withColumn(name, F.xxhash64("text")).dropDuplicates(["doc_id", name])
    return once.unionByName(again.select(*docs.columns))
