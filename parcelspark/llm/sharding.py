"""Operator 4: sharding by extendible hashing.

A directory is indexed by the leading bits of a document's hash.  A bucket
whose bytes exceed the limit splits on its next bit, and only such buckets do,
until every shard fits.  Bytes are summed by hash prefix, and prefixes rolled up
bit by bit, in Spark; only the finished shards come to the driver, as arrays of
numbers (40 bytes each, and at most a few times total bytes / limit of them).

The hash is that of ``doc_id``; of the text where the id is null.  Rows that
share all 64 bits (repeats of one id) and together exceed the limit go on
splitting by a hash of their row number, frozen when sizes are written.  Only
a single row beyond the limit makes a shard beyond it: it is alone there, and
``over_limit`` is true.  Null texts have 0 bytes.  One row comes back per
input row.  An empty table has no shards.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcelspark.llm.common import bytes_of, cut, small_batches

SHARD_BYTES = 64 << 20
#: Bits that one grouped sum resolves beyond those that equal shards would take.
SPARE = 3
BITS = 128
DIRECTORY = "depth int, p0 long, p1 long, n_bytes long, n_docs long"


def _prefix(depth: int):
    """The first ``depth`` of 128 bits held in ``h0`` and ``h1``, as (long, long)."""
    if depth <= 64:
        return [F.shiftrightunsigned("h0", 64 - depth), F.lit(0).cast("long")]
    return [F.col("h0"), F.shiftrightunsigned("h1", BITS - depth)]


def build_directory(sized: DataFrame, limit: int) -> pa.Table:
    """Buckets that cover all hashes of ``sized (h0, h1, n_bytes)``, as rows of ``DIRECTORY``; empty for an empty table.

    A bucket is closed if it fits the limit, holds a single row, or has used all
    bits.  Each round resolves some bits of the buckets still open.
    """
    spark = sized.sparkSession
    total, rows = sized.agg(F.sum("n_bytes"), F.count("*")).first()
    one = spark.createDataFrame([(0, 0, 0, total, rows)] if rows else [], DIRECTORY)
    if not rows or total <= limit or rows == 1:
        return one.toArrow()
    closed = (F.col("n_bytes") <= limit) | (F.col("n_docs") == 1) | (F.col("depth") == BITS)
    depth, most, large, parts = 0, total, one.select("depth", "p0", "p1"), []
    while most:
        fine = depth + min(max(1, math.ceil(math.log2(most / limit)) + SPARE), (64 if depth < 64 else BITS) - depth)
        below = sized
        if depth:
            at = _prefix(depth)
            below = sized.join(large.drop("depth"), (at[0] == F.col("p0")) & (at[1] == F.col("p1")), "left_semi")
        cells = below.groupBy(*[c.alias(n) for c, n in zip(_prefix(fine), ("p0", "p1"))]).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs"))
        up = cells.withColumn("depth", F.explode(F.sequence(F.lit(depth + 1), F.lit(fine))))
        moved = "p0" if fine <= 64 else "p1"
        up = up.withColumn(moved, F.call_function("shiftrightunsigned", F.col(moved), F.lit(fine) - F.col("depth")))
        sums = cut(up.groupBy("depth", "p0", "p1").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_docs").alias("n_docs")))
        # Sums only shrink on the way down, so whatever is above an open bucket is open too.
        opened = large.unionByName(sums.where(~closed & (F.col("depth") < fine)).select("depth", "p0", "p1"))
        child = opened.select((F.col("depth") + 1).alias("depth"), "p0", "p1", F.explode(F.array(F.lit(0), F.lit(1))).alias("bit"))
        child = child.withColumn(moved, F.shiftleft(moved, 1).bitwiseOR(F.col("bit"))).drop("bit")
        found = cut(child.join(sums, ["depth", "p0", "p1"], "left").fillna(0, ["n_bytes", "n_docs"]))
        parts.append(found.where(closed).select("depth", "p0", "p1", "n_bytes", "n_docs").toArrow())
        large = found.where(~closed & (F.col("depth") == fine))
        most = large.agg(F.max("n_bytes")).first()[0]
        large, depth = large.select("depth", "p0", "p1"), fine
    return pa.concat_tables(parts)


def _starts(leaves: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least hash of each bucket as high and low 64 bits, and the buckets in that order."""
    depth = leaves["depth"].to_numpy().astype(np.uint64)
    p0, p1 = (leaves[c].to_numpy().view(np.uint64) for c in ("p0", "p1"))

    def left(x, by):
        return np.where(by > 63, np.uint64(0), x << np.minimum(by, np.uint64(63)))

    shallow = depth <= 64
    high = np.where(shallow, left(p0, np.uint64(64) - np.minimum(depth, np.uint64(64))), p0)
    low = np.where(shallow, np.uint64(0), left(p1, np.uint64(BITS) - np.maximum(depth, np.uint64(64))))
    order = np.lexsort((low, high))
    return high[order], low[order], order


def assign(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, over_limit``.

    ``shard`` spells the bucket's bits after a ``b``, so that it reads back as text
    wherever it names a folder.  The directory is sent to the tasks as arrays.
    """
    sized = cut(_sized(docs, F.col("doc_id")))
    return _placed(sized, limit)


def _sized(docs: DataFrame, *more) -> DataFrame:
    """``more``, and ``n_bytes, h0, h1``; to be written, which freezes ``h1``."""
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    sized = docs.select(*more, bytes_of("text").alias("n_bytes"), own.alias("h0"), F.monotonically_increasing_id().alias("row"))
    return sized.withColumn("h1", F.xxhash64("row", F.lit("row"))).drop("row")


def _placed(sized: DataFrame, limit: int) -> DataFrame:
    """The columns of ``sized`` but for its hashes, with each row's shard."""
    leaves = build_directory(sized.select("h0", "h1", "n_bytes"), limit)
    high, low, order = _starts(leaves)
    about = [leaves[c].to_numpy()[order] for c in ("depth", "p0", "p1", "n_bytes", "n_docs")]
    sent = sized.sparkSession.sparkContext.broadcast((high, low, about, limit))
    own = [c for c in sized.columns if c not in ("h0", "h1")]
    small_batches(sized.sparkSession)

    def run(batches):
        high, low, (depth, p0, p1, n_bytes, n_docs), limit = sent.value

        def name(i) -> str:
            d, bits = int(depth[i]), int(p0[i]) & (1 << 64) - 1
            if d > 64:
                bits = bits << d - 64 | int(p1[i])
            return "b" + (format(bits, f"0{d}b") if d else "")

        for batch in batches:
            if not batch.num_rows:
                continue
            h0, h1 = (np.array(batch.column(c), np.int64).view(np.uint64) for c in ("h0", "h1"))
            at = np.searchsorted(high, h0, side="right") - 1
            for i in np.flatnonzero(low[at] > 0):  # buckets deeper than 64 bits: all with this first half are neighbours
                first = np.searchsorted(high, high[at[i]], side="left")
                at[i] = first + np.searchsorted(low[first : at[i] + 1], h1[i], side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in own],
                    pa.array([name(i) for i in at], pa.string()),
                    pa.array(depth[at], pa.int32()),
                    pa.array(n_bytes[at], pa.int64()),
                    pa.array(n_docs[at], pa.int64()),
                    pa.array(n_bytes[at] > limit, pa.bool_()),
                ],
                names=[*own, "shard", "depth", "shard_bytes", "shard_docs", "over_limit"],
            )

    found_in = StructType.fromDDL("shard string, depth int, shard_bytes long, shard_docs long, over_limit boolean")
    return sized.mapInArrow(run, StructType([*sized.select(*own).schema.fields, *found_in.fields]))


def write_shards(docs: DataFrame, folder: str, limit: int = SHARD_BYTES) -> DataFrame:
    """Write ``docs`` under ``folder`` with a partition folder per shard; returns the assignment.

    The rows are written once with their frozen hashes, so each goes to the shard
    that the assignment gives it, rows of one id or of none included.
    """
    id_, doc, name = "doc_id", f"__{uuid.uuid4().hex}", "__shard"
    kept = cut(_sized(docs, id_, F.struct(*[docs[c] for c in docs.columns]).alias(doc)))
    while name in docs.columns:
        name += "_"
    placed = _placed(kept, limit)
    placed.select(f"{doc}.*", F.col("shard").alias(name)).repartition(name).write.partitionBy(name).parquet(folder)
    return placed.drop(doc)
