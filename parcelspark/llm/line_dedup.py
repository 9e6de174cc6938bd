"""Operator 11: dedup of lines that many documents hold, by two Bloom filters.

A line's key is the line without white space at its ends, A-Z in lower case.
Keys of ``LEAST_CHARS`` code points or more that ``LEAST_DOCS`` documents or more
hold lose their lines everywhere but in the largest ``doc_id`` that holds them.

1. ``seen_twice`` reads all lines once.  A task keeps two filters over the keys
   of its documents: bits that were set once, and bits that were set again.
   Filters of several tasks merge chunk by chunk (again = again of either, or
   once in both), so a key of two documents always has all its bits in the second.
2. ``suspects`` reads the lines again; only keys that the second filter knows
   leave their task, as digests of 16 bytes of a cryptographic hash.
3. Suspects are counted exactly, with the largest id of each, before their
   occurrences meet the counts; what they lose goes to their documents.

Both filters have a fixed number of bits (``BITS``, 32 MB each), whatever the
corpus: one is broadcast, and no more than that.  Beyond some hundred million
keys more once-seen keys pass as suspects and are shuffled, and refused by the
exact count: a corpus far beyond that sets more bits, or shuffles up to 40 bytes
a line, as any exact count has to.  Counts and largest ids are combined before
the shuffle, and lookups spread hot keys (``common.lookup``), so a line that every
document holds is no hot key.

Rows: each row is a document.  A null text is an empty line; it and lines of
short keys never go.  Null ids rank below all others; a key that only rows of
null ids hold stays in all of them, as it stays in all rows of the largest id.
Equal rows lose the same lines.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import cut, lookup, map_texts, maybe_in, small_batches

LEAST_DOCS, LEAST_CHARS = 3, 20
#: Bits of each filter, set two a key; filters travel in chunks.
BITS = 1 << 28
CHUNK = 1 << 19
WHITE = b" \t\n\x0b\x0c\r"
_LATER_BYTES = bytes(range(0x80, 0xC0))  # of a code point in UTF-8


def keys_of(text: bytes | None, least: int) -> dict[bytes, list[int]]:
    """The keys of ``least`` code points or more of one text, and the lines of each."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or b"").split(b"\n")):
        if len(line) >= least:
            key = line.strip(WHITE).lower()  # of bytes: A-Z only
            if len(key) >= least and len(key.translate(None, _LATER_BYTES)) >= least:
                found.setdefault(key, []).append(i)
    return found


def bits_of(keys, bits: int) -> np.ndarray:
    """Two places in a filter for each key, one row a key."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)
    return np.stack((h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)), axis=1).astype(np.int64)


class Filters:
    """Bits seen once and bits seen again."""

    def __init__(self, bits: int):
        self.once, self.again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, places: np.ndarray) -> None:
        place, times = np.unique(places, return_counts=True)
        byte, bit = place >> 3, np.left_shift(1, place & 7).astype(np.uint8)
        seen = (times > 1) | ((self.once[byte] & bit) > 0)
        np.bitwise_or.at(self.again, byte[seen], bit[seen])
        np.bitwise_or.at(self.once, byte, bit)


def has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether both places of each row are set."""
    return ((bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)


PART = pa.schema([("chunk", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])


def seen_twice(docs: DataFrame, text_col: str = "text", least: int = LEAST_CHARS, bits: int = BITS) -> np.ndarray:
    """The second filter: all bits of every key that two rows or more hold."""
    spark = docs.sparkSession
    small_batches(spark)
    size = min(CHUNK, bits) // 8

    def packed(x):
        return pa.compress(x.tobytes(), codec="zstd", asbytes=True)

    def unpacked(x):
        return np.frombuffer(pa.decompress(x, size, codec="zstd", asbytes=True), np.uint8)

    def build(batches):
        filters = Filters(bits)
        for batch in batches:
            keys = [k for t in batch.column(0).to_pylist() for k in keys_of(t, least)]
            if keys:
                filters.add(bits_of(keys, bits))
        for i in range(0, bits // 8, size):
            once = filters.once[i : i + size]
            if once.any():
                row = {"chunk": [i // size], "once": [packed(once)], "again": [packed(filters.again[i : i + size])]}
                yield pa.RecordBatch.from_pydict(row, schema=PART)

    def merge(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for chunk, once, again in zip(*(c.to_pylist() for c in batch.columns)):
                once, again = unpacked(once), unpacked(again)
                if chunk in held:
                    a, b = held[chunk]
                    once, again = a | once, b | again | (a & once)
                held[chunk] = once, again
        for chunk, (_, again) in held.items():
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "once": [b""], "again": [packed(again)]}, schema=PART)

    parts = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(build, "chunk int, once binary, again binary")
    whole = np.zeros(bits // 8, np.uint8)
    by_chunk = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
    for row in by_chunk.mapInArrow(merge, "chunk int, once binary, again binary").select("chunk", "again").collect():
        whole[row["chunk"] * size : (row["chunk"] + 1) * size] = unpacked(row["again"])
    return whole


def suspects(docs: DataFrame, known: np.ndarray, least: int = LEAST_CHARS) -> DataFrame:
    """``node, doc_id, digest, lines`` of each row's keys that ``known`` has, from ``node, doc_id, text binary``."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def make():
        known = sent.value
        bits = 8 * len(known)

        def step(node, doc_id, text):
            found = [list(keys_of(t, least).items()) for t in text]
            every = [key for keys in found for key, _ in keys]
            passed = iter(has(known, bits_of(every, bits)).tolist() if every else ())
            out = [[(hashlib.blake2b(k, digest_size=16).digest(), lines) for k, lines in keys if next(passed)] for keys in found]
            return {"node": node, "doc_id": doc_id, "found": [[{"digest": d, "lines": lines} for d, lines in keys] for keys in out]}

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_texts(docs, ["node", "doc_id", "text"], make, f"node binary, doc_id {kind}, found array<struct<digest:binary,lines:array<int>>>")
    return rows.where(F.size("found") > 0).select("node", "doc_id", F.explode("found").alias("x")).select("node", "doc_id", "x.*")


def lost_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least: int = LEAST_CHARS, bits: int = BITS) -> DataFrame:
    """``node, lines, copies`` of the rows that lose lines, from ``node, doc_id, text binary``; rows of one ``node`` are equal."""
    found = cut(suspects(docs, seen_twice(docs, "text", least, bits), least))
    repeats = cut(found.groupBy("digest").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= least_docs))
    lost = lookup(found, repeats, "digest", "docs").where(F.col("keeper").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper"))))
    # equal rows have equal arrays of lines, each of its own key
    sets = F.collect_set("lines")
    return cut(lost.groupBy("node").agg(F.flatten(sets).alias("lines"), (F.count("*") / F.size(sets)).cast("long").alias("copies")))


def without_repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least: int = LEAST_CHARS, bits: int = BITS) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: the text that is left, lines before, and lines that went."""
    name = {c: f"__{uuid.uuid4().hex}" for c in ("node", "hash")}
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "text", F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text))).alias("node"))
    lost = lost_lines(rows.select("node", "doc_id", F.col("text").cast("binary").alias("text")), least_docs, least, bits)
    rows = rows.withColumn(name["hash"], F.xxhash64("node"))
    # rows that a filter of fixed size lets pass join what they lose; the others stay as they are
    passed = maybe_in(rows, name["hash"], lost.select(F.xxhash64("node")), flag=name["node"])
    whole = passed.where(~F.col(name["node"])).select("doc_id", text.alias("text"), (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))

    def make():
        def step(doc_id, text, lines):
            out = {"doc_id": doc_id, "text": [], "n_lines": [], "n_dropped": []}
            for t, gone in zip(text, lines):
                every, gone = (t or "").split("\n"), set(gone or ())
                out["text"].append("\n".join([x for i, x in enumerate(every) if i not in gone]) if gone else t or "")
                out["n_lines"].append(len(every))
                out["n_dropped"].append(len(gone))
            return out

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    edited = lookup(passed.where(name["node"]).select("node", "doc_id", "text"), lost, "node", "copies", merge=True)
    return whole.unionByName(map_texts(edited, ["doc_id", "text", "lines"], make, f"doc_id {kind}, text string, n_lines long, n_dropped long"))


def line_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256``."""
    return without_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
