"""Operator 10: token ids in length-delimited binary records with an offset index.

File format of a part, little-endian throughout:

* header: ``PSQR``, one byte version (1), one byte id width (2 or 4 bytes);
* a record for each document: length of the payload (u64), masked checksum of
  those 8 bytes (u32), payload (the ids), masked checksum of the payload (u32);
* beside it ``.idx``: one fixed entry a record (``INDEX``): doc_id, whether it
  is null, byte offset of the record, ids before it within the part.  A reader
  that shuffles picks entries at random and seeks.

The masked checksum is crc32 rotated right by 15 bits plus a constant, so that
a file of records within a record does not check itself.

Parts follow ascending doc_id (range partitioning, sorted within the part;
null ids first, equal ids by a hash of their text, which also spreads them over
parts), so a part's place fixes the ids before it.
A part is written under an attempt's own name and then moved, so a retried or
doubled task leaves one whole file.  The folder must be one that all executors
reach; any URI that ``pyarrow.fs`` opens will do.

Rows: a null text is an empty document, which is the end id alone; repeated
rows are documents of their own; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.llm.common import shared_dir, small_batches, tokenizer_path
from parcelspark.llm.rank_bpe import WordBPE

END_ID = 2
MAGIC = b"PSQR\x01"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("start", "<u8")])
#: Records that one row of a read stage covers.
SLICE = 2048


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def read_frame(stream) -> bytes:
    """The payload at the stream's place; raises ValueError where a checksum fails."""
    head = stream.read(12)
    length, crc = struct.unpack("<QI", head)
    if masked_crc(head[:8]) != crc:
        raise ValueError("length checksum")
    payload = stream.read(length)
    if struct.unpack("<I", stream.read(4))[0] != masked_crc(payload):
        raise ValueError("payload checksum")
    return payload


class LibraryBPE(WordBPE):
    """Pieces are encoded by the ``tokenizers`` library's model, once each while cached."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model

    def piece(self, piece: str) -> bytes:
        letters = self.merges.letters
        found = self.model.tokenize("".join([letters[b] for b in piece.encode("utf-8")]))
        return np.array([t.id for t in found], "<u4").tobytes()


_LOADED: dict[str, LibraryBPE] = {}


def library_bpe(path: str) -> LibraryBPE:
    if path not in _LOADED:
        _LOADED[path] = LibraryBPE(path)
    return _LOADED[path]


def _open(uri: str):
    return pa.fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, parts: int | None = None, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to ``folder``; returns the parts: ``part, uri, n_docs, n_tokens, start``.

    ``start``: ids in all earlier parts.  The list of parts is the only thing
    that comes to the driver: one short row per part.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path("word_bpe_49k.json")
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        bpe = library_bpe(path)
        width = 2 if max(bpe.merges.names) < 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}.rec"
        fs, at = _open(uri)
        own = f"{at}.{uuid.uuid4().hex}"
        n_docs = n_tokens = 0
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(own, buffer_size=1 << 20) as data, fs.open_output_stream(own + ".idx", buffer_size=1 << 20) as index:
            head = MAGIC + bytes([width])
            data.write(head)
            offset = len(head)
            for batch in batches:
                entries = np.zeros(batch.num_rows, INDEX)
                for i, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                    ids = np.frombuffer(bpe.encode(text or "") + end, "<u4")
                    record = frame(ids.astype(f"<u{width}").tobytes())
                    data.write(record)
                    entries[i] = (key or 0, key is None, offset, n_tokens)
                    offset += len(record)
                    n_tokens += len(ids)
                index.write(entries.tobytes())
                n_docs += batch.num_rows
        fs.move(own + ".idx", at + ".idx")
        fs.move(own, at)
        yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "n_docs": [n_docs], "n_tokens": [n_tokens]}, schema=PARTS)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    rows = sorted((tuple(r) for r in ordered.mapInArrow(write, "part int, uri string, n_docs long, n_tokens long").collect()))
    starts = np.cumsum([0, *(r[3] for r in rows)]).tolist()
    return spark.createDataFrame([(*r, s) for r, s in zip(rows, starts)], "part int, uri string, n_docs long, n_tokens long, start long")


PARTS = pa.schema([("part", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def read_records(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """``doc_id, start, ids binary`` (unsigned 32-bit, the end id with them) from written parts.

    Work is dealt out in slices of ``SLICE`` records, found through the index.
    """
    small_batches(spark)
    slices = parts.where("n_docs > 0").select("uri", "start", F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(SLICE))).alias("first"))
    slices = slices.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uri", "first")

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = _open(row["uri"])
                with fs.open_input_file(at + ".idx") as index:
                    index.seek(row["first"] * INDEX.itemsize)
                    entries = np.frombuffer(index.read(SLICE * INDEX.itemsize), INDEX)
                with fs.open_input_file(at) as data:
                    width = data.read(len(MAGIC) + 1)[-1]
                    for few in np.array_split(entries, max(1, len(entries) // 128)):
                        ids = []
                        for e in few:
                            data.seek(int(e["offset"]))
                            ids.append(np.frombuffer(read_frame(data), f"<u{width}").astype("<u4").tobytes())
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([None if e["null"] else int(e["doc_id"]) for e in few], pa.int64()),
                                pa.array([row["start"] + int(e["start"]) for e in few], pa.int64()),
                                pa.array(ids, pa.binary()),
                            ],
                            schema=READ,
                        )

    return slices.mapInArrow(read, "doc_id long, start long, ids binary")


def record_report(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write, read back, and report ``doc_id, start, n_tokens, ids_crc32``."""
    spark = docs.sparkSession
    parts = write_records(docs, folder or shared_dir(spark))
    return read_records(spark, parts).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
