"""Operator 12: alignment of two tokenizers by counts of linked id pairs.

A text with a space before it is cut into tokens twice, by a byte-level file (A)
and by a piece model (B).  Byte offsets where both have a token end cut the
tokens into groups; an A and a B token of one group are linked.  An id pair is
one int64, ``a << 32 | b``.

1. ``align`` encodes each text once and keeps, beside the digests, its distinct
   pairs with their multiplicities (sorted, packed, compressed), in the shared
   folder.  Neither library's tokens cross from a character that is not white
   space to a space, so a text is cut there, and each distinct stretch of a
   batch is encoded once and kept in a bounded cache.
2. ``count_pairs`` merges the pairs of a partition by ``np.unique`` into partial
   counts, range-partitions and sorts them, and sums runs: each partition
   writes one shard of sorted keys and counts.
3. ``link_report`` maps the shards into memory and finds the counts of a batch's
   pairs with ``np.searchsorted``; nothing of the corpus's pairs is broadcast but
   one place a shard and the highest count of each A id (a vocabulary's length).

A pair's partial counts are one row a task at most (for each ``PAIRS`` distinct
pairs it holds), so a pair that all documents share is no hot key.  A shard is
written under an attempt's own name and then moved, so a lost or doubled task
leaves one whole shard.

Rows: a null or empty text has no tokens, as has one whose tokens' joined bytes
are not the text's (B reads U+2581 as a space); their counts are zero and their
digest is ''.  One row per input row; repeated rows are documents of their own
and count so; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.llm.common import cut, map_texts, shared_dir, small_batches, tokenizer_path
from parcelspark.llm.rank_bpe import byte_letters

#: Distinct pairs that a task holds before it hands on their partial counts: 64 MB.
PAIRS = 4_000_000
#: Stretches that a worker keeps, and the longest of them in characters.
KEPT, LONGEST = 500_000, 32
KEPT_LINKS = 4_000_000
#: Groups of more links than this are counted by distinct ids instead of link by link.
MANY = 64
#: Stretches that are encoded in one piece, and that are put together at once.
JOINED = 256
RUN = 200_000

#: A place where both tokenizers always have a token's end.
CUT = re.compile(r"(?<=\S)(?= )")
#: White space before a space, where there is no such place.
MET = re.compile(r"\s ")
B_SHIFT = 32
B_MASK = (1 << B_SHIFT) - 1


class Aligner:
    """Tokens, groups and links of texts under two tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letter = {c: n for n, c in enumerate(byte_letters())}
        size_a = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        names = [self.a.id_to_token(i) or "" for i in range(size_a)]
        self.bytes_a = [bytes(letter[c] for c in n) if all(c in letter for c in n) else n.encode("utf-8") for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of B joins a word to a space after it, so texts cannot be cut there")
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # how a token is written: first of a group, later in it, first of B's, later of B's
        self.written = [f"{mark}{i}" for mark, n in ((";", size_a), (",", size_a), ("|", len(pieces)), (",", len(pieces))) for i in range(n)]
        self.base = np.cumsum([0, size_a, size_a, len(pieces)])
        self.place: dict[str, int] = {}
        self.known = Known()

    def stretches(self, text: str) -> list[str]:
        """``' ' + text`` cut where both tokenizers have an end, each stretch without the space it begins with."""
        parts = text.split(" ")
        if "" not in parts and not MET.search(text):
            return parts
        parts = [p[1:] for p in CUT.split(" " + text)]
        if len(parts) > 1 and not parts[-1].strip(" "):  # trailing spaces stay with what precedes them
            tail = parts.pop()
            parts[-1] += " " + tail
        return parts

    def read(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the places of its stretches in ``known``; -1 for one that does not keep its bytes."""
        split = [self.stretches(t) if t else [] for t in texts]
        every = set(chain.from_iterable(split))
        missing = list(every - self.place.keys())
        if len(self.place) + len(missing) > KEPT or self.known.key.size > KEPT_LINKS:
            self.place, self.known = {}, Known()
            missing = list(every)
        missing.sort(key=loose)
        self.place.update(zip(missing, self.learn(missing)))
        out = [np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts)) for parts in split]
        for s in missing:
            if len(s) > LONGEST:
                del self.place[s]
        return out

    def tokens(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """Ids of all stretches under A and B, end to end, and which stretches keep their bytes; others give none.

        Stretches are encoded joined by the spaces they begin with, as their ends
        are ends of both; where the bytes differ, or a stretch's end would meet the
        next one's space, each by itself.
        """
        texts = [" ".join(stretches[i : i + JOINED]) for i in range(0, len(stretches), JOINED)]
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        a, b, kept = [], [], []
        for k, (text, x) in enumerate(zip(texts, ids_a)):
            y, some = self.b.encode(text), stretches[k * JOINED : (k + 1) * JOINED]
            same = b"".join(map(self.bytes_a.__getitem__, x)) == (" " + text).encode("utf-8") == b"".join(map(self.bytes_b.__getitem__, y))
            if len(some) > 1 and not (same and not loose(some[-1])):
                for s in some:
                    one = self.tokens([s])
                    a.append(one[0]), b.append(one[1]), kept.extend(one[2])
                continue
            a.append(np.array(x if same else [], np.int64)), b.append(np.array(y if same else [], np.int64)), kept.extend([same] * len(some))
        return np.concatenate(a), np.concatenate(b), kept

    def learn(self, stretches: list[str]) -> list[int]:
        """Groups and links of new stretches are put into ``known``; returns their places there."""
        if not stretches:
            return []
        a, b, kept = self.tokens(stretches)
        stretches = [s for s, k in zip(stretches, kept) if k]
        first = len(self.known)
        if stretches:
            self.known.add(*self.groups(a, b, np.cumsum([1 + len(s.encode("utf-8")) for s in stretches])))
        places = iter(range(first, len(self.known)))
        return [next(places) if k else -1 for k in kept]

    def groups(self, a: np.ndarray, b: np.ndarray, text_ends: np.ndarray):
        """Groups and links of texts laid end to end, as the columns of ``Known``."""
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends_a, ends_b = np.zeros(end_a[-1] + 1, bool), np.zeros(end_a[-1] + 1, bool)
        ends_a[end_a] = ends_b[end_b] = True
        last_a, last_b = ends_b[end_a], ends_a[end_b]  # the last token of its group
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n_a, n_b = np.bincount(group_a), np.bincount(group_b)
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        # written groups: A's tokens of a group, then B's
        order = np.empty(len(a) + len(b), np.int64)
        new_a, new_b = np.diff(group_a, prepend=-1) > 0, np.diff(group_b, prepend=-1) > 0
        order[np.arange(len(a)) + first_b[group_a]] = a + np.where(new_a, self.base[0], self.base[1])
        order[np.arange(len(b)) + (first_a + n_a)[group_b]] = b + np.where(new_b, self.base[2], self.base[3])
        # links of small groups one by one, of large ones by distinct ids
        n_links = n_a * n_b
        per_a = np.where(n_links <= MANY, n_b, 0)[group_a]
        key = np.repeat(a << B_SHIFT, per_a) | b[spans(first_b[group_a], per_a)]
        times, of = np.ones(len(key), np.int64), np.repeat(group_a, per_a)
        for g in np.flatnonzero(n_links > MANY):
            (x, times_x), (y, times_y) = (np.unique(t, return_counts=True) for t in (a[first_a[g] : first_a[g] + n_a[g]], b[first_b[g] : first_b[g] + n_b[g]]))
            key = np.concatenate((key, ((x[:, None] << B_SHIFT) | y[None]).ravel()))
            times = np.concatenate((times, (times_x[:, None] * times_y[None]).ravel()))
            of = np.concatenate((of, np.full(len(x) * len(y), g)))
        if (n_links > MANY).any():
            by_group = np.argsort(of, kind="stable")
            key, times, of = key[by_group], times[by_group], of[by_group]
        # cut by text
        groups = 1 + group_a[np.searchsorted(end_a, text_ends)]
        to_a, to_b, to_key = np.cumsum(n_a)[groups - 1], np.cumsum(n_b)[groups - 1], np.searchsorted(of, groups)
        sizes = [np.diff(x, prepend=0) for x in (to_a, to_b, groups, np.cumsum(n_links)[groups - 1], to_key)]
        return order, key, times, np.stack(sizes)

    def align(self, texts: list[str | None]) -> list[tuple]:
        """For each text ``n_a, n_b, n_groups, n_links, digest, n_pairs, pairs, times``."""
        out = []
        for places in self.read(texts):
            one = Aligned()
            if not (places < 0).any():
                for at in range(0, len(places), RUN):
                    one.add(*self.known.take(places[at : at + RUN]), self.written)
            out.append(one.result())
        return out


def loose(stretch: str) -> bool:
    """Whether a space after it would join it."""
    return not stretch or stretch[-1].isspace()


def spans(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places ``first, first + 1, ...`` of spans laid end to end."""
    end = np.cumsum(length)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(first - end + length, length)


class Column:
    """An array that grows at its end."""

    def __init__(self, rows: tuple[int, ...] = ()):
        self.space, self.size = np.zeros((*rows, 1 << 16), np.int64), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + values.shape[-1]
        if need > self.space.shape[-1]:
            grown = np.zeros((*self.space.shape[:-1], 2 * need), np.int64)
            grown[..., : self.size] = self.space[..., : self.size]
            self.space = grown
        self.space[..., self.size : need] = values
        self.size = need


class Known:
    """Groups and links of known stretches, each column end to end."""

    def __init__(self):
        self.order, self.key, self.times = Column(), Column(), Column()
        self.sizes = Column((7,))  # A tokens, B tokens, groups, links, distinct links, first place in order, in key

    def __len__(self) -> int:
        return self.sizes.size

    def add(self, order, key, times, sizes) -> None:
        n = sizes[0] + sizes[1]
        self.sizes.extend(np.stack((*sizes, self.order.size + np.cumsum(n) - n, self.key.size + np.cumsum(sizes[4]) - sizes[4])))
        for column, values in ((self.order, order), (self.key, key), (self.times, times)):
            column.extend(values)

    def take(self, places: np.ndarray):
        """Sizes, written groups, keys and times of the stretches at ``places``."""
        sizes = self.sizes.space[:, places]
        links = spans(sizes[6], sizes[4])
        return sizes.sum(axis=1)[:4], self.order.space[spans(sizes[5], sizes[0] + sizes[1])], self.key.space[links], self.times.space[links]


class Aligned:
    """What is known of one text, part by part."""

    def __init__(self):
        self.counts, self.digest, self.pairs = np.zeros(4, np.int64), None, []

    def add(self, counts, order, keys, times, written: list[str]) -> None:
        self.counts = self.counts + counts
        text = "".join([written[w] for w in order.tolist()])
        if self.digest is None:
            self.digest, text = hashlib.sha256(), text[1:]
        self.digest.update(text.encode())
        plain = times.max(initial=1) == 1
        self.pairs.append(np.unique(keys, return_counts=True) if plain else merged([(keys, times)]))
        if len(self.pairs) > 1:
            self.pairs = [merged(self.pairs)]

    def result(self) -> tuple:
        keys, times = self.pairs[0] if self.pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return *self.counts.tolist(), self.digest.hexdigest() if self.digest else "", len(keys), pack(keys), pack(times)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several (keys, weights), and their summed weights."""
    keys, weights = np.concatenate([k for k, _ in parts]), np.concatenate([w for _, w in parts])
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights[:0]


def pack(values: np.ndarray) -> bytes:
    """Ascending or small int64 values as differences, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(np.diff(values, prepend=0)).view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T
    return np.cumsum(np.ascontiguousarray(planes).view(np.int64).ravel())


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's own aligner; kept between tasks."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_pairs, pairs binary, times binary``, written to the shared folder.

    ``pairs`` and ``times``: the document's distinct pairs and the links of each, as ``pack`` makes them.
    """
    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")

    def make():
        model = aligner(path_a, path_b)

        def step(key, text):
            names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "pairs", "times")
            return {"doc_id": key} | dict(zip(names, map(list, zip(*model.align(text)))))

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return cut(map_texts(docs, [id_col, text_col], make, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, pairs binary, times binary"))


COUNTS = pa.schema([("key", pa.int64()), ("n", pa.int64())])
SHARD = "part int, uri string, n long, first long, ids binary, best binary"


def count_pairs(aligned: DataFrame, folder: str | None = None, pairs: int = PAIRS) -> DataFrame:
    """Write the sorted shards to ``folder``; returns them: ``part, uri, n, first, ids, best``.

    ``<uri>.keys`` and ``<uri>.counts`` hold int64 values, little-endian.
    ``ids`` and ``best``: the A ids of the shard and the highest count of each, so
    that all shards together list little more than a vocabulary.
    """
    spark = aligned.sparkSession
    folder = folder or shared_dir(spark)
    small_batches(spark)

    def partial(batches):
        held, size = [], 0
        for batch in batches:
            found = [unpack(d, n) for d, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if not found:
                continue
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            held.append((keys, n))
            size += len(keys)
            if size > pairs:
                held = [merged(held)]
                if (size := len(held[0][0])) > pairs // 2:
                    yield from _slices(*held[0])
                    held, size = [], 0
        if size:
            yield from _slices(*merged(held))

    def write(batches):
        part = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{part:06d}"
        fs, at = pa.fs.FileSystem.from_uri(uri)
        own = f"{at}.{uuid.uuid4().hex}"
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        n, first, last, best = 0, None, None, {}

        def put(keys, counts):
            nonlocal n, first
            if len(keys):
                k.write(keys.astype("<i8").tobytes())
                c.write(counts.astype("<i8").tobytes())
                n += len(keys)
                first = int(keys[0]) if first is None else first
                ids = keys >> B_SHIFT
                at = np.flatnonzero(np.diff(ids, prepend=-1))
                for i, top in zip(ids[at].tolist(), np.maximum.reduceat(counts, at).tolist()):
                    best[i] = max(top, best.get(i, 0))

        with fs.open_output_stream(own + ".keys", buffer_size=1 << 20) as k, fs.open_output_stream(own + ".counts", buffer_size=1 << 20) as c:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                runs = [(keys, counts)] if last is None else [last, (keys, counts)]
                keys, counts = merged(runs)
                put(keys[:-1], counts[:-1])
                last = keys[-1:], counts[-1:]  # its run may go on in the next batch
            if last is not None:
                put(*last)
        fs.move(own + ".counts", at + ".counts")
        fs.move(own + ".keys", at + ".keys")
        ids = sorted(best)
        row = {"part": [part], "uri": [uri], "n": [n], "first": [first or 0], "ids": [np.array(ids, "<i8").tobytes()], "best": [np.array([best[i] for i in ids], "<i8").tobytes()]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("uri", pa.string()), ("n", pa.int64()), ("first", pa.int64()), ("ids", pa.binary()), ("best", pa.binary())]))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = aligned.where("n_pairs > 0").select("pairs", "n_pairs").mapInArrow(partial, "key long, n long")
    shards = counts.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(write, SHARD)
    return spark.createDataFrame(shards.collect(), SHARD).where("n > 0")


def _slices(keys: np.ndarray, counts: np.ndarray, rows: int = 65536):
    for i in range(0, len(keys), rows):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + rows]), pa.array(counts[i : i + rows])], schema=COUNTS)


class Shards:
    """Counts of pairs by ``np.searchsorted`` in the shards, each mapped into memory when first asked for."""

    def __init__(self, shards: list[tuple[int, str]]):
        ordered = sorted(shards)
        self.first, self.uris = np.array([f for f, _ in ordered], np.int64), [u for _, u in ordered]
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def columns(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            fs, at = pa.fs.FileSystem.from_uri(self.uris[i])
            if isinstance(fs, pa.fs.LocalFileSystem):
                self.open[i] = np.memmap(at + ".keys", "<i8", "r"), np.memmap(at + ".counts", "<i8", "r")
            else:  # a store that cannot be mapped: one shard is held at a time
                self.open = {i: tuple(np.frombuffer(fs.open_input_file(at + end).read(), "<i8") for end in (".keys", ".counts"))}
        return self.open[i]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct keys, 0 for unknown ones."""
        out = np.zeros(len(keys), np.int64)
        shard = np.searchsorted(self.first, keys, side="right") - 1
        edges = np.flatnonzero(np.diff(shard, prepend=-2, append=-2))
        for lo, hi in zip(edges[:-1], edges[1:]):
            if shard[lo] >= 0:
                known, n = self.columns(int(shard[lo]))
                at = np.minimum(np.searchsorted(known, keys[lo:hi]), len(known) - 1)
                out[lo:hi] = np.where(known[at] == keys[lo:hi], n[at], 0)
        return out


def link_report(aligned: DataFrame, shards: DataFrame) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per row of ``aligned``."""
    spark = aligned.sparkSession
    small_batches(spark)
    rows = shards.select("first", "uri", "ids", "best").collect()  # one row a shard; their ids are a vocabulary's
    places, best = [(r["first"], r["uri"]) for r in rows], np.zeros(1, np.int64)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<i8")
        best = np.concatenate((best, np.zeros(max(0, int(ids.max()) + 1 - len(best)), np.int64)))
        best[ids] = np.maximum(best[ids], np.frombuffer(r["best"], "<i8"))
    sent = spark.sparkContext.broadcast((places, best))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def make():
        places, best = sent.value
        counts = Shards(places)

        def step(*columns):
            *plain, n_pairs, pairs, times = columns
            each = [unpack(p, n) for p, n in zip(pairs, n_pairs)]
            known = np.unique(np.concatenate(each))
            count = counts.counts(known)
            top = count == best[known >> B_SHIFT] if len(known) else count
            n_best, total = [], []
            for keys, t, n in zip(each, times, n_pairs):
                at, t = np.searchsorted(known, keys), unpack(t, n)
                n_best.append(int(t[top[at]].sum()) if n else 0)
                total.append(int((t * count[at]).sum()))
            return dict(zip(kept, plain)) | {"n_best": n_best, "count_sum": total}

        return step

    kind = aligned.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return map_texts(aligned, [*kept, "n_pairs", "pairs", "times"], make, schema)


def pair_table(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """``a, b, n_docs`` of every linked id pair, read from the shards."""

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                keys, counts = Shards([(0, uri)]).columns(0)
                for i in range(0, len(keys), 65536):
                    k = np.asarray(keys[i : i + 65536])
                    yield pa.RecordBatch.from_arrays([pa.array(k >> B_SHIFT), pa.array(k & B_MASK), pa.array(np.asarray(counts[i : i + 65536]))], names=["a", "b", "n_docs"])

    return shards.select("uri").repartition("uri").mapInArrow(read, "a long, b long, n_docs long")


def alignment_report(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    aligned = align(docs, path_a, path_b)
    return link_report(aligned, count_pairs(aligned))
