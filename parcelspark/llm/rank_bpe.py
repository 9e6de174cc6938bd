"""Operator 9: BPE encoding and decoding with a contiguous rank array.

A short word is held as two contiguous lists: the ids between its part
boundaries and the merge rank of each adjacent pair.  The encoder scans the
ranks for the minimum, deletes that boundary, and refreshes the two
neighbouring ranks, until no pair can merge.  Words beyond ``SHORT`` parts use
the same merges from a heap, as repeated scans would be quadratic there.

Results equal the ``tokenizers`` library's for files of the ``word_bpe``
layout (NFC, white space collapsed, lower case, byte-level pieces with a word
end) and of the ``byte_bpe`` layout.

Rows: a null text counts as empty and has no ids; one row comes back per input
row, repeated rows included; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array

import regex
from pyspark.sql import DataFrame

from parcelspark.llm.common import map_texts, tokenizer_path

SHORT = 256
NO_RANK = 1 << 60
#: Entries of a worker's word cache; when full it is emptied, so memory is bounded.
CACHE_WORDS = 300_000
#: White space as Unicode defines it.  ``str.split`` also splits at \x1c-\x1f.
CONTROL_SPACE = re.compile("[\x1c-\x1f]")
WHITE = "\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    out = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [out[b] for b in range(256)]


class Merges:
    """Vocabulary and merge ranks of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.letters = byte_letters()
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.vocab[left] << 20 | self.vocab[right]] = r
            self.made.append(self.vocab[left + right])
        self.single = [self.vocab[x] for x in self.letters]
        self.final = [self.vocab[x + self.end] for x in self.letters]

    def start(self, word: str) -> list[int]:
        """Ids of the single bytes of ``word``, the last with the word end."""
        raw, single = word.encode("utf-8"), self.single
        parts = [single[b] for b in raw]
        parts[-1] = self.final[raw[-1]]
        return parts

    def merge(self, parts: list[int]) -> list[int]:
        """Merge ``parts`` in place, lowest rank first and leftmost among equals."""
        if len(parts) > SHORT:
            return self.merge_long(parts)
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            parts[i] = made[low]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 20 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | parts[i], NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank.get
        after, before, gone = [*range(1, n), -1], [-1, *range(n - 1)], bytearray(n)
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i] = self.made[r]
            gone[j] = 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (s := rank(parts[i] << 20 | parts[k])) is not None:
                    heapq.heappush(heap, (s, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (s := rank(parts[h] << 20 | parts[i])) is not None:
                heapq.heappush(heap, (s, h, parts[h], parts[i]))
        return [p for p, x in zip(parts, gone) if not x]


#: Longest text that a cache keeps; with the number of entries it bounds a cache to some 100 MB.
LONGEST = 32


class Cache(dict):
    """Memo of ``make`` for numbers and short texts; emptied when full.  Long texts are made anew each time."""

    def __init__(self, make, most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if not isinstance(key, int) and len(key) > LONGEST:
            return self.make(key)
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


class WordBPE:
    """Encoder and decoder for the lower-casing layout with word ends."""

    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + WHITE + r"\p{L}\p{N}]+")

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.pieces = Cache(self.piece)
        self.words = Cache(self.word)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) + ")")
        self.special = {s: i.to_bytes(4, "little") for s, i in self.merges.special.items()}

    def piece(self, piece: str) -> bytes:
        return array("I", self.merges.merge(self.merges.start(piece))).tobytes()

    def word(self, word: str) -> bytes:
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
        return b"".join(map(self.pieces.__getitem__, self.PIECES.findall(word.lower())))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "<|" in text:
            parts = self.split.split(text)
            if len(parts) > 1:
                return b"".join(self.special[p] if i % 2 else self.plain(p) for i, p in enumerate(parts))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if CONTROL_SPACE.search(text):
            return b"".join(map(self.word, re.split(f"[{WHITE}]+", text)))
        return b"".join(map(self.words.__getitem__, text.split()))

    def decode(self, ids: bytes) -> str:
        """Names of the ids between single spaces, as a file without a decoder asks for."""
        name = self.merges.names
        return " ".join([name[i] for i in array("I", ids)])


_LOADED: dict[str, WordBPE] = {}


def word_bpe(path: str) -> WordBPE:
    """The worker's own encoder for ``path``; kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def encode_ids(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids binary``: ids as little-endian unsigned 32-bit integers."""
    path = path or tokenizer_path("word_bpe_49k.json")

    def make():
        bpe = word_bpe(path)
        return lambda key, text: {"doc_id": key, "ids": [bpe.encode(t or "") for t in text]}

    return map_texts(docs, [id_col, text_col], make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from rows of ``encode_ids``; null ids give an empty text."""
    path = path or tokenizer_path("word_bpe_49k.json")

    def make():
        bpe = word_bpe(path)
        return lambda key, ids: {"doc_id": key, "text": [bpe.decode(x or b"") for x in ids]}

    return map_texts(encoded, ["doc_id", "ids"], make, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode each text, decode the ids, and return digests of both.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``; encoding and decoding
    share one pass, so ids never travel between tasks.
    """
    path = path or tokenizer_path("word_bpe_49k.json")

    def make():
        bpe = word_bpe(path)

        def step(key, text):
            ids = [bpe.encode(t or "") for t in text]
            return {
                "doc_id": key,
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode("utf-8")).hexdigest() for x in ids],
            }

        return step

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, ["doc_id", "text"], make, schema)
