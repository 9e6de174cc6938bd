"""Operator 6: exact token counts by prefix dynamic programming.

For each prefix of a piece, the table holds the last token of the prefix's BPE
encoding and its token count.  A token that ends at a prefix can be its last
one exactly if the BPE encoding of (last token of the shorter prefix + token)
leaves the pair apart; one token alone meets this.  So one left-to-right pass
gives the exact count at *every* prefix, and questions of truncation and
budget need no further encoding.  The tokens that end at a prefix come from an
automaton of all tokens (Aho-Corasick), one step a byte, so no slice that is no
token is looked up.  Steps, pair checks and pieces are memoised in bounded caches.

Equal to the ``tokenizers`` library on files of the byte-level layout, special
strings counted as their one token.  A null text counts as empty; one row per
input row; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import regex
from pyspark.sql import DataFrame

from parcelspark.llm.common import map_texts, tokenizer_path
from parcelspark.llm.rank_bpe import WHITE, Cache, Merges

LIMIT = 1024
#: Stands before the first token of a piece; no file has this id.
START = 0xFFFFF


class PrefixCounter:
    PIECES = regex.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+|[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + r"]+"
    )
    #: The same for ASCII, whose classes need no table of Unicode.
    PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
    #: White space runs stay with the word after them, as they share a boundary.
    RUNS = re.compile("[WHITE]{2,}[^WHITE]*| ?[^WHITE]+|[WHITE]+".replace("WHITE", WHITE))
    SPACES = frozenset(re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001)))))

    def __init__(self, path: str):
        m = self.merges = Merges(path)
        letter = {c: b for b, c in enumerate(m.letters)}
        self.ids = {bytes(letter[c] for c in s): i for s, i in m.vocab.items() if all(c in letter for c in s)}
        self.raw = {i: b for b, i in self.ids.items()}
        self.single = m.single
        self.begins = {b[:n] for b in self.ids for n in range(len(b) + 1)}
        self.states: dict[bytes, tuple[int, tuple]] = {}
        self.seen: list[bytes] = []
        self.root = self.state(b"")[0]
        self.steps: dict[int, tuple[int, tuple]] = Cache(self.step, 1_000_000)
        self.apart: dict[int, bool] = Cache(self._apart, 1_000_000)
        self.pieces: dict[str, bytes | list[int]] = Cache(self.table)
        self.words: dict[str, bytes | list[int]] = Cache(self.counts)
        self.spaced: dict[str, bytes | list[int] | None] = Cache(self.after_space)
        self.special = re.compile("(" + "|".join(map(re.escape, m.special)) + ")") if m.special else None

    def _encode(self, raw: bytes) -> list[int]:
        return self.merges.merge([self.single[b] for b in raw])

    def _apart(self, key: int) -> bool:
        a, b = key >> 20, key & 0xFFFFF
        if a == START:
            return self._encode(self.raw[b]) == [b]
        return self._encode(self.raw[a] + self.raw[b]) == [a, b]

    def state(self, suffix: bytes) -> tuple[int, tuple]:
        """The automaton's state at ``suffix``, a beginning of a token: its number, shifted, and the tokens that end there, longest first."""
        if suffix not in self.states:
            ends = [(self.ids[suffix[i:]], len(suffix) - i) for i in range(len(suffix)) if suffix[i:] in self.ids]
            self.states[suffix] = len(self.seen) << 8, tuple(ends)
            self.seen.append(suffix)
        return self.states[suffix]

    def step(self, key: int) -> tuple[int, tuple]:
        """The state after one more byte: the longest suffix that begins a token."""
        suffix = self.seen[key >> 8] + bytes([key & 0xFF])
        while suffix not in self.begins:
            suffix = suffix[1:]
        return self.state(suffix)

    def table(self, piece: str):
        """Token counts of the prefixes of one piece, at each code point."""
        raw = piece.encode("utf-8")
        steps, apart, at = self.steps, self.apart, self.root
        last, count = [START << 20], [0]
        for end, byte in enumerate(raw, 1):
            at, tokens = steps[at | byte]
            for token, size in tokens:
                if apart[last[end - size] | token]:
                    last.append(token << 20)
                    count.append(count[end - size] + 1)
                    break
        if len(raw) == len(piece):
            del count[0]
            out = count
        else:
            out = [count[i] for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
        return bytes(out) if out[-1] < 256 and max(out) < 256 else out

    def counts(self, word: str):
        """Counts at each code point of a stretch whose pieces its ends do not change."""
        ascii = word.isascii()
        if ascii and word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            return self.pieces[word]
        pieces = (self.PLAIN if ascii else self.PIECES).findall(word)
        if len(pieces) == 1 and word[0] != "'":
            return self.pieces[word]
        out: list[int] = []
        base, run, run_base = 0, "", 0
        for p in pieces:
            if p in ("'re", "'ve", "'ll"):  # cut short, the mark and the letter stand apart
                mark = self.pieces["'"][-1]
                inner = [mark, mark + self.pieces[p[1]][-1], self.pieces[p][-1]]
            else:
                inner = self.pieces[p]
            if run and p[0].isspace():  # cut after this character, the whole run is one piece
                first = run_base + self.pieces[run + p[0]][-1]
                out.append(first)
                out.extend([base + c for c in inner[1:]])
            else:
                out.extend([base + c for c in inner] if base else inner)
            run, run_base = (p, base) if p.isspace() else ("", 0)
            base += inner[-1]
        out[-1] = base
        return bytes(out) if max(out) < 256 else out

    def after_space(self, word: str):
        """Counts of a space and ``word``; None where white space meets the space."""
        if not word or word[0] in self.SPACES or word[-1] in self.SPACES:
            return None
        return self.counts(" " + word)

    def stretches(self, text: str) -> list:
        """Stretches of ``text`` that are encoded apart, as count tables."""
        if self.special is None or "<|" not in text:
            return self.plain(text)
        out, before = [], ""
        for i, part in enumerate(self.special.split(text)):
            if i % 2 == 0:
                out += self.plain(part)
                before = part
            else:  # cut inside, a special string is ordinary text that joins what precedes it
                tail = self.RUNS.findall(before)[-1] if before else ""
                base = self.counts(tail)[-1] if tail else 0
                out.append([*(self.counts(tail + part[:j])[-1] - base for j in range(1, len(part))), 1])
                before = ""
        return out

    def plain(self, text: str) -> list:
        if not text:
            return []
        first, *rest = text.split(" ")
        if first and first[-1] not in self.SPACES:
            tables = list(map(self.spaced.__getitem__, rest))
            if None not in tables:
                return [self.words[first], *tables]
        return list(map(self.words.__getitem__, self.RUNS.findall(text)))

    def total(self, text: str) -> int:
        return sum([t[-1] for t in self.stretches(text)])

    def prefix_counts(self, text: str) -> list[int]:
        """Exact token count of ``text[:i]`` for i = 1 .. len(text)."""
        out: list[int] = []
        base = 0
        for t in self.stretches(text):
            out.extend(base + c for c in t)
            base += t[-1]
        return out

    def measure(self, text: str, limit: int) -> tuple[int, int]:
        """Token count, and code points of the longest prefix of ``limit`` tokens or fewer."""
        tables = self.stretches(text)
        totals = [t[-1] for t in tables]
        n = sum(totals)
        if n <= limit:
            return n, len(text)
        bases = [0, *accumulate(totals)]
        j = bisect_right(bases, limit) - 1
        inner = max((i + 1 for i, c in enumerate(tables[j]) if bases[j] + c <= limit), default=0)
        return n, sum(map(len, tables[:j])) + inner


_LOADED: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _LOADED:
        _LOADED[path] = PrefixCounter(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fit_chars``.

    ``fit_chars``: code points of the longest prefix with ``limit`` tokens or fewer.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")

    def make():
        pc = counter(path)

        def step(key, text):
            text = [t or "" for t in text]
            found = [pc.measure(t, limit) for t in text]
            return {
                "doc_id": key,
                "n_bytes": [len(t.encode("utf-8")) for t in text],
                "n_tokens": [n for n, _ in found],
                "over_limit": [n > limit for n, _ in found],
                "fit_chars": [c for _, c in found],
            }

        return step

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return map_texts(docs, ["doc_id", "text"], make, schema)
