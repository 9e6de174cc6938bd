"""Operator 6 looks up no slices of a piece: the tokens that end at a byte come from the automaton."""

import numpy as np
import pytest

from parcelspark.llm import common, prefix_counts


class Counted(dict):
    looks = 0

    def get(self, *key):
        self.looks += 1
        return super().get(*key)

    def __getitem__(self, key):
        self.looks += 1
        return super().__getitem__(key)

    def __contains__(self, key):
        self.looks += 1
        return super().__contains__(key)


@pytest.fixture(scope="module")
def own():
    return prefix_counts.PrefixCounter(common.tokenizer_path("byte_bpe_50k.json"))


def test_no_slices_are_looked_up(own, monkeypatch):
    pieces = [" shatonedtion", "Èouanque", " " + "ab" * 400, "===----", " 漢字漢字"]
    first = [list(own.table(p)) for p in pieces]
    ids = Counted(own.ids)
    monkeypatch.setattr(own, "ids", ids)
    assert [list(own.table(p)) for p in pieces] == first
    assert ids.looks == 0


def test_made_up_words_count_as_the_library_counts_them(own):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))

    def count(s):
        return len(lib.encode(s, add_special_tokens=False).ids)

    rng = np.random.default_rng(6)
    bits = ["th", "on", "ed", "tion", "ble", "A", "z", "É", "ß", "漢", "🙂", "́", "7", "²", "'ll", "'re", "'", ".", ",\n", "\x1c", "_", "<0x", "ⅷ", "\U000323af", "Ჿ"]
    for _ in range(600):
        s = " ".join("".join(rng.choice(bits, rng.integers(0, 9))) for _ in range(rng.integers(1, 4)))
        assert own.prefix_counts(s) == [count(s[: i + 1]) for i in range(len(s))], s


def test_steps_outlive_a_full_cache(own):
    words = [" shatonedtion", " bythatshly", " Èouanque"]
    want = [list(own.table(w)) for w in words]
    small = prefix_counts.PrefixCounter(common.tokenizer_path("byte_bpe_50k.json"))
    small.steps.most = small.apart.most = 3
    assert [list(small.table(w)) for w in words * 2] == want * 2
