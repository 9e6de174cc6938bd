"""Operator 12 against a plain version, and on awkward rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from parcelspark.llm import alignment
from parcelspark.llm.common import tokenizer_path
from parcelspark.llm.rank_bpe import byte_letters
from tests.llm.test_operators import docs_of, keyed


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def plain(libraries, texts):
    """Rows in the order of ``texts``, by loops over tokens."""
    a, b = libraries
    letter = {c: n for n, c in enumerate(byte_letters())}
    found = []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        want = (" " + text).encode() if text else b""
        groups = []
        if b"".join(raw_a) == want == b"".join(raw_b):
            i = j = x = y = 0
            one, two = [], []
            while i < len(ids_a) or j < len(ids_b):
                if x <= y and i < len(ids_a):
                    one.append(ids_a[i])
                    x, i = x + len(raw_a[i]), i + 1
                else:
                    two.append(ids_b[j])
                    y, j = y + len(raw_b[j]), j + 1
                if x == y:
                    groups.append((one, two))
                    one, two = [], []
        found.append(groups)
    count = Counter(p for groups in found for p in {(x, y) for one, two in groups for x in one for y in two})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for groups in found:
        links = [(x, y) for one, two in groups for x in one for y in two]
        written = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, two)) for one, two in groups)
        out.append(
            (
                sum(len(one) for one, _ in groups),
                sum(len(two) for _, two in groups),
                len(groups),
                len(links),
                sum(count[p] == best[p[0]] for p in links),
                sum(count[p] for p in links),
                hashlib.sha256(written.encode()).hexdigest() if groups else "",
            )
        )
    return out, count


def result(row):
    return row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum, row.groups_sha256


AWKWARD = [
    None, "", " ", "  ", "a ", "a  b", " a", "a\nb \n c\t d", "x\x1c y\x85 z\xa0 q", "ﬁ Å ① 漢字かな 😀😀 é", "has ▁ mark", "▁", "<s> </s> <|endoftext|> <unk>",
    "zzqxj" * 400, " " * 700, "😀" * 300, "don't we'll I've", "a" * 5000 + " " + "b" * 3000, "the same", "the same", "\x00\x01 \x7f", "　全角　 spaces ",
]


def test_equals_plain_version(spark, small, libraries):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = keyed(alignment.alignment_report(docs))
    want, _ = plain(libraries, [r.text for r in rows])
    assert [result(got[r.doc_id]) for r in rows] == want
    assert len({w[-1] for w in want}) > 100


def test_awkward_rows(spark, libraries):
    docs = docs_of(spark, list(enumerate(AWKWARD)))
    got = keyed(alignment.alignment_report(docs))
    want, count = plain(libraries, AWKWARD)
    for i, t in enumerate(AWKWARD):
        assert result(got[i]) == want[i], t
    shards = alignment.count_pairs(alignment.align(docs))
    table = {(r.a, r.b): r.n_docs for r in alignment.pair_table(spark, shards).collect()}
    assert table == dict(count)


def test_parts_of_one_text_and_of_one_count(spark, libraries, monkeypatch):
    """Texts put together part by part, and partial counts handed on early, give the same."""
    texts = ["one two three four five six seven", "two  three \n four zz" * 40, "zzqxj" * 90, "one two"]
    model = alignment.Aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    whole = model.align(texts)
    monkeypatch.setattr(alignment, "RUN", 3)
    monkeypatch.setattr(alignment, "KEPT", 4)
    monkeypatch.setattr(alignment, "MANY", 2)
    assert alignment.Aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).align(texts) == whole
    aligned = alignment.align(docs_of(spark, list(enumerate(texts))))
    few = alignment.link_report(aligned, alignment.count_pairs(aligned, pairs=10))
    want, _ = plain(libraries, texts)
    got = keyed(few)
    assert [result(got[i]) for i in range(len(texts))] == want


def test_null_ids_and_no_rows(spark):
    docs = docs_of(spark, [(None, "a b c"), (None, "a b c"), (None, None)])
    rows = alignment.alignment_report(docs).collect()
    assert len(rows) == 3 and sorted(r.count_sum for r in rows)[0] == 0 and all(r.doc_id is None for r in rows)
    assert alignment.alignment_report(docs.limit(0)).count() == 0


def test_packing():
    values = np.array([0, 5, 5, 9, 1 << 46], np.int64)
    assert (alignment.unpack(alignment.pack(values), 5) == values).all()
    assert len(alignment.unpack(alignment.pack(values[:0]), 0)) == 0
