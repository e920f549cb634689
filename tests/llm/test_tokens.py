"""Tokens and packing, against the tokenizers library and plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spendloom.llm import bpe, packing
from spendloom.llm.queries import tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


PARTS = [" ", "  ", "\n", "\t", "a", "the", "'s", "'ll", "12", "²", "Ⅷ", "é", "漢字", "😀", ".", "!!", "<|endoftext|>", "<|endof", " ", "\r\n", "_",
         "a" * 300, "zq" * 200, "é", "word", " and", "\x00", "�"]


def test_random_texts_encode_and_decode_as_the_library_does(library):
    coder = bpe.Encoder(bpe.Vocabulary(tokenizer()))
    draw = random.Random(5)
    for _ in range(4000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 12)))
        want = ids(library, text)
        got = coder.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)
        assert coder.decode(got) == library.decode(want, skip_special_tokens=False)


def test_heap_and_rank_array_agree():
    v = bpe.Vocabulary(tokenizer())
    draw = random.Random(6)
    for _ in range(500):
        word = "".join(draw.choice(["th", "e", "in", "g", "é", "ß", "a", "aa", "x"]) for _ in range(draw.randint(1, 60))).encode()
        assert v.merge_word(word) == v._long(word)


def test_full_tables_start_anew(monkeypatch, library):
    monkeypatch.setattr(bpe, "TABLE", 3)
    coder = bpe.Encoder(bpe.Vocabulary(tokenizer()))
    text = "one two three four five six one two\nseven, eight. one"
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids(library, text)
    assert len(coder.words) <= 3


@pytest.mark.parametrize("table, block", [(1 << 18, 1 << 22), (3, 60), (40, 1)])
def test_columns_of_texts_encode_as_the_library_does(monkeypatch, library, table, block):
    monkeypatch.setattr(bpe, "TABLE", table)
    monkeypatch.setattr(bpe, "BLOCK", block)
    monkeypatch.setattr(packing, "_CODERS", {})
    draw = random.Random(7)
    parts = [*PARTS, *[" " + w for w in ["voilà", "à", "Àà", "ost***", "don't", "dogs'.", "it.'s", "naïve,", "e\u0301a", "x_", "3a", "\xa0", "à\xa0", "¡sí", "ª"]]]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(1500)]
    texts += [None, "", " ", *[" ".join(draw.choice(["à", "og", "the", "enà", "漢à", "zz..."]) for _ in range(90)) for _ in range(20)]]
    column = pa.array(["left out", *texts]).slice(1)
    for coder in packing.coder(tokenizer()), bpe.Encoder(bpe.Vocabulary(tokenizer())):
        got = [np.frombuffer(data, "<u4").tolist() for data in coder.encode_all(column)]
        assert got == [ids(library, text) for text in texts]
        assert len(coder.spans) <= table
        assert list(coder.encode_all(pa.array([], pa.string()))) == []


def test_new_words_of_a_column_are_merged_in_few_calls(monkeypatch, library):
    monkeypatch.setattr(packing, "_CODERS", {})
    calls, together = [], packing._together

    def counted(merge, vocab):
        return together(lambda row: calls.append(row) or merge(row), vocab)

    monkeypatch.setattr(packing, "_together", counted)
    coder = packing.coder(tokenizer())
    monkeypatch.setattr(coder.words, "merge", lambda word: calls.append(word) or library.encode(word.decode(), add_special_tokens=False).ids)
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(3000)]
    texts = ["start " + " ".join(words[i:i + 100]) for i in range(0, 3000, 100)]
    assert [np.frombuffer(data, "<u4").tolist() for data in coder.encode_all(pa.array(texts))] == [ids(library, t) for t in texts]
    assert len(calls) <= 100


def test_broken_bytes_decode_to_replacement(library):
    coder = bpe.Encoder(bpe.Vocabulary(tokenizer()))
    some = [ids(library, "é")[0], ids(library, "漢")[0], 50256]
    assert coder.decode(np.array(some, "<u4").tobytes()) == library.decode(some, skip_special_tokens=False)


def test_encoded_rows(library, edge_docs, no_docs):
    got = bpe.encoded(edge_docs, tokenizer(), ids=True).collect()
    assert len(got) == edge_docs.count()
    texts = sorted((r.doc_id is None, r.doc_id or 0, ids(library, r.text)) for r in edge_docs.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in got) == texts
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert bpe.encoded(no_docs, tokenizer()).count() == 0


def plain_sum_of_squares(sizes, length):
    """The rule as it is written, trying every bin."""
    bins = []
    for s in sizes:
        def squares(gaps):
            return sum(n * n for g in set(gaps) if g for n in [gaps.count(g)])

        options = [(squares([*bins[:i], bins[i] - s, *bins[i + 1:]]), bins[i], i) for i in range(len(bins)) if bins[i] >= s > 0 and bins[i] < length]
        fresh = squares([*bins, length - s])
        best = min(options, default=None)
        if best and best[0] <= fresh:
            bins[best[2]] -= s
        else:
            bins.append(length - s)
    return sorted(bins)


def test_sum_of_squares_is_the_rule():
    draw = random.Random(1)
    for _ in range(60):
        length = draw.randint(4, 16)
        sizes = [draw.randint(1, length - 1) for _ in range(draw.randint(1, 30))]
        _, _, fill = packing.sum_of_squares(np.array(sizes), length)
        assert sorted((length - fill).tolist()) == plain_sum_of_squares(sizes, length)


def check_packing(rows, tokens, length, end=2):
    sequences, seen = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    for doc, all_ids in tokens.items():
        whole = [*all_ids, end]
        pieces = sorted(seen.pop(doc), key=lambda r: r.piece)
        stops = list(range(len(whole) % length or length, len(whole) + 1, length))
        assert [(r.piece, r.start, r.start + r.length) for r in pieces] == [(i, a, b) for i, (a, b) in enumerate(zip([0, *stops], stops))]
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(whole[r.start:r.start + r.length], "<u4").tobytes())
    assert not seen
    return len(sequences)


@pytest.mark.parametrize("shard", [100_000, 40])
def test_documents_are_packed_whole(spark, sf, library, shard):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack_documents(docs, tokenizer(), shard_rows=shard).collect()
    tokens = {r.doc_id: ids(library, r.text) for r in docs.collect()}
    n = check_packing(rows, tokens, 1024)
    least = -(-sum(len(t) + 1 for t in tokens.values()) // 1024)
    assert least <= n <= 1.05 * least + 3


def test_packing_edges(edge_docs, no_docs, library):
    unique = edge_docs.dropDuplicates(["doc_id", "text"])
    rows = packing.pack_documents(unique, tokenizer()).collect()
    check_packing(rows, {r.doc_id: ids(library, r.text) for r in unique.collect()}, 1024)
    assert len(packing.pack_documents(edge_docs, tokenizer()).collect()) == len(rows) + 1
    assert packing.pack_documents(no_docs, tokenizer()).count() == 0
