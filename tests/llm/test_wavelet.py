import functools
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomworks.llm import wavelet as wm

PATH = P.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=400), st.integers(10, 17), st.sampled_from([64, 128, wm.BLOCK_BITS]))
def test_matrix(ids, levels, block_bits):
    a = np.array(ids, np.int64)
    matrix = wm.WaveletMatrix.build(a, levels, block_bits)
    counts = np.array([len(ids)], np.int64)
    matrix, doc_ids, got = wm.from_file(wm.to_file(matrix, [None], counts))
    assert matrix.decode().tolist() == ids and doc_ids == [None] and got.tolist() == [len(ids)]
    assert matrix.access(np.arange(len(ids))).tolist() == ids
    for s in [*ids[:5], 3, 1 << 18]:
        assert matrix.positions(s).tolist() == np.flatnonzero(a == s).tolist()
        assert matrix.positions(s, 1, 2).tolist() == np.flatnonzero(a == s)[1:3].tolist()
        assert matrix.count(s) == ids.count(s) and matrix.count(s, len(ids) // 2) == ids[: len(ids) // 2].count(s)


def test_lookups_open_few_blocks():
    """An access, a count and an occurrence of a shard of 3 million ids decompress at most two blocks a plane."""
    ids = np.random.default_rng(1).integers(0, 40_000, 3_000_000)
    matrix = wm.from_file(wm.to_file(wm.WaveletMatrix.build(ids, 16), [1], np.array([len(ids)])))[0]
    opened, frame = [], matrix._frame
    matrix._frame = lambda k, b: opened.append((k, b)) or frame(k, b)
    assert matrix.before.shape == (16, 6)
    assert matrix.access(1_234_567).tolist() == [ids[1_234_567]] and len(opened) <= 16
    del opened[:]
    matrix._loaded.clear()
    assert matrix.count(77, 2_000_001) == int((ids[:2_000_001] == 77).sum()) and len(opened) <= 32
    del opened[:]
    matrix._loaded.clear()
    assert matrix.positions(77, 3, 1).tolist() == [int(np.flatnonzero(ids == 77)[3])] and len(opened) <= 48


def test_files_equal_library(spark, docs, odd_docs, tmp_path):
    wm.write(wm.shards(docs, PATH, 2, n_shards=3), str(tmp_path / "w"))
    files = wm.read(spark, str(tmp_path / "w"))
    got = sorted(wm.documents_of(files).collect(), key=lambda r: r.start)
    tok, start, want = Tokenizer.from_file(PATH), 0, []
    order = sorted(odd_docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    every = []
    for r in order:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        every += ids
    assert [tuple(r) for r in got] == want
    told = sorted(wm.documents_of(files, end_id=2).collect(), key=lambda r: r.start)
    assert [(r.first_id, r.n_end_ids) for r in told] == [(every[r.start], every[r.start : r.start + r.n_tokens].count(2)) for r in told]
    assert all(r.end_at == r.n_tokens - 1 for r in told)
    assert sum(r.n for r in wm.occurrences(files, 2).collect()) == every.count(2)


@functools.cache
def encoders():
    return Tokenizer.from_file(PATH), wm._Encoder(PATH)


def same_ids(texts):
    tok, own = encoders()
    ids, counts = own(pa.chunked_array([pa.array(texts, pa.string())]), 2)
    at = np.concatenate([[0], np.cumsum(counts)])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids + [2], t


def test_words_equal_library():
    same_ids(["Hello, World! It's 42.", "ÄÖÜ straße Éa İstanbul ΣΑΣ", "a\x1cb <|endoftext|>x foo-bar z", "don't 日本 é ﬁ 10,000", "", None, "  \n"])
    same_ids(["été&&& les,*** ai%%% &&& <|endoftext|> end<|startoftext|> END<|ENDOFTEXT|> `a_b_ ^_^ rock'n'roll '' x''s ÿ÷× Àß!?", "e\u0301t\u0301 a\u0338< <\u0338 µ ª"])
    same_ids([])


def test_other_tokenizers_equal_library():
    """A file whose pre-tokens hold white space is read by whole texts; without plain pieces, by whole words."""
    texts = ["Hello, World!  It's 42.", "don't été&&&\n\nx ", "", None]
    path = P.path("byte_bpe_50k.json")
    other, tok = wm._Encoder(path), Tokenizer.from_file(path)
    assert not other.by_word and encoders()[1].by_piece
    want = [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    ids, counts = other(pa.chunked_array([pa.array(texts)]), 2)
    assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))
    slow = wm._Encoder(PATH)
    slow.by_piece = False
    want = [encoders()[0].encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert slow(pa.chunked_array([pa.array(texts)]), 2)[0].tolist() == sum(want, [])


def test_white_space_equals_library():
    odd = [chr(i) for i in [*range(1, 0x21), *range(0x7F, 0xA1), 0xAD, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]]
    same_ids([f"ab{c}cd {c} x{c}" for c in odd])  # with separators among them
    same_ids([f"ab{c}cd {c} x{c}" for c in odd if not 0x1C <= ord(c) <= 0x1F])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text("aZé'.,&<|>ß1 \n\u0301\x1d", max_size=30)), max_size=5))
def test_any_text_equals_library(texts):
    same_ids(texts)


def test_empty(spark, empty, tmp_path):
    wm.write(wm.shards(empty, PATH, 2), str(tmp_path / "w"))
    assert wm.documents_of(wm.read(spark, str(tmp_path / "w"))).collect() == []
