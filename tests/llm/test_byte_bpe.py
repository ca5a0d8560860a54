import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomworks.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_library(docs, odd_docs, library):
    got = byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN), PATH).collect()
    want = sorted((repr(r[0]), library.encode_ordinary(r[1] or "")) for r in odd_docs)
    assert sorted((repr(r.doc_id), r.ids) for r in got) == want
    assert sorted(bytes(r.decoded) for r in got) == sorted((r[1] or "").encode() for r in odd_docs)


def test_blanks_and_marks(spark, library):
    rng = random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", ",", ".", "1", "é", " ", "日", "🙂", " \n", "\r\n", "'", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in byte_bpe.encode(df, PATH, P.PATTERN).collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id])


def test_other_patterns_match_whole_texts(spark, library):
    df = spark.createDataFrame([(1, "ab cd  ef")], "doc_id long, text string")
    assert byte_bpe.encode(df, PATH, r"\S+|\s+").first().ids == [i for w in ("ab", " ", "cd", "  ", "ef") for i in library._encode_single_piece(w)]


def test_decode_nulls_and_clash(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, [], "y"), (3, [0, 1], "z")], "doc_id long, ids array<int>, decoded string")
    out = {r.doc_id: r.decoded for r in byte_bpe.decode(df, PATH).collect()}
    assert out[1] is None and bytes(out[2]) == b"" and bytes(out[3]) == b"".join(byte_bpe.read_ranks(PATH)[:2])


def test_empty(empty):
    assert byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(empty, PATH, P.PATTERN), PATH)).collect() == []


def test_blocks_of_one_document(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 1)
    df = spark.createDataFrame([(i, f"word {i} word") for i in range(20)], "doc_id long, text string").withColumn("extra", F.lit(1))
    assert {r.doc_id: r.ids for r in byte_bpe.encode(df, PATH, P.PATTERN).collect()} == {i: library.encode_ordinary(f"word {i} word") for i in range(20)}
