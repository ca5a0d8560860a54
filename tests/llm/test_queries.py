"""The registered queries themselves, on a folder of odd rows: columns and values of their contracts."""

import hashlib
import re
import zlib

import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import test_decontaminate
import test_lexical_search
import test_variants
import tiktoken
import xxhash
from tokenizers import Tokenizer

from loomworks.llm import queries as q
from loomworks.llm.byte_bpe import read_ranks

WORD = re.compile("[^\x20\x09-\x0d]+")
sha = lambda t: hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(tmp_path_factory, odd_docs):
    """Documents with distinct ids (the odd rows and some prose), labels, and pages."""
    top = tmp_path_factory.mktemp("odd")
    rows = [r for i, r in enumerate(odd_docs) if r[0] is not None and r[0] not in {x[0] for x in odd_docs[:i]}]
    rows += [(20 + i, " ".join(f"{w}{i % 7}" for w in "the river of stone walks and light under the old bridge again".split() * 6), "en" if i % 2 else "de", "s4", 0) for i in range(30)]
    rows += [(60 + i, "junk!! " * 60, None, None, 0) for i in range(10)]
    types = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
    pq.write_table(pa.table({n: pa.array(list(c), t) for (n, t), c in zip(types, zip(*rows))}), top / "documents.parquet")
    labels = [(r[0], int(r[0] < 60), 0) for r in rows if r[0] >= 20]
    pq.write_table(pa.table({n: pa.array(list(c), t) for (n, t), c in zip((("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())), zip(*labels))}), top / "labels.parquet")
    urls = ["https://A.Example.NET/en/x?q#f", "http://example.net/EN", "http://b.example.com/de/1", "http://c.org/fr/", "http://freecasinobets.com/play", "http://river.com/", None, "no scheme", "http://river.com/"]
    urls += [f"http://{'freecasinobets' if i % 2 else 'river'}.com/{i % 3}" for i in range(60)]
    html = [None] * 9 + [f"<p>{rows[-1][1] if i % 2 else rows[-12][1]}</p>" for i in range(60)]
    pq.write_table(pa.table({"page_id": list(range(len(urls))), "url": pa.array(urls, pa.string()), "html": pa.array(html, pa.string())}), top / "pages.parquet")
    items = [(1, "the river0 of"), (2, None), (3, rows[7][1][:90]), (4, "café 42 absent"), (5, "")]
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}), top / "benchmark.parquet")
    return str(top), sorted(rows), items


def run(spark, folder, name, columns):
    made = q.queries()[name](spark, folder[0])
    types = dict(made.dtypes)
    assert {c: types.get(c) for c in columns} == columns
    return made.collect()


def test_op1(spark, folder):
    got = {r.doc_id: r for r in run(spark, folder, "op1_substring_dedup", {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"})}
    seen = set()
    for i, text, *_ in folder[1]:
        w, gone = WORD.findall(text or ""), set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if key in seen else set()
            seen.add(key)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), sha(kept))


def test_op2(spark, folder):
    got = {r.page_id: r for r in run(spark, folder, "op2_url_filter", {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"})}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("example.net", "/EN", "net/"), ("b.example.com", "/de/1", "example.com/de/"), ("c.org", "/fr/", "org/fr/"),
        ("freecasinobets.com", "/play", None), ("river.com", "/", None), ("", "", None), ("", "", None), ("river.com", "/", None)]
    assert [got[i].verdict for i in range(9)] == ["allow", "block", "block", "allow", "block", "allow", "allow", "allow", "allow"]


def test_op3(spark, folder):
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("library", pat_str=P.PATTERN, mergeable_ranks={b: i for i, b in enumerate(read_ranks(path))}, special_tokens={})
    got = {r.doc_id: r for r in run(spark, folder, "op3_byte_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})}
    for i, text, *_ in folder[1]:
        ids = library.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text or ""))


def test_op4(spark, folder):
    tok, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in run(spark, folder, "op4_wavelet_ids", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})}
    for i, text, *_ in folder[1]:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(raw))
        start += len(ids)


def test_op5(spark, folder):
    got = {r.doc_id: r for r in run(spark, folder, "op5_mix_sources", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"})}
    sizes = {i: len(WORD.findall(t or "")) for i, t, *_ in folder[1]}
    by = {}
    for i, _, _, source, _ in folder[1]:
        by[source] = by.get(source, 0) + sizes[i]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight, want, left, open_ = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, 1.5 * sum(by.values()), set(names)
    while open_:  # deal the rest by weight, close what is full, again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * by[s]} or open_
        want |= {s: min(weight[s] * level, 2.0 * by[s]) for s in full}
        left, open_ = left - sum(want[s] for s in full), open_ - full
    assert got.keys() == sizes.keys()
    for i, _, _, source, _ in folder[1]:
        assert (got[i].size, got[i].source_size) == (sizes[i], by[source]) and abs(got[i].target - want[source]) < 1e-6
        assert 0 <= got[i].taken <= 2 * sizes[i]


def test_op6(spark, folder):
    got = run(spark, folder, "op6_quality_pairs", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.doc_id: r.predicted for r in got if r.doc_id >= 20} == {r[0]: int(r[0] < 60) for r in folder[1] if r[0] >= 20}


def test_op7(spark, folder):
    got = {r.doc_id: r for r in run(spark, folder, "op7_fingerprints", {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"})}
    rows = folder[1]
    far = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    for (i, text, *_), (j, after, *_) in zip(rows, [*rows[1:], rows[0]]):
        t, r = text or "", got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(t[: len(t) - len(t) // 2] + (after or "")[: len(t) // 2]))
        assert abs(r.near_edited - 1 + far(r.fingerprint, r.edited_fingerprint) / 128) < 1e-9 and abs(r.near_next - 1 + far(r.fingerprint, got[j].fingerprint) / 128) < 1e-9
        if i % 20 == 0:
            assert r.n_within == sum(far(x.fingerprint, r.fingerprint) <= 4 for x in got.values())


def test_op8(spark, folder):
    got = {r.doc_id: r for r in run(spark, folder, "op8_quality_rules", {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"})}
    for i, text, *_ in folder[1]:
        w = WORD.findall(text or "")
        at = {}
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        repeated = len({k + d for v in at.values() if len(v) > 1 for k in v for d in range(8)})
        failed = len(w) < 20 or 100 * repeated > 30 * len(w)
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].base_failed) == (len(w), sum(map(len, w)), repeated, failed)
        assert not (failed and got[i].kept)
    assert got[8].kept


def test_op9(spark, folder):
    got = {r.doc_id: r for r in run(spark, folder, "op9_simhash_dedup", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})}
    made = {}
    for i, text, *_ in folder[1]:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        made[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i].fingerprint == f"{made[i]:016x}"
    up = {i: i for i in made}
    for _ in made:
        up = {i: min(up[j] for j in made if (made[i] ^ made[j]).bit_count() <= 2) for i in made}
    assert {i: r.component_id for i, r in got.items()} == up


def test_op10(spark, folder):
    got = run(spark, folder, "op10_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    texts = {r[0]: r[1] for r in folder[1]}
    assert len(got) == len(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))


def test_op11(spark, folder):
    got = run(spark, folder, "op11_lexical_search", {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"})
    assert sorted(map(tuple, got), key=str) == test_lexical_search.brute([r[:2] for r in folder[1]], folder[2])


def test_op12(spark, folder):
    got = run(spark, folder, "op12_spelling_variants", {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"})
    assert sorted(map(tuple, got)) == test_variants.brute([r[:2] for r in folder[1]])


def test_op13(spark, folder):
    columns = {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}
    got = run(spark, folder, "op13_decontamination", columns)
    want = test_decontaminate.brute([r[:2] for r in folder[1]], folder[2])
    assert sorted(map(tuple, got), key=str) == want and any(r[5] for r in want)
