import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    """A corpus of clean prose, junk, exact and near copies, and a shared passage."""
    top = tmp_path_factory.mktemp("corpus")

    def prose(k, n=150):
        return " ".join(f"{w}{(k * 31 + i * 7) % 997}" for i, w in zip(range(n), ["river", "stone", "light", "under", "walks"] * n)) + "."

    passage = " ".join(f"pass{i}" for i in range(60))
    rows = [(i, prose(i), "en", f"s{i % 3}", 0) for i in range(120)]
    rows += [(200 + i, ("BUY NOW!! " * 50, "junk " * 100, "a$$$ b%%% " * 40)[i % 3], "en", "s0", 0) for i in range(24)]
    rows += [(300, prose(5), "en", "s1", 0), (301, prose(6, 1500), "en", "s1", 0), (302, prose(6, 1500) + " more", "en", "s2", 0)]
    rows += [(400 + i, f"{prose(500 + i, 80)} {passage} {prose(600 + i, 80)}", "en", "s2", 0) for i in range(4)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    pq.write_table(pa.table({n: list(c) for n, c in zip(names, zip(*rows))}), top / "documents.parquet")
    labels = [(r[0], int(not 200 <= r[0] < 300), 0) for r in rows]
    pq.write_table(pa.table({n: pa.array(list(c), t) for (n, t), c in zip((("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())), zip(*labels))}), top / "labels.parquet")
    return str(top)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        path = f"{folder}/stage{k}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
    good = {r.doc_id for r in seen["quality classifier"].collect()}
    assert good == {*range(120), 300, 301, 302, *range(400, 404)}
    unique = sorted(r.doc_id for r in seen["near-dedup by min-hash and jaccard"].collect())
    assert unique == [*range(120), 301, *range(400, 404)]
    cut = {r.doc_id: r for r in seen["substring dedup"].collect()}
    assert "pass5 " in cut[400].text and all("pass5 " not in cut[i].text for i in (401, 402, 403))
    assert cut[401].n_chars == len(cut[401].text) and cut[3].text.startswith("river")
    mixed = [r.doc_id for r in seen["mix sources"].collect()]
    assert set(mixed) <= set(unique) and max(mixed.count(i) for i in set(mixed)) == 2
    told = seen["byte-level bpe"].collect()
    assert sorted(r.doc_id for r in told) == sorted(mixed)
    assert all(r.n_tokens == len(r.ids) > 0 for r in told)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, told), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_empty_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, folder).collect() == []


def test_odd_rows_pass_every_stage(spark, folder, odd_docs):
    """Null ids and texts, empty and very long texts, repeated rows and columns of clashing names: no stage fails, and each keeps what it states."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [*odd_docs, (None, "a b c", "en", "s1", 5), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "x", 3, "n", "c", "b", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, root string, score int, n_words string, copies string, block string, size int")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        if k == 4:
            break
        assert made.columns == [*names, "root", "score", "n_words", "copies", "block", "size"], name
        made.write.parquet(f"{folder}/odd{k}")
        made = spark.read.parquet(f"{folder}/odd{k}")
        got = made.collect()
        assert {r.doc_id for r in got} <= {r[0] for r in rows} and all(tuple(r)[5:] == ("x", 3, "n", "c", "b", 7) for r in got), name
        if k == 0:  # the other stages see all the odd rows
            made = docs
        elif k == 1:
            ids = [r.doc_id for r in got]
            assert ids.count(None) == 3 and ids.count(10) == 0 and ids.count(8) == 1 and 9 not in ids and 3 not in ids
        elif k == 2:
            assert len(got) == made.count() and all(r.n_chars == len(r.text) for r in got if r.text is not None)
        docs = made
    told = made.collect()
    assert len(told) == docs.count() and all(r.n_tokens == len(r.ids) for r in told)
