import random

import pytest
from pyspark.sql import functions as F

from loomworks.llm import quality_pairs as qp


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)

    def good():
        return " ".join(rng.choice(["the", "river", "of", "stone", "walks", "and", "light", "under"]) + str(rng.randrange(30)) for _ in range(80)) + ".\nEnd."

    def bad(i):
        return ("BUY NOW!! " * 40, "same " * 90, "a$$$ b%%% c*** " * 25)[i % 3]

    rows = [(i, bad(i) if i % 6 == 0 else good()) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 6 == 0 else 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    held = qp.crc_fold("__qp_id", 5) == 0
    model = qp.train(docs, labels, held_out=held)
    got = qp.score(docs, model).filter(qp.crc_fold("doc_id", 5) == 0).collect()
    assert len(got) > 50
    assert sum(r.predicted == int(r.doc_id % 6 != 0) for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_learning_is_stable(corpus):
    docs, labels = corpus
    a = qp.train(docs, labels)
    b = qp.train(docs.repartition(7), labels.repartition(3))
    assert abs(a.weights - b.weights).max() < 1e-9 and abs(a.cut - b.cut) < 1e-9


def test_pairs_rank(corpus):
    docs, labels = corpus
    model = qp.train(docs, labels)
    s = {r.doc_id: r.score for r in qp.score(docs, model).collect()}
    assert min(s[i] for i in range(1, 600) if i % 6) > max(s[i] for i in range(0, 600, 6))


def test_odd_rows(docs, corpus):
    model = qp.train(*corpus)
    out = qp.score(docs.withColumn("score", F.lit("x")).withColumn("extra", F.lit(1)), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "score", "predicted"]
    got = {r.doc_id: r.score for r in out.collect()}
    assert got[1] == got[2] == got[3] and got[8] == got[10]


def test_no_or_odd_labels(spark, corpus, empty):
    docs, labels = corpus
    none = spark.createDataFrame([], labels.schema)
    assert qp.score(docs, qp.train(docs, none)).filter("predicted = 0").count() == 0
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0), (3, 1, 0)], labels.schema)
    assert qp.score(docs, qp.train(docs, odd)).count() == 600
    assert qp.score(empty, qp.train(docs, labels)).collect() == []
