import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomworks.llm import langid as li

WORDS = {"en": "the and of to in that was with for from which their".split(), "fr": "le la les des une dans est pour avec été où qui".split(), "de": "der die das und nicht mit für über ein schön auf".split()}


@pytest.fixture(scope="module")
def models(spark):
    rng = random.Random(1)
    rows = [(lang, " ".join(rng.choice(w) for _ in range(60)).capitalize() + ".") for lang, w in WORDS.items() for _ in range(40)]
    return li.profiles(spark.createDataFrame([*rows, (None, "the"), ("xx", "123"), ("yy", None)], "lang string, text string"))


def test_profiles_equal_brute_force(spark):
    text = "The cat, the CAT 7 at"
    got = li.profiles(spark.createDataFrame([("en", text)], "lang string, text string"), size=1000)["en"]
    count = Counter()
    for w in "the cat the cat at".split():
        count.update(w)
    flat = " the cat the cat at "
    count.update(flat[i : i + 2] for i in range(len(flat) - 1))
    count.update(flat[i : i + 3] for i in range(len(flat) - 2) if flat[i + 1] != " ")

    def code(g):
        out = 0
        for ch in g:
            out = out << 21 | (1 if ch == " " else ord(ch))
        return out

    want = [c for c, _ in sorted(((code(g), n) for g, n in count.items()), key=lambda x: (-x[1], x[0]))]
    assert got.tolist() == want


def test_parts_of_a_long_text_count_as_the_whole(monkeypatch):
    text, letters = "The cat, the CAT 7 at " + "x" * 50 + " été\u0301 fin. " * 9, li._letters()
    whole = Counter(li._grams(text, letters).tolist())
    for size in (1, 2, 3, 7, 40):
        monkeypatch.setattr(li, "_CHUNK", size)
        parts = list(li._chunks(text))
        assert "".join(parts) == text
        assert sum((Counter(li._grams(p, letters).tolist()) for p in parts), Counter()) == whole
    assert list(li._chunks(None)) == list(li._chunks("")) == []


def test_distance_equals_brute_force(models):
    judge, letters = li._Judge(models, 300), li._letters()
    codes = li._grams("the night was dark and full of stars", letters)
    own = li._ranked(codes, 300).tolist()
    best = min((sum(min(abs(p.index(g) - r), 300) if g in p else 300 for r, g in enumerate(own)), lang) for lang, p in ((k, v.tolist()) for k, v in models.items()))
    assert judge(codes)[0] == best[1] == "en"


def test_predictions(spark, models):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(15)), lang) for i, lang in enumerate(list(WORDS) * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, truth string")
    got = li.predict(df, models).collect()
    assert sum(r.lang_pred == r.truth for r in got) >= 58
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(docs, models, empty, spark):
    out = li.predict(docs.withColumn("score", F.lit(1)), models)
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[8] == got[10]
    assert set(models) == {"en", "fr", "de"}
    assert li.predict(empty, models).collect() == []
    assert li.profiles(empty) == {}
    assert {r.lang_pred for r in li.predict(docs, {}).collect()} == {"und"}
    assert li._grams("1 2 3", li._letters()).dtype == np.int64
