import hashlib
import random

from pyspark.sql import functions as F

from loomworks.llm import substring_dedup as sd


def brute(rows, window):
    """Kept words and spans by (doc_id, text) order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] is not None, rows[i][1] or ""))
    seen, out = set(), []
    for i in order:
        w = (rows[i][1] or "").encode().split()
        hit = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                hit[s : s + window] = [True] * window
            seen.add(k)
        kept = b" ".join(x for x, h in zip(w, hit) if not h)
        out.append((rows[i][0], len(w), sum(hit), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_equals_brute_force(docs, odd_docs):
    got = sd.digest(sd.remove_repeats(docs, window=20, blocks=5, buckets=3)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute([r[:2] for r in odd_docs], 20)


def test_random_texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sd.digest(sd.remove_repeats(df, window=5, blocks=7, buckets=4)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, 5)


def test_cuts_in_place(spark):
    shared = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"a\n{shared}"), (2, f"x\ty  {shared}\nz")], "doc_id long, text string")
    out = {r.doc_id: r for r in sd.remove_repeats(df).collect()}
    assert out[1].text == f"a\n{shared}" and out[1].spans == []
    assert out[2].text == "x\ty  z" and [tuple(s) for s in out[2].spans] == [(2, 22)]


def test_extra_and_clashing_columns(docs):
    out = sd.remove_repeats(docs.withColumn("spans", F.lit("mine")).withColumn("extra", F.lit(3)))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "n_words", "spans"]
    assert out.count() == docs.count()


def test_empty(empty):
    assert sd.remove_repeats(empty).collect() == []
