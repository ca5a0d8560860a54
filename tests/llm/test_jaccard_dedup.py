import random

import corpus_pipeline
from loomworks.llm import jaccard_dedup as jd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def planted():
    """Texts with edited copies of similarity 0.8 to 0.95 (even k) or below 0.8, as (text, copy, similarity)."""
    rng = random.Random(5)
    out = []
    for k in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([80, 300]))]
        copy = list(words)
        for at in rng.sample(range(len(words)), max(1, round(len(words) * (rng.uniform(0.006, 0.022) if k % 2 == 0 else 0.06)))):
            copy[at] = f"x{rng.randrange(10**9)}"
        out.append((" ".join(words), " ".join(copy)))
    return [(a, b, similarity(a, b)) for a, b in out]


def rows_of(pairs):
    return [(2 * k + s, p[s], "en", "s", 0) for k, p in enumerate(pairs) for s in (0, 1)]


def test_planted_copies(spark):
    pairs = planted()
    assert sum(s >= 0.8 for *_, s in pairs) >= 40 and sum(s < 0.8 for *_, s in pairs) >= 40
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows_of(pairs), SCHEMA), "").collect()}
    assert kept == {2 * k + s for k, p in enumerate(pairs) for s in (0, 1) if s == 0 or p[2] < 0.8}


def test_crowd(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        texts.append((i, " ".join(copy), "en", "s", 0))
    kept = jd.keep_one(spark.createDataFrame(texts, SCHEMA), crowd=4).collect()
    assert [r.doc_id for r in kept] == [0]


def test_crowd_of_uneven_copies(spark):
    """A large group, edited by 0 to 20 words each, against all pairs: no link is lost, none is wrong."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(250):
        copy = list(base[: rng.choice([150, 150, 130])])
        for at in rng.sample(range(len(copy)), rng.choice([0, 1, 2, 4, 8, 20])):
            copy[at] = f"x{rng.randrange(40)}"
        texts.append(" ".join(copy))
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [shingles(t) for t in texts]
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in jd.keep_one(docs, crowd=4).collect()) == sorted({top(i) for i in range(len(texts))})


def test_rows_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = spark.createDataFrame([(1, a, "en", "s", 0), (1, b, "en", "s", 0), (1, a, "en", "s", 0), (2, b, "en", "s", 0), (None, c, "en", "s", 0), (None, c, "en", "s", 0)], SCHEMA)
    assert sorted((r.doc_id or 0, r.text[0]) for r in jd.keep_one(docs).collect()) == [(0, "c"), (0, "c"), (1, "a"), (1, "b")]


def test_odd(docs, empty):
    kept = sorted((r.doc_id is not None, r.doc_id or 0) for r in jd.keep_one(docs).collect())
    # 5 and 6 share 26 of 30 shingles
    assert kept == [(False, 0)] + [(True, i) for i in (1, 4, 5, 7, 8, 11, 12, 13)]
    assert jd.keep_one(empty).collect() == []


def test_simhash_comes_first(spark):
    base = [f"w{i}" for i in range(400)]
    near = [*base[:399], "other"]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"x{i}" for i in range(400)))]
    made = jd.signatures(spark.createDataFrame(rows, "doc_id long, text string"))
    cls = {r.doc_id: r.cls for r in made.collect()}
    got = [(r.u, r.v) for r in jd.simhash_pairs(made.select("cls", "n", "fp"), radius=3).collect()]
    prints = {r.doc_id: r.fp for r in made.collect()}
    apart = ((prints[1] ^ prints[2]) & (1 << 64) - 1).bit_count()
    assert got == ([tuple(sorted((cls[1], cls[2])))] if apart <= 3 else [])
    same = made.withColumn("fp", made.n * 0)  # all of one fingerprint: each meets the least of them alone
    assert {x for p in jd.simhash_pairs(same.select("cls", "n", "fp")).collect() for x in p} == set(cls.values())
    assert jd.simhash_pairs(same.select("cls", "n", "fp")).count() == 2
