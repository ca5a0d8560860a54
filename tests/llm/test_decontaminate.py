"""Decontamination against a plain search for every window at every place."""

import hashlib
import random
import re

import pytest

from loomworks.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
words = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, of = words(text), set(), set()
        for item, own in items:
            x = words(own)
            for a in range(max(1, len(x) - window + 1) if x else 0):
                part = x[a : a + window]
                for k in range(len(w) - len(part) + 1):
                    if item is not None and w[k : k + len(part)] == part:
                        hit |= set(range(k, k + len(part)))
                        of.add(str(item))
        out.append((i, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def ask(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, n_hit long, `a.b` string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    found = dc.contamination(d, q, **options)
    assert found.columns == ["doc_id", "text", "a.b", "n_words", "n_hit", "items", "n_items", "contaminated"]
    return sorted((tuple(r) for r in dc.digest(found).collect()), key=str)


def planted(seed, n, vocabulary=12):
    """Few words, so that parts of windows are everywhere, and whole passages in some documents."""
    rng = random.Random(seed)
    text = lambda k: [rng.choice("Ab cé dd e1 F g h ii jj kk ll".split()[:vocabulary]) for _ in range(k)]
    items = [(i, " ".join(text(rng.choice((1, 3, 4, 5, 9, 10, 11, 25))))) for i in range(15)]
    docs = []
    for i in range(n):
        w = text(rng.choice((0, 3, 30, 120)))
        for _ in range(rng.choice((0, 0, 1, 3))):
            own = rng.choice(items)[1].split()
            a = rng.randrange(len(w) + 1)
            w[a:a] = own[rng.choice((0, 0, 1)) :]
        docs.append((i, rng.choice((" ", ", ", "\n")).join(w)))
    return docs, items


@pytest.mark.parametrize("options", [{}, {"share": 7}, {"window": 4, "shingle": 2}, {"shingle": 12}, {"shingle": 1, "share": 3}])
def test_equals_brute_force(spark, options):
    docs, items = planted(1, 120)
    want = brute(docs, items, options.get("window", 10))
    assert ask(spark, docs, items, **options) == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)


def test_odd_rows(spark, odd_docs):
    docs = [(r[0], r[1]) for r in odd_docs] + [(None, "one two three"), (None, "one two three"), (8, "one TWO-three four"), (30, "a École ÉCOLE École İX \u212aELVIN b"), (31, "école école İx kelvin école École")]
    items = [(1, "one two three"), (1, "one two three"), (12, "Two three"), (None, "a b c"), (3, None), (4, "--"), (5, odd_docs[8][1]), (6, "größe naïve café the end tis 42 日本 🙂 x"), (7, "ÉCOLE École İx \u212aelvin"), (9, "école École")]
    assert ask(spark, docs, items) == brute(docs, items)


def test_same_window_in_many_items(spark):
    text = " ".join(f"w{i}" for i in range(14))
    docs, items = [(i, f"x{i} {text} y") for i in range(40)], [(i, text) for i in range(60)]
    assert ask(spark, docs, items) == brute(docs, items) == ask(spark, docs, items, share=5)


def test_empty(spark):
    docs, items = planted(2, 5)
    assert ask(spark, [], items) == [] and ask(spark, docs, []) == brute(docs, []) and ask(spark, docs, [(1, "?!")]) == brute(docs, [])


def test_clashing_columns_pass(spark):
    docs, items = planted(3, 30)
    d = spark.createDataFrame([(i, t, 1, "h", 2, "w") for i, t in docs], "doc_id long, text string, id long, hash string, i int, win string")
    found = dc.contamination(d, spark.createDataFrame(items, "item_id long, text string"))
    assert found.columns[:6] == ["doc_id", "text", "id", "hash", "i", "win"] and found.filter("id = 1 AND hash = 'h' AND i = 2 AND win = 'w'").count() == 30
    assert sorted((tuple(r) for r in dc.digest(found).collect()), key=str) == brute(docs, items)


def test_native(spark):
    """No Python worker runs in the plan of occurrences or of the digest."""
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = dc.contamination(d, q)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
