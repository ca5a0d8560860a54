"""Ranked lexical search against a plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomworks.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, k=50):
    """[(item_id, rank, doc_id, score)] of (doc_id, text) and (item_id, text) rows."""
    held = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, size, df = len(held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        own = set(TERM.findall(lower(text)))
        found = []
        for i, c, n in held:
            m = 100 - 50 + 50 * n * n_docs // size
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            found += [(-score, i is None, i or 0, i)] if score > 0 else []
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def ask(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, i, "x") for i, t in docs], "doc_id long, text string, score long, rank string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    return sorted(map(tuple, ls.search(d, q, **options).collect()), key=str)


def some(seed, n, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    zipf = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(rng.choices(words, zipf, k=rng.choice((1, 5, 30, 200))))) for i in range(n)]


@pytest.mark.parametrize("k, focus, bucket", [(50, 4, 4096), (7, 2, 16), (3, 0, 8), (400, 99, 32)])
def test_equals_brute_force(spark, k, focus, bucket):
    docs = some(1, 500)
    items = [(i, t) for i, t in some(2, 20)]
    assert ask(spark, docs, items, k=k, focus=focus, bucket=bucket) == brute(docs, items, k)


def test_odd_rows(spark, odd_docs):
    docs = [(r[0], r[1]) for r in odd_docs if r[0] != 10] + [(50 + i, "the café SHOUT a-b") for i in range(60)] + [(10, odd_docs[8][1])]
    items = [(1, "Café naïve 42 日本 🙂"), (2, None), (3, ""), (None, "shout a b"), (5, "the the THE"), (5, "the the THE"), (6, "absent"), (7, odd_docs[7][1])]
    assert ask(spark, docs, items) == brute(docs, items)


def test_repeated_rows_are_documents(spark):
    docs = [(3, "river stone"), (3, "river stone"), (4, "other text here")]
    assert ask(spark, docs, [(1, "river")]) == brute(docs, [(1, "river")])


def test_items_in_blocks(spark):
    docs, items = some(3, 200), some(4, 30)
    assert ask(spark, docs, items, k=5, block_bytes=400) == brute(docs, items, 5)


def test_empty(spark):
    docs, items = some(5, 20), some(6, 3)
    assert ask(spark, [], items) == [] and ask(spark, docs, []) == [] and ask(spark, [(1, None), (2, "-- ")], items) == []


def test_bounds_leave_out_no_row():
    """The candidates of a bucket hold every row that reaches the bound."""
    rng = np.random.default_rng(0)
    cut = rng.integers(1, 12, 300)
    held = np.concatenate([rng.choice(40, c, replace=False) for c in cut]).astype(np.int32)
    impacts = rng.integers(1, 10**6, len(held))
    norms = np.sqrt(np.bincount(np.repeat(np.arange(300), cut), impacts.astype(float) ** 2))
    box, mask = ls.Bucket(np.arange(300), norms, held, impacts, cut, 40), np.zeros(40, np.int64)
    for size in (1, 3, 10, 40):
        item = rng.choice(40, size, replace=False).astype(np.int32)
        full = box.scores(item, np.arange(300), mask)
        for least in (1, int(np.median(full)), int(full.max())):
            for focus in (0, 1, 4, 99):
                rows = box.reach(item, focus, least)
                assert set(np.flatnonzero(full >= max(least, 1))) <= set(rows)
                assert len(rows) == 0 or (box.scores(item, rows, mask) == full[rows]).all()
