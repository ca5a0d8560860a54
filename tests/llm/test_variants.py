"""Spelling variants against all pairs of edit distance one."""

import random
import re
import zlib
from collections import Counter

import pytest

from loomworks.llm import variants as v

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs, shortest=7):
    n = Counter()
    for i, text in docs:
        for w in RUN.findall(text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest}


def brute(docs, shortest=7, least=2, times=10):
    n = {w: k for w, k in counted(docs, shortest).items() if k >= least}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x), default=None) for w, xs in near.items()}
    form = {w: x if x and n[x] >= times * n[w] else None for w, x in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def ask(spark, docs, **options):
    made = v.variants(spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int"), **options)
    return sorted(tuple(r) for r in made.select("word", "form", "root", "n", "n_near", "form_n").collect())


def typos(seed, n, alphabet="abcé"):
    """Documents of a few long words, their typos and typos of those, in falling numbers."""
    rng = random.Random(seed)

    def err(w):
        i = rng.randrange(len(w))
        return rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :]))

    base = ["".join(rng.choices(alphabet, k=rng.randint(7, 11))) for _ in range(25)]
    once = [err(w) for w in base for _ in range(6)]
    twice = [err(w) for w in once]
    pool = base * 250 + once * 8 + twice
    return [(i, " ".join(rng.choices(pool, k=120))) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 8])
def test_equals_brute_force(spark, block):
    docs = typos(1, 150)
    want = brute(docs)
    assert ask(spark, docs, block=block) == want
    assert any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want)


def test_index_equals_all_pairs():
    rng = random.Random(3)
    own = sorted({"".join(rng.choices("ab", k=rng.randint(1, 7))) for _ in range(150)})
    index = v.Index(own)
    for w in [*own, "aaaaaaaaa", "b"]:
        bits = index.near(w)
        assert {x for j, x in enumerate(own) if bits >> j & 1} == {x for x in own if one_apart(w, x)}
        bits = index.near(w, 2)
        assert {x for j, x in enumerate(own) if bits >> j & 1} == {x for x in own if one_apart(w, x) and not (len(w) >= 2 and x[:2] == w[:2])}


def test_odd_rows(spark, odd_docs):
    docs = [(r[0], r[1]) for r in odd_docs] + [(77, "Größenwahn ÉCLAIRS éclairs Éclairs nation×al nation÷al 日本nationalé " * 3), (None, "nationale nationale")]
    assert ask(spark, docs) == brute(docs)


def test_chain_of_forms(spark):
    docs = [(i, "abcdefgh") for i in range(2000)] + [(5000 + i, "abcdefgx") for i in range(150)] + [(9000 + i, "abcdefxx") for i in range(12)]
    got = {r[0]: r for r in ask(spark, docs)}
    assert got["abcdefxx"][1] == "abcdefgx" and got["abcdefxx"][2] == "abcdefgh" and sorted(got.values()) == brute(docs)


def test_empty_and_parameters(spark):
    assert ask(spark, []) == [] and ask(spark, [(1, None), (2, "short")]) == []
    with pytest.raises(ValueError):
        ask(spark, [], times=1)
