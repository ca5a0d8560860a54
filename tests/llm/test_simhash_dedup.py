import random

import xxhash
from pyspark.sql import functions as F

from loomworks.llm import simhash_dedup as sh


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(fps, radius):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_equals_brute_force(docs, odd_docs):
    got = sh.near_duplicates(docs).collect()
    assert len(got) == len(odd_docs)
    fp = {r[0]: brute_fp(r[1]) for r in odd_docs}
    root = roots(set(fp.values()), 2)
    least = {}
    for i, f in fp.items():
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    for r in got:
        assert r.fp & (1 << 64) - 1 == fp[r.doc_id]
        assert r.component_id == least.get(root[fp[r.doc_id]])


def test_links_in_crowds_and_small_blocks(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:6]:  # crowds: many fingerprints within a few bits
        fps |= {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}
    for radius in (1, 2, 3):
        for crowd in (4, 1000):
            df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
            found = {(r.u, r.v) for r in sh.links(df, radius, crowd).collect()}
            signed = {f - (1 << 64) if f >> 63 else f for f in fps}
            assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= radius and u < v for u, v in found)
            parent = {f: f for f in signed}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for u, v in found:
                x, y = find(u), find(v)
                parent[max(x, y)] = min(x, y)
            assert {f: find(f) for f in signed} == roots(signed, radius)


def test_keep_one(docs):
    kept = sorted((r.doc_id is not None, r.doc_id or 0) for r in sh.keep_one(docs).collect())
    # blank texts are one group (1), the near copies 8 to 10 another; a null id always stays
    assert kept == [(False, 0)] + [(True, i) for i in (1, 4, 5, 6, 7, 8, 11, 12, 13)]


def test_empty_and_extra(empty, docs):
    assert sh.near_duplicates(empty).collect() == []
    assert sh.keep_one(empty).collect() == []
    more = docs.withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(2))
    assert sh.keep_one(more).columns == more.columns


def test_long_drifting_chain(spark):
    rng = random.Random(1)
    chain = [rng.getrandbits(64)]
    while len(chain) < 800:  # each two random bits from the last
        a, b = rng.sample(range(64), 2)
        chain.append(chain[-1] ^ (1 << a) ^ (1 << b))
    signed = [f - (1 << 64) if f >> 63 else f for f in chain]
    edges = spark.createDataFrame([(min(p), max(p)) for p in zip(signed, signed[1:])], "u long, v long")
    assert {(r.fp, r.root) for r in sh.components(edges).collect()} == {(f, min(signed)) for f in signed}
