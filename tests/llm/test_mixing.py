from collections import defaultdict

from pyspark.sql import functions as F

from loomworks.llm import mixing as mx


def size():
    return mx.word_count(F.col("text"))


def fill(sizes, weights, share, most):
    """Targets by repeated dealing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, free = share * sum(sizes.values()), {s: 0.0 for s in names}, set(names)
    left = budget
    while free and left > 1e-9:
        total = sum(w[s] for s in free)
        full = {s for s in free if target[s] + left * w[s] / total >= most * sizes[s]}
        if not full:
            for s in free:
                target[s] += left * w[s] / total
            break
        spent = 0.0
        for s in full:
            spent += most * sizes[s] - target[s]
            target[s] = most * sizes[s]
        left -= spent
        free -= full
    return target


def test_targets(spark):
    sizes = {"a": 100, "b": 5000, "c": 40, "d": 3000, None: 700, "é": 0, "z": 9000}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mx.targets(df).collect()}
    want = fill(sizes, mx.WEIGHTS, 1.5, 2)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_nears_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mx.mix(df, size()).collect()
    assert len(got) == 3000
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    for s in taken:
        assert abs(taken[s] - target[s]) <= 3 * largest[s] + 2
    again = mx.mix(df.coalesce(1), size()).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_odd_rows(docs, odd_docs):
    got = mx.mix(docs, size()).collect()
    assert len(got) == len(odd_docs)
    assert {r.source for r in got} == {"s1", "s2", "s3", None}
    assert sum(r.size for r in got) == sum(len((t or "").encode().split()) for _, t, *_ in odd_docs)
    plan = mx.mixed(docs.withColumn("extra", F.lit(1)), size())
    assert plan.columns == [*docs.columns, "extra"]


def test_empty(empty):
    assert mx.mix(empty, size()).collect() == []
    assert mx.mixed(empty, size()).collect() == []
