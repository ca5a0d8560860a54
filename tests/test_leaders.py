import random
from pathlib import Path

from pyspark.sql import functions as F

from loomworks.operators import duplicates
from loomworks.operators.duplicates import leaders


def greedy(edges):
    nodes, led, out = sorted({n for e in edges for n in e}), set(), {}
    near = {n: sorted(i for i, j in edges if j == n) for n in nodes}
    for n in nodes:
        first = [i for i in near[n] if i in led]
        out[n] = first[0] if first else n
        if not first:
            led.add(n)
    return out


def found(spark, edges):
    return {r.node: r.leader for r in leaders(spark.createDataFrame(sorted(edges), "i long, j long")).collect()}


def test_long_chain(spark):
    edges = {(i, i + 1) for i in range(1000)}
    assert found(spark, edges) == greedy(edges)


def test_least_leader(spark):
    edges = {(1, 2), (2, 3), (3, 6), (5, 6)}  # 3 leads only after 2 is taken, yet takes 6 before 5
    assert found(spark, edges) == {1: 1, 2: 1, 3: 3, 5: 5, 6: 3}


def test_random_graph(spark):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(120)}
    assert found(spark, edges) == greedy(edges)


def test_iterations_delete_their_rounds(spark):
    """One table is left of each iteration, and none once all are dropped."""
    from loomworks.operators import graph
    from loomworks.streaming import lifecycle

    def tables():
        return [sorted(p.name for p in Path(r.path.removeprefix("file:")).glob("*")) for r in graph.Rounds.made]

    graph.Rounds.drop_all()
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "i long, j long")
    results = [
        graph.components(spark.range(41), links),
        duplicates.leaders(links),
        lifecycle.retry_lineage(links.select(F.col("j").alias("id"), F.col("i").alias("retried_from"))),
    ]
    assert [r.count() for r in results] == [41, 41, 40]
    assert [len(t) for t in tables()] == [1, 1, 1]
    paths = [Path(r.path.removeprefix("file:")) for r in graph.Rounds.made]
    graph.Rounds.drop_all()
    assert graph.Rounds.made == [] and not any(p.exists() for p in paths)
