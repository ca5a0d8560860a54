import hashlib

import pytest
from pyspark.sql import functions as F

from loomworks.llm import fingerprints as fp


def brute(a, b):
    return 1 - sum((x ^ y).bit_count() for x, y in zip(a, b)) / (64 * len(a))


def words(hexed):
    return [int(hexed[i : i + 16], 16) for i in range(0, len(hexed), 16)]


def test_edited_and_likeness(docs, odd_docs):
    got = fp.compare_edited(docs).collect()
    assert len(got) == len(odd_docs)
    order = sorted(odd_docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted((r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert abs(brute(words(r.fingerprint), words(r.edited_fingerprint)) - r.near_edited) < 1e-12
        by[r.doc_id] = r
    assert by[8].fingerprint == by[10].fingerprint and by[2].fingerprint == by[3].fingerprint
    assert by[12].near_next == brute(words(by[12].fingerprint), words(by[13].fingerprint))
    assert by[8].near_next > 0.9 > by[7].near_next


def test_next_goes_round_over_blocks(spark):
    df = spark.createDataFrame([(i * 10, f"t{i}") for i in range(50)], "doc_id long, text string").repartition(3)
    for blocks in (1, 7, 200):
        got = {r.doc_id: r.next_text for r in fp.with_next(df, blocks=blocks).collect()}
        assert got == {i * 10: f"t{(i + 1) % 50}" for i in range(50)}
    one = spark.createDataFrame([(1, "alone")], "doc_id long, text string")
    assert fp.with_next(one).first().next_text == "alone"


def test_votes_equal_brute_force(spark):
    text = "the cat sat on the mat the cat"
    w = text.split()
    pairs = list(zip(w, w[1:]))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    made = fp.fingerprint(df, ["id"], "text").first().fp
    for seed, got in zip(fp.SEEDS, made):
        rows = spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64(F.lit(seed), "a", "b").alias("h"), (F.length("a") + F.length("b")).alias("w")).collect()
        total = sum(r.w for r in rows)
        want = sum(1 << b for b in range(64) if 2 * sum(r.w for r in rows if r.h >> b & 1) > total)
        assert got & (1 << 64) - 1 == want


def planted(words):
    """Random fingerprints and copies of them with up to 5 bits flipped, as unsigned words."""
    import random

    rng = random.Random(2)
    base = [rng.getrandbits(64 * words) for _ in range(40)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64 * words), n)) for b in base for n in (1, 3, 4, 5)] + base[:3]
    return [[v >> 64 * w & (1 << 64) - 1 for w in range(words)] for v in values]


@pytest.mark.parametrize("words,radius", [(1, 3), (2, 4)])
def test_search_equals_brute_force(spark, words, radius):
    values = planted(words)
    signed = [[v - (1 << 64) if v >> 63 else v for v in row] for row in values]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp array<long>")
    got = [(r.asked_id, r.id, r.distance) for r in fp.search(df, df.filter("id % 20 = 0"), radius, words).collect()]

    def far(i, j):
        return sum((a ^ b).bit_count() for a, b in zip(values[i], values[j]))

    want = {(i, j, far(i, j)) for i in range(0, len(values), 20) for j in range(len(values)) if far(i, j) <= radius}
    assert len(got) == len(set(got)) and set(got) == want
    crowds = fp.pairs_within(df.select("fp").distinct(), df.filter("id % 20 = 0").select("fp").distinct(), radius, words, crowd=1)
    assert crowds.count() == len({(tuple(values[i]), tuple(values[j])) for i, j, _ in want})


def test_query_searches_all_rows(docs, odd_docs):
    got = fp.compare_edited(docs, asks=F.col("doc_id") % 2 == 0).collect()
    plain = {r.doc_id: r.fingerprint for r in got}
    assert len(got) == len(odd_docs)
    for r in got:
        if r.doc_id is None or r.doc_id % 2:
            assert r.n_within is None and r.first_within is None
        else:
            near = [x[0] for x in odd_docs if brute(words(plain[x[0]]), words(r.fingerprint)) >= 1 - fp.RADIUS / 128]
            assert (r.n_within, r.first_within) == (len(near), min(i for i in near if i is not None))


def test_empty_and_extra(empty, docs):
    assert fp.compare_edited(empty).collect() == []
    assert fp.compare_edited(empty, asks=F.col("doc_id") % 20 == 0).collect() == []
    assert fp.compare_edited(docs.withColumn("block", F.lit(1)).withColumn("fp", F.lit(2))).count() == docs.count()


def test_plan_of_a_fingerprint_is_small(docs):
    made = fp.fingerprint(docs.select("doc_id", "text"), ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("CASE WHEN") < 20 and len(made) < 15_000


def test_search_broadcasts_no_side_that_grows(spark, tmp_path):
    """The sides' files are far below the threshold, which says little of them once they are exploded."""
    rows = spark.range(600).select(F.col("id"), F.array(F.xxhash64("id"), F.xxhash64("id", F.lit(1))).alias("fp"), F.lit(1).cast("long").alias("n"), F.col("id").alias("least"))
    rows.write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    asked = index.filter("id % 20 = 0")
    for made in (fp.within(index.select("fp", "n", "least"), asked.select("fp")), fp.search(index.select("id", "fp"), asked.select("id", "fp")).drop("distance")):
        assert len(made.collect()) == 30
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        joins = [x for x in plan.splitlines() if "Join" in x]
        # Only the crowded keys, none here, may be broadcast: a left join on the keys of a table.
        assert joins and all("SortMergeJoin" in x or "LeftOuter" in x for x in joins), joins
