import math
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from loomworks.llm import quality_pairs
from loomworks.llm import url_filter as uf


@pytest.fixture(scope="module")
def known(spark):
    texts = [("the river runs free and the cold river, Größe! x",), (None,), ("",), ("stone river the the 日本 a" + "b" * 30,)]
    return uf.unigrams(spark.createDataFrame(texts, "text string"))


def test_parts_and_rules(spark, known):
    cases = [
        (1, "https://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "http://example.net/EN/x", "example.net", "/EN/x", "net/", "block"),
        (3, "http://b.example.com/de/", "b.example.com", "/de/", "example.com/de/", "block"),
        (4, "http://c.org/fr/1", "c.org", "/fr/1", "org/fr/", "allow"),
        (5, "http://x.net", "x.net", "", None, None),
        (6, "http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
        (7, None, "", "", None, None),
        (8, "no scheme", "", "", None, None),
        (9, "x://h?p=/a://b", "h", "", None, None),
        (10, "x://ÄB.org/fr/\n", "Äb.org", "/fr/\n", "org/fr/", "allow"),
    ]
    df = spark.createDataFrame([(c[0], c[1]) for c in cases], "page_id long, url string")
    got = {r.page_id: r for r in uf.judge(df, uf.Model(known, {}, -1.0)).collect()}
    for i, _, host, path, rule, verdict in cases:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or "allow")


def value(words, counts, total):
    return sum(math.log(counts[w] / total) if w in counts else math.log(10 / max(total, 10)) - len(w) * math.log(10) for w in words)


def best(name, counts, total):
    """Every split of ``name``: the value of the best."""
    splits = []
    for cut in product([0, 1], repeat=max(0, len(name) - 1)):
        words, word = [], name[0]
        for c, ch in zip(cut, name[1:]):
            words, word = ([*words, word], ch) if c else (words, word + ch)
        splits.append(value([*words, word], counts, total))
    return max(splits)


def test_segmentation_equals_brute_force(spark):
    counts = {"free": 50, "casino": 20, "bets": 9, "be": 90, "ts": 3, "cas": 4, "in": 70, "ob": 2, "o": 5, "größe": 7}
    total = sum(counts.values())
    known = uf.Unigrams(spark.createDataFrame(list(counts.items()), "word string, n bigint"), total)
    names = ["freecasino", "freebets", "casinobets", "zzfree", "x", "größebets", "freecasinobets", "q" * 14, "0"]
    got = {r.name: r.words for r in uf.segment(spark.createDataFrame([(n,) for n in names], "name string"), known).collect()}
    counts.pop("o")  # parts of one letter are no words
    for name in names:
        assert "".join(got[name]) == name and abs(value(got[name], counts, total) - best(name, counts, total)) < 1e-6
    assert got["freecasinobets"] == ["free", "casino", "bets"] and got["größebets"] == ["größe", "bets"] and got["q" * 14] == ["q" * 14]
    long = uf.viterbi("ab" * 50_000, {(0, 2): 5}, 100)
    assert long == ["ab", "ab" * 49_999]


def test_unigrams(known):
    got = {r.word: r.n for r in known.words.collect()}
    assert {w: got[w] for w in ("the", "river", "größe", "日本", "cold")} == {"the": 4, "river": 3, "größe": 1, "日本": 1, "cold": 1}
    assert "a" + "b" * 30 not in got and "x" not in got and len(got) == 9


def test_words_of_any_script(spark):
    text = "हिन्दी cafe\u0301 \u0301x naïve a1 ن\u0651ص"
    got = {r.word for r in uf.unigrams(spark.createDataFrame([(text,)], "text string")).words.collect()}
    assert got == {"हिन्दी", "cafe\u0301", "naïve", "ن\u0651ص"}


def test_bayes_equals_brute_force(spark, known):
    rows = [("http://freecasino.com/win", 1), ("http://freecasino.com/win", 1), ("http://casino.org/", 1), ("http://river.com/en/free", 0), ("http://stone.org/12", 0), ("http://both.org/", 0), ("http://both.org/", 1), (None, 1)]
    model = uf.learn(spark.createDataFrame(rows, "url string, block int"), known)
    hosts = {1: ["free", "casino", "com", "casino", "org"], 0: ["river", "com", "stone", "org"]}
    paths = {1: ["/win"], 0: ["/en", "/free", "/0"]}
    want = {}
    for of in (hosts, paths):
        v = set(of[0] + of[1])
        want |= {t: math.log((of[1].count(t) + 1) / (len(of[1]) + len(v))) - math.log((of[0].count(t) + 1) / (len(of[0]) + len(v))) for t in v}
    assert model.weights.keys() == want.keys() and all(abs(model.weights[t] - w) < 1e-12 for t, w in want.items())
    assert abs(model.prior - math.log(3 / 4)) < 1e-12
    asked = spark.createDataFrame([(1, "http://casinoriver.com/win/7?x")], "page_id long, url string")
    got = uf.judge(asked, model, rules=()).first()
    assert got.segments == "casino river com" and got.verdict == ("block" if got.block_score > 0 else "allow")
    assert abs(got.block_score - model.prior - sum(want[t] for t in ("casino", "river", "com", "/win", "/0"))) < 1e-6


def texts():
    """Pages of six made-up words: those of ``bad`` ones have junk for text."""
    good, junk = "The old bridge over the river was built of grey stone, and people walk there. " * 4, "win win win!! $$$ &&& ### click click *** " * 12
    bad, plain = ("zorka", "blint", "quoff"), ("meadow", "harbor", "window")
    rows = []
    for i in range(120):
        word = (bad + plain)[i % 6]
        rows.append((i, f"http://{word}{'abc'[i // 6 % 3]}{i % 5}.{word}.com/{i % 7}", f"<html><script>x = '<p>{good}'</script><p>{junk if word in bad else good}&amp;</p></html>"))
    return rows, bad, plain


@pytest.fixture(scope="module")
def quality(spark):
    rows, *_ = texts()
    docs = spark.createDataFrame([(i, h) for i, _, h in rows], "doc_id long, html string").select("doc_id", uf.page_text(F.col("html")).alias("text"))
    return quality_pairs.train(docs, spark.createDataFrame([(i, int(i % 6 >= 3)) for i, *_ in rows], "doc_id long, quality int"))


def test_evidence(spark, quality):
    rows, bad, _ = texts()
    odd = [(900, None, rows[0][2]), (901, "http://a/", None), (902, "http://b/", "<p> </p>"), (903, "http://c/", "")]
    pages = spark.createDataFrame([*rows, *odd], "page_id long, url string, html string").withColumn("score", F.lit("x"))
    got = uf.evidence(pages, quality).collect()
    assert sorted((r.url, r.block) for r in got) == sorted((u, int(any(w in u for w in bad))) for _, u, _ in rows)


def test_held_out_by_word(spark, known, quality):
    """A model knows the words of its own hosts and no others: on hosts of other words only what both halves share counts."""
    rows, bad, plain = texts()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    words = uf.Unigrams(spark.createDataFrame([(w, 10) for w in bad + plain], "word string, n bigint"), 1000)
    own, other = {bad[0], bad[1], plain[0]}, {bad[2], plain[1], plain[2]}
    side = lambda half: F.col("url").rlike("|".join(half))
    model = uf.learn(uf.evidence(frame.filter(side(own)), quality), words)
    assert own.isdisjoint(other) and own <= model.weights.keys() and other.isdisjoint(model.weights)
    seen = uf.judge(frame.filter(side(own)).drop("html"), model, rules=()).collect()
    told = [(r.verdict == "block", any(w in r.url for w in bad)) for r in seen]
    assert sum(a and b for a, b in told) == sum(b for _, b in told) == sum(a for a, _ in told)  # precision and recall 1
    for r in uf.judge(frame.filter(side(other)).drop("html"), model, rules=()).collect():
        shared = [t for t in r.segments.split() if t in model.weights] + ["/0"]
        assert other & set(r.segments.split()) and abs(r.block_score - model.prior - sum(model.weights[t] for t in shared)) < 1e-6


def test_no_word_of_the_tables_in_code():
    """Nothing of a host is written in the code: no name of the tables' hosts is found there but the rules' own."""
    import inspect
    from pathlib import Path

    path = Path("/root/testdata/sf0.01/pages.parquet")
    if not path.exists():
        pytest.skip("no tables")
    import pyarrow.parquet as pq

    hosts = {u.split("://")[1].split("/")[0].lower() for u in pq.read_table(path, columns=["url"])["url"].to_pylist() if u and "://" in u}
    names = {n for h in hosts for n in re.findall("[a-z]{4,}", h)} - {"example", "blog"}
    code = inspect.getsource(uf).lower()
    assert not [n for n in names if re.search(rf"(?<![a-z]){n}(?![a-z])", code)] and len(names) > 50


def test_hot_names_and_urls(spark, known, monkeypatch):
    """With every key too frequent, or none, the joins give the same rows."""
    rows = [(i, "http://a.example.com/en/" if i % 3 else f"http://casino{'abcde'[i % 5]}.example.com/{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    model = uf.learn(spark.createDataFrame([(u, int("casino" in u)) for _, u in rows[:20]], "url string, block int"), known)
    got = []
    for heavy in (1, 10**9):
        monkeypatch.setattr(uf._joined, "__defaults__", (heavy,))
        got.append(sorted(map(tuple, uf.judge(df, model).collect())))
    assert got[0] == got[1] and len(got[0]) == 60


def test_empty_and_clash(spark, known):
    none = spark.createDataFrame([], "page_id long, url string")
    model = uf.learn(spark.createDataFrame([], "url string, block int"), uf.unigrams(spark.createDataFrame([], "text string")))
    assert uf.judge(none, model).collect() == [] and model.prior < 0
    df = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id long, url string").withColumn("host", F.lit(3)).withColumn("uses", F.lit(4))
    out = uf.judge(df, model)
    assert out.columns == ["page_id", "url", "uses", "host", "path", "rule", "verdict", "segments", "block_score"] and out.count() == 3
