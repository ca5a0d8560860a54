import re
from collections import defaultdict

from pyspark.sql import functions as F

from loomworks.llm import quality_rules as qr


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    where = defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i : i + 8])].append(i)
    covered = {p + k for v in where.values() if len(v) > 1 for p in v for k in range(8)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_metrics_equal_brute_force(docs, odd_docs):
    got = qr.metrics(docs).select("doc_id", *qr.METRICS).collect()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == sorted((repr(r[0]), *brute(r[1])) for r in odd_docs)


def test_verdicts(docs):
    got = {r.doc_id: (r.base_failed, r.kept) for r in qr.judge(docs.filter("doc_id IS NOT NULL")).collect()}
    assert got[7] == got[8] == (False, True)
    assert got[1] == got[2] == got[4] == (True, False)
    assert got[12][1] is False and got[13][1] is False


def test_order_changes_no_verdict(spark):
    rows = [(i, ("good prose about many things and more words here " * 4) + ("###" if i % 3 else "") * i + " OK!! " * (i % 7 * 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rules = qr.default_rules()
    m = qr.metrics(df)
    a = m.select("doc_id", qr.cascade(rules).alias("k")).collect()
    b = m.select("doc_id", qr.cascade(rules[::-1]).alias("k")).collect()
    assert a == b
    planned = qr.plan(df, rules)
    assert {r.name for r, _, _ in planned} == {r.name for r in rules}
    worth = [share / cost for _, share, cost in planned]
    assert worth == sorted(worth, reverse=True)


def test_costly_rule_goes_last(spark):
    """Of rules that reject the same rows, the cheap ones come first, in every run."""
    rows = [(i, "plain words in a row and then some " * 60 + ("!!" if i % 2 else "")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hit = F.col("text").endswith("!!")
    slow = F.regexp_count("text", F.lit(r"(?:[a-z]+[ ]){3,9}(?=[a-z]*q)")) >= 0
    costly = [qr.Rule("a_windows", hit & (F.col("n_repeat_words") >= 0)), qr.Rule("b_regex", hit & slow | ~slow)]
    cheap = qr.Rule("z_cheap", hit)
    for _ in range(2):
        planned = qr.plan(df, [*costly, cheap], runs=3)
        assert planned[0][0].name == "z_cheap" and planned[0][2] < min(p[2] for p in planned[1:])
        assert {round(p[1], 6) for p in planned} == {round(planned[0][1], 6)}


def test_cascade_equals_brute_force(docs, odd_docs):
    rules = qr.default_rules()
    m = qr.metrics(docs)
    each = m.select("doc_id", qr.cascade(rules).alias("kept"), *[F.coalesce(r.rejects, F.lit(False)).alias(r.name) for r in rules]).collect()
    assert len(each) == len(odd_docs) and all(r.kept == (not any(r[x.name] for x in rules)) for r in each)


def test_empty_and_clash(empty, docs):
    assert qr.judge(empty).collect() == []
    out = qr.judge(docs.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("y")))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *qr.METRICS, "base_failed", "kept"]
    assert qr.judge(docs, rules=[]).count() == docs.count()
