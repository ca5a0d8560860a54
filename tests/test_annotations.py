"""Annotations are those of each pattern by itself, and the query's work is dealt over all tasks."""

import random
import re

from pyspark.sql import functions as F

from loomworks.functions import annotations
from loomworks.plans import catalog

TABLES = {"operations": annotations.OPERATIONS, "domains": {n: (rf"\b(?:{w})\b",) for n, w in annotations.DOMAINS.items()}, "patterns": annotations.PATTERNS, "data_types": annotations.DATA_TYPES}


def plainly(code, said):
    """Every pattern of every table, tried one by one."""
    out = {}
    for kind, table in TABLES.items():
        flags, text = re.A | (0 if kind == "data_types" else re.I), said if kind == "domains" else code
        out[kind] = {n for n, ps in table.items() if text is not None and any(re.search(p, text, flags) for p in ps)}
    if {"iterate", "append"} <= out["operations"] and re.search(r"\bif\s{0,20}\(", code):
        out["operations"] |= {"filter", "map"}
    return {k: sorted(v) for k, v in out.items()}


def samples(rng, n):
    bits = [w for ws in annotations.DOMAINS.values() for w in ws.split("|") if w.isidentifier()] + ["it (x", "it(", "expect (é", "it(_"]
    for p in (p for t in (annotations.OPERATIONS, annotations.PATTERNS, annotations.DATA_TYPES) for ps in t.values() for p in ps):
        plain = re.sub(r"\\d[+*]", "12", re.sub(r"\\w[+*]", "ab", re.sub(r"\\s\{\d,20\}", " ", p.replace(r"\b", "").replace("(?:", "(")))).replace("\\", "")
        bits += [plain, *plain.strip("()").split("|")]
    between = ["", " ", "_", "é", "\u212a", "\u017f", "\u0130", "7", "7.", "\n", "\u00a0", "\x0b", ".", "(", ")", '"', "'", "`", "/", "[]", "{}", "😀"]
    for _ in range(n):
        yield "".join(rng.choice(between) + rng.choice((str, str, str.upper, str.title))(rng.choice(bits)) + rng.choice(between) for _ in range(rng.choice((1, 1, 2, 4))))


def test_annotations_equal_each_pattern_by_itself(spark):
    rng = random.Random(8)
    rows = [(i, c, rng.choice(([], ["task"], ["a", "Job:x"]))) for i, c in enumerate([None, "", " ", *samples(rng, 2500)])]
    frame = spark.createDataFrame(rows, "i int, code string, tags array<string>").repartition(8)
    bare, tagged = annotations.annotate(F.col("code")), annotations.annotate(F.col("code"), F.col("tags"))
    got = {r.i: r for r in frame.select("i", F.struct(*[v.alias(k) for k, v in bare.items()]).alias("bare"), tagged["domains"].alias("tagged")).collect()}
    for i, code, tags in rows:
        want = plainly(code, code)
        assert got[i].bare.asDict() == want, code
        assert got[i].tagged == plainly(code, " ".join([*([] if code is None else [code]), " ".join(tags)]))["domains"], (code, tags)


def test_word_boundaries_are_single_classes():
    """A class of several ranges, or Java's boundary, at each character takes many times as long."""
    for table in (annotations.OPERATIONS, annotations._domain_patterns(), annotations.PATTERNS, annotations.DATA_TYPES):
        for p in (p for ps in table.values() for p in ps):
            assert r"\b" not in annotations._java(p) and "[A-Za-z0-9_]" not in annotations._java(p), p
            assert not annotations._lead(p) or re.sub(r"\\b|\\(?=[^\w\s])", "", p).startswith(annotations._lead(p)), p


def test_a_long_row_of_digits_is_read_once(spark):
    frame = spark.createDataFrame([("1" * 300_000 + "x",), ("x" + "1" * 300_000,), ("1" * 300_000 + ".x",)], "code string")
    assert [r[0] for r in frame.select(annotations.annotate(F.col("code"))["data_types"]).collect()] == [[], [], ["number"]]


def test_pages_of_one_file_are_dealt_over_all_tasks(spark, tmp_path):
    rows = [(i, f"http://a.b/{i}", html) for i, html in enumerate(("<p>User login, 12 orders</p>", None, "", "Array of null"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    made = catalog.semantic_annotations(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, made.collect())) == [(0, "auth+commerce+user", "number"), (1, "", ""), (2, "", ""), (3, "", "array+null")]
