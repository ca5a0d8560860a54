"""Quality rules as a short-circuit cascade, in DataFrame and SQL functions only.

A rule is a predicate that rejects a document. On a bounded sample each rule is run alone, with the metrics that it
needs; its share of rejections and its time, less that of reading the sample alone, give rejections per cost, and
the cascade asks the best rule first. A CASE expression
stops at the first rule that rejects, so the order changes the cost only: a document is kept if no rule
rejects it, in any order.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, SharedTables, without

WINDOW = 8
SAMPLE_ROWS, RUNS = 1000, 2
_GAPS = " \t\n\x0b\x0c\r"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def metrics(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``METRICS`` as longs; columns of those names are replaced, others pass through.

    Words are runs of characters that are not ASCII white space; null and blank texts have none. ``n_repeat_words``
    counts the words within windows of ``window`` words that occur twice or more in the text, found by equal
    64-bit hashes of the windows' word hashes; texts shorter than a window have none. Very long texts are handled
    within their row, in memory in proportion to their words. There is no shuffle.
    """
    docs = without(docs, [*METRICS, *(f"__qr_{x}" for x in ("text", "words", "lines", "h", "at", "hit"))])
    keep = [F.col(f"`{c}`") for c in docs.columns]
    made = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__qr_text"))
    lined = F.filter(F.split("__qr_text", "\n"), lambda x: x.rlike(WORD))
    flat = F.trim(F.translate("__qr_text", _GAPS, " " * len(_GAPS)))
    hashed = F.transform(F.split(flat, " +"), lambda w: F.xxhash64(w))
    made = made.select("*", F.when(flat == "", F.array().cast("array<bigint>")).otherwise(hashed).alias("__qr_words"), lined.alias("__qr_lines"))
    n = F.size("__qr_words")
    hashes = F.when(n >= window, F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice("__qr_words", i, window))))
    made = made.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate("__qr_text", _GAPS, "")).cast("long").alias("word_chars"),
        (F.length("__qr_text") - F.length(F.translate("__qr_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__qr_lines") - F.size(F.array_distinct("__qr_lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("__qr_h"),
    )
    # Most texts repeat no window; only the others sort (hash, position).
    repeats = F.size(F.array_distinct("__qr_h")) < F.size("__qr_h")
    made = made.withColumn("__qr_at", F.when(repeats, F.sort_array(F.transform("__qr_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    at = F.col("__qr_at")
    last = F.size(at) - 1

    def twin(k: Column) -> Column:
        before = F.when(k > 0, F.get(at, k - 1)["h"] == F.get(at, k)["h"]).otherwise(False)
        return before | F.when(k < last, F.get(at, k + 1)["h"] == F.get(at, k)["h"]).otherwise(False)

    hits = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda k: F.get(at, k)["i"]))
    made = made.withColumn("__qr_hit", F.when(at.isNotNull(), hits))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(
        "__qr_hit",
        start,
        lambda s, p: F.struct((s["n"] + p + window - F.greatest(s["end"], p.cast("long"))).alias("n"), (p + window).cast("long").alias("end")),
        lambda s: s["n"],
    )
    made = made.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return made.select(*keep, *METRICS)


@dataclass(frozen=True)
class Rule:
    """A named predicate on the text and the metrics; true rejects, false and null do not."""

    name: str
    rejects: Column


def default_rules(text_col: str = "text") -> list[Rule]:
    """Rules for prose: symbols, shouting, exclamation runs, repeated lines, word lengths, words without letters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > words),
        Rule("exclamations", F.regexp_count(text, F.lit("!!")) * 5 > words),
        Rule("capitals", F.regexp_count(text, F.lit(r"\p{Lu}")) * 2 > F.col("word_chars")),
        Rule("dup_lines", F.col("n_dup_lines") * 10 > 3 * F.greatest(F.regexp_count(text, F.lit("\n")) + 1, F.lit(3))),
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 20 * words)),
        Rule("letterless", F.regexp_count(text, F.lit(r"(?:^|[\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?=[\x20\x09-\x0D]|$)")) * 2 > words),
    ]


def plan(texts: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 5, runs: int = RUNS) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds a row) in cascade order: rejections per second, most first.

    The sample, about ``sample_rows`` rows of ``texts``, is a table in the shared folder. Each rule runs alone over
    it, from the text on, so the metrics it needs are in its cost and others are not. A time is the least of ``runs``
    rounds over all rules after one that warms up, as what else a machine does only adds to it; less that of a job that
    only reads the texts, and at least a twentieth of that: what is less can't be told apart. Rules go by name where they
    tie. The sample decides the order alone, never a verdict. Null and empty texts are rows of it like others; of an
    empty table every rule rejects nothing, and the order is that of the names.
    """
    tables = SharedTables(texts.sparkSession, "rules")
    total = texts.count()
    drawn = texts.select(text_col).sample(fraction=min(1.0, sample_rows / max(total, 1)), seed=seed)
    sample = tables.put(drawn)
    measured = metrics(sample, text_col)
    none = Rule("", F.length(text_col) < 0)
    seconds: dict[str, list[float]] = {}
    hits: dict[str, int] = {}
    for k in range(runs + 1):  # the first round warms the JVM up
        for rule in (none, *rules):
            began = time.perf_counter()
            told = measured.agg(F.count_if(rule.rejects).alias("hit"), F.count(F.lit(1)).alias("n")).first()
            hits[rule.name], n = told["hit"], max(1, told["n"])
            if k:
                seconds.setdefault(rule.name, []).append(time.perf_counter() - began)
    tables.drop()
    read = min(seconds[""])
    out = [(rule, hits[rule.name] / n, max(min(seconds[rule.name]) - read, read / 20) / n) for rule in rules]
    return sorted(out, key=lambda r: (-r[1] / r[2], r[0].name))


def cascade(rules: list[Rule]) -> Column:
    """True if no rule rejects; asks them in the order given and stops at the first that does."""
    out = None
    for rule in rules:
        out = F.when(rule.rejects, False) if out is None else out.when(rule.rejects, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``METRICS``, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 20 words, or over 30 of 100 words in repeated windows. ``kept``: false if so, else
    the cascade's verdict. Null and empty texts fail the base; long ones are read whole. Rows are judged each alone, so repeated rows agree; an
    empty table gives an empty result. Columns of those names are replaced.
    """
    docs = without(docs, ["base_failed", "kept"])
    rules = default_rules(text_col) if rules is None else rules
    ordered = [rule for rule, _, _ in plan(docs, rules, text_col, sample_rows)]
    measured = metrics(docs, text_col)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(ordered)))
