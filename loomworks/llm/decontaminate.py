"""Benchmark decontamination: every occurrence of an item's windows of words in the documents, by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of an item (an item of fewer, but not none, is one window). Its set is its
shingles of ``SHINGLE`` words with their places; a document holds the window where it holds all of them, each at its
place. Full containment needs a prefix of one shingle only, the rarest. So:

1. every shingle of every document meets the distinct shingles of the windows by hash and, where the hash agrees, by
   its words: the hits (document, position, shingle), a small table. The counts of hits are the shingles' frequencies;
2. a window's rarest shingle, and it alone, joins the hits: these are the candidates. Length and position bound them:
   the window must begin and end inside the document;
3. a candidate counts where all other shingles of its window are hits at their places too: exact containment over the
   window's own stretch of the document, as hits were compared by their words.

All is DataFrame functions. Words of a document are exploded where they are read and meet broadcast shingles, so no key
gathers rows before only hits are left; what is broadcast is at most ``SHARE`` shingles, and more of them are joined in
as many passes over the documents as that takes. Windows that many items share are one window until the items are told.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTables, without

WINDOW, SHINGLE, SHARE, SALTS = 10, 5, 1_000_000, 32
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lowered: ASCII letters and digits and all beyond ASCII; null has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def windows_of(items: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words): each distinct window of each item."""
    made = items.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    begins = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return made.select("item", F.explode(begins).alias("i"), "w").select("item", F.slice("w", F.col("i"), F.lit(window)).alias("words")).distinct()


def _shingles(of: Column, shingle: int) -> Column:
    """The shingles of an array of words; fewer words than a shingle are one."""
    n = F.least(F.size(of), F.lit(shingle))
    return F.transform(F.sequence(F.lit(1), F.size(of) - n + 1), lambda i: F.slice(of, i, n))


def _hits(docs: DataFrame, known: DataFrame, length: int) -> DataFrame:
    """(id, hash, size, i, s): where documents (id, hash, w) hold shingles (s, key, words) of ``length`` words; i counts from 1."""
    at = docs.filter(F.size("w") >= length).select("id", "hash", "w", F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("i"))
    own = [F.get("w", F.col("i") + (k - 1)) for k in range(length)]
    met = at.join(F.broadcast(known), (F.xxhash64(*own) == F.col("key")) & (F.array(*own) == F.col("words")))
    return met.select("id", "hash", F.size("w").alias("size"), "i", "s")


def _met(left: DataFrame, right: DataFrame, key: str, n: int, share: int) -> DataFrame:
    """``left`` inner join ``right`` (``n`` rows) on ``key``: broadcast up to ``share`` rows, else by salted shuffle."""
    if n <= share:
        return left.join(F.broadcast(right), key)
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64("hash", "i"), F.lit(SALTS)).cast("int")).join(right, [key, "__salt"]).drop("__salt")


def _same(a: DataFrame, b: DataFrame, *also: str):
    """The condition that rows of ``a`` and ``b`` are of one document, null ids included, and agree in ``also``."""
    return reduce(Column.__and__, [(a[c] == b[c]) for c in ("hash", *also)], a["id"].eqNullSafe(b["id"]))


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Where windows occur, (id, hash, i, n, win), each once, and the items that have them, (win, item).

    A document is a row's id and the hash of its text, so equal rows are one. ``i`` is the place of the occurrence's
    first word, from 1, ``n`` its words. Null texts have no words; null item ids are no items.
    """
    spark, tables = docs.sparkSession, SharedTables(docs.sparkSession, "decontaminate")
    told = tables.put(windows_of(items.filter(F.col(item_col).isNotNull()), window, item_col).withColumn("win", F.md5(F.array_join("words", " "))))
    each = told.select("win", F.size("words").alias("n"), "words").distinct()
    parts = tables.put(each.select("win", "n", F.posexplode(_shingles(F.col("words"), shingle)).alias("o", "words")).withColumn("s", F.md5(F.array_join("words", " "))))
    known = parts.select("s", "words").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), words(F.col(text_col)).alias("w"))
    found = []
    for size in known.groupBy(F.size("words").alias("length")).agg(F.count("*").alias("n")).orderBy("length").collect():
        own = known.filter(F.size("words") == size["length"]).select("s", F.xxhash64(*[F.get("words", F.lit(k)) for k in range(size["length"])]).alias("key"), "words")
        passes = -(-size["n"] // share)
        found += [_hits(rows, own.filter(F.pmod("key", F.lit(passes)) == p) if passes > 1 else own, size["length"]) for p in range(passes)]
    if not found:
        return spark.createDataFrame([], f"id {docs.schema[id_col].dataType.simpleString()}, hash long, i int, n int, win string"), told.select("win", "item")
    hits = tables.put(reduce(DataFrame.union, found).distinct())
    uses = hits.groupBy("s").agg(F.count("*").alias("f"))
    ranked = parts.join(uses, "s").groupBy("win", "n").agg(F.array_sort(F.collect_list(F.struct("f", "o", "s"))).alias("all"))
    ranked = tables.put(ranked.filter(F.size("all") == F.col("n") - F.least("n", F.lit(shingle)) + 1))
    prefix = ranked.select("win", "n", F.col("all")[0]["s"].alias("s"), F.col("all")[0]["o"].alias("o"), F.slice("all", 2, window).alias("rest"))
    met = _met(hits, prefix, "s", ranked.count(), share).withColumn("i", F.col("i") - F.col("o"))
    able = met.filter((F.col("i") >= 1) & (F.col("i") + F.col("n") - 1 <= F.col("size"))).select("id", "hash", "i", "n", "win", "rest")
    ask = able.select("id", "hash", F.col("i").alias("begin"), "n", "win", F.explode("rest").alias("r"), F.size("rest").alias("need"))
    ask = ask.select("id", "hash", "begin", "n", "win", "need", (F.col("begin") + F.col("r.o")).alias("i"), F.col("r.s").alias("s"))
    held = ask.join(hits, _same(ask, hits, "i", "s"), "left_semi").groupBy("id", "hash", "begin", "n", "win", "need").agg(F.count("*").alias("k")).filter("k = need")
    out = tables.put(able.filter(F.size("rest") == 0).select("id", "hash", "i", "n", "win").union(held.select("id", "hash", F.col("begin").alias("i"), "n", "win")))
    tables.drop(*range(2, tables.n))
    return out, told.select("win", "item")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside any occurrence), ``items`` (ids, sorted as strings), ``n_items`` and ``contaminated``.

    Null and empty texts have no words and no hits. Repeated rows, and rows of null ids, have results of their own; an
    item given twice is one. Very long texts are judged whole. Without documents the result is empty, without items
    nothing is hit. Columns named so are replaced; others pass through.
    """
    made = ["n_words", "n_hit", "items", "n_items", "contaminated"]
    at, told = occurrences(docs, items, window, shingle, share, id_col, text_col, item_col)
    before = F.max(F.col("i") + F.col("n")).over(Window.partitionBy("id", "hash").orderBy("i", "n").rowsBetween(Window.unboundedPreceding, -1))
    spans = at.select("id", "hash", "i", "n").distinct().withColumn("free", F.greatest("i", F.coalesce(before, F.lit(1))))
    hit = spans.groupBy("id", "hash").agg(F.sum(F.greatest(F.col("i") + F.col("n") - F.col("free"), F.lit(0))).cast("long").alias("n_hit"))
    by = _met(at.groupBy("id", "hash", "win").agg(F.min("i").alias("i")), told, "win", told.count(), share)
    of = by.groupBy("id", "hash").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    hit = hit.alias("h").join(of, _same(hit, of), "inner").select("h.id", "h.hash", "n_hit", "items")
    rows = without(docs, [*made, "__hash"]).withColumn("__hash", F.xxhash64(text_col))
    rows = rows.withColumn("n_words", F.size(words(F.col(text_col))).cast("long"))
    out = rows.join(hit, rows[id_col].eqNullSafe(hit["id"]) & (rows["__hash"] == hit["hash"]), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(*[rows[f"`{c}`"] for c in rows.columns if c != "__hash"], F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), items_.alias("items"), F.size(items_).cast("long").alias("n_items"), F.col("n_hit").isNotNull().alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    """The row a document of the query: the item ids as one hash."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
