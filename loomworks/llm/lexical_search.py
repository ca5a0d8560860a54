"""Ranked lexical search: the k best documents of every item by a sum of integer term impacts, found over norm buckets.

A document is a vector of impacts over the items' terms, an item a vector of ones, the score their inner product. The
search is LEMP's: documents are walked in order of length, longest first, in buckets. By Cauchy-Schwarz no document of a
bucket can score more for an item than |item| times the bucket's greatest length, so a bucket below the item's k-th
best score is skipped. Inside, the item's ``FOCUS`` heaviest coordinates are added up, and Cauchy-Schwarz over the other
coordinates bounds the rest; documents that still may reach the k-th best are scored exactly, in 64-bit integers.
Bounds are in doubles, raised by a billionth, and only what lies strictly below is left out, so no result is lost.

Plan: one pass over the texts counts terms (the items' terms only are kept; a document's size counts all). Its small
table gives document frequencies, then vectors. A share of the vectors is searched first, for a lower bound of every
item's k-th best score; then each task walks its own vectors, sorted by length, with what it has found as its bound.
Tasks return at most k rows an item. Items are taken in blocks of ``ITEM_BYTES`` of text, each a search of its own, so
what tasks hold of them, and what is collected, has that bound; the documents of no group or key meet in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTables, small_batches

K, FOCUS, BUCKET, SEED_SHARE, ITEM_BYTES = 50, 4, 4096, 16, 4 << 20
#: A null id inside a task: it comes after all others.
_NULL = (1 << 63) - 1
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters and digits and all beyond ASCII, A-Z lowered; null has none."""
    return text.translate(_WORDS).split() if text else []


def _flat(lists: list[np.ndarray], kind) -> pa.Array:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists).astype(kind) if lists else np.empty(0, kind)))


def counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf) of every row: its number of terms, and the vocabulary's numbers among them with their occurrences."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            sizes, found, times = [], [], []
            for text in b.column(1).cast(pa.large_binary()).to_pylist():
                own, all_ = {}, terms(text)
                for w in all_:
                    if w in vocabulary:
                        own[w] = own.get(w, 0) + 1
                sizes.append(len(all_))
                found.append(np.fromiter((vocabulary[w] for w in own), np.int32, len(own)))
                times.append(np.fromiter(own.values(), np.int64, len(own)))
            ids = b.column(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), _flat(found, np.int32), _flat(times, np.int64)], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def weight(n_docs: int, df: int) -> int:
    """A term's weight: floor of 1000 * ln((2N + 2) / (2df + 1)), in doubles."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def vectors(counted: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, norm, terms, impacts) of the rows with an impact above 0: w * ((1e9 tf) div (1000 tf + 20 m)), and the vector's length."""

    def run(batches):
        for b in batches:
            held, times = b.column(2), b.column(3)
            t, tf, cut = held.flatten().to_numpy(), times.flatten().to_numpy(), held.value_lengths().to_numpy()
            m = np.array([50 + 50 * n * n_docs // max(n_terms, 1) for n in b.column(1).to_pylist()], np.int64)
            impact = weights[t] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, cut)))
            at = np.repeat(np.arange(len(cut)), cut)
            norm = np.sqrt(np.bincount(at, impact.astype(np.float64) ** 2, len(cut)))
            ends = pa.array(np.concatenate([[0], np.cumsum(cut)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (t, impact)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(norm), *lists], ["doc_id", "norm", "terms", "impacts"])

    return counted.filter(F.size("terms") > 0).mapInArrow(run, "doc_id long, norm double, terms array<int>, impacts array<long>").filter("norm > 0")


class Bucket:
    """Vectors of similar length, longest first: rows as they came and lists by term."""

    def __init__(self, ids, norms, held, impacts, cut, size):
        self.ids, self.norms, self.held, self.impacts = ids, norms, held, impacts
        self.begin = np.concatenate([[0], np.cumsum(cut)])
        order = np.argsort(held, kind="stable")
        self.at, self.by_term = np.repeat(np.arange(len(cut), dtype=np.int32), cut)[order], impacts[order]
        self.starts = np.searchsorted(held[order], np.arange(size + 1))

    def reach(self, item: np.ndarray, focus: int, least: int) -> np.ndarray:
        """The rows that may score ``least`` for ``item``, whose terms are heaviest first."""
        sums, squares = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        for t in item[:focus]:
            a, b = self.starts[t], self.starts[t + 1]
            rows, x = self.at[a:b], self.by_term[a:b].astype(np.float64)
            sums[rows] += x
            squares[rows] += x * x
        rest = np.sqrt(max(len(item) - focus, 0) * np.maximum(self.norms * self.norms * (1 + 1e-9) - squares, 0.0))
        return np.flatnonzero((sums + rest) * (1 + 1e-9) >= least)

    def scores(self, item: np.ndarray, rows: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Exact scores of ``rows``; ``mask`` is a scratch array of the vocabulary's size."""
        cut = self.begin[rows + 1] - self.begin[rows]
        ends = np.cumsum(cut)
        flat = np.arange(ends[-1]) + np.repeat(self.begin[rows] - ends + cut, cut)
        mask[item] = 1
        sums = np.add.reduceat(self.impacts[flat] * mask[self.held[flat]], ends - cut)
        mask[item] = 0
        return sums


def _walk(items: list[np.ndarray], least: list[int], size: int, k: int, focus: int, bucket: int):
    """A task's search: vectors sorted by length, longest first, to (item, doc_id, score), at most ``k`` an item."""

    def buckets(batches):
        kept, n = [], 0
        for b in batches:
            kept, n = [*kept, b], n + b.num_rows
            if n >= bucket:
                yield kept
                kept, n = [], 0
        if n:
            yield kept

    def run(batches):
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        bound, mask = list(least), np.zeros(size, np.int64)
        for kept in buckets(batches):
            t = pa.Table.from_batches(kept).combine_chunks()
            ids, norms = t.column(0).fill_null(_NULL).to_numpy(), t.column(1).to_numpy()
            lists = t.column(2).chunk(0)
            box = Bucket(ids, norms, lists.flatten().to_numpy(), t.column(3).chunk(0).flatten().to_numpy(), lists.value_lengths().to_numpy(), size)
            for i, item in enumerate(items):
                if not len(item) or math.sqrt(len(item)) * norms[0] * (1 + 1e-9) < bound[i]:
                    continue
                rows = box.reach(item, focus, bound[i])
                if not len(rows):
                    continue
                score = box.scores(item, rows, mask)
                good = score >= bound[i]
                score, own = np.concatenate([best[i][0], score[good]]), np.concatenate([best[i][1], ids[rows[good]]])
                top = np.lexsort((own, -score))[:k]
                best[i] = (score[top], own[top])
                if len(top) == k:
                    bound[i] = max(bound[i], int(score[top[-1]]))
        for i, (score, own) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i, np.int32)), pa.array(own), pa.array(score)], ["item", "doc_id", "score"])

    return run


def _top(vectors_: DataFrame, items, least, size: int, k: int, focus: int, bucket: int) -> DataFrame:
    """(item, doc_id, score, rank): the ``k`` best of all tasks' finds."""
    found = vectors_.sortWithinPartitions(F.desc("norm")).mapInArrow(_walk(items, least, size, k, focus, bucket), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(docs: DataFrame, rows: list[tuple], k: int, focus: int, bucket: int, tables: SharedTables, id_col: str, text_col: str) -> DataFrame:
    """The results of one block of items, (item_id, text) rows."""
    spark, own = docs.sparkSession, [sorted(set(terms(text))) for _, text in rows]
    vocabulary = {w: i for i, w in enumerate(sorted({w for x in own for w in x}))}
    counted = tables.put(counts(docs, vocabulary, id_col, text_col))
    total = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(max(len(vocabulary), 1), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        df[r["t"]] = r["df"]
    weights = np.array([weight(total["docs"], int(x)) for x in df], np.int64)
    items = [np.array(sorted((vocabulary[w] for w in x), key=lambda t: (-weights[t], t)), np.int32) for x in own]
    made = tables.put(vectors(counted, weights, total["docs"], total["terms"] or 0))
    seeds = made.filter(F.pmod(F.xxhash64("doc_id", "norm"), F.lit(SEED_SHARE)) == 0)
    least = [1] * len(items)
    for r in _top(seeds, items, least, len(df), k, focus, bucket).filter(F.col("rank") == k).collect():
        least[r["item"]] = r["score"]
    names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "item int, item_id long")
    found = _top(made, items, least, len(df), k, focus, bucket).join(F.broadcast(names), "item")
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != _NULL, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, focus: int = FOCUS, bucket: int = BUCKET, block_bytes: int = ITEM_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): every item's ``k`` best documents of a score above 0, equal scores by ascending id.

    Null and empty texts have no terms: such documents are never found, such items find nothing, and neither counts in
    N. A null document id is a document like others, and comes after equal scores. Repeated rows, of documents or items,
    are documents or items of their own. Texts of any length count whole. Empty tables give an empty result. Other
    columns are not read. Ids are integers.
    """
    spark, tables = docs.sparkSession, SharedTables(docs.sparkSession, "lexical")
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // block_bytes))
    out = None
    for b in range(blocks):
        block = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [(r["item_id"], bytes(r["text"] or b"")) for r in block.select("item_id", F.col("text").cast("binary")).orderBy("item_id", "text").collect()]
        if rows:
            before = tables.n
            kept = tables.put(_search(docs, rows, k, focus, bucket, tables, id_col, text_col))
            tables.drop(*range(before + 1, tables.n))
            out = kept if out is None else out.union(kept)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
