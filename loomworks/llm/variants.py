"""Spelling variant grouping: near words (one letter inserted, deleted or replaced) found by bit-sliced position indexes.

Each word gets the near word that is most frequent by far as its form, and the form's form, to the last, as its root.

Near words of a and a or a + 1 letters agree in their first or in their last floor(a / 2) letters, as one error leaves
one half whole. So words meet in cells of (a, first half) and (a, last half); the pairs of a last-half cell whose first
halves agree too are left to the other cell, so each pair is met once. A cell is indexed by bitsets over its words, one
per (position, letter), and every word of it runs over the index: bitsets hold the words that agree with the letters
read so far without error, and with one error, at the same, the next or the last position; each letter moves all words
of the cell at once by a few operations on bits.

A cell of over ``BLOCK`` words is indexed in blocks and each of its words runs over every block, so no task holds more
than a block, and the blocks of a cell are dealt to many tasks. A block tells a word's number of near words and its most frequent one; no pairs are emitted.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTables, small_batches

SHORTEST, LEAST, TIMES, BLOCK, LARGE, EVERY, HELD = 7, 2, 10, 4096, 1_000_000, 31, 200_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words(docs: DataFrame, shortest: int = SHORTEST, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters of all whole texts, A-Z lowered, of ``shortest`` letters or more, and their number.

    Where ``every`` divides the crc32 h of ``<id>:<run>``, the run loses its letter h % length first. A null id is the
    empty text there; null and empty texts have no runs; repeated rows count each. Tasks add up their words first.
    """
    small_batches(docs.sparkSession)

    def told(by: dict[str, int]):
        return pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array(list(by.values()), pa.int64())], ["word", "n"])

    def run(batches):
        by: dict[str, int] = {}
        crc = zlib.crc32
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
                begun, own = crc(f"{key}:".encode()), {}
                for w in _RUN.findall((text or b"").lower().decode()):  # bytes: only A-Z are lowered
                    if len(w) >= shortest:
                        own[w] = own.get(w, 0) + 1
                for w, n in own.items():
                    h = crc(w.encode(), begun)
                    if h % every == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < shortest:
                            continue
                    by[w] = by.get(w, 0) + n
                if len(by) > HELD:
                    yield told(by)
                    by = {}
        yield told(by)

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col)
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """Bitsets over words, one per (position, letter) and one per length; bit j is word j."""

    def __init__(self, own: list[str]):
        self.own, self.longest = own, max(map(len, own), default=0)
        self.slices: list[dict[str, int]] = [{} for _ in range(self.longest)]
        self.sizes: dict[int, int] = {}
        for j, w in enumerate(own):
            bit = 1 << j
            self.sizes[len(w)] = self.sizes.get(len(w), 0) | bit
            for at, letter in zip(self.slices, w):
                at[letter] = at.get(letter, 0) | bit
        self.after = [0] * (self.longest + 1)  # words with a letter at the position
        for k in range(self.longest - 1, -1, -1):
            self.after[k] = self.after[k + 1] | self.sizes.get(k + 1, 0)

    def near(self, word: str, apart: int = 0) -> int:
        """The words one insertion, deletion or replacement from ``word``, as bits; with ``apart``, those whose first ``apart`` letters differ from its."""
        exact, last, skip = (1 << len(self.own)) - 1, self.longest, 0
        same, longer, shorter = 0, exact & self.after[0], 0
        for i, letter in enumerate(word):
            here = self.slices[i].get(letter, 0) if i < last else 0
            shorter = exact | (shorter & self.slices[i - 1].get(letter, 0) if 0 < i <= last else 0)
            same = (same & here) | (exact & self.after[min(i, last)] & ~here)
            exact &= here
            longer = (longer & self.slices[i + 1].get(letter, 0) if i + 1 < last else 0) | (exact & self.after[min(i + 1, last)])
            if i + 1 == apart:
                skip = exact
        m = len(word)
        return ((same & self.sizes.get(m, 0)) | (longer & self.sizes.get(m + 1, 0)) | (shorter & self.sizes.get(m - 1, 0))) & ~skip


def _cells(counted: DataFrame) -> DataFrame:
    """(a, side, half, word, n): the cells of every word, as one of the shorter (a its length) and of the longer words."""
    length = F.length("word")
    each = [F.struct((length - d).alias("a"), F.lit(side).alias("side"), (F.expr(f"left(word, (length(word) - {d}) div 2)") if side == 0 else F.expr(f"right(word, (length(word) - {d}) div 2)")).alias("half")) for d in (0, 1) for side in (0, 1)]
    return counted.select(F.explode(F.array(*each)).alias("c"), "word", "n").select("c.a", "c.side", "c.half", "word", "n").filter("a > 0")


def near(counted: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n) of the distinct words (word, n) that have near words: how many, and the most frequent
    one, of equal ones the smallest by code points."""
    tables = SharedTables(counted.sparkSession, "variants")
    cells = tables.put(_cells(counted))
    # Large cells are few: each has over ``block`` of the rows.
    large = tables.put(cells.groupBy("a", "side", "half").agg(F.count("*").alias("k")).filter(F.col("k") > block).withColumn("of", F.ceil(F.col("k") / block).cast("int")).drop("k"))
    dealt = cells.join(F.broadcast(large) if large.count() <= LARGE else large, ["a", "side", "half"], "left").withColumn("of", F.coalesce("of", F.lit(1)))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("word"), F.col("of")).cast("int")).repartition("a", "side", "half", "of", "b")
    lists = tables.put(dealt.groupBy("a", "side", "half", "of", "b").agg(F.collect_list("word").alias("own"), F.collect_list("n").alias("ns")).filter((F.size("own") > 1) | (F.col("of") > 1)))
    one = lists.filter("of = 1").select("a", "side", "own", "ns", F.col("own").alias("asked"))
    many = lists.filter("of > 1")
    more = many.select("a", "side", "half", "own", "ns").join(many.select("a", "side", "half", F.col("own").alias("asked")), ["a", "side", "half"]).select("a", "side", "own", "ns", "asked")

    def run(batches):
        for b in batches:
            out = []
            for a, side, own, ns, asked in zip(*(c.to_pylist() for c in b.columns)):
                index = Index(own)
                shorts = index.sizes.get(a, 0)
                for w in asked:
                    bits = index.near(w, a // 2 if side else 0)
                    if len(w) > a:
                        bits &= shorts
                    if bits:
                        n, most, best = bits.bit_count(), -1, ""
                        while bits:
                            j = (bits & -bits).bit_length() - 1
                            bits &= bits - 1
                            if ns[j] > most or (ns[j] == most and own[j] < best):
                                most, best = ns[j], own[j]
                        out.append((w, n, best, most))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "n_near", "form", "form_n"])

    told = one.union(more).mapInArrow(run, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form"))).alias("best")
    out = tables.put(told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.form", (-F.col("best.m")).alias("form_n")))
    tables.drop(*range(1, tables.n))
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the forms that follow each other from each word.

    Each step's word is ``times`` as frequent as the one before, so the steps are few; they go on until none is left.
    """
    tables = SharedTables(forms.sparkSession, "roots")
    forms = tables.put(forms.select("word", "form"))
    now, step = forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), forms.select(F.col("word").alias("root"), F.col("form").alias("up"))
    while not now.filter("open").isEmpty():
        now = tables.put(now.join(step, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("open")))
        if tables.n > 2:
            tables.drop(tables.n - 1)
    return now.select("word", "root")


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES, every: int = EVERY, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root): a row a distinct word of ``shortest`` letters or more that occurs ``least`` times.

    ``form`` is the most frequent near word, of equal ones the smallest by code points, if it is ``times`` as frequent
    at least; else it and ``form_n`` are null. ``root`` follows the forms to the last. For nulls, empty and long texts
    and repeated rows see ``words``; an empty table gives an empty result. Other columns are not read.
    """
    if least < 1 or times <= 1 or shortest < 2:
        raise ValueError("shortest must be 2, least 1 and times over 1 at least")
    tables = SharedTables(docs.sparkSession, "words")
    counted = tables.put(words(docs, shortest, every, id_col, text_col).filter(F.col("n") >= least))
    found = counted.join(near(counted, block), "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    usual = F.col("form_n") >= times * F.col("n")
    told = tables.put(found.select("word", "n", "n_near", F.when(usual, F.col("form")).alias("form"), F.when(usual, F.col("form_n")).alias("form_n")))
    last = roots(told.filter(F.col("form").isNotNull()))
    return told.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
