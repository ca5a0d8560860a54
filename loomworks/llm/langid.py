"""Language identification by rank-order profiles (Cavnar and Trenkle).

A profile is a language's most frequent letter n-grams, n = 1 to 3, in order. They are counted over all
documents that may be learned from: tasks add up each batch, Spark adds up the sums. A document's own most
frequent n-grams are compared to each profile: an n-gram is out of place by the difference of its ranks, or by
the profile's length if the profile lacks it. The language of the least sum is predicted.

Texts are lower-cased; runs of anything but letters become one blank, and n-grams keep the blank as a mark of
where words begin and end. Three code points fit in 63 bits, so n-grams are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, without

PROFILE, ORDERS, UNKNOWN = 300, 3, "und"
_CHUNK = 2_000_000
_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])


def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(text: str | None, letters: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of a text with at least one letter each; codes of longer n-grams are larger."""
    if not text:
        return np.zeros(0, np.int64)
    cps = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = letters[cps]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one blank after each word
    keep[0] = True
    c = np.where(is_letter, cps, 1)[keep]
    out = [c[c > 1]]
    two = (c[:-1] << 21) | c[1:]
    out.append(two)
    if len(c) > 2:
        inner = c[1:-1] > 1  # no blank in the middle
        out.append(((two[:-1] << 21) | c[2:])[inner])
    return np.concatenate(out)


def _chunks(text: str | None):
    """Parts of about ``_CHUNK`` characters that begin at no letter, so all n-grams of the parts are those of the text."""
    begin, n = 0, len(text or "")
    while begin < n:
        end = min(begin + _CHUNK, n)
        while end < n and text[end].isalpha():
            end += 1
        yield text[begin:end]
        begin = end


def _ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    grams, counts = np.unique(codes, return_counts=True)
    if len(grams) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        near = counts >= least
        grams, counts = grams[near], counts[near]
    return grams[np.lexsort((grams, -counts))][:most]


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, np.ndarray]:
    """The ranked n-grams of each language of ``docs``; rows with a null language or no letter teach nothing.

    Repeated rows count each; ties go to the smaller n-gram. Very long texts are counted in parts, whole. Other columns
    are not read. No rows give no profile.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        letters = _letters()
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for part in _chunks(text):
                    by.setdefault(lang, []).append(_grams(part, letters))
            for lang, parts in by.items():
                grams, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    counted = docs.filter(F.col(lang_col).isNotNull()).select(lang_col, text_col).mapInArrow(run, _COUNTS)
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = total.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size).collect()
    out: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: np.array([g for _, g in sorted(out[lang])], np.int64) for lang in sorted(out)}


class _Judge:
    """Out-of-place distances of ranked n-grams to every profile."""

    def __init__(self, models: dict[str, np.ndarray], size: int):
        self.langs, self.size = list(models), size
        self.known = np.unique(np.concatenate([np.zeros(0, np.int64), *models.values()]))
        self.rank = np.full((len(self.langs), len(self.known) + 1), -1, np.int64)
        for k, grams in enumerate(models.values()):
            self.rank[k, np.searchsorted(self.known, grams)] = np.arange(len(grams))

    def __call__(self, codes: np.ndarray) -> tuple[str, float]:
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = _ranked(codes, self.size)
        at = np.searchsorted(self.known, own)
        at = np.where((at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == own), at, len(self.known))
        ranks = self.rank[:, at]
        off = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(own))), self.size)).sum(axis=1)
        best = int(np.argmin(off))
        others = np.delete(off, best)
        worst = len(own) * self.size
        margin = 1.0 if not len(others) else (others.min() - off[best]) / max(others.min(), 1)
        return self.langs[best], float(np.clip(0.5 * margin + 0.5 * (1 - off[best] / worst), 0, 1))


def predict(docs: DataFrame, models: dict[str, np.ndarray], text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1: the mean of the margin over the next language and of the fit).

    Very long texts are ranked whole. ``und`` and 0 for null texts, texts without a letter and if no language was learned; equal distances go to the
    first language by name. An empty table gives an empty result. Columns named so are replaced; others pass through.
    """
    small_batches(docs.sparkSession)
    docs = without(docs, ["lang_pred", "score"])
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        letters, judge = _letters(), _Judge(models, size)
        for b in batches:
            told = [judge(_grams(t, letters)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t[0] for t in told], pa.string()), pa.array([round(t[1], 9) for t in told], pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
