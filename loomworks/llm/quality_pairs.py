"""Quality classifier: Bradley-Terry ranking learned from preference pairs, thresholded at a score quantile.

A labelled document of label 1 is preferred to one of label 0. The model is a linear score s(x) = w.x with
P(i preferred to j) = sigmoid(s(x_i) - s(x_j)); w minimises the logistic loss on feature differences of such
pairs, by Newton steps. The threshold is the quantile of the training scores at the share of label 0. Scores
are mapped to 0..1 so that the threshold falls on ``CUT``.

Learning takes a bounded sample: at most ``TRAIN_ROWS`` labelled rows, those of the smallest hash of their id,
and ``PAIRS`` pairs of them. Only their ids are broadcast, so texts are read, not shuffled. Scoring is one pass.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, without

TRAIN_ROWS, PAIRS, CUT = 24_000, 200_000, 0.3
FEATURES = ("words", "word_length", "symbols", "shouting", "capitals", "digits", "punctuation", "high_bytes", "repeated_words", "doubled_words", "repeated_lines", "lines", "bare_words", "longest_run")
_SYMBOLS, _PUNCTUATION = np.frombuffer(b"#*$%&|<>", np.uint8), np.frombuffer(b".,;:!?", np.uint8)


def features(text: bytes | None) -> list[float]:
    """Shape features of a text, in the order of ``FEATURES``; all 0 for null, empty and blank texts."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    doubled = list(map(operator.eq, words, words[1:]))
    run = longest = 0
    if any(doubled):
        for same in doubled:
            run = run + 1 if same else 0
            longest = max(longest, run)
    letters = int(count[65:91].sum() + count[97:123].sum() + count[192:].sum())
    return [
        np.log1p(n) / 10,
        min(letters / n / 10, 3.0),
        min(int(count[_SYMBOLS].sum()) / n, 3.0),
        min(text.count(b"!!") / n, 1.0),
        int(count[65:91].sum()) / max(letters, 1),
        int(count[48:58].sum()) / size,
        min(int(count[_PUNCTUATION].sum()) / n, 3.0),
        int(count[128:].sum()) / size,
        1 - len(set(words)) / n,
        sum(doubled) / n,
        1 - len(set(lines)) / len(lines),
        min(len(lines) / n, 1.0),
        sum(map(bytes.isdigit, words)) / n,
        np.log1p(longest) / 5,
    ]


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


@dataclass
class Model:
    """Standardised linear scores: ``(x - mean) / scale . weights``, threshold ``cut`` and a spread."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, z**2], axis=1) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.clip((self.raw(x) - self.cut) / self.spread, -30, 30) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-at))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 3, ridge: float = 1e-3, steps: int = 25) -> Model:
    """The Bradley-Terry model of ``pairs`` drawn pairs; with one label only, all scores equal the threshold or above."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    mean, scale = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES)), x.std(axis=0) if len(x) else np.ones(len(FEATURES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    model = Model(mean, scale, np.zeros(2 * len(FEATURES)), 0.0, 1.0)
    if not len(good) or not len(bad):
        model.cut = 0.0 if len(good) or not len(bad) else 1.0
        return model
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.concatenate([z, z**2], axis=1)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / pairs + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    s = z @ w
    model.weights = w
    model.cut = float(np.quantile(s, len(bad) / len(label)))
    model.spread = max(float(s.std()), 1e-9) / 2
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, held_out: Column | None = None) -> Model:
    """Learns from at most ``rows`` labelled documents outside ``held_out``; labels of an id that differ or are null are left out.

    Ids that several documents share are left out too, so no more than ``rows`` rows of features reach the driver. Null,
    empty and very long texts teach like any other. Without rows, or with one label, ``fit`` says what is learned.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("__qp_id"), F.col(label_col).cast("int").alias("__qp_label")).filter("__qp_id IS NOT NULL")
    known = known.groupBy("__qp_id").agg(F.min("__qp_label").alias("lo"), F.max("__qp_label").alias("hi")).filter("lo = hi AND lo IN (0, 1)")
    if held_out is not None:
        known = known.filter(~held_out)
    drawn = known.orderBy(F.xxhash64("__qp_id"), "__qp_id").limit(rows).select("__qp_id", F.col("lo").alias("__qp_label"))
    texts = docs.select(F.col(id_col).alias("__qp_key"), F.col(text_col).alias("__qp_text"))
    hit = F.col("__qp_key") == F.col("__qp_id")
    once = texts.select("__qp_key").join(F.broadcast(drawn), hit).groupBy("__qp_id", "__qp_label").agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    found = texts.join(F.broadcast(once), hit).select("__qp_id", "__qp_label", "__qp_text")

    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column(2).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["id", "label", "x"])

    schema = T.StructType([T.StructField("id", drawn.schema["__qp_id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = found.mapInArrow(run, schema).toPandas().sort_values(["id", "label"], kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    if len(x):
        key = np.lexsort(np.column_stack([x, got["label"]]).T[::-1])  # rows of one id come in any order
        x, label = x[key], got["label"].to_numpy()[key]
    else:
        label = np.zeros(0, int)
    return fit(x, label)


def score(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is ``cut`` or more).

    Null, empty and blank texts have the same features and so one score. Equal texts have equal scores; a very
    long one is read whole. An empty table gives an empty result. Columns named so are replaced; others pass through.
    """
    small_batches(docs.sparkSession)
    docs = without(docs, ["score", "predicted"])
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(at).cast(pa.large_binary()).to_pylist()], float).reshape(-1, len(FEATURES))
            s = np.round(model.score(x), 9)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= cut).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
