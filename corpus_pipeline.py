"""The corpus pipeline: quality, near-dedup, substring dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of ``documents``. Between stages, documents are a table in the shared folder.

Rows are never told apart by their place, so a stage gives the same rows however its input is dealt. Null ids, null and
empty texts, very long texts, repeated rows, empty tables and further columns have the results that each stage states.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomworks.llm import byte_bpe, jaccard_dedup, mixing, quality_pairs, substring_dedup
from loomworks.llm.common import SharedTables, documents


def _aside(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs``, with the columns of ``docs``: those that the operator would replace, ``names``, are set aside meanwhile."""
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in names}
    held = docs.withColumnsRenamed(own)
    return work(held).select(*[f"`{c}`" for c in held.columns]).withColumnsRenamed({v: k for k, v in own.items()})


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Rows are judged each alone, whatever their id, so repeated rows stay or go together; null, empty and blank texts
    have one score. Without usable labels all documents stay. Further columns pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_pairs.train(docs, labels, held_out=quality_pairs.crc_fold("__qp_id", 5) == 0)
    return _aside(docs, ("score", "predicted"), lambda rows: quality_pairs.score(rows, model).filter("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each near-duplicate group: five-word shingles, similarity 0.8 or more.

    Candidates come from SimHash fingerprints first, and from min-hashes where documents are still apart, as 64 bits can't
    bring all pairs of that similarity together (README); all are compared whole.
    Rows of equal id and text are one document; rows of a null id all stay; texts without words are one group.
    """
    return jaccard_dedup.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that start earlier in the corpus.

    Kept words are joined by one blank; a document of which nothing is left stays, with an empty text. ``n_chars`` is
    that of the text that is left. Null ids come first, and rows of one id are in order of their texts.
    """
    return _aside(docs, ("n_words", "n_removed", "spans"), lambda rows: substring_dedup.remove_repeats(rows).withColumn("n_chars", F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them; one taken twice is two rows.

    A null source is a source. Documents without words have no share in a target; further columns pass through.
    """
    return mixing.mixed(docs, mixing.word_count(F.col("text")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and the hash of the bytes they decode to; a null text has none."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    told = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("near-dedup by min-hash and jaccard", near_dedup),
    ("substring dedup", repeats),
    ("mix sources", mix),
    ("byte-level bpe", encode),
]

#: Learned scores, XXH64 and BPE have no DuckDB SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, tables = documents(spark, sf_dir), SharedTables(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tables.put(docs)
            if k > 0:
                tables.drop(tables.n - 1)
    return docs
