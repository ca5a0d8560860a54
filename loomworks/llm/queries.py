"""The registered queries of the training-text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, fingerprints, langid, lexical_search, mixing, quality_pairs, quality_rules, simhash_dedup, substring_dedup, url_filter, variants, wavelet
from .common import documents, shared_dir


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of 20 words over all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substring_dedup.digest(substring_dedup.remove_repeats(docs))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; words are learned from all documents, the verdict from what the quality
    classifier, learned from the labelled documents, says of the pages' texts."""
    docs, pages = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    quality = quality_pairs.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = url_filter.learn(url_filter.evidence(pages, quality), url_filter.unigrams(docs))
    return url_filter.judge(pages.drop("html"), model).select("page_id", "host", "path", "rule", "verdict", "segments", "block_score")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded with the 50k byte-level vocabulary, then decoded."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digest(byte_bpe.decode(ids, ranks))


def op4_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as wavelet matrices, one a shard, and read back; first ids and end ids by access, rank and select."""
    made = wavelet.shards(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    path = f"{shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    wavelet.write(made, path)
    return wavelet.documents_of(wavelet.read(spark, path), end_id=2)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the mix of their sources."""
    mix = mixing.mix(documents(spark, sf_dir), mixing.word_count(F.col("text")))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_quality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a ranking learned from the labels outside fold 0 of 5."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality_pairs.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=quality_pairs.crc_fold("__qp_id", 5) == 0)
    return quality_pairs.score(docs, model).select("doc_id", (quality_pairs.crc_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness; ids divisible by 20 search all rows."""
    return fingerprints.compare_edited(documents(spark, sf_dir), asks=F.col("doc_id") % 20 == 0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and the cascade's verdict of every document."""
    return quality_rules.judge(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = simhash_dedup.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by profiles of the documents outside fold 2 of 4."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = quality_pairs.crc_fold("doc_id", 4) == 2
    models = langid.profiles(docs.filter(~held))
    return langid.predict(docs.select("doc_id", "text"), models).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its near words, form and root."""
    return variants.variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of the benchmark's items, and the items."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return decontaminate.digest(decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


#: DuckDB's SQL of the contracts that it can express and run on whole tables.
SQL = {
    "op11_lexical_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nl FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d),
c AS (SELECT doc_id, n, t, count(*) AS tf FROM tf GROUP BY ALL),
wt AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, total GROUP BY t, nd),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nl)))) AS BIGINT) AS score FROM i JOIN c USING (t) JOIN wt USING (t), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50""",
    "op13_decontamination": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS s, least(len(w), 10) AS n FROM k),
size AS (SELECT DISTINCT n FROM win),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, size WHERE len(w) >= n),
q AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM p),
m AS (SELECT doc_id, i, q.n AS n, item_id FROM q JOIN win ON q.s = win.s AND q.n = win.n),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_substring_dedup, op2_url_filter, op3_byte_bpe, op4_wavelet_ids, op5_mix_sources, op6_quality_pairs, op7_fingerprints, op8_quality_rules, op9_simhash_dedup, op10_language_id, op11_lexical_search, op12_spelling_variants, op13_decontamination)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
