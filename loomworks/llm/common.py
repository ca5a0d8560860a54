"""Helpers that the training-text operators share: words, ordered blocks of rows, shared-folder tables."""

from __future__ import annotations

import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_dir

#: What separates words in every contract of this subpackage: ASCII white space.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text in a block that one task holds at once.
BLOCK_BYTES = 64 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions; every block and bucket count is a multiple of it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def blocks_of(docs: DataFrame, text_col: str, per_partition: int) -> int:
    """How many blocks to deal whole texts to: ``per_partition`` a shuffle partition, and more where a block would
    have over ``BLOCK_BYTES`` of text. The bytes are one pass over the text column."""
    least = per_partition * partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return max(least, -(-size // BLOCK_BYTES))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """At most ``rows`` rows in an Arrow batch of this session: whole texts are wide rows, of which the default 10,000
    take tens of MB in the JVM's buffers and again in each Python worker. Smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def without(df: DataFrame, names) -> DataFrame:
    """``df`` without the columns ``names``: an operator's own output replaces input columns of the same name."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def range_block(docs: DataFrame, key: str, blocks: int) -> Column:
    """A column with the number of the block, in ascending order of ``key``, that a row belongs to.

    The bounds are approximate quantiles of ``key`` (one pass over that column, ``blocks`` numbers to the
    driver). A row finds its block by a search in two steps over the bounds, about 2 * sqrt(blocks)
    comparisons. Equal keys share a block; null keys are in block 0. Any monotone bounds give the same
    results downstream, so the approximation only moves work about.
    """
    if blocks < 2:
        return F.lit(0).cast("long")
    probs = [i / blocks for i in range(1, blocks)]
    found = docs.agg(F.percentile_approx(F.col(key).cast("long"), probs, 20 * blocks).alias("q")).first()["q"]
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0).cast("long")
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    firsts = "[" + ",".join(str(g[0]) for g in groups) + "]"
    nested = "[" + ",".join("[" + ",".join(map(str, g)) + "]" for g in groups) + "]"
    x = f"CAST(`{key}` AS BIGINT)"
    coarse = f"size(filter(from_json('{firsts}', 'array<bigint>'), b -> b <= {x}))"
    fine = f"size(filter(element_at(from_json('{nested}', 'array<array<bigint>>'), {coarse}), b -> b <= {x}))"
    return F.expr(f"CAST(CASE WHEN {x} IS NULL OR {x} < {bounds[0]} THEN 0 ELSE ({coarse} - 1) * {step} + {fine} END AS BIGINT)")


class SharedTables:
    """Parquet tables in the shared folder that cut the lineage of iterative jobs; losing an executor loses none.

    Operators drop what they have read. The tables that a result still reads stay until ``drop_all``.
    """

    made: ClassVar[list[SharedTables]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.made.append(self)

    @classmethod
    def drop_all(cls) -> None:
        """Deletes the tables of all operators of this session; results that still read them can't be read again."""
        while cls.made:
            cls.made.pop().drop()

    def put(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and returns the written table."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *numbers: int) -> None:
        """Deletes the tables of those numbers (the n-th ``put``), or all."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for at in [f"{self.root}/{k}" for k in numbers] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)
