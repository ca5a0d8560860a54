"""Iterations over links: tables of rounds in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the session's checkpoint folder. Where neither is set, a local session makes one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomworks-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Rounds:
    """Tables of an iteration, in the shared folder; losing an executor loses none.

    An operator deletes what its result does not read. What it reads stays until ``drop_all``.
    """

    made: ClassVar[list[Rounds]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", 0
        self.made.append(self)

    @classmethod
    def drop_all(cls) -> None:
        """Deletes the tables of all operators of this session; results that still read them can't be read again."""
        while cls.made:
            cls.made.pop()._delete("")

    def done(self, df: DataFrame) -> DataFrame:
        """Writes the result ``df`` and deletes all tables before it."""
        out = self.put(df)
        self.drop(*range(1, self.n))
        return out

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def drop(self, *numbers: int) -> None:
        """Deletes the tables of those numbers (the n-th ``put``)."""
        for k in numbers:
            self._delete(f"/{k}")

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, cluster): the smallest id reachable over ``pairs`` (i, j), for every row of ``nodes`` (id).

    Each round every root goes under its smallest neighbour if that is smaller, pointers jump until all show roots, and
    the links are kept between roots only. The larger end of every link goes under another root, so there are fewer
    roots each round; it ends when no link is left.
    """
    rounds = Rounds(nodes.sparkSession)
    left = rounds.put(pairs.select("i", "j").filter("i <> j").distinct())
    labels = rounds.put(nodes.select("id", F.col("id").alias("cluster")).distinct())
    while not left.isEmpty():
        both = left.union(left.select("j", "i"))
        hooks = rounds.put(both.groupBy("i").agg(F.least(F.min("j"), F.col("i")).alias("to")))
        moved = True
        while moved:
            up = hooks.select(F.col("i").alias("at"), F.col("to").alias("up"))
            step = rounds.put(hooks.join(up, F.col("to") == F.col("at")).select("i", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved")))
            rounds.drop(rounds.n - 1)
            hooks, moved = step.select("i", "to"), not step.filter("moved").isEmpty()
        root = hooks.select(F.col("i").alias("at"), F.col("to").alias("root"))
        labels = rounds.put(labels.join(root, F.col("cluster") == F.col("at"), "left").select("id", F.coalesce("root", "cluster").alias("cluster")))
        ends = left.join(root, F.col("i") == F.col("at")).select(F.col("root").alias("i"), "j").join(root, F.col("j") == F.col("at")).select("i", F.col("root").alias("j"))
        left = rounds.put(ends.filter("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct())
    return rounds.done(labels)
