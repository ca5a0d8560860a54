"""Accuracy of detected groups against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring


def overlaps(expected: DataFrame, detected: DataFrame, least: float = 0.5) -> DataFrame:
    """(expected, detected, overlap, ratio): groups that share ``least`` of the larger one's members.

    Both tables have ``group_id`` and ``member``; they meet on members, so groups that share none make no pair.
    """
    e, d = expected.distinct(), detected.distinct()
    n = e.groupBy("group_id").agg(F.count("*").alias("n"))
    m = d.groupBy("group_id").agg(F.count("*").alias("m"))
    both = e.withColumnRenamed("group_id", "expected").join(d.withColumnRenamed("group_id", "detected"), "member").groupBy("expected", "detected").agg(F.count("*").alias("overlap"))
    told = both.join(n.withColumnRenamed("group_id", "expected"), "expected").join(m.withColumnRenamed("group_id", "detected"), "detected")
    return told.withColumn("ratio", F.col("overlap") / F.greatest("n", "m")).filter(F.col("ratio") >= least).select("expected", "detected", "overlap", "ratio")


def compare(expected: DataFrame, detected: DataFrame, negatives: DataFrame, least: float = 0.5) -> DataFrame:
    """One row tp, fp, fn, tn: matching pairs, unmatched groups and detected negatives, missed groups, other negatives."""
    found = overlaps(expected, detected, least)
    seen = detected.select("member").distinct()
    counts = [
        found.agg(F.count("*").alias("tp")),
        expected.select(F.col("group_id").alias("expected")).distinct().join(found, "expected", "left_anti").agg(F.count("*").alias("fn")),
        detected.select(F.col("group_id").alias("detected")).distinct().join(found, "detected", "left_anti").agg(F.count("*").alias("fp_groups")),
        negatives.join(seen, "member", "left_semi").agg(F.count("*").alias("fp_members")),
        negatives.join(seen, "member", "left_anti").agg(F.count("*").alias("tn")),
    ]
    out = counts[0].withColumn("one", F.lit(1))
    for c in counts[1:]:
        out = out.join(c.withColumn("one", F.lit(1)), "one")
    return out.select("tp", (F.col("fp_groups") + F.col("fp_members")).alias("fp"), "fn", "tn")


def metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, false-positive rate and grade of a row of counts; 0 where a sum is 0."""
    c = F.col
    out = counts.withColumn("precision", scoring.ratio(c("tp"), c("fp"))).withColumn("recall", scoring.ratio(c("tp"), c("fn")))
    total = c("precision") + c("recall")
    out = out.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * (c("precision") * c("recall")) / total))
    out = out.withColumn("fpr", scoring.ratio(c("fp"), c("tn")))
    return out.withColumn("grade", scoring.grade(c("precision"), c("recall"), c("f1"), c("fpr")))
