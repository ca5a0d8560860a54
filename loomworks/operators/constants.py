"""Clusters of literals: token sets, named constants that fit, and peers of similar context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def top_tokens(occurrences: DataFrame, n: int = 30) -> DataFrame:
    """(literal, token, freq, rank): the ``n`` most frequent tokens of each literal's occurrences."""
    freq = occurrences.select("literal", F.explode("tokens").alias("token")).groupBy("literal", "token").agg(F.count("*").alias("freq"))
    w = Window.partitionBy("literal").orderBy(F.desc("freq"), "token")
    return freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def match_constants(literals: DataFrame, constants: DataFrame, most: int = 5, least: float = 0.2) -> DataFrame:
    """(literal, name, value_match, score): constants of equal value or similar tokens, best ``most`` of each literal.

    ``literals``: literal, value, tokens; ``constants``: name, value, tokens. Only pairs that share a value or a
    token are made (an equi join of values, and one of tokens that counts what is shared); the score of any other
    pair is 0 and below ``least``.
    """
    size = F.size("tokens")
    a = literals.select("literal", F.col("value").alias("v"), size.alias("n"), "tokens")
    b = constants.select("name", F.col("value").alias("w"), size.alias("m"), "tokens")
    shared = a.select("literal", F.explode("tokens").alias("t")).join(b.select("name", F.explode("tokens").alias("t")), "t").groupBy("literal", "name").agg(F.count("*").alias("both"))
    equal = a.join(b, F.col("v") == F.col("w")).select("literal", "name", F.lit(0).cast("long").alias("both"))
    pairs = shared.union(equal).groupBy("literal", "name").agg(F.max("both").alias("both"))
    told = pairs.join(a.drop("tokens"), "literal").join(b.drop("tokens"), "name")
    score = F.when((F.col("n") == 0) | (F.col("m") == 0), 0.0).otherwise(F.col("both") / (F.col("n") + F.col("m") - F.col("both")))
    told = told.select("literal", "name", (F.abs(F.col("v") - F.col("w")) < 1e-9).alias("value_match"), score.alias("score"))
    told = told.filter(F.col("value_match") | (F.col("score") >= least))
    w = Window.partitionBy("literal").orderBy(F.desc("value_match"), F.desc("score"), "name")
    return told.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def peer_pairs(occurrences: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(i, j) of occurrences (id, literal, tokens) of one literal whose token sets are similar.

    Occurrences of equal token sets act as one, so copies make no pairs. Distinct sets meet on their rarest tokens
    only: a pair of Jaccard similarity t or more shares one of the first n - ceil(t * n) + 1 tokens of each side in
    order of frequency.
    """
    sets = occurrences.select("id", "literal", F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    classes = sets.filter(F.size("tokens") > 0).groupBy("literal", "tokens").agg(F.min("id").alias("id"))
    freq = classes.select("literal", F.explode("tokens").alias("t")).groupBy("literal", "t").agg(F.count("*").alias("f"))
    ranked = classes.select("id", "literal", "tokens", F.explode("tokens").alias("t")).join(freq, ["literal", "t"])
    order = F.row_number().over(Window.partitionBy("id").orderBy("f", "t"))
    n = F.size("tokens")
    keys = ranked.withColumn("k", order).filter(F.col("k") <= n - F.ceil(n * F.lit(threshold) - 1e-9) + 1)
    a, b = keys.select("literal", "t", F.col("id").alias("i"), F.col("tokens").alias("x")), keys.select("literal", "t", F.col("id").alias("j"), F.col("tokens").alias("y"))
    pairs = a.join(b, ["literal", "t"]).filter(F.col("i") < F.col("j"))
    both = F.size(F.array_intersect("x", "y"))
    near = pairs.filter(both / (F.size("x") + F.size("y") - both) >= threshold).select("i", "j").distinct()
    same = sets.filter(F.size("tokens") > 0).join(classes.withColumnRenamed("id", "first"), ["literal", "tokens"]).filter("id <> first").select(F.col("first").alias("i"), F.col("id").alias("j"))
    return near.union(same)


def shared_tokens(members: DataFrame, share: float = 0.6, most: int = 10) -> DataFrame:
    """(cluster, token, freq, rank): tokens of at least ``share`` of a cluster's members (cluster, tokens)."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    freq = members.select("cluster", F.explode("tokens").alias("token")).groupBy("cluster", "token").agg(F.count("*").alias("freq"))
    kept = freq.join(sizes, "cluster").filter(F.col("freq") >= F.greatest(F.lit(1), F.ceil(F.col("n") * share)))
    w = Window.partitionBy("cluster").orderBy(F.desc("freq"), "token")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).drop("n")


#: Right sides that are a number, a name, or two of these with an operator between.
_KEPT = r"^(?:-?[0-9][0-9_]*(?:\.[0-9]+)?|[A-Z0-9_]+|[A-Z0-9_]+\s*[*/+\-]\s*[A-Z0-9_]+)$"


def repeated_values(lines: DataFrame, line: str = "line", most: int = 20) -> DataFrame:
    """(value, n, names): the right sides that two or more exported constants have, most first, the greater value first
    among equals; the names in order. Blanks and semicolons at a value's end are no part of it."""
    pattern = r"^export const ([A-Z0-9_]+)\s*=\s*(.*)$"
    value = F.regexp_replace(F.regexp_extract(line, pattern, 2), r"[\s;]+$", "")
    found = lines.filter(F.col(line).rlike(pattern)).select(F.regexp_extract(line, pattern, 1).alias("name"), value.alias("value")).filter(F.col("value").rlike(_KEPT))
    top = found.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), F.desc("value")).limit(most)
    return found.join(F.broadcast(top), "value").groupBy("value", "n").agg(F.array_sort(F.collect_list("name")).alias("names")).orderBy(F.desc("n"), F.desc("value"))


def distinct_constants(found: DataFrame, order: str = "ord") -> DataFrame:
    """Constants (path, line, name, value ...), the first in ``order`` of each place, name and value."""
    row = F.min_by(F.struct(*found.columns), order).alias("row")
    return found.groupBy("path", "line", "name", "value").agg(row).select("row.*")
