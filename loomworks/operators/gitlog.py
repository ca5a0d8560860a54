"""Log listings of repositories: headers carried down to the lines of their section, and the totals of a repository.

A listing is a table of lines (repo, line_no, line), as ``git log --numstat`` or ``--name-only`` prints them below
headers ``commit <hash> <yyyy-mm-dd>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Rounds

HEADER = r"^commit (\S+) ([0-9]{4}-[0-9]{2})(?:-[0-9]{2})?$"


def carry_forward(rows: DataFrame, value: Column, *order: str, name: str = "carried") -> DataFrame:
    """``rows`` with the last ``value`` that is not null at or before each row, in ``order``, which has no ties.

    Rows are dealt by ranges and sorted there; a range begins with the last value of the ranges before it, a sum over
    one row a range. So no key need bring its rows together, and a section may run over any number of ranges.
    """
    rounds = Rounds(rows.sparkSession)
    dealt = rounds.put(rows.withColumn("__v", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    each = dealt.groupBy(part.alias("__part")).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__at"))).alias("__end"))
    before = F.last("__end", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    begins = each.select("__part", before.alias("__begin"))
    own = F.last("__v", ignorenulls=True).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = dealt.withColumn("__part", part).join(F.broadcast(begins), "__part")  # one row a range
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(own, F.col("__begin")).alias(name))


def sections(log: DataFrame, repo: str = "repo") -> DataFrame:
    """The lines below headers: (repo, line_no, commit, month, additions, deletions, file).

    Numbers are null for a binary file (``-``) and for a line that is a name only. Blank lines, and lines above a
    repository's first header, are in no section.
    """
    is_header = F.col("line").rlike(HEADER)
    head = F.when(is_header, F.struct(F.col(repo).alias("repo"), F.regexp_extract("line", HEADER, 1).alias("commit"), F.regexp_extract("line", HEADER, 2).alias("month")))
    told = carry_forward(log.select(repo, "line_no", "line"), head, repo, "line_no", name="head")
    below = told.filter(~F.col("line").rlike(HEADER) & (F.trim("line") != "") & (F.col("head.repo") == F.col(repo)))
    p, numbers = F.split("line", "\t"), F.size(F.split("line", "\t")) >= 3
    number = lambda k: F.when(numbers & F.get(p, F.lit(k)).rlike("^[0-9]+$"), F.get(p, F.lit(k))).cast("long")
    return below.select(repo, "line_no", "head.commit", "head.month", number(0).alias("additions"), number(1).alias("deletions"), F.when(numbers, F.array_join(F.slice(p, F.lit(3), F.size(p)), "\t")).otherwise(F.col("line")).alias("file"))


def repository_stats(log: DataFrame, repo: str = "repo") -> DataFrame:
    """(repo, commits, monthly, additions, deletions, files): headers, headers by month, sums and lines of sections."""
    heads = log.filter(F.col("line").rlike(HEADER)).groupBy(repo, F.regexp_extract("line", HEADER, 2).alias("month")).agg(F.count("*").alias("n"))
    heads = heads.groupBy(repo).agg(F.sum("n").alias("commits"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("month", "n")))).alias("monthly"))
    sums = sections(log, repo).groupBy(repo).agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count("*").alias("files"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return heads.join(sums, repo, "left").select(repo, "commits", "monthly", zero("additions"), zero("deletions"), zero("files"))
