"""Report figures over blocks, groups, suggestions and configurations: one aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded


def scan_metrics(blocks: DataFrame, groups: DataFrame, suggestions: DataFrame, total_lines: int | None = None) -> DataFrame:
    """One row: counts by method, duplicated and removable lines, shares, quick wins, tags. Zeros for empty inputs.

    The share of duplicated lines is of ``total_lines``, or of all block lines where that is not given.
    """
    c = F.col

    def zero(x):
        return F.coalesce(x, F.lit(0)).cast("long")

    b = blocks.agg(F.count("*").alias("total_code_blocks"), zero(F.sum("line_count")).alias("block_lines"), F.count_if(F.size("tags") > 0).alias("blocks_with_tags"), zero(F.sum(F.greatest(F.size("tags"), F.lit(0)))).alias("tags"))
    g = groups.agg(
        F.count("*").alias("total_duplicate_groups"),
        *[F.count_if(c("method") == m).alias(n) for m, n in (("exact_match", "exact_duplicates"), ("structural", "structural_duplicates"), ("semantic", "semantic_duplicates"))],
        zero(F.sum("total_lines")).alias("total_duplicated_lines"),
        zero(F.sum(c("total_lines") - F.floor(c("total_lines") / c("occurrences")))).alias("potential_loc_reduction"),
        F.count_if((c("occurrences") <= 3) & (c("files") == 1)).alias("quick_wins"),
        F.count_if((c("total_lines") >= 20) | (c("occurrences") >= 5)).alias("high_impact"),
    )
    levels = [F.count_if(c("complexity") == x).alias(f"{x}_suggestions") for x in ("trivial", "simple", "moderate", "complex")]
    s = suggestions.agg(F.count("*").alias("total_suggestions"), *levels, F.count_if(c("impact") >= 75).alias("high_priority"))
    out = b.join(g.withColumn("one", F.lit(1)), F.lit(1) == c("one")).drop("one").join(s.withColumn("one", F.lit(1)), F.lit(1) == c("one")).drop("one")
    lines = F.lit(total_lines) if total_lines else c("block_lines")
    share = F.when(lines > 0, rounded(c("total_duplicated_lines") / lines * 100)).otherwise(0.0)
    n = c("total_code_blocks")
    tagged = F.when(n > 0, rounded(c("blocks_with_tags") / n * 100)).otherwise(0.0)
    mean = F.when(n > 0, rounded(c("tags") / n)).otherwise(0.0)
    return out.withColumn("duplication_percentage", share).withColumn("blocks_with_tags_percentage", tagged).withColumn("avg_tags_per_block", mean).drop("block_lines", "tags")


def distribution(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row with the count of each of ``values``; others are left out."""
    return rows.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each value."""
    by = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return by.join(total.withColumn("one", F.lit(1)), F.lit(1) == F.col("one")).select(column, "n", rounded(F.col("n") / F.col("total") * 100, 1).alias("percent"))


def roi_summary(suggestions: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: mean, least and greatest return of the suggestions, null without any, and the groups' top impact or 0."""
    top_ = groups.agg(F.coalesce(F.max("impact"), F.lit(0.0)).alias("top_impact"))
    return suggestions.agg(F.avg("roi").alias("avg_roi"), F.min("roi").alias("min_roi"), F.max("roi").alias("max_roi")).join(F.broadcast(top_))


def cross_metrics(cross: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row over cross-repository groups, with the mean of repositories as text of one decimal (0 without groups)."""
    b = blocks.agg(F.countDistinct("repository").alias("repositories_scanned"), F.count("*").alias("total_blocks"))
    g = cross.agg(
        F.count("*").alias("cross_groups"),
        F.coalesce(F.sum("occurrences"), F.lit(0)).cast("long").alias("occurrences"),
        F.coalesce(F.sum("total_lines"), F.lit(0)).cast("long").alias("lines"),
        F.count_if(F.col("strategy") == "shared_package").alias("shared_package"),
        F.count_if(F.col("strategy") == "mcp_server").alias("mcp_server"),
        F.coalesce(F.format_string("%.1f", F.avg("repositories")), F.lit("0")).alias("avg_repositories"),
    )
    return b.withColumn("one", F.lit(1)).join(g.withColumn("one", F.lit(1)), "one").drop("one")


def top(rows: DataFrame, score: str, n: int, tie: str) -> DataFrame:
    """The ``n`` rows of the highest score."""
    return rows.orderBy(F.col(score).desc(), tie).limit(n)


def config_stats(repositories: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts of repositories and groups, and of the enabled ones by priority and frequency."""
    on = F.col("enabled")
    r = repositories.agg(
        F.count("*").alias("repositories"),
        F.count_if(on).alias("enabled_repositories"),
        *[F.count_if(on & (F.col("priority") == p)).alias(p) for p in ("critical", "high", "medium", "low")],
        *[F.count_if(on & (F.col("scanFrequency") == f)).alias(f.replace("-", "_")) for f in ("daily", "weekly", "monthly", "on-demand")],
    )
    g = groups.agg(F.count("*").alias("groups"), F.count_if("enabled").alias("enabled_groups"))
    return r.withColumn("one", F.lit(1)).join(g.withColumn("one", F.lit(1)), "one").drop("one")


def success_rate(done: DataFrame, status: str = "status") -> DataFrame:
    """One row: enhanced, skipped and failed rows, their sum, and the share of enhanced ones among those tried, as text
    of two decimals; ``0`` without any enhanced."""
    n = {s: F.count_if(F.col(status) == s) for s in ("enhanced", "skipped", "failed")}
    share = F.when(n["enhanced"] > 0, F.format_string("%.2f", F.try_divide(100.0 * n["enhanced"], n["enhanced"] + n["failed"]))).otherwise("0")
    return done.agg(*[x.alias(s) for s, x in n.items()], (n["enhanced"] + n["skipped"] + n["failed"]).alias("total"), share.alias("success_rate"))
