"""From pattern matches to blocks, groups, suggestions and metrics: one scan of a repository."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import duplicates, metrics, scanners
from .graph import Rounds


def code_blocks(matches: DataFrame, repository: str, lines: DataFrame | None = None) -> DataFrame:
    """Blocks of ``matches`` (ord, file_path, rule_id, matched_text, line_start, line_end), in the columns of ``duplicates``.

    A block's id is the hash of its place, its category its rule's, its tag the name of its function: in its own text,
    else, where ``lines`` (file_path, line_no, line) has the files, the nearest declaration above it. A null text is
    empty, a null last line the first. ``ord`` is the order of the matches and has no ties.
    """
    rows = matches.select("ord", "file_path", "rule_id", F.coalesce("matched_text", F.lit("")).alias("code"), "line_start", F.coalesce("line_end", "line_start").alias("line_end"))
    none = F.lit(None).cast("string")
    named = scanners.block_names(rows, lines) if lines is not None else rows.withColumn("function_name", F.when(F.col("code") != "", text.function_name(F.col("code"))).otherwise(none))
    return named.select(
        F.col("ord").cast("long").alias("ord"),
        text.block_id(F.col("file_path"), F.col("line_start")).alias("block_id"),
        F.col("rule_id").alias("pattern_id"),
        text.category(F.col("rule_id")).alias("category"),
        text.language(F.col("file_path")).alias("language"),
        "file_path",
        F.lit(repository).alias("repository"),
        F.col("line_start").cast("int").alias("line_start"),
        (F.col("line_end") - F.col("line_start") + 1).cast("int").alias("line_count"),
        F.col("code").alias("source_code"),
        F.when(F.col("function_name").isNotNull(), F.array(F.concat(F.lit("function:"), F.col("function_name")))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )


@dataclass
class Scan:
    """Tables of a scan; ``metrics`` is one row."""

    blocks: DataFrame
    groups: DataFrame
    members: DataFrame
    suggestions: DataFrame
    metrics: DataFrame


def scan(matches: DataFrame, repository: str, lines: DataFrame | None = None, total_lines: int | None = None) -> Scan:
    """Blocks, one a function or place; the groups of all layers; a suggestion a group; the metrics over them, whose share
    of duplicated lines is of ``total_lines``, or of the blocks' where that is not known."""
    rounds = Rounds(matches.sparkSession)
    blocks = rounds.put(duplicates.dedup_blocks(code_blocks(matches, repository, lines)))
    groups, members = duplicates.detect(blocks)
    groups = rounds.put(groups)
    told = rounds.put(duplicates.suggestions(groups))
    return Scan(blocks, groups, members, told, metrics.scan_metrics(blocks, groups, told, total_lines))
