"""A scan of one JSON document of pattern matches: ``python -m loomworks.scan IN OUT [--lines FOLDER]``.

IN has ``repository_info`` (path), ``total_repo_lines`` and ``pattern_matches``; ``-`` reads it from standard input,
for documents of one machine's size. OUT becomes a folder of JSON lines, one file set for each of code_blocks,
duplicate_groups, members, suggestions and metrics, a report.md and a report.html. An input with a bad match gives an error and no
output, as does one of more matches than the boundary allows.
"""

from __future__ import annotations

import argparse
import sys
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import scoring
from .operators import extraction, metrics, scanners
from .operators.graph import Rounds
from .sources import files

MATCH = T.StructType([T.StructField(n, t) for n, t in (("file_path", T.StringType()), ("rule_id", T.StringType()), ("matched_text", T.StringType()), ("line_start", T.IntegerType()), ("line_end", T.IntegerType()), ("severity", T.StringType()), ("confidence", T.DoubleType()))])
INPUT = T.StructType([T.StructField("repository_info", T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType())])), T.StructField("total_repo_lines", T.LongType()), T.StructField("pattern_matches", T.ArrayType(MATCH))])
#: How many lines a report's lists have.
LISTED = 10


def read_input(spark: SparkSession, path: str) -> tuple[DataFrame, str, int]:
    """The matches with their order, the repository and its lines, of the one JSON document at ``path`` (``-``: standard input)."""
    if path == "-":
        one = spark.createDataFrame([(sys.stdin.read(),)], "value string").select(F.from_json("value", INPUT).alias("d")).select("d.*")
    else:
        one = spark.read.schema(INPUT).json(path, multiLine=True)
    head = one.select("repository_info.path", "total_repo_lines").first()
    if head is None or not head["path"]:
        raise ValueError("the input has no repository_info.path")
    matches = one.select(F.posexplode("pattern_matches").alias("ord", "m")).select("ord", "m.*")
    matches = Rounds(spark).put(matches.withColumn("line_end", F.coalesce("line_end", "line_start")))
    bad = files.validate_matches(matches)[1].select("ord", "problem").orderBy("ord").limit(1).collect()
    if bad:
        raise ValueError(f"match {bad[0]['ord']}: {bad[0]['problem']}")
    return matches, head["path"], head["total_repo_lines"] or 0


def report(found: extraction.Scan, most: int = LISTED) -> str:
    """The scan as Markdown: metrics, strategies, the groups of most impact and the suggestions of most return."""
    parts = ["# Duplicate report", "", "## Metrics", ""]
    parts += [f"* {k}: {v}" for k, v in found.metrics.first().asDict().items()]
    shares = {r["strategy"]: r["n"] for r in found.suggestions.groupBy("strategy").agg(F.count("*").alias("n")).orderBy("strategy").collect()}
    parts += ["", "## Strategies", "", *[f"* {k}: {n}" for k, n in shares.items()]]
    groups = metrics.top(found.groups, "impact", most, "group_id")
    parts += ["", "## Groups by impact", "", files.markdown_table(groups, ["group_id", "method", "category", "occurrences", "total_lines", "files", "impact"], most)]
    told = metrics.top(found.suggestions, "roi", most, "suggestion_id")
    parts += ["", "## Suggestions by return", "", files.markdown_table(told, ["suggestion_id", "strategy", "target", "complexity", "effort_hours", "roi"], most), ""]
    for s in told.select("suggestion_id", "rationale", "steps").collect():
        parts += [f"### {s['suggestion_id']}", "", s["rationale"] or "", "", *[f"{x['step']}. {x['what']}" + (" (automated)" if x["automated"] else "") for x in s["steps"] or ()], ""]
    return "\n".join(parts)


def page(found: extraction.Scan, most: int = LISTED) -> str:
    """The scan as an HTML page: metrics, the groups of most impact, each with its severity, and the suggestions of most return."""
    told = found.metrics.first().asDict()
    groups = metrics.top(found.groups, "impact", most, "group_id").withColumn("priority", scoring.priority(F.col("impact")))
    best = metrics.top(found.suggestions, "roi", most, "suggestion_id")
    parts = ["<!DOCTYPE html><html><head><meta charset='utf-8'><title>Duplicate report</title></head><body><h1>Duplicate report</h1>", "<h2>Metrics</h2><dl>"]
    parts += [f"<dt>{escape(str(k))}</dt><dd>{escape(str(v))}</dd>" for k, v in told.items()]
    parts += ["</dl><h2>Groups by impact</h2>", files.html_table(groups, ["group_id", "method", "category", "occurrences", "total_lines", "files", "impact", "priority"], most)]
    parts += ["<h2>Suggestions by return</h2>", files.html_table(best, ["suggestion_id", "strategy", "rationale", "target", "complexity", "risk", "effort_hours", "roi"], most), "</body></html>"]
    return "\n".join(parts)


def run(spark: SparkSession, source: str, out: str, lines: str | None = None) -> extraction.Scan:
    """Reads, scans and writes; ``lines`` names the folder of the repository's files for the search of function names."""
    matches, repository, total = read_input(spark, source)
    text = None
    if lines:
        whole = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(lines).select(F.col("_metadata.file_path").alias("at"), "value")
        root = F.concat(F.lit(lines.rstrip("/")), F.lit("/"))
        relative = F.expr("substring(at, locate(root, at) + length(root))")
        text = scanners.lines(whole.withColumn("root", root).select(relative.alias("file_path"), "value"), "file_path", "value")
    found = extraction.scan(matches, repository, text, total)
    for name, rows in (("code_blocks", found.blocks), ("duplicate_groups", found.groups), ("members", found.members), ("suggestions", found.suggestions), ("metrics", found.metrics)):
        rows.write.mode("overwrite").json(f"{out}/{name}")
    for name, made in (("report.md", report(found)), ("report.html", page(found))):
        spark.createDataFrame([(made,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/{name}")
    return found


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source")
    parser.add_argument("out")
    parser.add_argument("--lines")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("scan").getOrCreate()
    try:
        run(spark, given.source, given.out, given.lines)
    except ValueError as e:
        print(f"scan: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
