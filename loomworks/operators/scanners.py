"""Line and text scanners: look-ahead detectors, test patterns, prefixes, logs, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text


def lines(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, line_no, line) of every line of every file, numbered from 1, with the other columns but the content."""
    others = [c for c in files.columns if c not in (key, content)]
    return files.select(key, *others, F.posexplode(F.split(F.col(content), "\n")).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line", *others)


def ahead(key: str, order: str, hit: Column, n: int) -> Column:
    """Whether ``hit`` holds on this or one of the next ``n`` rows of the key."""
    return F.max(hit).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.currentRow, n))


def timeout_findings(files: DataFrame, key: str = "file_path", content: str = "content") -> DataFrame:
    """Findings (key, line_no, severity, category, snippet) of four patterns that hang or leak.

    A race without a timeout; a loading flag without ``finally`` on the next 20 lines; an async function without
    try and catch on the next 50; a timeout in a file that never clears one. The window is over the lines of one file.
    """
    # What the whole file tells goes along as one flag; the content itself is on no line's row.
    clears = F.col(content).contains("clearTimeout") | F.col(content).contains("return () =>")
    rows = lines(files.select(key, content, clears.alias("clears")), key, content)
    line = F.col("line")
    rows = rows.withColumn("fin", ahead(key, "line_no", line.contains("finally"), 20))
    rows = rows.withColumn("tri", ahead(key, "line_no", line.rlike(r"\btry\b"), 50)).withColumn("cat", ahead(key, "line_no", line.rlike(r"\bcatch\b"), 50))

    def finding(severity: str, category: str) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"))

    found = F.array(
        F.when(line.contains("Promise.race") & ~F.lower(line).contains("timeout"), finding("high", "promise_race_no_timeout")),
        F.when((line.contains("setLoading(true)") | line.contains("setLoading( true )")) & ~F.col("fin"), finding("medium", "loading_without_finally")),
        F.when(line.rlike(r"^\s*async\s+(function\s+\w+|function|\w+)\s*\(") & ~(F.col("tri") & F.col("cat")), finding("low", "async_no_error_handling")),
        F.when(line.contains("setTimeout") & ~F.col("clears") & (line.contains("reject") | F.lower(line).contains("timeout")), finding("low", "settimeout_no_cleanup")),
    )
    hits = rows.select(key, "line_no", F.trim("line").alias("snippet"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
    return hits.select(key, "line_no", "f.severity", "f.category", "snippet")


def detection_stats(matches: DataFrame, rules: DataFrame, key: str = "file_path") -> DataFrame:
    """One row: matches, rules applied, whether they matched or not, and distinct files with a match."""
    told = matches.agg(F.count("*").alias("total_matches"), F.countDistinct(key).alias("files_scanned"))
    return told.join(F.broadcast(rules.agg(F.count("*").alias("rules_applied"))))  # one row each


def breakdown(findings: DataFrame, key: str = "file_path") -> DataFrame:
    """Findings and distinct files by severity and category."""
    return findings.groupBy("severity", "category").agg(F.count("*").alias("findings"), F.countDistinct(key).alias("files"))


def top_per_severity(findings: DataFrame, key: str = "file_path", n: int = 10) -> DataFrame:
    """The first ``n`` findings of each severity, by key and line."""
    w = Window.partitionBy("severity").orderBy(key, "line_no", "category")
    return findings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def context(rows: DataFrame, key: str, order: str, text: str, n: int = 2) -> DataFrame:
    """``rows`` with ``context``: the texts from ``n`` rows before to ``n`` after, joined by newlines."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, n)
    return rows.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n"))


#: Calls that test files are counted by.
TEST_PATTERNS = {"tests": r"\b(?:it|test)\(", "suites": r"\bdescribe\(", "assertions": r"\bexpect\(", "setups": r"\b(?:beforeEach|beforeAll)\(", "mocks": r"\b(?:mock|spyOn)\("}


def pattern_counts(files: DataFrame, content: str, patterns: dict[str, str] = TEST_PATTERNS) -> DataFrame:
    """``files`` with the number of matches of each pattern."""
    return files.select("*", *[F.regexp_count(F.col(content), F.lit(p)).alias(n) for n, p in patterns.items()])


def prefix_duplicates(names: DataFrame, name: str = "name", marks: str = "[@-]") -> DataFrame:
    """Prefixes, up to the first mark, that two or more distinct names share."""
    by = names.select(F.split(F.col(name), marks)[0].alias("prefix"), name).distinct().groupBy("prefix")
    return by.agg(F.count("*").alias("n")).filter("n > 1")


def log_tail(log: DataFrame, order: str, line: str, n: int = 100) -> DataFrame:
    """One row over the last ``n`` lines: entries, slow ones with a duration, failures, the slowest."""
    last = log.filter(F.trim(line) != "").orderBy(F.col(order).desc()).limit(n)
    slow = F.col(line).contains("SLOW") & F.col(line).rlike(r"\[[^\]]+\].*?[0-9]+ms")
    ms = F.regexp_extract(line, r"\[[^\]]+\].*?([0-9]+)ms", 1).try_cast("bigint")
    return last.agg(F.count("*").alias("entries"), F.count_if(slow).alias("slow"), F.count_if(F.col(line).contains("failed")).alias("failures"), F.max(F.when(slow, ms)).alias("slowest_ms"))


def schema_type(path: Column, content: Column, package: Column, remote: Column) -> Column:
    """The kind of a document by its path and content, in turn; a repository with a ``package`` file is an application,
    one with a ``remote`` source code."""
    p, text_ = F.lower(path), F.lower(content)
    has = lambda x: F.coalesce(x, F.lit(False))
    return (
        F.when(p.contains("test") | text_.contains("testing guide"), "HowTo")
        .when(p.contains("api") | text_.contains("api reference") | text_.contains("endpoints"), "APIReference")
        .when(has(package), "SoftwareApplication")
        .when(text_.contains("tutorial") | text_.contains("getting started") | text_.contains("guide"), "HowTo")
        .when(has(remote), "SoftwareSourceCode")
        .otherwise("TechArticle")
    )


def document_facts(pages: DataFrame, path: str, content: str, package: Column | None = None, remote: Column | None = None) -> DataFrame:
    """``pages`` with schema ``type``, ``title``, ``description``, ``impact`` and ``rating`` of a Markdown document.

    The title is the first ``# `` line, else the folder, else Documentation. The description is the first line behind a
    heading that is long enough and no heading, fence or tag, cut to 200 characters; without one, a fixed text.
    """
    no = F.lit(False)
    kind = schema_type(F.col(path), F.col(content), no if package is None else package, no if remote is None else remote)
    strip = lambda x: F.regexp_replace(x, f"^{text.SPACE}+|{text.SPACE}+$", "")
    title = F.nullif(strip(F.regexp_extract(F.col(content), f"(?m)^#{text.SPACE}+([^\\n\\r\\u2028\\u2029]+)$", 1)), F.lit(""))
    folder = F.nullif(F.regexp_extract(F.col(path), r"([^/]*)/[^/]*$", 1), F.lit(""))
    rows = F.transform(F.split(F.col(content), "\n"), strip)
    below = F.slice(rows, F.array_position(F.transform(rows, lambda x: x.startswith("#")), F.lit(True)).cast("int") + 1, F.size(rows))
    fits = F.filter(below, lambda x: ~x.rlike("^(#|```|<)") & (F.length(x) > 10))
    description = F.when(F.exists(rows, lambda x: x.startswith("#")), F.get(fits, F.lit(0)))
    short = F.when(F.length(description) > 200, F.concat(F.substring(description, 1, 197), F.lit("..."))).otherwise(description)
    out = pages.select("*", kind.alias("type"), F.coalesce(title, folder, F.lit("Documentation")).alias("title"), F.coalesce(short, F.lit("Technical documentation and guides")).alias("description"))
    seo = F.lit(1) + F.when(F.col("description").isNotNull(), 1).otherwise(0)
    rich = F.when(F.col("type").isin("HowTo", "TechArticle"), 1).otherwise(0)
    out = out.withColumn("impact", scoring.schema_impact(seo, rich, F.col("description").isNotNull(), F.lit(False)))
    return out.withColumn("rating", scoring.schema_rating(F.col("impact")))


def to_json_ld(name: Column, description: Column, kind: Column) -> Column:
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), kind.alias("@type"), name.alias("name"), description.alias("description")))


def heading_line(content: Column) -> Column:
    """The number, from 1, of the first line that is a heading behind its blanks; null without one."""
    rows = F.split(content, "\n")
    at = F.filter(F.transform(rows, lambda x, i: F.when(F.regexp_replace(x, f"^{text.SPACE}+", "").startswith("#"), i + 1)), lambda x: x.isNotNull())
    return F.get(at, F.lit(0))


def inject_after_heading(content: Column, block: Column) -> Column:
    """``content`` with ``block``, between two empty lines, after its first heading line, or before all without one."""
    rows, at = F.split(content, "\n"), F.coalesce(heading_line(content), F.lit(0))
    return F.array_join(F.concat(F.slice(rows, 1, at), F.array(F.lit(""), block, F.lit("")), F.slice(rows, at + 1, F.size(rows) + 1)), "\n")


def block_names(blocks: DataFrame, lines_: DataFrame, key: str = "file_path", window: int = 10) -> DataFrame:
    """``blocks`` (key, line_start, code ...) with ``function_name``: the name in the code itself, else the nearest
    declaration at ``line_start`` or up to ``window`` + 1 lines above it in the file's ``lines_`` (key, line_no, line).

    Declarations are few lines; they and the blocks without a name of their own meet in buckets of ``window`` + 1 lines,
    a block's bucket and the one before. Null or empty code, and blocks without a line, have no name but their own.
    """
    wide = window + 1
    own = blocks.withColumn("__own", text.function_name(F.col("code")))
    named = lines_.select(F.col(key).alias("__key"), F.col("line_no").alias("__no"), text.function_name(F.col("line")).alias("__name")).filter("__name IS NOT NULL")
    named = named.withColumn("__bucket", F.floor(F.col("__no") / wide))
    asks = own.filter("__own IS NULL AND code <> '' AND line_start > 0").select(F.col(key).alias("__key"), F.col("line_start").alias("__line")).distinct()
    asks = asks.withColumn("__bucket", F.explode(F.array(F.floor(F.col("__line") / wide), F.floor(F.col("__line") / wide) - 1)))
    met = asks.join(named, ["__key", "__bucket"]).filter((F.col("__no") <= F.col("__line")) & (F.col("__no") >= F.col("__line") - window))
    found = met.groupBy("__key", "__line").agg(F.max_by("__name", "__no").alias("__found"))
    able = (own[key] == found["__key"]) & (own["line_start"] == found["__line"]) & F.col("__own").isNull() & (F.col("code") != "")
    return own.join(found, able, "left").select(*[own[f"`{c}`"] for c in blocks.columns], F.coalesce("__own", "__found").alias("function_name"))
