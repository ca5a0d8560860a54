"""Activity of repositories and feeds: histograms, rollups, categories, schedules and recent entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extensions and whole file names of each language; the first that fits counts.
LANGUAGE_FILES = {
    "Python": (".py", ".pyw"), "JavaScript": (".js", ".mjs", ".cjs"), "TypeScript": (".ts", ".tsx"), "Ruby": (".rb", ".rake", ".gemspec"),
    "HTML": (".html", ".htm"), "CSS/SCSS": (".css", ".scss", ".sass", ".less"), "Markdown": (".md", ".markdown"), "JSON": (".json",),
    "YAML": (".yml", ".yaml"), "Shell": (".sh", ".bash", ".zsh"), "SQL": (".sql",), "Go": (".go",), "Rust": (".rs",),
    "C/C++": (".c", ".cpp", ".cc", ".h", ".hpp"), "Java": (".java",), "PHP": (".php",),
    "Lock Files": (".lock", "package-lock.json", "Gemfile.lock", "yarn.lock", "pnpm-lock.yaml"), "SVG": (".svg",),
    "Images": (".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".bmp"), "Data Files": (".csv", ".xml", ".tsv", ".parquet"), "Text Files": (".txt", ".log", ".ini", ".conf"),
}
#: Words in a repository's name by category.
CATEGORY_WORDS = {"Data & Analytics": ("scraper", "analytics", "bot"), "Personal Sites": ("personalsite", "github.io"), "Infrastructure": ("integrity", "studio", "visualizer"), "MCP Servers": ("mcp", "server"), "Business Apps": ("inventory", "financial")}
PRIORITIES = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def file_language(path: Column) -> Column:
    """The language of a path; ``Other`` for an unknown extension, null without one."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1))
    out = None
    for lang, known in LANGUAGE_FILES.items():
        hit = ext.isin(*[k for k in known if k[0] == "."]) | name.isin(*known)
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    return out.otherwise(F.when(ext != "", "Other"))


def language_histogram(files: DataFrame, path: str = "path") -> DataFrame:
    """Changed files by language, most first."""
    lang = files.select(file_language(F.col(path)).alias("language")).filter("language IS NOT NULL")
    return lang.groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language")


def top_languages(files: DataFrame, path: str = "path", n: int = 10) -> DataFrame:
    """The ``n`` languages of most changed files, ties by name."""
    return language_histogram(files, path).limit(n)


def monthly(commits: DataFrame, at: str, *keys: str) -> DataFrame:
    """Commits by ``yyyy-MM`` (and ``keys``), in order."""
    month = F.date_format(at, "yyyy-MM").alias("month")
    return commits.groupBy(month, *keys).agg(F.count("*").alias("commits")).orderBy("month", *keys)


def monthly_totals(repositories: DataFrame, months: str = "monthlyCommits") -> DataFrame:
    """Sums over the month maps of all repositories."""
    rows = repositories.select(F.explode(months).alias("month", "n"))
    return rows.groupBy("month").agg(F.sum("n").cast("long").alias("commits")).orderBy("month")


def totals(repositories: DataFrame) -> DataFrame:
    """Repositories, commits, additions, deletions and changed files (each change counts)."""

    def total(x) -> Column:
        return F.coalesce(F.sum(x), F.lit(0)).cast("long")

    return repositories.agg(F.count("*").alias("repositories"), total("commits").alias("commits"), total("additions").alias("additions"), total("deletions").alias("deletions"), total(F.greatest(F.size("files"), F.lit(0))).alias("files"))


def numstat_totals(lines: DataFrame, line: str = "line") -> DataFrame:
    """Additions and deletions of ``added<tab>deleted<tab>path`` lines; anything but digits counts 0."""
    parts = F.split(F.col(line), r"\s+")

    def number(i: int) -> Column:
        x = F.get(parts, F.lit(i))
        return F.coalesce(F.sum(F.when(x.rlike(r"^[0-9]+$"), x.try_cast("bigint"))), F.lit(0)).cast("long")

    return lines.agg(number(0).alias("additions"), number(1).alias("deletions"))


def repository_category(name: Column, commits: Column, legacy_below: int = 5) -> Column:
    """By words in the name; else ``Legacy`` for few commits and ``Client Work`` for more."""
    low = F.lower(name)
    out = None
    for cat, words in CATEGORY_WORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, cat) if out is None else out.when(hit, cat)
    return out.when(commits < legacy_below, "Legacy").otherwise("Client Work")


def category_buckets(repositories: DataFrame) -> DataFrame:
    by = repositories.groupBy(repository_category(F.col("name"), F.col("commits")).alias("category"))
    return by.agg(F.count("*").alias("repositories"), F.sum("commits").cast("long").alias("commits"))


def most_active(repositories: DataFrame, n: int = 10) -> DataFrame:
    """Repositories with commits, most first."""
    return repositories.filter("commits > 0").orderBy(F.desc("commits"), "name").limit(n)


def due(repositories: DataFrame, day: str, most: int | None = None) -> DataFrame:
    """Enabled repositories whose schedule falls on ``day``: by priority, then longest without a scan."""
    d = F.lit(day).cast("date")
    f = F.col("scanFrequency")
    fits = (f == "daily") | ((f == "weekly") & (F.dayofweek(d) == 1)) | ((f == "monthly") & (F.dayofmonth(d) == 1))
    rank = F.lit(0)
    for name, value in PRIORITIES.items():
        rank = F.when(F.col("priority") == name, value).otherwise(rank)
    since = F.coalesce(F.unix_millis(F.expr("try_to_timestamp(lastScannedAt)")), F.lit(0))
    out = repositories.filter(F.col("enabled") & fits).orderBy(rank.desc(), since, "name")
    return out if most is None else out.limit(most)


def group_members(groups: DataFrame, repositories: DataFrame, group: str) -> DataFrame:
    """Enabled repositories of a group in the group's order."""
    names = groups.filter(F.col("name") == group).select(F.posexplode("repositories").alias("place", "name"))
    return names.join(repositories.filter("enabled"), "name").orderBy("place").drop("place")


def record_scan(repositories: DataFrame, name: str, at: str, status: str, seconds: float, found: int, keep: int = 10) -> DataFrame:
    """``repositories`` with a scan put before the history of ``name``, which keeps ``keep`` entries."""
    hit = F.col("name") == name
    entry = F.struct(F.lit(at).alias("timestamp"), F.lit(status).alias("status"), F.lit(float(seconds)).alias("duration"), F.lit(found).cast("long").alias("duplicatesFound"))
    past = F.coalesce("scanHistory", F.array().cast("array<struct<timestamp:string,status:string,duration:double,duplicatesFound:bigint>>"))
    history = F.when(hit, F.slice(F.concat(F.array(entry), past), 1, keep)).otherwise(F.col("scanHistory"))
    return repositories.withColumn("lastScannedAt", F.when(hit, F.lit(at)).otherwise(F.col("lastScannedAt"))).withColumn("scanHistory", history)


def feed_stats(events: DataFrame, at: str, kind: str, now) -> DataFrame:
    """One row: entries of the last hour and day before ``now``, all, by kind, oldest and newest."""
    age = F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col(at).cast("timestamp"))
    by = events.groupBy(kind).agg(F.count("*").alias("n"))
    kinds = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("by_type"))
    one = events.agg(F.count_if(age <= 3_600_000).alias("last_hour"), F.count_if(age <= 86_400_000).alias("last_day"), F.count("*").alias("total"), F.min(at).alias("oldest"), F.max(at).alias("newest"))
    return one.withColumn("one", F.lit(1)).join(kinds.withColumn("one", F.lit(1)), "one").drop("one")


def newest_per_key(rows: DataFrame, key: str, at: str, tie: str, n: int) -> DataFrame:
    """The ``n`` newest rows of each key; Spark limits each group within tasks before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def directory_stats(paths: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Directories by depth, and the ten most frequent names."""
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    rows = paths.select(F.size(parts).alias("depth"), F.element_at(parts, -1).alias("name"))
    return rows.groupBy("depth").agg(F.count("*").alias("n")).orderBy("depth"), rows.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)
