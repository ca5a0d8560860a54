"""Sources and sinks: JSON reports and logs, configurations, file listings, packed repositories, texts, caches, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import language, safe_id

#: Pipelines of log files by the start of their name.
LOG_PIPELINES = {"git-activity": "git-activity", "claude-health": "claude-health", "plugin-audit": "plugin-manager", "gitignore": "gitignore-manager", "schema-enhancement": "schema-enhancement", "doc-enhancement": "schema-enhancement", "repomix": "repomix"}
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def jobs_table(spark: SparkSession, path: str) -> DataFrame:
    """A jobs table written as Parquet."""
    return spark.read.schema(schemas.JOBS).parquet(path)


def jobs_jdbc(spark: SparkSession, url: str, table: str = "jobs", bounds: list[str] = (), **options) -> DataFrame:
    """A jobs table of a database, read in ranges of the id at ``bounds``, a task each; null ids are in the first."""
    cuts = [None, *sorted(b.replace("'", "''") for b in bounds), None]
    slices = []
    for low, high in zip(cuts, cuts[1:]):
        parts = [f"\"id\" >= '{low}'" * (low is not None), f"\"id\" < '{high}'" * (high is not None)]
        where = " AND ".join(p for p in parts if p) or "1 = 1"
        slices.append(where if low is not None or high is None else f"({where} OR \"id\" IS NULL)")
    return spark.read.jdbc(url, table, predicates=slices, properties={k: str(v) for k, v in options.items()})


def write_jobs_jdbc(jobs: DataFrame, url: str, table: str = "jobs", mode: str = "append", writers: int = 8, **options) -> None:
    """Writes jobs to a database over at most ``writers`` connections; a new table's ids hold 100 characters, as ids may have."""
    jobs.coalesce(writers).write.mode(mode).option("createTableColumnTypes", "id VARCHAR(100)").jdbc(url, table, properties={k: str(v) for k, v in options.items()})


def sql(spark: SparkSession, query: str, **tables_and_args) -> DataFrame:
    """A parameterised query; DataFrames among the arguments are tables in ``{name}``, others are ``:name`` values."""
    tables = {k: v for k, v in tables_and_args.items() if isinstance(v, DataFrame)}
    return spark.sql(query, args={k: v for k, v in tables_and_args.items() if k not in tables}, **tables)


def _named_json(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    whole = spark.read.option("wholetext", "true").option("pathGlobFilter", glob).text(folder)
    return whole.select(F.col("value").alias("raw"), F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"))


def _or(*json_paths: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object("raw", p), F.lit("")) for p in json_paths])


def report_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs from ``*-summary.json`` files; the day is in the file's name, else its time of change. Bad JSON is left out."""
    rows = _named_json(spark, folder, "*-summary.json").filter(F.expr("try_parse_json(raw)").isNotNull())
    changed = F.date_format("mtime", _ISO)
    day = F.coalesce(F.nullif(F.regexp_extract("file", r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")), F.substring(changed, 1, 10))
    start = F.concat(day, F.lit("T00:00:00.000Z"))
    data = F.to_json(F.struct(F.coalesce(_or("$.scanType"), F.lit("inter-project")).alias("scanType"), F.coalesce(_or("$.repositories"), F.lit("[]")).alias("repositories")))
    result = F.to_json(F.struct(F.coalesce(_or("$.totalDuplicates").cast("long"), F.lit(0)).alias("totalDuplicates"), F.coalesce(_or("$.totalBlocks").cast("long"), F.lit(0)).alias("totalBlocks"), _or("$.scanDuration").cast("double").alias("scanDuration"), F.col("path").alias("reportPath")))
    name = safe_id(F.replace(F.col("file"), F.lit("-summary.json"), F.lit("")))
    return _jobs(rows, name, F.lit("duplicate-detection"), F.lit("completed"), start, changed, data, result, F.lit(None))


def log_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs from ``*.json`` log files: pipeline by the start of the name, failed if they have an error."""
    rows = _named_json(spark, folder, "*.json").filter(F.expr("try_parse_json(raw)").isNotNull())
    pipeline = None
    for start, name in LOG_PIPELINES.items():
        hit = F.col("file").startswith(start)
        pipeline = F.when(hit, name) if pipeline is None else pipeline.when(hit, name)
    changed, error = F.date_format("mtime", _ISO), _or("$.error")
    begun = F.coalesce(_or("$.startTime"), changed)
    done = F.coalesce(_or("$.endTime"), changed)
    data = F.coalesce(_or("$.parameters", "$.config"), F.lit("{}"))
    result = F.coalesce(_or("$.result", "$.summary"), F.col("raw"))
    name = safe_id(F.regexp_replace("file", r"\.json$", ""))
    return _jobs(rows, name, pipeline.otherwise("unknown"), F.when(error.isNull(), "completed").otherwise("failed"), begun, done, data, result, error)


def import_folders(spark: SparkSession, reports: list[str], logs: list[str]) -> tuple[DataFrame, DataFrame]:
    """The jobs of folders of reports and of logs, with their folder as ``source``, and how many came of each, in order.

    An id that several files have is imported once, from the first folder that has it.
    """
    folders = [(f, report_jobs) for f in reports] + [(f, log_jobs) for f in logs]
    parts = [read(spark, f).withColumn("source", F.lit(f)).withColumn("__at", F.lit(i)) for i, (f, read) in enumerate(folders)]
    every = reduce(DataFrame.unionByName, parts)
    first = every.groupBy("id").agg(F.min_by(F.struct(*every.columns), "__at").alias("row")).select("row.*")
    order = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(folders)], "__at int, source string")
    counts = first.groupBy("__at").agg(F.count("*").alias("n"))
    return first.drop("__at"), order.join(counts, "__at", "left").orderBy("__at").select("source", F.coalesce("n", F.lit(0)).alias("imported"))


def _jobs(rows, id_, pipeline, status, begun, done, data, result, error) -> DataFrame:
    columns = (id_, pipeline, status, begun, begun, done, data, result, error, F.lit(None))
    return rows.select(*[c.cast("string").alias(n) for n, c in zip(schemas.JOBS.names, columns)])


def repository_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Repositories and groups of a JSON configuration."""
    whole = spark.read.schema(schemas.REPOSITORY_CONFIG).json(path, multiLine=True)
    repos = whole.select(F.inline("repositories"))
    return repos, whole.select(F.inline("repositoryGroups"))


def write_repository_config(repositories: DataFrame, groups: DataFrame, path: str) -> None:
    """Writes both as one JSON document (a configuration is small by nature)."""
    r = repositories.agg(F.collect_list(F.struct(*repositories.columns)).alias("repositories"))
    g = groups.agg(F.collect_list(F.struct(*groups.columns)).alias("repositoryGroups"))
    r.withColumn("one", F.lit(1)).join(g.withColumn("one", F.lit(1)), "one").drop("one").coalesce(1).write.mode("overwrite").json(path)


def pattern_matches(spark: SparkSession, path: str) -> DataFrame:
    """Matches of JSON lines, with the alternate field names of scanners put in place; absent lines count as 0."""
    raw = T.StructType([T.StructField(n, t) for n, t in (("file", T.StringType()), ("path", T.StringType()), ("ruleId", T.StringType()), ("rule_id", T.StringType()), ("text", T.StringType()), ("range", T.StructType([T.StructField(e, T.StructType([T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())])) for e in ("start", "end")])), ("severity", T.StringType()))])
    rows = spark.read.schema(raw).json(path)
    zero = F.lit(0)
    return rows.select(
        F.coalesce("file", "path", F.lit("")).alias("file_path"),
        F.coalesce("ruleId", "rule_id", F.lit("unknown")).alias("rule_id"),
        F.coalesce("text", F.lit("")).alias("matched_text"),
        F.coalesce("range.start.line", zero).alias("line_start"),
        F.coalesce("range.end.line", "range.start.line", zero).alias("line_end"),
        F.col("range.start.column").alias("column_start"),
        F.col("range.end.column").alias("column_end"),
        "severity",
        F.lit(None).cast("double").alias("confidence"),
    )


def invalid_match() -> Column:
    """The first rule of the boundary that a match breaks; null for a good one."""
    p, t = F.col("file_path"), F.col("matched_text")
    return (
        F.when(p.isNull() | (p == "") | (F.length(p) > 500), "path length")
        .when(p.contains("..") | p.startswith("/"), "path outside")
        .when((F.length("rule_id") < 1) | (F.length("rule_id") > 100), "rule length")
        .when(F.length(t) > 100_000, "text length")
        .when(~F.col("line_start").between(1, 1_000_000), "line start")
        .when(F.col("line_end") < F.col("line_start"), "line end")
    )


def validate_matches(matches: DataFrame, most: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(good, bad with ``problem``). Of an input of more than ``most`` matches all are bad. See ``strict``."""
    many = matches.agg((F.count("*") > most).alias("many"))  # one row
    marked = matches.join(F.broadcast(many)).withColumn("problem", F.coalesce(invalid_match(), F.when(F.col("many"), "too many"))).drop("many")
    return marked.filter("problem IS NULL").drop("problem"), marked.filter("problem IS NOT NULL")


def strict(matches: DataFrame, most: int = 50_000) -> DataFrame:
    """All matches, or none if any is bad or they are more than ``most``."""
    good, bad = validate_matches(matches, most)
    return good.join(bad.select(F.lit(True).alias("any")).limit(1), F.lit(True), "left_anti")


def list_files(spark: SparkSession, folder: str, extensions: list[str] | None = None, exclude: list[str] = (), most_bytes: int | None = None, depth: int | None = None) -> DataFrame:
    """(path, length, modified) of files below ``folder``; contents are not read. Hidden folders are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    rows = rows.filter(~F.col("path").rlike(r"/\.[^/]+/"))
    if extensions:
        rows = rows.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*extensions))
    for part in exclude:
        rows = rows.filter(~F.col("path").contains(part))
    if most_bytes is not None:
        rows = rows.filter(F.col("length") <= most_bytes)
    if depth is not None:
        base = len([x for x in folder.rstrip("/").split("/") if x])
        rows = rows.filter(F.size(F.filter(F.split(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "/"), lambda x: x != "")) <= base + depth)
    return rows


def rule_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rule files (yml, yaml) with their text."""
    rows = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").option("pathGlobFilter", "*.{yml,yaml}").text(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def packed_files(packs: DataFrame, pack: str = "pack") -> DataFrame:
    """(path, lines, language) of the ``<file path="...">`` sections of packed repositories."""
    section = r'(?s)<file path="[^"]+">.*?</file>'
    rows = packs.select(F.explode(F.regexp_extract_all(pack, F.lit(section), F.lit(0))).alias("s"))
    path = F.regexp_extract("s", r'<file path="([^"]+)">', 1)
    return rows.select(path.alias("path"), F.regexp_count("s", F.lit("\n")).alias("lines"), language(path).alias("language"))


def discover(*lists: DataFrame) -> DataFrame:
    """Sorted distinct paths of several listings."""
    out = lists[0].select("path")
    for x in lists[1:]:
        out = out.union(x.select("path"))
    return out.distinct().orderBy("path")


def lint_occurrences(spark: SparkSession, path: str, rule: str = "no-magic-numbers") -> DataFrame:
    """(path, line, column, literal) of one rule's messages in a lint report."""
    rows = spark.read.schema(T.ArrayType(schemas.LINT_FILE).elementType).json(path, multiLine=True)
    told = rows.select("filePath", F.inline("messages")).filter(F.col("ruleId") == rule)
    literal = F.regexp_extract("message", r"No magic number:\s*([^\s]+?)\.?(?:\s|$)", 1)
    return told.select(F.col("filePath").alias("path"), F.coalesce("line", F.lit(1)).alias("line"), F.coalesce("column", F.lit(1)).alias("column"), literal.alias("literal")).filter(F.col("literal") != "")


def step_timings(lines: DataFrame, line: str = "line") -> DataFrame:
    """(step, ms) of ``  name   12ms`` lines."""
    pattern = r"^\s{2}(\S+)\s+([0-9]+)ms$"
    return lines.filter(F.col(line).rlike(pattern)).select(F.regexp_extract(line, pattern, 1).alias("step"), F.regexp_extract(line, pattern, 2).cast("long").alias("ms"))


def stated_number(line: str, label: str) -> Column:
    """The number after ``label:`` in a text; null if it is not there."""
    return F.nullif(F.regexp_extract(line, rf"{label}:\s*([0-9,]+)", 1), F.lit("")).cast("string").try_cast("bigint")


def commit_rows(log: DataFrame, line: str = "line", most: int = 10) -> DataFrame:
    """(hash, author, email, at, subject) of ``hash|author|email|epoch|subject`` lines, the newest ``most``; what follows a further bar is cut."""
    p = F.split(F.col(line), r"\|")
    return log.select(p[0].alias("hash"), F.get(p, F.lit(1)).alias("author"), F.get(p, F.lit(2)).alias("email"), F.timestamp_seconds(F.get(p, F.lit(3)).try_cast("bigint")).alias("at"), F.get(p, F.lit(4)).alias("subject")).orderBy(F.col("at").desc(), "hash").limit(most)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose hash differs between two listings (path, hash), or that only the later one has."""
    old = before.select("path", F.col("hash").alias("old"))
    return after.join(old, "path", "left").filter(~F.col("hash").eqNullSafe(F.col("old"))).select("path")


def cached(entries: DataFrame, key: str, now: str, days: int = 30) -> DataFrame:
    """The live cache entry of a key: the newest not older than its time to live."""
    live = entries.filter((F.col("key") == key) & (F.col("cached_at") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")))
    return live.orderBy(F.col("cached_at").desc()).limit(1)


def cache_index(entries: DataFrame, per: str = "repository", most: int = 50) -> DataFrame:
    """The newest ``most`` entries of each repository."""
    w = Window.partitionBy(per).orderBy(F.col("cached_at").desc(), "key")
    return entries.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).drop("rank")


def invalidate(entries: DataFrame, prefix: str) -> DataFrame:
    """Entries whose key does not begin with ``prefix``."""
    return entries.filter(~F.col("key").startswith(prefix))


def cache_valid(force: Column, enabled: Column, is_git: Column, dirty: Column, hit: Column) -> Column:
    """Whether a cached scan is used, and else why not."""
    return F.when(force, "forced").when(~enabled, "disabled").when(~is_git, "not git").when(dirty, "dirty").when(~hit, "missing").otherwise("use")


def write_report(rows: DataFrame, path: str) -> None:
    """One JSON document a line."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def write_job_logs(jobs: DataFrame, path: str) -> None:
    """Jobs as JSON, a folder for each status."""
    jobs.write.mode("overwrite").partitionBy("status").json(path)


def markdown_table(rows: DataFrame, columns: list[str], most: int = 50) -> str:
    """The first ``most`` rows as a Markdown table."""
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows.select(*columns).limit(most).collect()]
    return "\n".join(lines)


def html_table(rows: DataFrame, columns: list[str], most: int = 50) -> str:
    """The first ``most`` rows as an HTML table."""
    from html import escape

    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(r[c]))}</td>" for c in columns) + "</tr>" for r in rows.select(*columns).limit(most).collect())
    return f"<table><tr>{head}</tr>{body}</table>"


#: Folders that a walk for repositories does not enter.
NOT_WALKED = ("node_modules", ".git", "dist", "build", "coverage", ".next", ".nuxt", "vendor", "__pycache__", ".venv", "venv", "target", ".idea", ".vscode", "jobs")


def repository_roots(paths: DataFrame, base: str, depth: int = 10, excluded=NOT_WALKED) -> DataFrame:
    """(path, relative, name, depth) of the repositories that a walk from ``base`` finds in a listing of ``paths`` (path).

    A folder with something below its ``.git`` is a repository; the walk stops there, so those inside another are not
    found. It enters no hidden and no ``excluded`` folder, and no folder more than ``depth`` levels below ``base``. All
    folders above a repository are looked up among the repositories by their paths; no folder is walked.
    """
    base = base.rstrip("/")
    inside = F.col("path").startswith(base + "/") & F.col("path").contains("/.git/")
    below = paths.filter(inside).select(F.substring_index("path", "/.git/", 1).alias("root")).filter(F.length("root") >= len(base)).distinct()
    parts = F.filter(F.split(F.substring(F.col("root"), len(base) + 2, 1 << 20), "/"), lambda x: x != "")
    able = below.withColumn("parts", parts).filter(F.size("parts") <= depth)
    able = able.filter(~F.exists("parts", lambda x: x.startswith(".") | x.isin(*excluded)))
    above = able.select("root", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda k: F.concat(F.lit(base), F.array_join(F.transform(F.slice("parts", F.lit(1), k), lambda x: F.concat(F.lit("/"), x)), "")))).alias("up")).filter("up <> root")
    nested = above.join(able.select(F.col("root").alias("up")), "up", "left_semi").select("root").distinct()
    top = able.join(nested, "root", "left_anti")
    name = F.substring_index("root", "/", -1)
    return top.select(F.col("root").alias("path"), F.coalesce(F.nullif(F.array_join("parts", "/"), F.lit("")), name).alias("relative"), name.alias("name"), F.size("parts").alias("depth"))
