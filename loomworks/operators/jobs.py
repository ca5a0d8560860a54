"""Job-store analytics: filters, pages, counts, latest rows, imports, upserts and cancellations of one jobs table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The store's statuses, and those that end a job.
STATUSES = ("queued", "running", "completed", "failed", "cancelled", "paused")
TERMINAL = ("completed", "failed", "cancelled")
ID_PATTERN = r"^[a-zA-Z0-9_-]{1,100}$"
JSON_COLUMNS = ("data", "result", "error", "git")
PAGE_LIMIT, PAGE_MOST = 50, 1000
#: Display names of pipelines.
PIPELINE_NAMES = {
    "duplicate-detection": "Duplicate Detection", "repomix": "Repomix Automation", "git-activity": "Git Activity Reporter", "claude-health": "Claude Health Monitor", "gitignore-manager": "Gitignore Manager",
    "plugin-manager": "Plugin Manager", "doc-enhancement": "Doc Enhancement", "test-refactor": "Test Refactor", "schema-enhancement": "Schema Enhancement", "bugfix-audit": "Bugfix Audit",
    "dashboard-populate": "Dashboard Populate", "repo-cleanup": "Repository Cleanup", "unknown": "Unknown Pipeline",
}


def json_or_null(column: str) -> Column:
    """The text if it is valid JSON, else null."""
    return F.when(F.expr(f"try_parse_json(`{column}`)").isNotNull(), F.col(column))


def valid_id(column: str = "id") -> Column:
    return F.coalesce(F.col(column).rlike(ID_PATTERN), F.lit(False))


def valid_status(column: str = "status") -> Column:
    return F.coalesce(F.col(column).isin(*STATUSES), F.lit(False))


def parsed(jobs: DataFrame) -> DataFrame:
    """Rows with JSON columns that are not JSON as null, and ``error`` kept only if it has a text ``message``."""
    out = jobs
    for c in JSON_COLUMNS:
        if c in jobs.columns:
            out = out.withColumn(c, json_or_null(c))
    if "error" in jobs.columns:
        out = out.withColumn("error", F.when(F.get_json_object("error", "$.message").isNotNull(), F.col("error")))
    return out


def select_jobs(jobs: DataFrame, pipeline: str | None = None, status: str | None = None, tab: str | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Jobs of a pipeline and status; ``tab='failed'`` stands for that status where none is given."""
    if pipeline is not None:
        jobs = jobs.filter(F.col("pipeline_id") == pipeline)
    if status is None and tab == "failed":
        status = "failed"
    if status is not None:
        jobs = jobs.filter(F.col("status") == status)
    return jobs if statuses is None else jobs.filter(F.col("status").isin(*statuses))


def by_id(jobs: DataFrame, wanted: str) -> DataFrame:
    """The job of an id, or none."""
    return jobs.filter(F.col("id") == wanted)


def pipeline_name(pipeline: Column) -> Column:
    """The display name of a pipeline; its own id where it has none."""
    names = F.create_map(*[F.lit(x) for pair in PIPELINE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, pipeline), pipeline)


def api_view(jobs: DataFrame) -> DataFrame:
    """Jobs as listings show them, with their pipeline's display name."""
    own = [F.col(c) for c in ("status", "created_at", "started_at", "completed_at", "error", "result", "data") if c in jobs.columns]
    return jobs.select("id", "pipeline_id", pipeline_name(F.col("pipeline_id")).alias("pipeline_name"), *own)


def page(jobs: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """Newest first, ties by id; a limit of 0 gives no rows."""
    return jobs.orderBy(F.col("created_at").desc(), F.col("id")).offset(offset).limit(limit)


def page_by_completion(jobs: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """Last completed first, jobs without completion at the end, newest first among them."""
    return jobs.orderBy(F.col("completed_at").desc_nulls_last(), F.col("created_at").desc(), F.col("id")).offset(offset).limit(limit)


def leading_integer(x) -> int | None:
    """The integer that the text of ``x`` begins with, after blanks; hexadecimal behind 0x. None if there is none."""
    found = re.match(r"\s*([+-]?)(?:0[xX]([0-9a-fA-F]+)|([0-9]+))", str(x))
    if not found:
        return None
    value = int(found[2], 16) if found[2] else int(found[3])
    return -value if found[1] == "-" else value


def page_parameters(limit=None, offset=None, most: int = PAGE_MOST, default: int = PAGE_LIMIT) -> tuple[int, int]:
    """Limit within 1 and ``most`` (``default`` if it is no number) and offset of 0 or more, from any text or number."""
    n, at = leading_integer(limit), leading_integer(offset)
    return min(max(1, default if n is None else n), most), max(0, at or 0)


def page_info(limit: int, offset: int, total: int, returned: int | None = None) -> dict:
    """Page number and whether more rows follow; with ``returned``, counted by the rows of the page."""
    end = offset + (limit if returned is None else returned)
    return {"total": total, "limit": limit, "offset": offset, "page": offset // limit if limit else 0, "hasMore": end < total}


def job_page(jobs: DataFrame, limit: int = 10, offset: int = 0) -> tuple[DataFrame, int]:
    """A page and the number of all rows it is taken from."""
    return page(jobs, limit, offset), jobs.count()


def _count(*statuses: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("status").isin(*statuses), 1).otherwise(0)), F.lit(0)).cast("long")


def _counts() -> list[Column]:
    return [F.count("*").alias("total"), *[_count(s).alias(s) for s in ("completed", "failed", "running", "queued")]]


def counts(jobs: DataFrame) -> DataFrame:
    """One row, zeros if there are no jobs: total, completed, failed, running, queued (others are in the total alone)."""
    return jobs.agg(*_counts())


def pipeline_stats(jobs: DataFrame) -> DataFrame:
    """The counts and the last completion of each pipeline, by pipeline."""
    return jobs.groupBy("pipeline_id").agg(*_counts(), F.max("completed_at").alias("last_run")).orderBy("pipeline_id")


def last_jobs(jobs: DataFrame) -> DataFrame:
    """The newest job of each pipeline, ties by greatest id: a max of the row, which tasks reduce before the shuffle."""
    names = [c for c in jobs.columns if c not in ("created_at", "id")]
    row = F.max(F.struct("created_at", "id", *names)).alias("row")
    return jobs.groupBy("pipeline_id").agg(row).select(*[F.col(f"row.{c}").alias(c) for c in jobs.columns])


def recent(jobs: DataFrame, each: int = 10, most: int = 20) -> DataFrame:
    """The last ``each`` completed and failed jobs in one list of ``most``, by completion or else creation."""
    parts = [page_by_completion(select_jobs(jobs, status=s), each) for s in ("completed", "failed")]
    at = F.coalesce("completed_at", "created_at").alias("happened_at")
    return parts[0].unionByName(parts[1]).select("id", "pipeline_id", "status", at).orderBy(F.col("happened_at").desc(), "id").limit(most)


def status_board(pipelines: DataFrame, stats: DataFrame, workers: DataFrame) -> DataFrame:
    """Supported pipelines (pipeline_id, name) with stored and worker counts; missing ones are 0 and ``idle``."""
    joined = pipelines.join(stats, "pipeline_id", "left").join(workers, "pipeline_id", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "completed", "failed", "running", "queued", "active")]
    state = F.when(F.coalesce("active", F.lit(0)) > 0, "running").otherwise("idle").alias("state")
    return joined.select("pipeline_id", F.coalesce("name", "pipeline_id").alias("name"), *numbers, "last_run", state)


#: What a worker counts.
WORKER_COUNTS = ("total", "queued", "active", "completed", "failed")


def worker_totals(workers: DataFrame) -> DataFrame:
    """One row: the sums of ``WORKER_COUNTS`` over workers (pipeline_id, counts), null ones 0, and ``by_pipeline``, a map
    of each worker's counts. Workers are few, one a pipeline."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in WORKER_COUNTS]
    by = F.map_from_entries(F.array_sort(F.collect_list(F.struct("pipeline_id", F.struct(*WORKER_COUNTS).alias("counts")))))
    return workers.agg(*sums, by.alias("by_pipeline"))


def total_capacity(settings: DataFrame, default: int = 5) -> DataFrame:
    """One row: the jobs that all pipelines (disabled, max_scans, max_jobs) not disabled may run at once; the first
    number that is set counts, else ``default``."""
    on = settings.filter(~F.coalesce("disabled", F.lit(False)))
    return on.agg(F.coalesce(F.sum(F.coalesce("max_scans", "max_jobs", F.lit(default))), F.lit(0)).cast("long").alias("capacity"))


def insert_absent(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """``jobs`` and those of ``rows`` whose id it lacks."""
    return jobs.unionByName(rows.join(jobs.select("id"), "id", "left_anti").select(*jobs.columns))


def classify_import(rows: DataFrame, existing: DataFrame, order: str = "ord") -> DataFrame:
    """Each row's ``outcome`` (imported, skipped, error) and ``reason``.

    Bad ids, statuses and JSON texts are errors, in that order. Ids of ``existing``, and all but the first good row
    of an id in ``order``, are skipped.
    """
    bad = F.when(~valid_id(), "invalid id").when(~valid_status(), "invalid status")
    for c in JSON_COLUMNS:
        if c in rows.columns:
            bad = bad.when(F.col(c).isNotNull() & F.expr(f"try_parse_json(`{c}`)").isNull(), F.lit(f"invalid json: {c}"))
    marked = rows.withColumn("reason", bad)
    first = marked.filter(F.col("reason").isNull()).groupBy("id").agg(F.min(order).alias("first_ord"))
    known = existing.select("id").distinct().withColumn("known", F.lit(True))
    told = marked.join(first, "id", "left").join(known, "id", "left")
    again = F.col("known").isNotNull() | (F.col(order) != F.col("first_ord"))
    outcome = F.when(F.col("reason").isNotNull(), "error").when(again, "skipped").otherwise("imported")
    return told.withColumn("outcome", outcome).drop("first_ord", "known")


def upsert(jobs: DataFrame, rows: DataFrame, order: str = "ord") -> DataFrame:
    """``jobs`` with ``rows`` over them: the last in ``order`` of an id wins, and any of ``rows`` over the store."""
    all_rows = jobs.withColumn(order, F.lit(None).cast("long")).unionByName(rows)
    names = [c for c in jobs.columns if c != "id"]
    best = F.max_by(F.struct(*names), F.coalesce(F.col(order), F.lit(-1))).alias("row")
    return all_rows.groupBy("id").agg(best).select("id", *[F.col(f"row.{c}").alias(c) for c in names])


def bulk_cancel(jobs: DataFrame, statuses: list[str], now: str) -> DataFrame:
    """Jobs in ``statuses`` become cancelled, completed ``now``; ``changed`` marks them."""
    hit = F.coalesce(F.col("status").isin(*statuses), F.lit(False))
    changed = jobs.withColumn("changed", hit)
    return changed.withColumn("completed_at", F.when(hit, F.lit(now)).otherwise(F.col("completed_at"))).withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status")))


def expired(jobs: DataFrame, now: str, days: int) -> DataFrame:
    """Ended jobs completed ``days`` or more before ``now``."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return jobs.filter(F.col("status").isin(*TERMINAL) & (F.expr("try_to_timestamp(completed_at)") <= cutoff))


def detail(jobs: DataFrame) -> DataFrame:
    """id, status, start (started or else created), end, and the milliseconds between where the job has ended."""
    start, end = F.coalesce("started_at", "created_at"), F.col("completed_at")
    ms = F.unix_millis(F.to_timestamp(end)) - F.unix_millis(F.to_timestamp(start))
    return jobs.select("id", "pipeline_id", "status", start.alias("start_time"), end.alias("end_time"), ms.alias("duration_ms"))


def log_lines(jobs: DataFrame) -> DataFrame:
    """(id, line_no, line): a job's life as numbered lines, those without a value left out.

    Creation and start; from ``data`` the repository and the attempt; from ``result`` the duration, summary and number
    of files; the message of ``error``; and how a completed or failed job ended. Values are one line of 200 characters
    at most; empty ones, 0 and false count as none. A line's time is the end's, the start's or the creation's.
    """
    begin, end = F.coalesce("started_at", "created_at"), F.coalesce("completed_at", "started_at", "created_at")

    def line(at: Column, lead: str, value: Column | None = None, tail: str = "", when: Column | None = None) -> Column:
        clean = F.lit("") if value is None else F.substring(F.regexp_replace(value, r"[\r\n\t]", " "), 1, 200)
        told = at.isNotNull() if value is None else ~F.coalesce(value, F.lit("")).isin("", "0", "false")
        return F.when(told if when is None else told & when, F.concat(F.lit("["), F.coalesce(at, F.lit("")), F.lit(f"] {lead}"), clean, F.lit(tail)))

    of = lambda column, name: F.get_json_object(column, f"$.{name}")
    lines = F.array(
        line(F.col("created_at"), "Job created (pipeline: ", F.coalesce("pipeline_id", F.lit("undefined")), ")", F.col("created_at").isNotNull()),
        line(F.col("started_at"), "Job started"),
        line(begin, "Repository: ", of("data", "repositoryPath")),
        line(begin, "Retry attempt: ", of("data", "retryCount")),
        line(end, "Duration: ", of("result", "duration_seconds"), "s"),
        line(end, "", of("result", "summary")),
        line(end, "Files processed: ", of("result", "filesProcessed")),
        line(end, "ERROR: ", of("error", "message")),
        line(F.col("completed_at"), "Job completed successfully", when=F.coalesce(F.col("status") == "completed", F.lit(False))),
        line(F.col("completed_at"), "Job failed", when=F.coalesce(F.col("status") == "failed", F.lit(False))),
    )
    return jobs.select("id", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("line_no", "line"))


def retry_metrics(jobs: DataFrame, near: int = 3) -> DataFrame:
    """One row over (id, retries): total retries, jobs by 1, 2 and 3 or more attempts, those near the limit."""
    n = F.col("retries")
    return jobs.filter(n > 0).agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_attempts"),
        F.count_if(n == 1).alias("attempt_1"),
        F.count_if(n == 2).alias("attempt_2"),
        F.count_if(n >= 3).alias("attempt_3_plus"),
        F.count_if(n >= near).alias("near_limit"),
        F.count("*").alias("retrying"),
    )
