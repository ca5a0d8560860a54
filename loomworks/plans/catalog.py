"""Registered queries of the engine's operators over the driver's tables, each beside its DuckDB SQL.

Jobs are ``events`` (a row an event), blocks are ``documents`` or ``part``, repositories are ``nation`` and
``customer``, files are ``pages``. A query without SQL keeps state or iterates; tests/test_brute.py
holds it, or for the layers their operators on small blocks, to plain Python.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import annotations, errors, scoring, text
from ..operators import accuracy, activity, constants, duplicates, graph, jobs, metrics, scanners
from ..streaming import lifecycle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

STATUS = {"view": "queued", "click": "running", "purchase": "completed", "error": "failed", "signup": "cancelled"}
ENDED = ("purchase", "error", "signup")
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"
_AT = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"
JOBS_SQL = f"jobs AS (SELECT CAST(event_id AS VARCHAR) AS id, 'p' || (user_id % 12) AS pipeline_id, {_CASE} AS status, {_AT} AS created_at, CASE WHEN event_type IN {ENDED} THEN {_AT} END AS completed_at, props AS data, user_id, value FROM events)"


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs table that the events stand for."""
    e = table(spark, sf_dir, "events")
    status = scoring.lookup(F.col("event_type"), STATUS, None)
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    done = F.when(F.col("event_type").isin(*ENDED), at)
    return e.select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("p"), (F.col("user_id") % 12).cast("string")).alias("pipeline_id"), status.alias("status"), at.alias("created_at"), done.alias("completed_at"), F.col("props").alias("data"), "user_id", "value")


_COUNTS = ", ".join(["count(*) AS total", *[f"CAST(coalesce(sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS {s}" for s in ("completed", "failed", "running", "queued")]])


@query(f"WITH {JOBS_SQL} SELECT pipeline_id, {_COUNTS}, max(completed_at) AS last_run FROM jobs GROUP BY pipeline_id")
def pipeline_stats(spark, sf_dir):
    return jobs.pipeline_stats(event_jobs(spark, sf_dir))


@query(f"WITH {JOBS_SQL} SELECT {_COUNTS} FROM jobs WHERE pipeline_id = 'p3'")
def job_counts_one(spark, sf_dir):
    return jobs.counts(jobs.select_jobs(event_jobs(spark, sf_dir), pipeline="p3"))


@query(f"WITH {JOBS_SQL} SELECT count(*) AS n FROM jobs WHERE pipeline_id = 'p3' AND status = 'failed'")
def job_count_status(spark, sf_dir):
    return jobs.select_jobs(event_jobs(spark, sf_dir), pipeline="p3", tab="failed").agg(F.count("*").alias("n"))


@query(f"WITH {JOBS_SQL} SELECT id, pipeline_id, status, created_at FROM jobs WHERE pipeline_id = 'p1' AND status IN ('completed', 'failed') ORDER BY created_at DESC, id LIMIT 10 OFFSET 5")
def jobs_page(spark, sf_dir):
    found = jobs.select_jobs(event_jobs(spark, sf_dir), pipeline="p1", statuses=["completed", "failed"])
    return jobs.page(found, 10, 5).select("id", "pipeline_id", "status", "created_at")


@query(f"WITH {JOBS_SQL} SELECT id, status, created_at, completed_at FROM jobs WHERE pipeline_id = 'p2' ORDER BY completed_at DESC NULLS LAST, created_at DESC, id LIMIT 50")
def jobs_page_completed_order(spark, sf_dir):
    return jobs.page_by_completion(jobs.select_jobs(event_jobs(spark, sf_dir), pipeline="p2"), 50).select("id", "status", "created_at", "completed_at")


@query(f"WITH {JOBS_SQL} SELECT id, pipeline_id, status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY created_at DESC, id DESC) AS r FROM jobs) WHERE r = 1")
def last_job_per_pipeline(spark, sf_dir):
    return jobs.last_jobs(event_jobs(spark, sf_dir).select("id", "pipeline_id", "status", "created_at"))


@query(
    f"WITH {JOBS_SQL}, pl AS (SELECT 'p' || k AS pipeline_id, CASE WHEN k % 2 = 0 THEN 'Pipeline ' || k END AS name FROM range(15) t(k)), st AS (SELECT pipeline_id, {_COUNTS}, max(completed_at) AS last_run FROM jobs GROUP BY pipeline_id), "
    "wk AS (SELECT 'p' || (c_custkey % 7) AS pipeline_id, count(*) AS active FROM customer WHERE c_acctbal < 0 GROUP BY 1) SELECT pipeline_id, coalesce(name, pipeline_id) AS name, coalesce(total, 0) AS total, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, coalesce(running, 0) AS running, coalesce(queued, 0) AS queued, "
    "coalesce(active, 0) AS active, last_run, CASE WHEN coalesce(active, 0) > 0 THEN 'running' ELSE 'idle' END AS state FROM pl LEFT JOIN st USING (pipeline_id) LEFT JOIN wk USING (pipeline_id)"
)
def status_board(spark, sf_dir):
    k = F.col("id").cast("string")
    names = spark.range(15).select(F.concat(F.lit("p"), k).alias("pipeline_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("Pipeline "), k)).alias("name"))
    workers = table(spark, sf_dir, "customer").filter("c_acctbal < 0").groupBy(F.concat(F.lit("p"), (F.col("c_custkey") % 7).cast("string")).alias("pipeline_id")).agg(F.count("*").alias("active"))
    return jobs.status_board(names, jobs.pipeline_stats(event_jobs(spark, sf_dir)), workers)


_LAST = "SELECT * FROM (SELECT id, pipeline_id, status, created_at, completed_at FROM jobs WHERE status = '{0}' ORDER BY completed_at DESC NULLS LAST, created_at DESC, id LIMIT 10)"


@query(f"WITH {JOBS_SQL}, merged AS ({_LAST.format('completed')} UNION ALL {_LAST.format('failed')}) SELECT id, pipeline_id, status, coalesce(completed_at, created_at) AS happened_at FROM merged ORDER BY happened_at DESC, id LIMIT 20")
def recent_activity_merge(spark, sf_dir):
    return jobs.recent(event_jobs(spark, sf_dir))


_IMPORT_SQL = (
    "rows AS (SELECT event_id AS ord, CASE WHEN event_id % 17 = 0 THEN 'bad id ' || event_id WHEN event_id % 5 = 0 THEN 'r' || (event_id // 10) ELSE 'r' || event_id END AS id, CASE WHEN event_id % 13 = 0 THEN 'unknown' ELSE 'queued' END AS status, CASE WHEN event_id % 11 = 0 THEN '{broken' ELSE props END AS data FROM events), "
    "known AS (SELECT DISTINCT 'r' || (event_id * 3) AS id FROM events)"
)


@query(
    f"WITH {_IMPORT_SQL}, marked AS (SELECT *, CASE WHEN NOT regexp_matches(id, '^[a-zA-Z0-9_-]{{1,100}}$') THEN 'invalid id' WHEN status = 'unknown' THEN 'invalid status' WHEN data IS NOT NULL AND NOT json_valid(data) THEN 'invalid json: data' END AS reason FROM rows), "
    "firsts AS (SELECT id, min(ord) AS f FROM marked WHERE reason IS NULL GROUP BY id) SELECT m.ord, m.id, m.reason, CASE WHEN m.reason IS NOT NULL THEN 'error' WHEN k.id IS NOT NULL OR m.ord <> f.f THEN 'skipped' ELSE 'imported' END AS outcome FROM marked m LEFT JOIN firsts f USING (id) LEFT JOIN known k USING (id)"
)
def bulk_import_classify(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    key = F.when(n % 17 == 0, F.concat(F.lit("bad id "), n.cast("string"))).when(n % 5 == 0, F.concat(F.lit("r"), F.floor(n / 10).cast("string"))).otherwise(F.concat(F.lit("r"), n.cast("string")))
    rows = e.select(n.alias("ord"), key.alias("id"), F.when(n % 13 == 0, "unknown").otherwise("queued").alias("status"), F.when(n % 11 == 0, "{broken").otherwise(F.col("props")).alias("data"))
    known = e.select(F.concat(F.lit("r"), (n * 3).cast("string")).alias("id"))
    return jobs.classify_import(rows, known).select("ord", "id", "reason", "outcome")


@query(
    f"WITH {JOBS_SQL}, fresh AS (SELECT CAST(event_id // 2 AS VARCHAR) AS id, 'up' || (event_id % 3) AS status, event_id AS ord FROM events WHERE event_type = 'click') SELECT id, status FROM (SELECT id, status, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS r FROM (SELECT id, status, -1 AS ord FROM jobs UNION ALL SELECT * FROM fresh)) WHERE r = 1"
)
def upsert_latest(spark, sf_dir):
    store = event_jobs(spark, sf_dir).select("id", "status")
    n = F.col("event_id")
    fresh = table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.floor(n / 2).cast("string").alias("id"), F.concat(F.lit("up"), (n % 3).cast("string")).alias("status"), n.alias("ord"))
    return jobs.upsert(store, fresh)


@query(f"WITH {JOBS_SQL} SELECT CASE WHEN status IN ('queued', 'running') THEN 'cancelled' ELSE status END AS status, status IN ('queued', 'running') AS changed, count(*) AS n FROM jobs GROUP BY ALL")
def bulk_cancel(spark, sf_dir):
    done = jobs.bulk_cancel(event_jobs(spark, sf_dir), ["queued", "running"], "2025-01-01T00:00:00.000Z")
    return done.groupBy("status", "changed").agg(F.count("*").alias("n"))


@query(f"WITH {JOBS_SQL} SELECT id, status, completed_at FROM jobs WHERE status IN ('completed', 'failed', 'cancelled') AND completed_at <= '2024-01-20T00:00:00.000Z'")
def expired_jobs(spark, sf_dir):
    return jobs.expired(event_jobs(spark, sf_dir), "2024-01-27 00:00:00", 7).select("id", "status", "completed_at")


@query("WITH r AS (SELECT user_id, count(*) AS retries FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT CAST(sum(retries) AS BIGINT) AS total_attempts, count(*) FILTER (retries = 1) AS attempt_1, count(*) FILTER (retries = 2) AS attempt_2, count(*) FILTER (retries >= 3) AS attempt_3_plus, count(*) FILTER (retries >= 10) AS near_limit, count(*) AS retrying FROM r")
def retry_metrics(spark, sf_dir):
    r = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("retries"))
    return jobs.retry_metrics(r, near=10)


_HASH_SQL = "substr(sha256(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')), 1, 16)"
_ASCII = r"[\t\n\x0B\f\r ]"


@query(f"SELECT doc_id, {_HASH_SQL} AS content_hash, 'cb_' || substr(sha256(source || ':' || doc_id), 1, 12) AS block_id FROM documents")
def content_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.content_hash(F.col("text"), _ASCII).alias("content_hash"), text.block_id(F.col("source"), F.col("doc_id")).alias("block_id"))


@query(f"WITH b AS (SELECT doc_id, lang, source, {_HASH_SQL} AS h, len(string_split(text, chr(10))) AS line_count FROM documents) SELECT h AS content_hash, count(*) AS occurrences, CAST(sum(line_count) AS BIGINT) AS total_lines, count(DISTINCT source) AS repositories, arg_min(lang, doc_id) AS language, min(doc_id) AS first FROM b GROUP BY h HAVING count(*) >= 2")
def exact_dup_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("h", text.content_hash(F.col("text"), _ASCII)).withColumn("n", F.size(F.split("text", "\n")))
    made = d.groupBy(F.col("h").alias("content_hash")).agg(F.count("*").alias("occurrences"), F.sum("n").alias("total_lines"), F.countDistinct("source").alias("repositories"), F.min_by("lang", "doc_id").alias("language"), F.min("doc_id").alias("first"))
    return made.filter("occurrences >= 2")


def document_blocks(spark, sf_dir) -> DataFrame:
    """Documents as blocks: pattern by language, repository by source."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("block_id"),
        F.col("lang").alias("pattern_id"),
        F.when(F.col("lang") == "en", "api_handler").otherwise("logger").alias("category"),
        F.col("lang").alias("language"),
        F.concat(F.col("source"), F.lit("/f"), (F.col("doc_id") % 50).cast("string")).alias("file_path"),
        F.col("source").alias("repository"),
        (F.col("doc_id") % 100).cast("int").alias("line_start"),
        F.size(F.split("text", "\n")).alias("line_count"),
        F.col("text").alias("source_code"),
        F.array(F.concat(F.lit("function:f"), (F.col("doc_id") % 7).cast("string"))).alias("tags"),
    )


_BLOCKS_SQL = f"b AS (SELECT doc_id AS ord, lang AS pattern_id, CASE WHEN lang = 'en' THEN 'api_handler' ELSE 'logger' END AS category, source AS repository, source || '/f' || (doc_id % 50) AS file_path, {_HASH_SQL} AS h, len(string_split(text, chr(10))) AS line_count FROM documents)"
_CROSS_SQL = f"{_BLOCKS_SQL}, g AS (SELECT h AS content_hash, count(*) AS occurrences, count(DISTINCT repository) AS repositories, CAST(sum(line_count) AS BIGINT) AS total_lines, arg_min(category, ord) AS category FROM b GROUP BY h HAVING count(*) >= 2 AND count(DISTINCT repository) >= 2), s AS (SELECT *, least(CAST(least(occurrences * 5, 40) + repositories * 15 + least(total_lines / 2.0, 20.0) + CASE category WHEN 'api_handler' THEN 10 ELSE 0 END AS DOUBLE), 100.0) AS impact, CASE WHEN repositories <= 3 AND occurrences <= 10 THEN 'shared_package' WHEN repositories >= 4 OR category IN ('api_handler', 'database_operation') THEN 'mcp_server' WHEN occurrences >= 20 THEN 'autonomous_agent' ELSE 'shared_package' END AS strategy, CASE repositories WHEN 2 THEN 'simple' WHEN 3 THEN 'moderate' ELSE 'complex' END AS complexity FROM g)"


@query(
    f"WITH {_CROSS_SQL} SELECT 'cross_' || substr(content_hash, 1, 12) AS group_id, occurrences, repositories, total_lines, impact, strategy, complexity, CASE strategy WHEN 'shared_package' THEN 'medium' ELSE 'high' END AS risk, least(impact * CAST(1.2 AS DOUBLE) * CAST(CASE complexity WHEN 'simple' THEN 1.1 WHEN 'moderate' THEN 1.0 ELSE 0.8 END AS DOUBLE) * CAST(CASE strategy WHEN 'shared_package' THEN 1.0 ELSE 0.8 END AS DOUBLE), 100.0) AS roi FROM s"
)
def cross_source_groups(spark, sf_dir):
    blocks = document_blocks(spark, sf_dir).withColumn("content_hash", text.content_hash(F.col("source_code"), _ASCII))
    return duplicates.cross_groups(blocks).select("group_id", "occurrences", "repositories", "total_lines", "impact", "strategy", "complexity", "risk", "roi")


@query(f"WITH {_CROSS_SQL}, n AS (SELECT count(DISTINCT repository) AS repositories_scanned, count(*) AS total_blocks FROM b) SELECT n.*, count(*) AS cross_groups, CAST(coalesce(sum(occurrences), 0) AS BIGINT) AS occurrences, CAST(coalesce(sum(total_lines), 0) AS BIGINT) AS lines, count(*) FILTER (strategy = 'shared_package') AS shared_package, count(*) FILTER (strategy = 'mcp_server') AS mcp_server, coalesce(printf('%.1f', avg(repositories)), '0') AS avg_repositories FROM s, n GROUP BY ALL")
def cross_source_metrics(spark, sf_dir):
    blocks = document_blocks(spark, sf_dir).withColumn("content_hash", text.content_hash(F.col("source_code"), _ASCII))
    return metrics.cross_metrics(duplicates.cross_groups(blocks), blocks)


@query("SELECT doc_id AS ord, source || '/f' || (doc_id % 50) AS file_path, CAST(doc_id % 100 AS INTEGER) AS line_start FROM (SELECT *, row_number() OVER (PARTITION BY source, doc_id % 50, doc_id % 7 ORDER BY doc_id % 100, doc_id) AS r FROM documents) WHERE r = 1")
def dedup_blocks(spark, sf_dir):
    return duplicates.dedup_blocks(document_blocks(spark, sf_dir)).select("ord", "file_path", "line_start")


_CONTROL_SQL = " OR ".join(f"contains(text, '{w}')" for w in text.CONTROL)


@query(f"WITH c AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(regexp_replace(x, '\\s+', ' ', 'g'))) > 0)) AS n_lines, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS n_tokens, ({_CONTROL_SQL}) AS has_control FROM documents) SELECT doc_id, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_tokens AS INTEGER) AS n_tokens, has_control FROM c WHERE n_lines >= 1 AND (n_tokens >= 5 OR has_control)")
def complexity_filter(spark, sf_dir):
    c = text.complexity(F.col("text"))
    rows = table(spark, sf_dir, "documents").filter(text.complex_enough(F.col("text")))
    return rows.select("doc_id", c["n_lines"].alias("n_lines"), c["n_tokens"].alias("n_tokens"), c["has_control"].alias("has_control"))


_GROUPS_SQL = f"{_BLOCKS_SQL}, g AS (SELECT h, count(*) AS occurrences, CAST(sum(line_count) AS BIGINT) AS total_lines, count(DISTINCT file_path) AS files, count(DISTINCT repository) AS repositories, count(DISTINCT category) AS cats, count(DISTINCT pattern_id) AS pats, arg_min(category, ord) AS category, min(ord) AS ord FROM b GROUP BY h HAVING count(*) >= 2), q AS (SELECT *, CAST(1.0 AS DOUBLE) * CAST(0.4 AS DOUBLE) + least(occurrences / CAST(4.0 AS DOUBLE), 1.0) * CAST(0.2 AS DOUBLE) + least((total_lines / occurrences) / CAST(10.0 AS DOUBLE), 1.0) * CAST(0.2 AS DOUBLE) + CAST(CASE WHEN cats = 1 AND pats = 1 THEN 1.0 WHEN cats = 1 THEN 0.7 WHEN pats = 1 THEN 0.5 ELSE 0.3 END AS DOUBLE) * CAST(0.2 AS DOUBLE) AS quality FROM g), r AS (SELECT *, floor((least(occurrences / CAST(20.0 AS DOUBLE), 1.0) * 40 + CAST(1.0 AS DOUBLE) * 35 + least(total_lines / CAST(100.0 AS DOUBLE), 1.0) * 25) * 100 + 0.5) / 100 AS impact FROM q WHERE quality >= CAST(0.7 AS DOUBLE))"


def _exact(spark, sf_dir):
    return duplicates.exact_groups(document_blocks(spark, sf_dir), check=False)[0]


@query(f"WITH {_GROUPS_SQL} SELECT ord, 'dg_' || substr(h, 1, 12) AS group_id, occurrences, total_lines, files, repositories, impact, CASE WHEN impact >= 75 THEN 'critical' WHEN impact >= 50 THEN 'high' WHEN impact >= 25 THEN 'medium' ELSE 'low' END AS priority, CAST(floor((occurrences - 1) * (total_lines / occurrences)) AS BIGINT) AS dedup_potential FROM r")
def group_scores(spark, sf_dir):
    return _exact(spark, sf_dir).select("ord", "group_id", "occurrences", "total_lines", "files", "repositories", "impact", scoring.priority(F.col("impact")).alias("priority"), "dedup_potential")


def _strategy_sql(i: int) -> str:
    """Column i of (strategy, complexity, risk) as a CASE over the rule tables."""
    out = f"CASE WHEN files = 1 THEN '{('local_util', 'trivial', 'minimal')[i]}' "
    for family, rows in scoring.STRATEGIES.items():
        where = f"category IN ({', '.join(repr(f) for f in family)})" if family else "TRUE"
        for row in rows:
            more = "" if row[0] is None else f" AND occurrences <= {row[0]}"
            out += f"WHEN {where}{more} THEN '{row[1 + i]}' "
    return out + "END"


def _case_sql(column: str, values: dict) -> str:
    return f"CAST(CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END AS DOUBLE)"


_SUGGEST_SQL = f"{_GROUPS_SQL}, t AS (SELECT *, {_strategy_sql(0)} AS strategy, {_strategy_sql(1)} AS complexity, {_strategy_sql(2)} AS risk FROM r), u AS (SELECT *, least(impact * {_case_sql('complexity', scoring.COMPLEXITY_FACTORS)} * {_case_sql('risk', scoring.RISK_FACTORS)}, 100.0) AS roi FROM t)"


@query(f"WITH {_SUGGEST_SQL} SELECT 'cs_dg_' || substr(h, 1, 12) AS suggestion_id, strategy, complexity, risk, least(impact, 100.0) AS impact, floor(({_case_sql('complexity', scoring.EFFORT_HOURS)} + files * CAST(0.25 AS DOUBLE) + CAST(0.5 AS DOUBLE)) * 10 + 0.5) / 10 AS effort_hours, CASE strategy WHEN 'local_util' THEN false WHEN 'shared_package' THEN category IN ('api_handler', 'auth_check') ELSE true END AS breaking, CAST(0.9 AS DOUBLE) AS confidence, roi FROM u")
def suggestions(spark, sf_dir):
    return duplicates.suggestions(_exact(spark, sf_dir)).select("suggestion_id", "strategy", "complexity", "risk", "impact", "effort_hours", "breaking", "confidence", "roi")


@query(f"WITH {_SUGGEST_SQL} SELECT 'cs_dg_' || substr(h, 1, 12) AS suggestion_id, roi FROM u ORDER BY roi DESC, suggestion_id LIMIT 10")
def roi_ranked(spark, sf_dir):
    return metrics.top(duplicates.suggestions(_exact(spark, sf_dir)), "roi", 10, "suggestion_id").select("suggestion_id", "roi")


@query(
    f"WITH {_SUGGEST_SQL}, bb AS (SELECT count(*) AS n, sum(line_count) AS lines FROM b) SELECT any_value(n) AS total_code_blocks, count(*) AS total_duplicate_groups, count(*) AS exact_duplicates, CAST(sum(total_lines) AS BIGINT) AS total_duplicated_lines, CAST(sum(total_lines - floor(total_lines / occurrences)) AS BIGINT) AS potential_loc_reduction, count(*) FILTER (occurrences <= 3 AND files = 1) AS quick_wins, count(*) FILTER (total_lines >= 20 OR occurrences >= 5) AS high_impact, "
    "count(*) FILTER (complexity = 'trivial') AS trivial_suggestions, count(*) FILTER (impact >= 75) AS high_priority, floor(sum(total_lines) / any_value(lines) * 100 * 100 + 0.5) / 100 AS duplication_percentage, CAST(1.0 AS DOUBLE) AS avg_tags_per_block FROM u, bb"
)
def scan_metrics(spark, sf_dir):
    groups = graph.Rounds(spark).put(_exact(spark, sf_dir))  # several aggregates read them
    found = metrics.scan_metrics(document_blocks(spark, sf_dir), groups, duplicates.suggestions(groups))
    return found.select("total_code_blocks", "total_duplicate_groups", "exact_duplicates", "total_duplicated_lines", "potential_loc_reduction", "quick_wins", "high_impact", "trivial_suggestions", "high_priority", "duplication_percentage", "avg_tags_per_block")


@query(f"WITH {_SUGGEST_SQL} SELECT count(*) FILTER (strategy = 'local_util') AS local_util, count(*) FILTER (strategy = 'shared_package') AS shared_package, count(*) FILTER (strategy = 'mcp_server') AS mcp_server, count(*) FILTER (strategy = 'autonomous_agent') AS autonomous_agent FROM u")
def strategy_distribution(spark, sf_dir):
    return metrics.distribution(duplicates.suggestions(_exact(spark, sf_dir)), "strategy", ["local_util", "shared_package", "mcp_server", "autonomous_agent"])


@query("SELECT event_type, count(*) AS n, floor(count(*) * CAST(1.0 AS DOUBLE) / (SELECT count(*) FROM events) * 100 * 10 + 0.5) / 10 AS percent FROM events GROUP BY event_type")
def event_shares(spark, sf_dir):
    return metrics.shares(table(spark, sf_dir, "events").select("event_type"), "event_type")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(*) AS commits FROM orders GROUP BY 1, 2")
def monthly_activity(spark, sf_dir):
    return activity.monthly(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderpriority")


_REPOS_SQL = "repos AS (SELECT n_name AS name, count(o_orderkey) AS commits FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name)"


def _repositories(spark, sf_dir):
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    by = o.groupBy("o_custkey").agg(F.count("*").alias("k"))  # before the join, so orders are shuffled as counts
    per = c.join(by, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.sum("k").alias("k"))
    return n.join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("name"), F.coalesce("k", F.lit(0)).alias("commits"))


@query(f"WITH {_REPOS_SQL} SELECT CASE WHEN contains(lower(name), 'scraper') OR contains(lower(name), 'analytics') OR contains(lower(name), 'bot') THEN 'Data & Analytics' WHEN contains(lower(name), 'mcp') OR contains(lower(name), 'server') THEN 'MCP Servers' WHEN commits < 400 THEN 'Legacy' ELSE 'Client Work' END AS category, count(*) AS repositories, CAST(sum(commits) AS BIGINT) AS commits FROM repos GROUP BY 1")
def category_buckets(spark, sf_dir):
    r = _repositories(spark, sf_dir)
    by = r.groupBy(activity.repository_category(F.col("name"), F.col("commits"), 400).alias("category"))
    return by.agg(F.count("*").alias("repositories"), F.sum("commits").cast("long").alias("commits"))


@query(f"WITH {_REPOS_SQL} SELECT * FROM repos WHERE commits > 0 ORDER BY commits DESC, name LIMIT 10")
def most_active(spark, sf_dir):
    return activity.most_active(_repositories(spark, sf_dir))


@query("SELECT CASE WHEN regexp_matches(url, '\\.html([?#]|$)') THEN 'HTML' ELSE 'Other' END AS language, count(*) AS files FROM pages WHERE regexp_matches(split_part(split_part(regexp_replace(url, '^[a-z]+://[^/]*', ''), '?', 1), '#', 1), '\\.[^./]*$') GROUP BY 1")
def language_histogram(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    return activity.language_histogram(table(spark, sf_dir, "pages").select(path.alias("path")))


@query("WITH m AS (SELECT max(ts) AS now FROM events) SELECT count(*) FILTER (epoch_ms(now) - epoch_ms(ts) <= 3600000) AS last_hour, count(*) FILTER (epoch_ms(now) - epoch_ms(ts) <= 86400000) AS last_day, count(*) AS total, min(ts) AS oldest, max(ts) AS newest FROM events, m")
def activity_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    return activity.feed_stats(e, "ts", "event_type", now).drop("by_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def newest_per_user(spark, sf_dir):
    return activity.newest_per_key(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3).select("user_id", "event_id", "event_type")


def _error_sql(i: int) -> str:
    """Category, reason or delay of an error with HTTP status ``s`` and message ``m``."""
    rows = [("s = 429", "retryable", "'HTTP 429 indicates rate limit'", errors.RATE_DELAY), ("s BETWEEN 400 AND 499", "non_retryable", "'HTTP ' || s || ' indicates client error'", 0), ("s BETWEEN 500 AND 599", "retryable", "'HTTP ' || s || ' indicates server error'", errors.SERVER_DELAY)]
    rows += [(f"contains(lower(m), '{p}')", "non_retryable", f"'Error message contains ''{p}'''", 0) for p in errors.PERMANENT_MESSAGES]
    rows += [(f"contains(lower(m), '{p}')", "retryable", f"'Error message contains ''{p}'''", d) for p, d in errors.RETRYABLE_MESSAGES.items()]
    last = ("'non_retryable'", "'Unknown error type - treating as non-retryable for safety'", "0")[i]
    return "CASE " + " ".join(f"WHEN {w} THEN " + (f"'{c}'", r, str(d))[i] for w, c, r, d in rows) + f" ELSE {last} END"


_MESSAGES = ("Rate limit hit", "request timeout", "Permission denied here", "all well", "parse error at 3", "please try again")
_M_SQL = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MESSAGES)) + " END"


@query(f"WITH e AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 400 + CAST(floor(value) AS INTEGER) END AS s, {_M_SQL} AS m FROM events WHERE event_type = 'error') SELECT event_id, {_error_sql(0)} AS category, {_error_sql(1)} AS reason, CAST({_error_sql(2)} AS BIGINT) AS delay FROM e")
def error_classify(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    message = F.get(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("event_id") % 6).cast("int"))
    status = F.when(F.col("user_id") % 3 == 0, 400 + F.floor("value").cast("int"))
    return e.select("event_id", errors.classify(F.lit(None).cast("string"), status, message).alias("c")).select("event_id", "c.category", "c.reason", "c.delay")


@query("WITH w AS (SELECT conv_id, turn, role, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS a FROM conversations) SELECT conv_id, turn FROM w WHERE role = 'user' AND a = 0")
def lookahead_findings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    answered = scanners.ahead("conv_id", "turn", F.col("role") == "assistant", 2)
    return c.withColumn("answered", answered).filter((F.col("role") == "user") & ~F.col("answered")).select("conv_id", "turn")


_FIND_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents), f AS (SELECT doc_id, line_no, CASE WHEN contains(line, '!!') THEN 'high' WHEN contains(line, '|') THEN 'medium' WHEN contains(line, 'rights') THEN 'low' END AS severity, CASE WHEN length(line) > 80 THEN 'long' ELSE 'short' END AS category FROM l)"


def _findings(spark, sf_dir):
    rows = scanners.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    line = F.col("line")
    severity = F.when(line.contains("!!"), "high").when(line.contains("|"), "medium").when(line.contains("rights"), "low")
    return rows.select("doc_id", "line_no", severity.alias("severity"), F.when(F.length(line) > 80, "long").otherwise("short").alias("category")).filter("severity IS NOT NULL")


@query(f"WITH {_FIND_SQL} SELECT severity, category, count(*) AS findings, count(DISTINCT doc_id) AS files FROM f WHERE severity IS NOT NULL GROUP BY ALL")
def severity_breakdown(spark, sf_dir):
    return scanners.breakdown(_findings(spark, sf_dir), "doc_id")


@query(f"WITH {_FIND_SQL} SELECT severity, doc_id, CAST(line_no AS INTEGER) AS line_no FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY doc_id, line_no, category) AS r FROM f WHERE severity IS NOT NULL) WHERE r <= 10")
def findings_top_per_severity(spark, sf_dir):
    return scanners.top_per_severity(_findings(spark, sf_dir), "doc_id").select("severity", "doc_id", "line_no")


@query("SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), chr(10)) AS context FROM conversations")
def line_context(spark, sf_dir):
    return scanners.context(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role").select("conv_id", "turn", "context")


_OCC_SQL = "o AS (SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS literal, CAST(p_size AS DOUBLE) AS value, list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' '), lambda x: length(x) >= 2)) AS raw FROM part), oc AS (SELECT id, literal, value, list_distinct(regexp_extract_all(array_to_string(raw, ' '), '[a-z0-9]+')) AS toks FROM o), ot AS (SELECT id, literal, value, list_filter(toks, lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$') AND NOT list_contains(" + str(list(text.STOPWORDS)) + ", x)) AS tokens FROM oc)"


def _occurrences(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("literal"), F.col("p_size").cast("double").alias("value"), F.array_distinct(text.identifier_tokens(F.lower(words))).alias("tokens"))


@query(f"WITH {_OCC_SQL}, f AS (SELECT literal, token, count(*) AS freq FROM (SELECT literal, unnest(tokens) AS token FROM ot) GROUP BY ALL) SELECT literal, token, freq, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY literal ORDER BY freq DESC, token) AS r FROM f) WHERE r <= 30")
def token_top30(spark, sf_dir):
    return constants.top_tokens(_occurrences(spark, sf_dir))


@query(
    f"WITH {_OCC_SQL}, lit AS (SELECT literal, any_value(value) AS v, list(DISTINCT token) AS ts FROM (SELECT literal, value, unnest(tokens) AS token FROM ot) GROUP BY literal), k AS (SELECT n_name AS name, CAST(n_nationkey AS DOUBLE) AS w, [lower(n_name), 'economy', 'ring'] AS ts FROM nation), "
    "p AS (SELECT literal, name, abs(v - w) < 1e-9 AS value_match, len(list_intersect(lit.ts, k.ts)) / (len(lit.ts) + len(k.ts) - len(list_intersect(lit.ts, k.ts))) AS score FROM lit, k) SELECT literal, name, value_match, score FROM (SELECT *, row_number() OVER (PARTITION BY literal ORDER BY value_match DESC, score DESC, name) AS r FROM p WHERE value_match OR score >= 0.02) WHERE r <= 5"
)
def literal_constants_match(spark, sf_dir):
    occ = _occurrences(spark, sf_dir)
    literals = occ.select("literal", "value", F.explode("tokens").alias("t")).groupBy("literal", "value").agg(F.collect_set("t").alias("tokens"))
    known = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("value"), F.array(F.lower("n_name"), F.lit("economy"), F.lit("ring")).alias("tokens"))
    return constants.match_constants(literals, known, least=0.02).select("literal", "name", "value_match", "score")


@query()
def peer_clusters(spark, sf_dir):
    occ = _occurrences(spark, sf_dir)
    found = graph.components(occ.select("id"), constants.peer_pairs(occ, 0.5))
    return found.groupBy("cluster").agg(F.count("*").alias("size"))


_EXP_SQL = f"x AS (SELECT source AS group_id, CAST(d.doc_id AS VARCHAR) AS member FROM documents d JOIN labels l USING (doc_id) WHERE quality = 0), {_BLOCKS_SQL}, dd AS (SELECT 'g' || (ord % 25) AS group_id, CAST(ord AS VARCHAR) AS member FROM b WHERE line_count <= 3), n AS (SELECT group_id, count(*) AS n FROM x GROUP BY 1), m AS (SELECT group_id, count(*) AS m FROM dd GROUP BY 1), p AS (SELECT x.group_id AS e, dd.group_id AS d, count(*) AS k FROM x JOIN dd USING (member) GROUP BY 1, 2), q AS (SELECT e, d FROM p JOIN n ON n.group_id = e JOIN m ON m.group_id = d WHERE k / greatest(n, m) >= 0.1), neg AS (SELECT CAST(doc_id AS VARCHAR) AS member FROM labels WHERE toxic = 1), cc AS (SELECT (SELECT count(*) FROM q) AS tp, (SELECT count(*) FROM m WHERE group_id NOT IN (SELECT d FROM q)) + (SELECT count(*) FROM neg WHERE member IN (SELECT member FROM dd)) AS fp, (SELECT count(*) FROM n WHERE group_id NOT IN (SELECT e FROM q)) AS fn, (SELECT count(*) FROM neg WHERE member NOT IN (SELECT member FROM dd)) AS tn), s AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / (fp + tn) END AS fpr FROM cc)"


@query(f"WITH {_EXP_SQL} SELECT tp, fp, fn, tn, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * (precision * recall) / (precision + recall) END AS f1, fpr FROM s")
def accuracy_eval(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    expected = d.select("doc_id", "source").join(labels.filter("quality = 0"), "doc_id").select(F.col("source").alias("group_id"), F.col("doc_id").cast("string").alias("member"))
    found = document_blocks(spark, sf_dir).filter("line_count <= 3").select(F.concat(F.lit("g"), (F.col("ord") % 25).cast("string")).alias("group_id"), F.col("block_id").alias("member"))
    negatives = labels.filter("toxic = 1").select(F.col("doc_id").cast("string").alias("member"))
    return accuracy.metrics(accuracy.compare(expected, found, negatives, 0.1)).drop("grade")


_COUNT_PATTERNS = {"bars": r"\|", "shouts": "!!", "numbers": "[0-9]+"}


@query("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS INTEGER) AS {n}" for n, p in _COUNT_PATTERNS.items()) + " FROM documents")
def test_pattern_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scanners.pattern_counts(d, "text", _COUNT_PATTERNS).drop("text")


@query("WITH h AS (SELECT DISTINCT split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages), p AS (SELECT DISTINCT split_part(host, '.', 1) AS prefix, host FROM h) SELECT prefix, count(*) AS n FROM p GROUP BY prefix HAVING count(*) > 1")
def plugin_prefix_dups(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("name"))
    return scanners.prefix_duplicates(hosts, "name", "[.]")


@query("WITH l AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 100) SELECT count(*) AS entries, count(*) FILTER (value > 60) AS slow, count(*) FILTER (event_type = 'error') AS failures, max(CASE WHEN value > 60 THEN CAST(floor(value) AS BIGINT) END) AS slowest_ms FROM l")
def perf_tail(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("["), F.col("event_type"), F.lit("] "), F.when(F.col("value") > 60, "SLOW ").otherwise(""), F.floor("value").cast("string"), F.lit("ms"), F.when(F.col("event_type") == "error", " failed").otherwise(""))
    return scanners.log_tail(e.select("event_id", line.alias("line")), "event_id", "line", 100)


def _annotation_sql(table_: dict, flags: str = "(?i)") -> str:
    parts = [f"CASE WHEN regexp_matches(html, {_quoted(flags + '|'.join(f'(?:{p})' for p in ps))}) THEN '{n}' END" for n, ps in table_.items()]
    return f"array_to_string(list_sort(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)), '+')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"SELECT page_id, {_annotation_sql({n: (chr(92) + 'b(?:' + w + ')' + chr(92) + 'b',) for n, w in annotations.DOMAINS.items()})} AS domains, {_annotation_sql(annotations.DATA_TYPES, '')} AS data_types FROM pages")
def semantic_annotations(spark, sf_dir):
    # Patterns take long on few bytes: all tasks get pages, however few parts the file has.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = table(spark, sf_dir, "pages").select("page_id", "html").repartition(n, "page_id")
    made = annotations.annotate(F.col("html"))
    return p.select("page_id", F.array_join(made["domains"], "+").alias("domains"), F.array_join(made["data_types"], "+").alias("data_types"))


@query()
def normalize_code(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    norm = text.normal_form(F.col("html"))
    return p.select("page_id", F.length(norm).alias("n"), F.sha2(norm, 256).alias("ast_hash"))


def part_blocks(spark, sf_dir) -> DataFrame:
    """Parts as short blocks of code: one call a part."""
    p = table(spark, sf_dir, "part")
    code = F.concat(F.lit("const "), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(" = load("), F.col("p_size").cast("string"), F.lit(").filter(x => x.ok).map("), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(");\nif ("), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" !== null) { save("), F.lower("p_type"), F.lit("); }"))
    return p.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("block_id"), F.col("p_brand").alias("pattern_id"), F.col("p_type").alias("category"), F.lit("javascript").alias("language"), F.concat(F.col("p_brand"), F.lit("/"), (F.col("p_partkey") % 40).cast("string")).alias("file_path"), F.col("p_brand").alias("repository"), (F.col("p_partkey") % 90).cast("int").alias("line_start"), F.lit(2).alias("line_count"), code.alias("source_code"), F.array().cast("array<string>").alias("tags"))


@query()
def structural_groups(spark, sf_dir):
    return duplicates.structural_groups(part_blocks(spark, sf_dir))[0].select("group_id", "pattern_id", "category", "occurrences", "similarity", "impact", "ord")


@query()
def semantic_groups(spark, sf_dir):
    return duplicates.semantic_groups(part_blocks(spark, sf_dir))[0].select("group_id", "category", "occurrences", "similarity", "impact", "ord")


@query()
def layered_groups(spark, sf_dir):
    return duplicates.detect(part_blocks(spark, sf_dir))[0].groupBy("method").agg(F.count("*").alias("groups"), F.sum("occurrences").alias("blocks"))


def lifecycle_events(df: DataFrame) -> DataFrame:
    status = scoring.lookup(F.col("event_type"), STATUS, None)
    return df.select("event_id", F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), status.alias("event"), "value")


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has written once its input is read, as a table in the shared folder.

    Each batch overwrites a folder of its own, so a batch that runs again writes no row twice. In complete mode the
    last batch is the whole result, in update mode all batches are.
    """
    spark = stream.sparkSession
    root = f"{graph.shared_dir(spark)}/drained-{uuid.uuid4().hex}"
    last: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        last.append(number)

    writer = stream.writeStream.foreachBatch(put).outputMode(mode).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{root}/state").start().awaitTermination()
    schema = stream.schema if mode == "complete" else T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    if not last:  # no batch: the input is empty
        return spark.createDataFrame([], schema)
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{root}/out/batch={max(last)}")
    return spark.read.schema(schema).option("basePath", f"{root}/out").parquet(*[f"{root}/out/batch={n}" for n in sorted(set(last))])


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return lifecycle_events(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*"))


@query(f"SELECT {_CASE} AS event, count(*) AS n FROM events GROUP BY 1")
def stream_status_counts(spark, sf_dir):
    return drain(lifecycle.status_counts(_stream(spark, sf_dir)), "complete").select("event", "n")


@query("SELECT CAST(time_bucket(INTERVAL '15 minutes', ts) AS VARCHAR) AS start, user_id AS job_id, count(*) AS n FROM events GROUP BY ALL")
def stream_rate_windows(spark, sf_dir):
    found = drain(lifecycle.rate_windows(_stream(spark, sf_dir)), "complete")
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "job_id", "n")


@query()
def stream_job_states(spark, sf_dir):
    rows = drain(lifecycle.job_states(_stream(spark, sf_dir)), "update")
    return rows.groupBy("job_id").agg(F.max_by(F.struct("status", "retries", "rejected"), "batch").alias("s")).select("job_id", "s.*")


@query(f"SELECT job_id, event FROM (SELECT user_id AS job_id, {_CASE} AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_states(spark, sf_dir):
    return lifecycle.last_states(lifecycle_events(table(spark, sf_dir, "events"))).select("job_id", "event")


@query()
def circuit_breaker(spark, sf_dir):
    e = lifecycle_events(table(spark, sf_dir, "events")).filter(F.col("event").isin("completed", "failed"))
    states = lifecycle.breaker_states(e.withColumn("ok", F.col("event") == "completed"), 2, 86_400.0)
    return states.groupBy("state").agg(F.count("*").alias("n"), F.sum("failures").alias("failures"))
