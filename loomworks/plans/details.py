"""Queries of job details, workers, configuration, documents and errors, each beside its DuckDB SQL, values written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import annotations, errors, text
from ..operators import activity, constants, duplicates, extraction, graph, jobs, metrics, scanners, testsuite
from .catalog import _SUGGEST_SQL, _exact, query, table

_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"
_JOB = (
    "j AS (SELECT event_id AS id, 'p' || user_id % 12 AS pipeline_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, {at} AS created_at, "
    "CASE WHEN event_id % 3 <> 0 THEN {later5} END AS started_at, CASE WHEN event_type IN ('purchase', 'error') THEN {later90} END AS completed_at, event_id % 4 AS k, user_id FROM events)"
)
_JOB_SQL = _JOB.format(at=_ISO, later5=_ISO.replace("(ts,", "(ts + INTERVAL 5 SECOND,"), later90=_ISO.replace("(ts,", "(ts + INTERVAL 90 SECOND,"))


def _jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    iso = lambda s: F.date_format(F.col("ts").cast("timestamp") + F.expr(f"INTERVAL {s} SECONDS"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    k, n = F.col("event_id") % 4, F.col("user_id").cast("string")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("p"), (F.col("user_id") % 12).cast("string")).alias("pipeline_id"),
        kind.alias("status"),
        iso(0).alias("created_at"),
        F.when(F.col("event_id") % 3 != 0, iso(5)).alias("started_at"),
        F.when(kind != "running", iso(90)).alias("completed_at"),
        F.when(k != 0, F.concat(F.lit('{"repositoryPath": "/code/u'), n, F.lit('\\tx", "retryCount": '), k.cast("string"), F.lit("}"))).alias("data"),
        F.when(k == 1, F.concat(F.lit('{"duration_seconds": '), n, F.lit(', "summary": "", "filesProcessed": 0}'))).when(k == 2, F.concat(F.lit('{"summary": "'), F.repeat(n, 100), F.lit('", "filesProcessed": 7}'))).alias("result"),
        F.when(kind == "failed", F.concat(F.lit('{"message": "it failed\\nat '), n, F.lit('"}'))).alias("error"),
    )


@query(f"WITH {_JOB_SQL} SELECT id, pipeline_id, status, coalesce(started_at, created_at) AS start_time, completed_at AS end_time, CASE WHEN completed_at IS NOT NULL THEN CAST(CASE WHEN started_at IS NULL THEN 90000 ELSE 85000 END AS BIGINT) END AS duration_ms FROM j")
def job_detail(spark, sf_dir):
    return jobs.detail(_jobs(spark, sf_dir))


@query(
    f"WITH {_JOB_SQL}, l AS (SELECT id, unnest([['[' || created_at || '] Job created (pipeline: ' || pipeline_id || ')', '[' || started_at || '] Job started', "
    "CASE WHEN k > 0 THEN '[' || coalesce(started_at, created_at) || '] Repository: /code/u' || user_id || ' x' END, CASE WHEN k > 0 THEN '[' || coalesce(started_at, created_at) || '] Retry attempt: ' || k END, "
    "CASE WHEN k = 1 AND user_id <> 0 THEN '[' || coalesce(completed_at, started_at, created_at) || '] Duration: ' || user_id || 's' END, CASE WHEN k = 2 THEN '[' || coalesce(completed_at, started_at, created_at) || '] ' || left(repeat(CAST(user_id AS VARCHAR), 100), 200) END, "
    "CASE WHEN k = 2 THEN '[' || coalesce(completed_at, started_at, created_at) || '] Files processed: 7' END, CASE WHEN status = 'failed' THEN '[' || completed_at || '] ERROR: it failed at ' || user_id END, "
    "CASE WHEN status = 'completed' THEN '[' || completed_at || '] Job completed successfully' WHEN status = 'failed' THEN '[' || completed_at || '] Job failed' END]]) AS a FROM j), m AS (SELECT id, [x FOR x IN a IF x IS NOT NULL] AS a FROM l) "
    "SELECT id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS line_no, unnest(a) AS line FROM m"
)
def job_log_lines(spark, sf_dir):
    return jobs.log_lines(_jobs(spark, sf_dir))


_W_SQL = "w AS (SELECT 'p' || user_id % 12 AS p, count(*) AS total, count(*) FILTER (event_type = 'view') AS queued, count(*) FILTER (event_type = 'click') AS active, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1)"


@query(f"WITH {_W_SQL} SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(queued) AS BIGINT) AS queued, CAST(sum(active) AS BIGINT) AS active, CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(failed) AS BIGINT) AS failed, string_agg(p || ':' || total || '/' || active, ',' ORDER BY p) AS by_pipeline FROM w")
def worker_totals(spark, sf_dir):
    kind = lambda t: F.count_if(F.col("event_type") == t)
    by = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("p"), (F.col("user_id") % 12).cast("string")).alias("pipeline_id"))
    told = jobs.worker_totals(by.agg(F.count("*").alias("total"), kind("view").alias("queued"), kind("click").alias("active"), kind("purchase").alias("completed"), kind("error").alias("failed")))
    each = F.transform(F.map_entries("by_pipeline"), lambda x: F.concat_ws("", x["key"], F.lit(":"), x["value"]["total"].cast("string"), F.lit("/"), x["value"]["active"].cast("string")))
    return told.withColumn("by_pipeline", F.array_join(each, ","))


@query("SELECT CAST(sum(coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey END, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 7 END, 5)) AS BIGINT) AS capacity FROM supplier WHERE s_suppkey % 4 <> 1")
def total_capacity(spark, sf_dir):
    k = F.col("s_suppkey")
    return jobs.total_capacity(table(spark, sf_dir, "supplier").select(F.when(k % 4 == 1, True).when(k % 4 == 2, False).alias("disabled"), F.when(k % 3 == 0, F.col("s_nationkey")).alias("max_scans"), F.when(k % 5 != 0, (k % 7).cast("int")).alias("max_jobs")))


@query(f"WITH {_SUGGEST_SQL} SELECT round(avg(roi), 6) AS avg_roi, min(roi) AS min_roi, max(roi) AS max_roi, coalesce(max(impact), 0) AS top_impact FROM u")
def roi_summary(spark, sf_dir):
    groups = graph.Rounds(spark).put(_exact(spark, sf_dir))
    return metrics.roi_summary(duplicates.suggestions(groups), groups).withColumn("avg_roi", F.round("avg_roi", 6))


@query(f"WITH {_SUGGEST_SQL} SELECT 'dg_' || substr(h, 1, 12) AS group_id, impact FROM u ORDER BY impact DESC, group_id LIMIT 25")
def groups_by_impact(spark, sf_dir):
    return metrics.top(_exact(spark, sf_dir), "impact", 25, "group_id").select("group_id", "impact")


@query(
    "SELECT count(*) AS repositories, count(*) FILTER (c_custkey % 4 > 0) AS enabled_repositories, " + ", ".join(f"count(*) FILTER (c_custkey % 4 > 0 AND c_nationkey % 4 = {i}) AS {p}" for i, p in enumerate(("critical", "high", "medium", "low")))
    + ", " + ", ".join(f"count(*) FILTER (c_custkey % 4 > 0 AND c_mktsegment = '{m}') AS {f}" for m, f in (("AUTOMOBILE", "daily"), ("BUILDING", "weekly"), ("FURNITURE", "monthly"), ("MACHINERY", "on_demand")))
    + ", (SELECT count(*) FROM nation) AS groups, (SELECT count(*) FILTER (n_regionkey > 0) FROM nation) AS enabled_groups FROM customer"
)
def config_stats(spark, sf_dir):
    frequency = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "daily").when(F.col("c_mktsegment") == "BUILDING", "weekly").when(F.col("c_mktsegment") == "FURNITURE", "monthly").when(F.col("c_mktsegment") == "MACHINERY", "on-demand")
    repositories = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 4 > 0).alias("enabled"), F.element_at(F.array(*[F.lit(p) for p in ("critical", "high", "medium", "low")]), (F.col("c_nationkey") % 4 + 1).cast("int")).alias("priority"), frequency.alias("scanFrequency"))
    return metrics.config_stats(repositories, table(spark, sf_dir, "nation").select((F.col("n_regionkey") > 0).alias("enabled")))


@query(
    "WITH m AS (SELECT p_size % 20 AS cluster, p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS tokens FROM part WHERE p_partkey % 10 < p_size % 3 + 1), s AS (SELECT cluster, count(*) AS n FROM m GROUP BY 1), "
    "f AS (SELECT cluster, token, count(*) AS freq FROM (SELECT cluster, unnest(tokens) AS token FROM m) GROUP BY ALL), r AS (SELECT f.*, row_number() OVER (PARTITION BY f.cluster ORDER BY freq DESC, token) AS rank FROM f JOIN s USING (cluster) WHERE freq >= greatest(1, ceil(n * CAST(0.1 AS DOUBLE)))) SELECT cluster, token, freq, rank FROM r WHERE rank <= 10"
)
def shared_tokens(spark, sf_dir):
    """Tokens that a tenth of a cluster's members share."""
    members = table(spark, sf_dir, "part").filter("p_partkey % 10 < p_size % 3 + 1").select((F.col("p_size") % 20).alias("cluster"), F.array_distinct(F.split(F.lower("p_name"), " ")).alias("tokens"))
    return constants.shared_tokens(members, share=0.1)


@query("SELECT count(*) FILTER (event_type = 'purchase') AS enhanced, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type IN ('purchase', 'view', 'error')) AS total, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN printf('%.2f', CAST(100 AS DOUBLE) * count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type IN ('purchase', 'error'))) ELSE '0' END AS success_rate FROM events")
def enhancement_rate(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "enhanced").when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "error", "failed")
    return metrics.success_rate(table(spark, sf_dir, "events").select(kind.alias("status")))


_RHS = "CASE p_partkey % 5 WHEN 0 THEN '-' || p_size || '.5' WHEN 1 THEN 'BASE_' || p_size || ' * 60' WHEN 2 THEN p_size || '_000' WHEN 3 THEN 'f(' || p_size || ')' ELSE 'OTHER' || p_size END"


@query(f"WITH c AS (SELECT 'C' || p_partkey AS name, {_RHS} AS value FROM part WHERE p_partkey % 5 <> 3 AND p_partkey % 7 > 0) SELECT value, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM c GROUP BY value HAVING count(*) > 1 ORDER BY n DESC, value DESC LIMIT 20")
def repeated_constants(spark, sf_dir):
    line = F.concat(F.when(F.col("p_partkey") % 7 > 0, "export const C").otherwise("  export const C"), F.col("p_partkey").cast("string"), F.lit(" = "), F.expr(_RHS), F.lit(" ; "))
    return constants.repeated_values(table(spark, sf_dir, "part").select(line.alias("line"))).withColumn("names", F.array_join("names", ","))


_SNIPPETS = ("for (const x of rows) { if (x.ok) { out.push(x); } }", "for (const x of rows) { out.push(x); }", "rows.map(f)", "if (a) { out.push(b); }", "rows.filter(ok).map(f)", "const y = 1;")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'append,filter,iterate,map' WHEN 1 THEN 'append,iterate' WHEN 2 THEN 'map' WHEN 3 THEN 'append' WHEN 4 THEN 'filter,map' ELSE '' END AS operations FROM events")
def composite_operations(spark, sf_dir):
    """The operations of a loop that appends under a condition are also a filter and a map."""
    code = F.element_at(F.array(*[F.lit(x) for x in _SNIPPETS]), (F.col("event_id") % 6 + 1).cast("int"))
    named = table(spark, sf_dir, "events").select("event_id", code.alias("code"))
    return named.select("event_id", F.array_join(annotations.annotate(F.col("code"))["operations"], ",").alias("operations"))


_CODES = ("ETIMEDOUT", "ECONNRESET", "ENOENT", "EACCES", "ERR_HTTP_404", "ERR_HTTP_503", "EWHAT", "ENOTFOUND")


@query(
    "WITH e AS (SELECT event_id, event_id % 8 AS k FROM events) SELECT event_id, CASE WHEN k IN (0, 1, 5) THEN 'retryable' ELSE 'non_retryable' END AS category, CASE WHEN k IN (0, 5) THEN 10000 WHEN k = 1 THEN 5000 ELSE 0 END AS delay, "
    "CASE WHEN k IN (4, 5) THEN 'http' ELSE 'unknown' END AS family FROM e"
)
def error_codes(spark, sf_dir):
    """Errors by their code alone, and the family that the reason's words name."""
    code = F.element_at(F.array(*[F.lit(x) for x in _CODES]), (F.col("event_id") % 8 + 1).cast("int"))
    told = table(spark, sf_dir, "events").select("event_id", errors.classify(code, F.lit(None).cast("int"), F.lit(None).cast("string")).alias("c"))
    return told.select("event_id", "c.category", F.col("c.delay").cast("int").alias("delay"), errors.family(F.col("c.reason")).alias("family"))


_REASONS = ("Rate limit hit", "request timeout", "Permission denied here", "no such directory", "network down", "all well")


@query("SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'network' WHEN 2 THEN 'file_system' WHEN 3 THEN 'file_system' WHEN 4 THEN 'network' ELSE 'unknown' END AS family FROM events")
def error_families(spark, sf_dir):
    reason = F.element_at(F.array(*[F.lit(x) for x in _REASONS]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", errors.family(reason).alias("family"))


_DOC = "CASE doc_id % 4 WHEN 0 THEN 'intro before any title, long enough' || chr(10) || '# The title ' || doc_id || chr(10) || '<p>a tag that is skipped</p>' || chr(10) || 'short' || chr(10) || chr(10) || coalesce(t, '') WHEN 1 THEN coalesce(t, '') || chr(10) || 'Getting Started' WHEN 2 THEN '## Sub' || chr(10) || '```' || chr(10) || '  A line of some length.  ' || chr(10) || 'see the endpoints' ELSE '#x' || chr(10) || 'y' END"
_DOC_PATH = "CASE doc_id % 5 WHEN 0 THEN 'docs/Test/README.md' WHEN 1 THEN 'README.md' ELSE 'lib' || doc_id % 3 || '/README.md' END"


@query(
    f"WITH d AS (SELECT doc_id, replace(replace(replace(replace(replace(trim(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')), 'api', 'ipa'), 'tutorial', ''), 'guide', ''), 'endpoints', ''), 'test', '') AS t FROM documents), "
    f"c AS (SELECT doc_id, t, {_DOC} AS content, {_DOC_PATH} AS path FROM d), b AS (SELECT *, trim(t) AS body FROM c) SELECT doc_id, "
    "CASE WHEN doc_id % 5 = 0 OR contains(lower(content), 'testing guide') THEN 'HowTo' WHEN contains(lower(content), 'api reference') OR contains(lower(content), 'endpoints') THEN 'APIReference' WHEN doc_id % 7 = 0 THEN 'SoftwareApplication' WHEN contains(lower(content), 'tutorial') OR contains(lower(content), 'getting started') OR contains(lower(content), 'guide') THEN 'HowTo' WHEN doc_id % 2 = 0 THEN 'SoftwareSourceCode' ELSE 'TechArticle' END AS type, "
    "CASE WHEN doc_id % 4 = 0 THEN 'The title ' || doc_id WHEN doc_id % 5 = 0 THEN 'Test' WHEN doc_id % 5 = 1 THEN 'Documentation' ELSE 'lib' || doc_id % 3 END AS title, "
    "CASE WHEN doc_id % 4 = 0 AND len(body) > 10 THEN CASE WHEN len(body) > 200 THEN left(body, 197) || '...' ELSE body END WHEN doc_id % 4 = 2 THEN 'A line of some length.' ELSE 'Technical documentation and guides' END AS description FROM b"
)
def document_facts(spark, sf_dir):
    """Kind, title and description of documents as README files, some of repositories with a package file or a remote."""
    t = F.trim(F.regexp_replace("text", "[^a-zA-Z]+", " "))
    for a, b in (("api", "ipa"), ("tutorial", ""), ("guide", ""), ("endpoints", ""), ("test", "")):
        t = F.replace(t, F.lit(a), F.lit(b))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.expr(_DOC.replace("chr(10)", "char(10)")).alias("content"), F.expr(_DOC_PATH).alias("path"))
    return scanners.document_facts(rows, "path", "content", F.col("doc_id") % 7 == 0, F.col("doc_id") % 2 == 0).select("doc_id", "type", "title", "description")


_TEST = "CASE turn % 5 WHEN 0 THEN 'render(<A/>);  await waitFor(() => x);' WHEN 1 THEN 'expect(link).toHaveAttribute( \"href\", \"/u' || turn || '\");' WHEN 2 THEN 'screen.getByRole(\"heading\"); expect(screen.getByText(\"Label ' || conv_id % 9 || '\")).toBe(' || conv_id % 3 || ');' WHEN 3 THEN 'fireEvent.click(b); userEvent.type(c, \"d\"); getByText( \"Ab\"); querySelector(\"section#x\")' ELSE '// text' END"
_TEST_SQL = f"f AS (SELECT conv_id, string_agg({_TEST}, chr(10) ORDER BY turn) AS c FROM conversations GROUP BY 1)"


def _test_files(spark, sf_dir):
    made = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_TEST).alias("code")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "code"))).alias("rows"))
    return made.select("conv_id", F.array_join(F.transform("rows", lambda x: x["code"]), "\n").alias("content"))


_TEXTS_SQL = """t AS (SELECT text, count(*) AS n FROM (SELECT unnest(regexp_extract_all(c, 'getByText\\s*\\(\\s*["'']([^"'']+)["'']\\)', 1)) AS text FROM f) WHERE len(text) > 5 GROUP BY 1 HAVING count(*) >= 3), a AS (SELECT regexp_replace(a, '["''][^"'']+["'']', '""', 'g') AS assertion, count(*) AS n FROM (SELECT unnest(regexp_extract_all(c, '(expect\\([^)]+\\)\\.[^;]+);', 1)) AS a FROM f) GROUP BY 1 HAVING count(*) >= 3)"""
_SUMMARY_SQL = """s AS (SELECT count(*) AS files, CAST(sum(len(regexp_extract_all(c, 'render\\s*\\([^)]+\\);\\s*await\\s+waitFor'))) AS BIGINT) AS render_wait, CAST(sum(len(regexp_extract_all(c, 'toHaveAttribute\\s*\\(\\s*["'']href["'']'))) AS BIGINT) AS links, CAST(sum(len(regexp_extract_all(c, 'getByRole\\s*\\(\\s*["'']heading["'']|querySelector\\s*\\(\\s*["'']section#'))) AS BIGINT) AS semantic, CAST(sum(len(regexp_extract_all(c, 'userEvent\\.type|fireEvent\\.click|getByRole\\s*\\(\\s*["'']form["'']'))) AS BIGINT) AS forms, (SELECT count(*) FROM t) AS repeated_texts, (SELECT count(*) FROM a) AS repeated_assertions FROM f)"""


@query(f"WITH {_TEST_SQL}, {_TEXTS_SQL}, {_SUMMARY_SQL} SELECT * FROM s")
def test_suite_summary(spark, sf_dir):
    return testsuite.summary(_test_files(spark, sf_dir))


@query(f"WITH {_TEST_SQL}, {_TEXTS_SQL} SELECT 'text' AS kind, text AS value, n FROM t UNION ALL SELECT 'assertion', assertion, n FROM a")
def test_suite_repeats(spark, sf_dir):
    files_ = _test_files(spark, sf_dir)
    texts = testsuite.repeated_texts(files_).select(F.lit("text").alias("kind"), F.col("text").alias("value"), "n")
    return texts.union(testsuite.repeated_assertions(files_).select(F.lit("assertion"), "assertion", "n"))


@query(
    f"WITH {_TEST_SQL}, {_TEXTS_SQL}, {_SUMMARY_SQL} SELECT unnest([x FOR x IN [CASE WHEN render_wait > 5 THEN 'Create renderAndWait helper to reduce render + waitFor boilerplate' END, CASE WHEN links > 5 THEN 'Create link assertion helpers (expectExternalLink, expectInternalLink, etc.)' END, CASE WHEN semantic > 5 THEN 'Create semantic validators (expectSectionWithId, expectHeadingLevel, etc.)' END, "
    "CASE WHEN forms > 5 THEN 'Create form helpers (fillContactForm, expectFormAccessibility, etc.)' END, CASE WHEN repeated_texts > 10 THEN 'Extract hardcoded strings to test-constants.ts' END, CASE WHEN repeated_assertions > 5 THEN 'Extract duplicate assertions to custom assertion helpers' END] IF x IS NOT NULL]) AS advice FROM s"
)
def test_suite_advice(spark, sf_dir):
    return testsuite.recommendations(testsuite.summary(_test_files(spark, sf_dir)))


_MATCH_SQL = "m AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS ord, 'src/o' || l_orderkey % 300 || CASE l_orderkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.vue' ELSE '.zig' END AS file, CASE l_linenumber % 4 WHEN 0 THEN 'console-statements' WHEN 1 THEN 'express-route-handlers' WHEN 2 THEN 'prisma-operations' ELSE 'own-rule' END AS rule, l_partkey % 40 + 1 AS line, CASE WHEN l_suppkey % 3 = 0 THEN 'f' || l_partkey % 30 END AS fn, CASE WHEN l_linenumber <> 2 THEN l_partkey % 40 + l_linenumber END AS line_end FROM lineitem)"


@query(
    f"WITH {_MATCH_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY file, fn, CASE WHEN fn IS NULL THEN line END ORDER BY CASE WHEN fn IS NULL THEN 0 ELSE line END, ord) AS r FROM m) "
    "SELECT 'cb_' || substr(sha256(file || ':' || line), 1, 12) AS block_id, rule AS pattern_id, CASE rule WHEN 'console-statements' THEN 'logger' WHEN 'express-route-handlers' THEN 'api_handler' WHEN 'prisma-operations' THEN 'database_operation' ELSE 'utility' END AS category, "
    "CASE regexp_extract(file, '[.][a-z]+$') WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.vue' THEN 'vue' ELSE 'unknown' END AS language, file AS file_path, CAST(line AS INTEGER) AS line_start, CAST(coalesce(line_end, line) - line + 1 AS INTEGER) AS line_count, fn AS function_name FROM k WHERE r = 1"
)
def extracted_blocks(spark, sf_dir):
    """Blocks of matches made of line items, one a function or place."""
    rows = table(spark, sf_dir, "lineitem")
    n, k = F.col("l_orderkey"), F.col("l_linenumber")
    ends = F.element_at(F.array(*[F.lit(x) for x in (".ts", ".py", ".vue", ".zig")]), (n % 4 + 1).cast("int"))
    rule = F.element_at(F.array(*[F.lit(x) for x in ("console-statements", "express-route-handlers", "prisma-operations", "own-rule")]), (k % 4 + 1).cast("int"))
    line, named = (F.col("l_partkey") % 40 + 1).cast("int"), F.concat(F.lit("async function f"), (F.col("l_partkey") % 30).cast("string"), F.lit("() {}"))
    made = rows.select(
        (n * 10 + k).alias("ord"), F.concat(F.lit("src/o"), (n % 300).cast("string"), ends).alias("file_path"), rule.alias("rule_id"),
        F.when(F.col("l_suppkey") % 3 == 0, named).alias("matched_text"), line.alias("line_start"), F.when(k != 2, (F.col("l_partkey") % 40 + k).cast("int")).alias("line_end"),
    )
    found = duplicates.dedup_blocks(extraction.code_blocks(made, "/code"))
    return found.select("block_id", "pattern_id", "category", "language", "file_path", "line_start", "line_count", text.function_tag(F.col("tags")).alias("function_name"))


@query("WITH d AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'b' || p_size % 13 END || '/' || CASE WHEN p_size % 2 = 0 THEN 'x/' ELSE '' END || 'n' || p_size % 17 AS path FROM part) SELECT string_split(path, '/')[-1] AS name, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def directory_names(spark, sf_dir):
    path = F.concat(F.when(F.col("p_partkey") % 3 == 0, "a").otherwise(F.concat(F.lit("b"), (F.col("p_size") % 13).cast("string"))), F.lit("/"), F.when(F.col("p_size") % 2 == 0, "x/").otherwise(""), F.lit("n"), (F.col("p_size") % 17).cast("string"))
    return activity.directory_stats(table(spark, sf_dir, "part").select(path.alias("path")))[1]


@query(f"WITH {_SUGGEST_SQL}, x AS (SELECT u.h, any_value(u.strategy) AS strategy, any_value(u.category) AS category, arg_min(b.file_path, b.ord) AS ff, arg_min(b.pattern_id, b.ord) AS pattern_id FROM u JOIN b ON u.h = b.h GROUP BY u.h) SELECT 'cs_dg_' || substr(h, 1, 12) AS suggestion_id, CASE strategy WHEN 'local_util' THEN string_split(ff, '/')[1] || '/utils.js' WHEN 'shared_package' THEN CASE category WHEN 'logger' THEN 'shared/logging/logger-utils.js' WHEN 'api_handler' THEN 'shared/middleware/auth-middleware.js' ELSE 'shared/utils/' || category || '.js' END WHEN 'mcp_server' THEN 'mcp-servers/' || pattern_id || '-server/' ELSE 'agents/' || pattern_id || '-agent/' END AS target FROM x")
def suggestion_targets(spark, sf_dir):
    return duplicates.suggestions(_exact(spark, sf_dir)).select("suggestion_id", "target")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS heading_line FROM documents WHERE text IS NOT NULL")
def heading_lines(spark, sf_dir):
    """The first heading line of documents as README files; a third of them begin with prose, or have none."""
    prose = F.regexp_replace("text", "[#\n]", " ")
    k = F.col("doc_id") % 4
    content = F.when(k == 0, F.concat(prose, F.lit("\n  ## two\n# three"))).when(k == 1, prose).when(k == 2, F.concat(F.lit("#"), prose)).otherwise(F.concat(F.lit("\t# x\n"), prose))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.coalesce(scanners.heading_line(content), F.lit(0)).alias("heading_line"))


@query(
    f"WITH {_SUGGEST_SQL} SELECT 'cs_dg_' || substr(h, 1, 12) AS suggestion_id, CASE WHEN files = 1 THEN 'trivial' WHEN category = 'api_handler' THEN CASE WHEN occurrences <= 3 THEN 'simple' WHEN occurrences <= 10 THEN 'moderate' ELSE 'complex' END ELSE CASE WHEN occurrences <= 5 THEN 'trivial' ELSE 'simple' END END AS complexity, "
    "CASE WHEN files = 1 THEN 'minimal' WHEN category = 'api_handler' THEN CASE WHEN occurrences <= 3 THEN 'low' WHEN occurrences <= 10 THEN 'medium' ELSE 'high' END ELSE CASE WHEN occurrences <= 5 THEN 'minimal' ELSE 'low' END END AS risk, "
    "CASE WHEN files = 1 THEN 'All ' || occurrences || ' occurrences in same file - extract to local function' WHEN category = 'api_handler' THEN 'API pattern used ' || occurrences || ' times' || CASE WHEN occurrences <= 3 THEN ' - extract to middleware/util' WHEN occurrences <= 10 THEN ' across ' || files || ' files - create shared middleware' ELSE ' - candidate for framework/MCP abstraction' END "
    "ELSE 'Logger/config pattern used ' || occurrences || ' times' || CASE WHEN occurrences <= 5 THEN ' - extract to module constant' ELSE ' across ' || files || ' files - centralize configuration' END END AS rationale FROM u"
)
def suggestion_rationales(spark, sf_dir):
    """Strategies' risks and reasons, with the values written out in the SQL."""
    return duplicates.suggestions(_exact(spark, sf_dir)).select("suggestion_id", "complexity", "risk", "rationale")


_PIPE = "CASE user_id % 5 WHEN 0 THEN 'repomix' WHEN 1 THEN 'claude-health' WHEN 2 THEN 'repo-cleanup' WHEN 3 THEN 'own' ELSE 'unknown' END"


@query(f"SELECT event_id AS id, {_PIPE} AS pipeline_id, CASE user_id % 5 WHEN 0 THEN 'Repomix Automation' WHEN 1 THEN 'Claude Health Monitor' WHEN 2 THEN 'Repository Cleanup' WHEN 3 THEN 'own' ELSE 'Unknown Pipeline' END AS pipeline_name, event_type AS status, props AS data FROM events")
def job_view(spark, sf_dir):
    return jobs.api_view(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(_PIPE).alias("pipeline_id"), F.col("event_type").alias("status"), F.col("props").alias("data")))


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS status FROM events WHERE event_id = 77")
def job_by_id(spark, sf_dir):
    return jobs.by_id(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("status")), "77")


@query("SELECT (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS total_matches, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_returnflag = 'R') AS files_scanned, (SELECT count(*) FROM part) AS rules_applied")
def detection_stats(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("file_path"))
    return scanners.detection_stats(found, table(spark, sf_dir, "part").select("p_partkey"))


@query("SELECT s_suppkey AS id, s_name AS content_hash, n_name AS source_repository, '/code/' || n_name AS source_repository_path FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def blocks_of_scans(spark, sf_dir):
    """Blocks of a scan a nation; nations without suppliers have scans without blocks."""
    by = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("content_hash"))).alias("code_blocks"))
    n = table(spark, sf_dir, "nation")
    scans = n.join(by, n["n_nationkey"] == by["s_nationkey"], "left").select(F.col("n_name").alias("repository_name"), F.concat(F.lit("/code/"), "n_name").alias("repository_path"), "code_blocks")
    return duplicates.blocks_of_scans(scans)


@query("SELECT path, line, name, value, min(ord) AS ord FROM (SELECT l_orderkey * 10 + l_linenumber AS ord, 'c' || l_suppkey % 7 || '.ts' AS path, l_partkey % 30 AS line, 'N' || l_linenumber AS name, l_tax AS value FROM lineitem) GROUP BY ALL")
def distinct_constants(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    made = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("c"), (F.col("l_suppkey") % 7).cast("string"), F.lit(".ts")).alias("path"), (F.col("l_partkey") % 30).alias("line"), F.concat(F.lit("N"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_tax").alias("value"))
    return constants.distinct_constants(made)


@query("WITH f AS (SELECT CASE p_partkey % 14 WHEN 0 THEN 'Python' WHEN 1 THEN 'Python' WHEN 2 THEN 'JavaScript' WHEN 3 THEN 'TypeScript' WHEN 4 THEN 'Images' WHEN 5 THEN 'Text Files' WHEN 6 THEN 'Data Files' WHEN 7 THEN 'Other' WHEN 8 THEN 'Other' WHEN 9 THEN 'Other' WHEN 10 THEN 'Images' WHEN 11 THEN 'HTML' END AS language FROM part) SELECT language, count(*) AS files FROM f WHERE language IS NOT NULL GROUP BY 1 ORDER BY files DESC, language LIMIT 4")
def top_languages(spark, sf_dir):
    names = ("a.py", "b/c.py", "d.js", "e.ts", "f.png", "g.log", "h.csv", "i.zzz", "j.zzz", "k.zzz", "l.svg.gif", "m.html", "noext", "dir/noext")
    path = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % 14 + 1).cast("int"))
    return activity.top_languages(table(spark, sf_dir, "part").select(path.alias("path")), n=4)
