"""Queries of code scanners, migration steps, log listings, walks, and client and retry state, with their SQL.

Files, steps and logs are made of the rows of ``orders``, ``lineitem``, ``events``, ``conversations`` and ``part``, all
of them. A query without SQL keeps state in turn; tests/test_scans.py holds it to a serial replay.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import errors
from ..operators import gitlog, migration, reports, rootdir, scanners, scopes
from ..sources import files
from ..streaming import clients, lifecycle, retention, retries
from .catalog import drain, lifecycle_events, query, table

_STEP = "CASE p_partkey % 7 WHEN 0 THEN 'Update import of x from ' || chr(39) || './s' || p_partkey % 100 || chr(39) || ' to \"../lib/t' || p_size || '\"' WHEN 1 THEN 'replace calls to f' || p_partkey % 200 || ' with util.g' || p_size WHEN 2 THEN 'Remove duplicate const c' || p_partkey % 200 || ' from it' WHEN 3 THEN 'Add import ' || chr(39) || '{ a' || p_size || ' }' || chr(39) || ' from \"./n' || p_partkey || '\"' WHEN 4 THEN 'Update import from ./s' || p_size WHEN 5 THEN 'Remove duplicate f' || p_size ELSE p_name END"
_STEP_ONE = {"update-import": "(?i)Update import.*?from [''\"]([^''\"]+)[''\"].*?to [''\"]([^''\"]+)[''\"]", "replace-call": r"(?i)Replace calls to (\w+) with ([\w.]+)", "remove-declaration": r"(?i)Remove duplicate (?:function|class|const|let|var) (\w+)", "add-import": "(?i)Add import.*?[''\"]([^''\"]+)[''\"].*?from [''\"]([^''\"]+)[''\"]"}
_KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in _STEP_ONE.items()) + " END"
_FIELD_SQL = ", ".join(f"CASE WHEN kind = '{k}' THEN regexp_extract(text, '{_STEP_ONE[k]}', {i}) END AS {n}" for k, names in (("update-import", ("old_path", "new_path")), ("replace-call", ("old_name", "new_name")), ("remove-declaration", ("name",)), ("add-import", ("imported", "source"))) for i, n in enumerate(names, 1))
_STEPS_SQL = f"st AS (SELECT p_partkey, {_STEP} AS text FROM part), k AS (SELECT *, {_KIND_SQL} AS kind FROM st), s AS (SELECT p_partkey, kind, {_FIELD_SQL} FROM k)"


def _steps(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_STEP).alias("text"))


@query(f"WITH {_STEPS_SQL} SELECT * FROM s")
def step_kinds(spark, sf_dir):
    return _steps(spark, sf_dir).select("p_partkey", F.inline(F.array(migration.step_kind(F.col("text")))))


_LINE = "CASE l_linenumber % 4 WHEN 0 THEN 'import a from \"./s' || l_suppkey % 100 || '\";' WHEN 1 THEN 'x = f' || l_partkey % 200 || ' (1);' WHEN 2 THEN 'const  c' || l_partkey % 200 || ' = 1' ELSE 'refactor' END"
_PATH = "CASE WHEN o % 5 = 0 THEN 'dist/' ELSE 'src/' END || o || CASE WHEN o % 3 = 0 THEN '.ts' WHEN o % 3 = 1 THEN '.jsx' ELSE '.md' END"


@query(
    f"WITH {_STEPS_SQL}, f AS (SELECT l_orderkey AS o, string_agg({_LINE}, chr(10) ORDER BY l_linenumber) AS c FROM lineitem GROUP BY 1), g AS (SELECT {_PATH} AS file_path, c FROM f WHERE o % 5 <> 0 AND o % 3 < 2), "
    "q AS (SELECT p_partkey % 50 AS suggestion_id, p_partkey AS step_no, kind, old_path, old_name, name FROM s), "
    "m AS (SELECT suggestion_id, step_no, file_path FROM q JOIN g ON CASE kind WHEN 'update-import' THEN contains(c, 'from \"' || old_path || '\"') WHEN 'replace-call' THEN contains(c, ' ' || old_name || ' (') WHEN 'remove-declaration' THEN contains(c, 'const  ' || name || ' ') END) "
    "SELECT * FROM m UNION SELECT q.suggestion_id, q.step_no, m.file_path FROM q JOIN m USING (suggestion_id) WHERE kind = 'add-import'"
)
def step_files(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), "l_linenumber", F.expr(_LINE).alias("line"))
    made = lines.groupBy("o").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x["line"]), "\n").alias("content"))
    steps = _steps(spark, sf_dir).select((F.col("p_partkey") % 50).alias("suggestion_id"), F.col("p_partkey").alias("step_no"), "text", F.lit(None).cast("string").alias("example"))
    return migration.step_files(steps, made.select(F.expr(_PATH).alias("file_path"), "content"))


#: Pieces of code, one a turn of a conversation, each behind a comment with the turn's text.
_PIECES = ("Promise.race([a(), b([1])]);", "Promise.race( [ withTimeout(a(1)), b ] );", "setLoading(true);", "async function f(x, y = g()) {\n  return { z: await h(x) };\n}", "async m() {\n  try { n(); } catch (e) { p('}'); }\n}", "setLoading(false); // setLoading(true)", "text = 'setLoading(true)';")
_PIECE = "CASE (conv_id * 3 + turn) % 7 " + " ".join(f"WHEN {i} THEN '" + p.replace("'", "''") + "'" for i, p in enumerate(_PIECES)) + " END"
_NOTE = "replace(replace(coalesce(text, ''), '*', ' '), '/', ' ')"


@query(
    f"WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, '/* ' || {_NOTE} || ' */' || chr(10) AS note, {_PIECE} || chr(10) AS piece, (conv_id * 3 + turn) % 7 AS k FROM conversations), "
    "u AS (SELECT *, len(note) - len(replace(note, chr(10), '')) + coalesce(sum(len(note || piece) - len(replace(note || piece, chr(10), ''))) OVER (PARTITION BY conv_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM t), "
    "v AS (SELECT conv_id || CASE WHEN conv_id % 2 = 0 THEN '.ts' ELSE '.js' END AS file_path, conv_id, line, k FROM u), "
    "w AS (SELECT file_path, line, line AS line_end, CASE k WHEN 0 THEN 'promise_race_no_timeout' WHEN 2 THEN 'loading_without_finally' ELSE 'async_no_error_handling' END AS category FROM v WHERE k IN (0, 2) UNION ALL SELECT file_path, line, line + 2, 'async_no_error_handling' FROM v WHERE k = 3 "
    "UNION ALL SELECT file_path, min(line), min(line), 'missing_loading_safety_net' FROM v WHERE conv_id % 2 = 0 AND k IN (2, 5) GROUP BY file_path HAVING bool_or(k = 2) UNION ALL SELECT 'src/utils/timeout.ts', 0, 0, 'missing_timeout_utility') "
    "SELECT file_path, CAST(line AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, category FROM w"
)
def pattern_findings(spark, sf_dir):
    piece = F.expr(_PIECE.replace("''", "\\'").replace("\n", "\\n"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("/* "), F.expr(_NOTE), F.lit(" */\n"), piece, F.lit("\n")).alias("code"))
    made = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "code"))), lambda x: x["code"]), "").alias("content"))
    path = F.concat(F.col("conv_id").cast("string"), F.when(F.col("conv_id") % 2 == 0, ".ts").otherwise(".js"))
    return scopes.findings(made.select(path.alias("file_path"), "content")).select("file_path", "line_start", "line_end", "category")


_L_SQL = "l AS (SELECT user_id AS f, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no FROM events)"


@query(
    f"WITH {_L_SQL}, d AS (SELECT f, line_no, CASE event_type WHEN 'view' THEN 'v' || event_id WHEN 'signup' THEN 's' || event_id END AS name FROM l WHERE event_type IN ('view', 'signup') AND event_id % 11 = 0), b AS (SELECT f, line_no, event_id, event_type FROM l WHERE event_type IN ('purchase', 'error')) "
    "SELECT b.f AS file_path, b.line_no AS line_start, CASE WHEN event_type = 'error' THEN 'e' || event_id ELSE (SELECT arg_max(name, d.line_no) FROM d WHERE d.f = b.f AND d.line_no BETWEEN b.line_no - 10 AND b.line_no) END AS function_name FROM b"
)
def block_names(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_path"), "ts", "event_id", "event_type")
    at = e.withColumn("line_no", F.row_number().over(Window.partitionBy("file_path").orderBy("ts", "event_id")))
    line = F.when((F.col("event_type") == "view") & (F.col("event_id") % 11 == 0), F.concat(F.lit("const v"), F.col("event_id").cast("string"), F.lit(" = ("))).when((F.col("event_type") == "signup") & (F.col("event_id") % 11 == 0), F.concat(F.lit("  export function s"), F.col("event_id").cast("string"))).otherwise("x")
    code = F.when(F.col("event_type") == "error", F.concat(F.lit("function e"), F.col("event_id").cast("string"), F.lit(" ("))).otherwise("return x")
    blocks = at.filter(F.col("event_type").isin("purchase", "error")).select("file_path", F.col("line_no").alias("line_start"), code.alias("code"))
    return scanners.block_names(blocks, at.select("file_path", "line_no", line.alias("line"))).select("file_path", "line_start", "function_name")


def _log(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("repo"), (F.col("o_orderkey") * 10).alias("line_no"), F.concat(F.lit("commit "), F.col("o_orderkey").cast("string"), F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("line"))
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 25).alias("repo"))
    added = F.when(F.col("l_linenumber") == 3, "-").otherwise(F.col("l_quantity").cast("int").cast("string"))
    rows = table(spark, sf_dir, "lineitem").join(keys, "l_orderkey").select("repo", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), F.concat_ws("\t", added, F.col("l_linenumber").cast("string"), F.concat(F.lit("src/"), F.col("l_partkey").cast("string"))).alias("line"))
    return o.unionByName(rows)


@query(
    "WITH x AS (SELECT o_custkey % 25 AS repo, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, l_linenumber AS n, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey) "
    "SELECT repo, month, count(DISTINCT o_orderkey) AS commits, CAST(coalesce(sum(CASE WHEN n <> 3 THEN CAST(trunc(q) AS BIGINT) END), 0) AS BIGINT) AS additions, CAST(coalesce(sum(n), 0) AS BIGINT) AS deletions, count(n) AS files FROM x GROUP BY ALL"
)
def log_sections(spark, sf_dir):
    log = _log(spark, sf_dir)
    heads = log.filter(F.col("line").rlike(gitlog.HEADER)).groupBy("repo", F.regexp_extract("line", gitlog.HEADER, 2).alias("month")).agg(F.count("*").alias("commits"))
    told = gitlog.sections(log).groupBy("repo", "month").agg(F.sum("additions").alias("a"), F.sum("deletions").alias("d"), F.count("*").alias("n"))
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return heads.join(told, ["repo", "month"], "left").select("repo", "month", "commits", zero("a", "additions"), zero("d", "deletions"), zero("n", "files"))


@query("WITH x AS (SELECT o_custkey % 25 AS repo, o_orderkey, l_linenumber AS n, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey) SELECT repo, count(DISTINCT o_orderkey) AS commits, CAST(coalesce(sum(CASE WHEN n <> 3 THEN CAST(trunc(q) AS BIGINT) END), 0) AS BIGINT) AS additions, CAST(coalesce(sum(n), 0) AS BIGINT) AS deletions, count(n) AS files FROM x GROUP BY ALL")
def log_repository_stats(spark, sf_dir):
    return gitlog.repository_stats(_log(spark, sf_dir)).drop("monthly")


_DIR = "'/code/' || CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '.h/' WHEN 2 THEN 'build/' ELSE 'a' || p_size % 5 || '/' END || 'b' || p_size || CASE WHEN p_partkey % 4 = 0 THEN '/c' || p_partkey % 30 ELSE '' END || CASE WHEN p_partkey % 9 = 0 THEN '/d/e/f' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '/.git/HEAD' ELSE '/x' || p_partkey || '.ts' END"


@query(
    f"WITH p AS (SELECT {_DIR} AS path FROM part), r AS (SELECT DISTINCT substr(split_part(path, '/.git/', 1), 7) AS rel FROM p WHERE contains(path, '/.git/')), "
    "a AS (SELECT rel FROM r WHERE NOT regexp_matches(rel, '(^|/)(\\.[^/]*|build)(/|$)') AND len(string_split(rel, '/')) <= 4) "
    "SELECT '/code/' || rel AS path, rel AS relative, string_split(rel, '/')[-1] AS name, CAST(len(string_split(rel, '/')) AS INTEGER) AS depth FROM a WHERE NOT EXISTS (SELECT 1 FROM a AS b WHERE starts_with(a.rel, b.rel || '/'))"
)
def repository_roots(spark, sf_dir):
    return files.repository_roots(table(spark, sf_dir, "part").select(F.expr(_DIR).alias("path")), "/code", depth=4)


@query()
def resolved_ids(spark, sf_dir):
    """Ids of which some are asked for as another's suffixed form."""
    rid = F.concat(F.lit("u"), (F.col("user_id") % 60).cast("string"), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("-"), (F.col("event_id") % 5 + 1).cast("string"))).otherwise(""))
    return reports.unique_ids(table(spark, sf_dir, "events").select("event_id", rid.alias("rid")), "rid", "event_id")


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


@query()
def client_lists(spark, sf_dir):
    """The lists of 20 clients after all events of their jobs."""
    rows = lifecycle_events(_events(spark, sf_dir)).withColumn("client", F.col("job_id") % 20)
    told = drain(clients.lists(rows), "update")
    last = told.groupBy("client").agg(F.max_by(F.struct("queued", "active", "activity", "unread"), "batch").alias("s"))
    return last.select("client", *[F.array_join(f"s.{c}", ",").alias(c) for c in ("queued", "active", "activity")], "s.unread")


def _messages(events):
    """Messages that ask for three channels: a name of the kind, one of the user, one that is too long or no name."""
    bad = F.when(F.col("event_id") % 2 == 0, F.repeat(F.lit("x"), 129)).otherwise("no name")
    third = F.when(F.col("event_id") % 5 == 0, bad).otherwise(F.concat(F.lit("u:"), (F.col("event_id") % 97).cast("string")))
    return events.select((F.col("user_id") % 50).alias("client"), F.col("event_id").alias("message_id"), F.array(F.concat(F.lit("k:"), "event_type"), F.concat(F.lit("u:"), (F.col("user_id") % 97).cast("string")), third).alias("channels"))


@query()
def client_channels(spark, sf_dir):
    """What each message of a client adds to its channels."""
    return drain(clients.channels(_messages(_events(spark, sf_dir))), "append").select("client", "message_id", F.array_join("added", ",").alias("added"), "rejected", "dropped")


@query()
def channel_events(spark, sf_dir):
    """Events that reach each client by its channels, by channel."""
    added = drain(clients.channels(_messages(_events(spark, sf_dir))), "append")
    rows = _events(spark, sf_dir).select("event_id", F.concat(F.lit("u:"), (F.col("user_id") % 97).cast("string")).alias("channel"))
    return drain(clients.deliver(rows, added), "append").groupBy("client", "channel").agg(F.count("*").alias("n"))


def _attempts(events):
    """Lifecycle events with the class of each error: by status and message, as ``error_classify`` has them."""
    message = F.get(F.array(*[F.lit(m) for m in ("Rate limit hit", "request timeout", "Permission denied here", "please try again")]), (F.col("event_id") % 4).cast("int"))
    c = errors.classify(F.lit(None).cast("string"), F.lit(None).cast("int"), message)
    return lifecycle_events(events).select("job_id", "event_id", "ts", "event", (c["category"] == "retryable").alias("retryable"), c["delay"].cast("long").alias("delay_ms"))


@query()
def timed_retries(spark, sf_dir):
    """Retries of failed jobs after their error's delay, three at most."""
    retries.use_timers(spark)
    return drain(retries.retries(_attempts(_events(spark, sf_dir))), "append").drop("batch")



@query()
def retained_counters(spark, sf_dir):
    """Ended jobs that are kept for two days after their end, at the end of each day."""
    retries.use_timers(spark)
    told = drain(retention.changes(lifecycle_events(_events(spark, sf_dir)), 2 * 86_400.0), "append")
    return retention.counters(told).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "status", "n")


_ROOT = "CASE p_partkey % 13 WHEN 0 THEN 'util_' || p_partkey || '.py' WHEN 1 THEN 'server_' || p_partkey || '.py' WHEN 2 THEN 'm' || p_partkey || '.py' WHEN 3 THEN 'migrate' || p_partkey || '.py' WHEN 4 THEN 's' || p_partkey || '.sh' WHEN 5 THEN 'conf' || p_partkey || '.yml' WHEN 6 THEN 'd' || p_partkey || '.sqlite' WHEN 7 THEN 'x' || p_partkey || '.log' WHEN 8 THEN '.hidden' || p_partkey || '.py' WHEN 9 THEN 'm' || p_partkey || '.py' WHEN 10 THEN 'n' || p_partkey || '.toml' WHEN 11 THEN 'README' || p_partkey || '.md' ELSE 'm' || p_partkey || '.py' END"
_ROOT_SQL = (
    f"f AS (SELECT p_brand AS repo, {_ROOT} AS name, p_partkey AS k FROM part), g AS (SELECT *, lag(name) OVER (PARTITION BY repo ORDER BY k) AS before FROM f), py AS (SELECT * FROM f WHERE name LIKE '%.py'), "
    "i AS (SELECT g.repo, g.name, left(before, -3) AS module FROM g WHERE name LIKE '%.py' AND name NOT LIKE '.%' AND before LIKE '%.py' AND before NOT LIKE '.%' AND k % 2 = 0), used AS (SELECT DISTINCT repo, module || '.py' AS name FROM i), "
    "c AS (SELECT repo, count(*) AS n FROM f WHERE name LIKE '%.yml' OR name LIKE '%.toml' GROUP BY repo), "
    "lib AS (SELECT repo, name FROM py WHERE name NOT LIKE '.%' AND (regexp_matches(name, 'lib|util|helper|middleware|config|auth|rate|sentry') OR (repo, name) IN (SELECT repo, name FROM used)) AND NOT regexp_matches(name, 'server|app|main|run|start')), "
    "r AS (SELECT repo, name, 'move_python_lib' AS id FROM lib UNION ALL SELECT repo, name, 'move_scripts' FROM f WHERE name LIKE 'migrate%' OR name LIKE '%.sh' UNION ALL SELECT repo, name, 'move_data' FROM f WHERE name LIKE '%.sqlite' "
    "UNION ALL SELECT repo, name, 'move_configs' FROM f JOIN c USING (repo) WHERE n > 5 AND (name LIKE '%.yml' OR name LIKE '%.toml') UNION ALL SELECT repo, name, 'remove_temp' FROM f WHERE name LIKE '%.log')"
)


def _root(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), F.expr(_ROOT).alias("name"), F.col("p_partkey").alias("k"))
    placed = own.withColumn("before", F.lag("name").over(Window.partitionBy("repo").orderBy("k")))
    of = F.when(F.col("before").endswith(".py") & (F.col("k") % 2 == 0), F.concat(F.lit(" from "), F.expr("substring(before, 1, length(before) - 3)"), F.lit(" import a, b")))
    lines = placed.select("repo", "name", F.explode(F.array(F.lit("import os.path"), F.coalesce(of, F.lit("x = 1")), F.lit("from . import y"))).alias("line"))
    return own.select("repo", "name"), lines


@query(f"WITH {_ROOT_SQL} SELECT repo, name, id, CASE id WHEN 'move_python_lib' THEN 'lib' WHEN 'move_scripts' THEN 'scripts' WHEN 'move_data' THEN 'data' WHEN 'move_configs' THEN 'config' ELSE 'docs (or delete)' END AS target, CASE WHEN id IN ('move_scripts', 'remove_temp') THEN 'low' ELSE 'medium' END AS impact, id NOT IN ('move_scripts', 'remove_temp') AS updates FROM r")
def root_moves(spark, sf_dir):
    return rootdir.recommendations(*_root(spark, sf_dir))


@query(f"WITH {_ROOT_SQL} SELECT i.repo, i.name AS file, 'from ' || module || ' import' AS old, 'from lib.' || module || ' import' AS new FROM i JOIN lib ON lib.repo = i.repo AND lib.name = module || '.py' UNION ALL SELECT i.repo, i.name, 'from ' || module, 'from lib.' || module FROM i JOIN lib USING (repo, name)")
def root_import_changes(spark, sf_dir):
    return rootdir.import_changes(*_root(spark, sf_dir))


@query(f"WITH {_ROOT_SQL}, t AS (SELECT repo, count(*) AS total FROM f WHERE name NOT LIKE '.%' GROUP BY repo), n AS (SELECT repo, count(*) AS n FROM r GROUP BY repo) SELECT repo, total, coalesce(n, 0) AS movable, total - coalesce(n, 0) AS rest, CAST(floor(CAST(100 AS DOUBLE) * coalesce(n, 0) / total + 0.5) AS BIGINT) AS percent FROM t LEFT JOIN n USING (repo)")
def root_statistics(spark, sf_dir):
    files_, lines = _root(spark, sf_dir)
    return rootdir.statistics(files_, rootdir.recommendations(files_, lines))


@query("SELECT count(*) AS total_scans, count(*) FILTER (event_type <> 'error') AS successful_scans, count(*) FILTER (event_type = 'error') AS failed_scans, CAST(coalesce(sum(user_id % 5) FILTER (event_type <> 'error'), 0) AS BIGINT) AS duplicates, CAST(coalesce(sum(event_id % 3) FILTER (event_type <> 'error'), 0) AS BIGINT) AS suggestions, CAST(coalesce(sum(CASE WHEN value >= 75 THEN 1 ELSE 0 END + CASE WHEN value * 2 >= 75 THEN 1 ELSE 0 END) FILTER (event_type <> 'error'), 0) AS BIGINT) AS high_impact FROM events")
def stream_scan_counters(spark, sf_dir):
    """Running counters over a stream of scans."""
    rows = _events(spark, sf_dir).select((F.col("event_type") != "error").alias("ok"), (F.col("user_id") % 5).alias("groups"), (F.col("event_id") % 3).alias("suggestions"), F.array(F.col("value"), F.col("value") * 2).alias("impacts"))
    return drain(lifecycle.scan_counters(rows), "complete")
