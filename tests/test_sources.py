"""Each source and sink on files of its own, and column functions on chosen values."""

import json

import pytest
from pyspark.sql import functions as F

from loomworks.functions import annotations, errors, text
from loomworks.functions.lcs import lcs_ratio
from loomworks.operators import activity, reports, rootdir, scanners
from loomworks.sources import files
from loomworks.streaming import lifecycle

JOBS = [("j1", "p", "completed", "2026-01-01T00:00:00.000Z", None, "2026-01-01T00:01:00.000Z", "{}", '{"n":1}', None, None), ("j2", "q", "failed", None, None, None, None, None, "boom", None)]


@pytest.fixture(scope="module")
def jobs(spark):
    return spark.createDataFrame(JOBS, files.schemas.JOBS)


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))


def test_tables_and_sql(spark, jobs, tmp_path):
    jobs.write.parquet(str(tmp_path / "jobs"))
    back = files.jobs_table(spark, str(tmp_path / "jobs"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, jobs.collect()))
    got = files.sql(spark, "SELECT id FROM {jobs} WHERE status = :status", jobs=jobs, status="failed").collect()
    assert [r.id for r in got] == ["j2"]


def test_jdbc_round_trip(spark, jobs):
    url = "jdbc:derby:memory:jobsdb;create=true"
    files.write_jobs_jdbc(jobs.select("id", "status"), url, "jobs", "overwrite", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    for bounds in ([], ["j2"], ["a", "j15", "z"]):
        back = files.jobs_jdbc(spark, url, "jobs", bounds, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
        assert sorted(tuple(r) for r in back.select("id", "status").collect()) == [("j1", "completed"), ("j2", "failed")]
        assert back.rdd.getNumPartitions() == len(bounds) + 1


def test_report_and_log_jobs(spark, tmp_path):
    put(tmp_path / "a b-2026-02-03-summary.json", {"scanType": "intra", "totalDuplicates": 3, "totalBlocks": 9})
    put(tmp_path / "bad-summary.json", "{not json")
    got = files.report_jobs(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].id == "a-b-2026-02-03" and got[0].created_at == "2026-02-03T00:00:00.000Z" and got[0].status == "completed"
    assert json.loads(got[0].result)["totalDuplicates"] == 3 and json.loads(got[0].data)["scanType"] == "intra"
    put(tmp_path / "logs" / "plugin-audit-1.json", {"startTime": "2026-01-01T00:00:00.000Z", "error": "bad"})
    put(tmp_path / "logs" / "other.json", {"result": {"ok": 1}})
    logs = {r.id: r for r in files.log_jobs(spark, str(tmp_path / "logs")).collect()}
    assert (logs["plugin-audit-1"].pipeline_id, logs["plugin-audit-1"].status, logs["plugin-audit-1"].created_at) == ("plugin-manager", "failed", "2026-01-01T00:00:00.000Z")
    assert (logs["other"].pipeline_id, logs["other"].status) == ("unknown", "completed") and json.loads(logs["other"].result) == {"ok": 1}
    put(tmp_path / "more" / "other.json", {"error": "later"})
    put(tmp_path / "more" / "new.json", {})
    (tmp_path / "none").mkdir()
    folders = [str(tmp_path / x) for x in ("logs", "more", "none")]
    jobs_, counts = files.import_folders(spark, [str(tmp_path)], folders)
    assert {r.id: (r.source, r.status) for r in jobs_.collect()} == {"a-b-2026-02-03": (str(tmp_path), "completed"), "plugin-audit-1": (folders[0], "failed"), "other": (folders[0], "completed"), "new": (folders[1], "completed")}
    assert [tuple(r) for r in counts.collect()] == [(str(tmp_path), 1), (folders[0], 2), (folders[1], 1), (folders[2], 0)]


def test_repository_config(spark, tmp_path):
    repos = [{"name": "a", "path": "/a", "priority": "high", "scanFrequency": "daily", "enabled": True, "tags": ["x"]}, {"name": "b", "path": "/b", "priority": "low", "scanFrequency": "weekly", "enabled": False}]
    put(tmp_path / "c.json", {"repositories": repos, "repositoryGroups": [{"name": "g", "repositories": ["b", "a"], "enabled": True}]})
    r, g = files.repository_config(spark, str(tmp_path / "c.json"))
    assert sorted(x.name for x in r.collect()) == ["a", "b"]
    assert [x.name for x in activity.group_members(g, r, "g").collect()] == ["a"]
    scanned = activity.record_scan(r, "a", "2026-01-02T00:00:00Z", "success", 1.5, 4)
    files.write_repository_config(scanned, g, str(tmp_path / "out"))
    again, groups = files.repository_config(spark, str(tmp_path / "out"))
    told = {x.name: x for x in again.collect()}
    assert told["a"].scanHistory[0].duplicatesFound == 4 and told["a"].lastScannedAt == "2026-01-02T00:00:00Z" and not told["b"].scanHistory
    assert groups.count() == 1


def test_pattern_matches(spark, tmp_path):
    rows = [{"file": "a.js", "ruleId": "r", "text": "x", "range": {"start": {"line": 2, "column": 1}, "end": {"line": 3, "column": 4}}}, {"path": "../b.js", "rule_id": "s"}]
    put(tmp_path / "m.json", "\n".join(map(json.dumps, rows)))
    found = files.pattern_matches(spark, str(tmp_path / "m.json"))
    good, bad = files.validate_matches(found)
    assert [(r.file_path, r.rule_id, r.line_start, r.line_end) for r in good.collect()] == [("a.js", "r", 2, 3)]
    assert [r.problem for r in bad.collect()] == ["path outside"]
    assert files.strict(found).count() == 0 and files.strict(good).count() == 1


def test_listings_and_packs(spark, tmp_path):
    for name in ("a.py", "x/b.js", "x/y/c.py", "x/.hidden/d.py", "node_modules/e.py"):
        put(tmp_path / "repo" / name, "text")
    base = str(tmp_path / "repo")
    names = lambda df: sorted(r.path.split("/repo/")[1] for r in df.collect())
    assert names(files.list_files(spark, base, [".py"], ["node_modules"])) == ["a.py", "x/y/c.py"]
    assert names(files.list_files(spark, base, depth=1)) == ["a.py"]
    assert files.list_files(spark, base, most_bytes=1).count() == 0
    lists = [spark.createDataFrame([(p,) for p in ps], "path string") for ps in (["b", "a"], ["a", "c"])]
    assert [r.path for r in files.discover(*lists).collect()] == ["a", "b", "c"]
    put(tmp_path / "rules" / "one.yml", "id: one")
    assert [r.text for r in files.rule_files(spark, str(tmp_path / "rules")).collect()] == ["id: one"]
    pack = '<file path="src/a.py">\nx = 1\n</file>\n<file path="b.rs">\n</file>'
    assert sorted(tuple(r) for r in files.packed_files(spark.createDataFrame([(pack,)], "pack string")).collect()) == [("b.rs", 1, "rust"), ("src/a.py", 2, "python")]


def test_lint_steps_commits(spark, tmp_path):
    put(tmp_path / "lint.json", [{"filePath": "a.ts", "messages": [{"ruleId": "no-magic-numbers", "message": "No magic number: 42.", "line": 3, "column": 5}, {"ruleId": "other", "message": "x", "line": 1, "column": 1}]}])
    assert [tuple(r) for r in files.lint_occurrences(spark, str(tmp_path / "lint.json")).collect()] == [("a.ts", 3, 5, "42")]
    lines = spark.createDataFrame([("  build   12ms",), ("Total files: 1,234",), ("no",)], "line string")
    assert [tuple(r) for r in files.step_timings(lines).collect()] == [("build", 12)]
    log = spark.createDataFrame([("h1|A|a@x|100|old",), ("h2|B|b@x|200|new|more",)], "line string")
    assert [(r.hash, r.subject) for r in files.commit_rows(log).collect()] == [("h2", "new"), ("h1", "old")]
    before, after = (spark.createDataFrame(rows, "path string, hash string") for rows in ([("a", "1"), ("b", "2")], [("a", "1"), ("b", "3"), ("c", "4")]))
    assert sorted(r.path for r in files.changed_files(before, after).collect()) == ["b", "c"]


def test_cache(spark):
    rows = [("scan:a:1", "a", "2026-01-01 00:00:00"), ("scan:a:1", "a", "2026-01-20 00:00:00"), ("scan:b:1", "b", "2025-01-01 00:00:00")]
    entries = spark.createDataFrame(rows, "key string, repository string, at string").withColumn("cached_at", F.col("at").cast("timestamp"))
    assert [r.at for r in files.cached(entries, "scan:a:1", "2026-01-25 00:00:00").collect()] == ["2026-01-20 00:00:00"]
    assert files.cached(entries, "scan:b:1", "2026-01-25 00:00:00").count() == 0
    assert files.cache_index(entries, most=1).count() == 2 and files.invalidate(entries, "scan:a").count() == 1
    flags = [(True, True, True, False, True), (False, False, True, False, True), (False, True, False, False, True), (False, True, True, True, True), (False, True, True, False, False), (False, True, True, False, True)]
    told = spark.createDataFrame(flags, "a boolean, b boolean, c boolean, d boolean, e boolean").select(files.cache_valid(*map(F.col, "abcde")).alias("v"))
    assert [r.v for r in told.collect()] == ["forced", "disabled", "not git", "dirty", "missing", "use"]


def test_sinks(spark, jobs, tmp_path):
    files.write_report(jobs.select("id", "status"), str(tmp_path / "r"))
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "r")).collect()) == ["j1", "j2"]
    files.write_job_logs(jobs, str(tmp_path / "l"))
    assert {p.name for p in (tmp_path / "l").iterdir() if p.is_dir()} == {"status=completed", "status=failed"}
    assert files.markdown_table(jobs.orderBy("id"), ["id", "status"]).splitlines()[2] == "| j1 | completed |"
    assert "<td>a&lt;b</td>" in files.html_table(spark.createDataFrame([("a<b",)], "x string"), ["x"])


def test_feed_keeps_the_newest(spark, tmp_path):
    for n in range(3):
        rows = spark.createDataFrame([(n * 40 + i, n * 40 + i) for i in range(40)], "event_id long, s long").select("event_id", F.timestamp_seconds("s").alias("ts"))
        lifecycle.keep_recent(rows, str(tmp_path / "feed"), 50)
    turn = (tmp_path / "feed" / "turn").glob("part-*")
    now = "ab"[int(next(p.read_text() for p in turn if p.read_text()).strip())]
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "feed" / now)).collect()) == list(range(70, 120))


def test_subscriptions(spark):
    events = spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, channel string")
    subs = spark.createDataFrame([("x", "a"), ("y", "*"), ("x", "b")], "client string, channel string")
    assert sorted((r.client, r.event_id) for r in lifecycle.subscribed(events, subs).collect()) == [("x", 1), ("x", 2)]
    assert [r.client for r in lifecycle.everything(subs).collect()] == ["y"]


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_column_functions(spark):
    t = F.lit
    got = one(
        spark,
        *[text.numeric_literal(t(x)) for x in ("1_000", "0x1F", "-0b11", "0o17", "12n", "5.", "1e3;", "abc")],
        *[text.format_bytes(t(n)) for n in (0, 512, 1536, 1048576)],
        *[text.language(t(p)) for p in ("a/b.ts", "x.PY", "noext")],
        text.category(t("auth-checks")), text.category(t("zzz")),
        *[text.function_name(t(c)) for c in ("async function go() {}", "const f = (x) => x", "x + 1")],
        text.duration_text(t(3723)), text.report_kind(t(7)), text.report_kind(t(90)),
    )
    assert list(got) == [1000.0, 31.0, None, 15.0, 12.0, 5.0, 1000.0, None, "0 B", "512.0 B", "1.5 KB", "1.0 MB", "typescript", "python", "unknown", "auth_check", "utility", "go", "f", None, "1h 2m 3s", "Weekly", "90-Day"]
    arrays = lambda *x: F.array(*[t(v) for v in x]).cast("array<string>")
    sims = one(spark, *[text.chain_similarity(arrays(*a), arrays(*b)) for a, b in ((("map", "filter"), ("map", "filter")), ((), ("a", "b")), (("a", "b"), ("a", "b", "c", "d")), (("a", "b"), ("a", "c")), (("a", "b"), ("x", "y", "z")))])
    assert list(sims) == [1.0, 0.5, 0.5, 0.5, 0.0]
    assert lcs_ratio("abcbdab", "bdcaba") == 8 / 13 and lcs_ratio("", "x") == 0 and lcs_ratio("a", "a") == 1
    meets = one(spark, annotations.intents_meet(t("filter+map|on:user"), t("map")), annotations.intents_meet(t("find"), t("map")), annotations.intents_meet(t("unknown"), t("unknown")))
    assert list(meets) == [True, False, False]
    names = {"Makefile": "other", "a.py": "python", "A.PY": "other", "zz": "other", "package.json": "packageManager", "tsconfig.json": "config", "render.yaml": "deployment", "x.tsx": "typescript", "b.cjs": "javascript", "c.bash": "shell", "d.sqlite3": "data", "R.md": "documentation", ".py": "other", "e.csv": "other"}
    assert list(one(spark, *[rootdir.root_kind(t(n)) for n in names])) == list(names.values())
    lines = {"from os import x": ("from os import x", "os", "root"), "  from a.b import c": ("from a.b import c", "a.b", "package"), "from .a import b": ("from .a import b", ".a", "relative"), "import m.n, o": ("import m.n, o", "m.n,", "root"), "x = 1": None}
    assert [i and tuple(i) for i in one(spark, *[rootdir.import_class(t(x)) for x in lines])] == list(lines.values())
    assert one(spark, scanners.inject_after_heading(t("x\n# T\ny"), t("B")), scanners.inject_after_heading(t("x"), t("B"))) == ("x\n# T\n\nB\n\ny", "\nB\n\nx")
    assert one(spark, errors.classify(t(None).cast("string"), t(429), t("slow down"))).c0.category == "retryable"


def test_timeout_findings(spark):
    rows = [
        ("a.ts", "await Promise.race([a, b]);\nsetLoading(true);\nrun();"),
        ("b.ts", "setLoading(true);\ntry {\n} finally {\n}"),
        ("c.ts", "async function go() {\n  await x();\n}"),
        ("d.ts", "setTimeout(() => reject(e), 5);"),
        ("e.ts", "setTimeout(() => reject(e), 5);\nclearTimeout(t);"),
    ]
    got = scanners.timeout_findings(spark.createDataFrame(rows, "file_path string, content string"))
    assert sorted((r.file_path, r.line_no, r.category) for r in got.collect()) == [("a.ts", 1, "promise_race_no_timeout"), ("a.ts", 2, "loading_without_finally"), ("c.ts", 1, "async_no_error_handling"), ("d.ts", 1, "settimeout_no_cleanup")]
    assert "content" not in scanners.lines(spark.createDataFrame(rows, "file_path string, content string"), "file_path", "content").columns


def test_numbering_over_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(5)
    assert {r.k: r.number for r in reports.numbered(rows, "k").collect()} == {k: k + 1 for k in range(5000)}
