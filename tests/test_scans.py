"""Scanners, steps, logs, walks, identifiers and client and retry state against plain Python."""

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomworks.operators import gitlog, migration, reports, scanners, scopes
from loomworks.plans import catalog, scans
from loomworks.sources import files
from loomworks.streaming import clients, lifecycle, retries

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def test_step_kind(spark):
    texts = {
        "Update import from './utils/json.js' to '../shared/json-utils.js'": ("update-import", "./utils/json.js", "../shared/json-utils.js", *[None] * 5),
        "Update import of x from './a' to './b'": ("update-import", "./a", "./b", *[None] * 5),
        "Replace calls to writeJsonFile with jsonUtils.writeJsonFile": ("replace-call", None, None, "writeJsonFile", "jsonUtils.writeJsonFile", *[None] * 3),
        "Remove duplicate function writeJsonFile from legacy.js": ("remove-declaration", *[None] * 4, "writeJsonFile", None, None),
        "remove DUPLICATE Class foo": ("remove-declaration", *[None] * 4, "foo", None, None),
        "Add import '{ writeJsonFile }' from '../shared/json-utils.js'": ("add-import", *[None] * 5, "{ writeJsonFile }", "../shared/json-utils.js"),
        "Add import \"x\" from 'y'": ("add-import", *[None] * 5, "x", "y"),
        "Update import\nfrom 'a' to 'b'": (None,) * 8,
        "Remove duplicate foo": (None,) * 8,
        "Update imports": (None,) * 8,
        "": (None,) * 8,
    }
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", migration.step_kind(F.col("t")).alias("s")).collect()
    assert {r.t: tuple(r.s) for r in rows} == {**texts, None: (None,) * 8}


def matches(content, kind, subject):
    word = re.escape(subject)
    pattern = {"update-import": rf"from\s+['\"]{word}['\"]", "replace-call": rf"\b{word}\s*\(", "remove-declaration": rf"(?:function|const|let|var|class)\s+{word}\b"}[kind]
    return re.search(pattern, content, re.ASCII) is not None


def test_step_files_equal_a_search_of_each_pair(spark):
    rng = random.Random(5)
    names, paths = ["foo", "fooBar", "bar", "b2"], ["./old", "../x.js", "./a b"]
    bits = [f"from '{p}'" for p in paths] + [f'from "{p}\'' for p in paths] + [f"{k} {n}" for k in ("function", "const", "myclass", "let\n") for n in names] + [f"{n} (" for n in names] + [f"x{n}(" for n in names] + ["from 'a\nfrom './old'", ";", "y.", " "]
    folders = ["src/", "lib/node_modules/", "build/", "builds/", ""]
    made = [(f"{rng.choice(folders)}f{i}{rng.choice(('.ts', '.js', '.md', '.jsx'))}", rng.choice(("", " ", "\n")).join(rng.choices(bits, k=rng.randint(0, 6)))) for i in range(120)]
    texts = [(f"Update import from '{p}' to 'z'", "update-import", p) for p in paths] + [(f"Replace calls to {n} with q", "replace-call", n) for n in names] + [(f"Remove duplicate let {n}", "remove-declaration", n) for n in names] + [("Add import 'k' from 'l'", "add-import", None), ("Think", None, None), (None, None, None)]
    steps, want = [], set()
    good = [(f, c) for f, c in made if re.search(r"\.(js|ts|jsx|tsx)$", f) and not {"node_modules", "build"} & set(f.split("/")[:-1])]
    for s in range(12):
        own = set()
        chosen = [(k, *rng.choice(texts), rng.choice((None, "no path", "", "// src/named.ts\nx", "// lib/a.jsx") if rng.random() < 0.4 else (None,))) for k in range(4)]
        for k, text, kind, subject, example in chosen:
            steps.append((s, k, text, example))
            path = re.match(r"//\s*(.+?\.(?:js|ts|jsx|tsx))", example or "")
            if path:
                want.add((s, k, path[1]))
            elif subject:
                hit = {f for f, c in good if matches(c, kind, subject)}
                own |= hit
                want |= {(s, k, f) for f in hit}
        want |= {(s, k, f) for k, _, kind, _, example in chosen if kind == "add-import" and not (example or "").startswith("//") for f in own}
    got = migration.step_files(spark.createDataFrame(steps, "suggestion_id int, step_no int, text string, example string"), spark.createDataFrame([*made, ("n.ts", None)], "file_path string, content string"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def partners(text):
    """{begin: end} of the brackets outside texts and comments, by a stack; brackets must fit."""
    token = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|[()\[\]{}]", re.S)
    stack, out = [], {}
    for m in token.finditer(text):
        if m[0] in "([{":
            stack.append(m.start())
        elif m[0] in ")]}":
            out[stack.pop()] = m.end()
    return out


def test_extents_equal_a_stack(spark):
    rng = random.Random(7)
    names = ["Promise.race(", "async f(", "async function g (", "setLoading(", "call(", "xasync f(", "async (", "("]

    def code(depth):
        out = []
        for _ in range(rng.randint(0, 3)):
            kind = rng.random()
            inner = code(depth - 1) if depth else "1"
            if kind < 0.5:
                out.append(rng.choice(names) + rng.choice(("", " ")) + (f"[{inner}]" if rng.random() < 0.6 else inner) + rng.choice(("", "\n")) + ")" + rng.choice((" {" + inner + "}", "", "\n{ try {} catch (e) {} }", ": void {" + inner + "}")))
            elif kind < 0.8:
                out.append(rng.choice(["'a)\\'('", '"}{"', "`([\n`", "// ) }\n", "/* { \n ( */"]))
            else:
                out.append(rng.choice(["{" + inner + "}", "[" + inner + "]", "timeout;", "x\n"]))
        return " ".join(out)

    texts = {f"{i}.ts": code(4) for i in range(150)}
    want = Counter()
    for name, t in texts.items():
        ends = partners(t)
        hidden = [m.span() for m in re.finditer(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", t, re.S)]
        for kind, p in (("race", r"(?<![\w.$])Promise\s*\.\s*race\s*\("), ("async", r"(?<![\w.$])async\s+(?:function\s+)?[A-Za-z_$][\w$]*\s*\("), ("loading", r"(?<![\w.$])setLoading\s*\(")):
            for m in re.finditer(p, t):
                if any(a <= m.start() < b for a, b in hidden):
                    continue
                end = ends[m.end() - 1]
                inside = t[m.end() : end - 1]
                if kind == "race":
                    a = m.end() + len(inside) - len(inside.lstrip())
                    if not (t[a : a + 1] == "[" and t[ends[a] : end - 1].strip() == ""):
                        continue
                elif kind == "async":
                    a = end + len(t[end:]) - len(t[end:].lstrip())
                    if t[a : a + 1] != "{":
                        continue
                    end = ends[a]
                elif inside == "":
                    continue
                want[(name, kind, t[: m.start()].count("\n"), t[:end].count("\n"), t[m.start() : end])] += 1
    got = scopes.extents(spark.createDataFrame([*texts.items(), ("n.ts", None)], "file_path string, content string"))
    assert Counter(map(tuple, got.collect())) == want and {k[1] for k in want} == {"race", "async", "loading"}


def test_findings(spark):
    net = "useEffect(() => { const t = setTimeout(() => setLoading(false), 9); return () => clearTimeout(t) })\nsetLoading(true)"
    rows = [("a.ts", "\nPromise.race([x()])\nPromise.race([x(), TimeOut()])"), ("b.tsx", net), ("c.ts", "setLoading(false)\nsetLoading(on ? true : x)"), ("d.js", "setLoading( true )"), ("e.md", "setLoading(true)"), ("f.ts", "async go() {\n run() }"), ("src/utils/timeout.ts", "")]
    found = scopes.findings(spark.createDataFrame(rows, "file_path string, content string"))
    got = sorted((r.file_path, r.line_start, r.line_end, r.severity, r.category) for r in found.collect())
    assert got == [("a.ts", 1, 1, "high", "promise_race_no_timeout"), ("b.tsx", 1, 1, "medium", "loading_without_finally"), ("c.ts", 0, 0, "low", "missing_loading_safety_net"), ("d.js", 0, 0, "medium", "loading_without_finally"), ("f.ts", 0, 1, "medium", "async_no_error_handling")]
    assert tuple(scopes.tally(found).first()) == (5, 5, 1, 3, 1, 0)
    assert [r.category for r in scopes.findings(spark.createDataFrame([], "file_path string, content string")).collect()] == ["missing_timeout_utility"]


def test_block_names(spark):
    lines = [("a", i, {3: "function near(", 9: "const b = (", 20: "x: async function", 21: "let far = ("}.get(i, "y")) for i in range(1, 40)]
    blocks = [("a", 13, "z"), ("a", 14, "z"), ("a", 9, "z"), ("a", 8, "z"), ("a", 20, "var own = ("), ("a", 31, "z"), ("a", 32, "z"), ("a", 20, ""), ("a", None, "z"), ("a", 21, None), ("q", 5, "z"), ("a", 13, "z")]
    got = scanners.block_names(spark.createDataFrame(blocks, "file_path string, line_start int, code string"), spark.createDataFrame(lines, "file_path string, line_no int, line string"))

    def name(i, code):
        own = re.search(r"(?:var|let|const)\s+(\w+) = \(|function (\w+)\(", code or "")
        if own or not code or i is None:
            return own and (own[1] or own[2])
        return next((n for k in range(i, max(0, i - 11), -1) for n in [{3: "near", 9: "b", 20: "x", 21: "far"}.get(k)] if n), None)

    assert Counter(map(tuple, got.collect())) == Counter((f, i, c, name(i, c) if f == "a" else None) for f, i, c in blocks)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_sections_run_over_ranges(spark, parts):
    rows = [("r1", 0, "lost\tno\thead")] + [("r1", 1, "commit aa 2024-05-01")] + [("r1", 2 + i, f"{i}\t1\tf{i}") for i in range(300)] + [("r1", 400, ""), ("r1", 401, "commit bb 2024-06-02"), ("r1", 402, "-\t-\tpic"), ("r1", 403, "name only")]
    rows += [("r2", 5, "9\t9\tother repository, no head"), ("r3", 1, "commit cc 2024-05-09"), ("r3", 2, "commit dd 2024-07-01"), ("r3", 3, "4\t5\ta\tb")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        log = spark.createDataFrame(rows, "repo string, line_no int, line string").repartition(5)
        got = {(r.repo, r.line_no): (r.commit, r.month, r.additions, r.deletions, r.file) for r in gitlog.sections(log).collect()}
        want = {("r1", 2 + i): ("aa", "2024-05", i, 1, f"f{i}") for i in range(300)} | {("r1", 402): ("bb", "2024-06", None, None, "pic"), ("r1", 403): ("bb", "2024-06", None, None, "name only"), ("r3", 3): ("dd", "2024-07", 4, 5, "a\tb")}
        assert got == want
        stats = {r.repo: (r.commits, r.monthly, r.additions, r.deletions, r.files) for r in gitlog.repository_stats(log).collect()}
        assert stats == {"r1": (2, {"2024-05": 1, "2024-06": 1}, sum(range(300)), 300, 302), "r3": (2, {"2024-05": 1, "2024-07": 1}, 4, 5, 1)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repository_roots_equal_a_walk(spark, tmp_path):
    rng = random.Random(2)
    base = tmp_path / "code"
    for _ in range(120):
        at = base.joinpath(*rng.choices(["a", "b", "c", ".h", "dist", "e"], k=rng.randint(0, 6)))
        (at / (".git" if rng.random() < 0.3 else "src")).mkdir(parents=True, exist_ok=True)
        (at / (".git" if (at / ".git").exists() else "src") / "HEAD").touch()

    def walk(path, rel, depth):
        if depth > 4:
            return
        if (path / ".git").is_dir():
            yield str(path), rel or path.name, path.name, depth
            return
        for x in path.iterdir():
            if x.is_dir() and not x.name.startswith(".") and x.name != "dist":
                yield from walk(x, f"{rel}/{x.name}" if rel else x.name, depth + 1)

    def found(top):
        listing = [(os.path.join(d, f),) for d, _, names in os.walk(top) for f in names]
        return sorted(map(tuple, files.repository_roots(spark.createDataFrame(listing, "path string"), str(top), depth=4).collect()))

    for top in (base, base / "a", base / "b"):
        assert found(top) == sorted(walk(top, "", 0))


def test_match_limit(spark):
    rows = spark.createDataFrame([(f"f{i}", "r", "t", 1, 1) for i in range(5)], "file_path string, rule_id string, matched_text string, line_start int, line_end int")
    assert files.strict(rows, 5).count() == 5 and files.strict(rows, 4).count() == 0
    assert [r.problem for r in files.validate_matches(rows, 4)[1].collect()] == ["too many"] * 5


def test_unique_ids_equal_a_serial_pass(spark):
    rng = random.Random(4)
    asked = ["a", "a", "a-1", *rng.choices(["a", "b", "a-1", "a-1-1", "a-2", "b-x", "c-100", "c-101", "b-1", None, "d-3", "job-7", "job-8"], k=300), *["c"] * 130]
    want, used = [], set()
    for i, x in enumerate(asked):
        got = None if x is None else next((m for k in range(101) for m in [f"{x}-{k}" if k else x] if m not in used), None)
        used.add(got)
        want.append((i, x, got))
    rows = spark.createDataFrame(list(enumerate(asked)), "n int, rid string").repartition(4)
    got = sorted(map(tuple, reports.unique_ids(rows, "rid", "n").collect()))
    assert got == want and len({u for *_, u in got if u}) == sum(u is not None for *_, u in got)


def test_lineage_of_long_chains_and_cycles(spark):
    n = 5000
    order = random.Random(1).sample(range(n), n)
    rows = [(order[i], order[i - 1] if i else None) for i in range(n)] + [(9000, 8888), (9001, 9000), (9100, 9101), (9101, 9100), (9102, 9101), (9200, 9200)]
    got = {r.id: (r.root, r.depth) for r in lifecycle.retry_lineage(spark.createDataFrame(rows, "id int, retried_from int")).collect()}
    assert got == {**{order[i]: (order[0], i) for i in range(n)}, 9000: (9000, 0), 9001: (9000, 1), 9100: (None, None), 9101: (None, None), 9102: (None, None), 9200: (None, None)}


def events():
    import duckdb

    return duckdb.connect().execute(f"SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 FROM '{DIR}/events.parquet' ORDER BY ts, event_id").fetchall()


needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@needs_tables
def test_timed_retries_equal_a_serial_replay(spark):
    delay = {0: (True, 60_000), 1: (True, 5_000), 2: (False, 0), 3: (True, 5_000)}
    kind = {"view": "queued", "click": "running", "purchase": "completed", "error": "failed", "signup": "cancelled"}
    held, want, last = {}, [], max(e[3] for e in events()) - 600_000
    for i, job, what, at in events():
        status, tries, due = held.get(job, ("", 0, None))
        if due is not None and due <= at:
            want.append((job, due, "requeued", tries, 0))
            due = None
        if kind[what] == "failed":
            again, ms = delay[i % 4]
            if again and tries < 3:
                tries, status, due = tries + 1, "queued", at + ms
                want.append((job, at, "retry:created", tries, ms))
            else:
                want.append((job, at, "retry:max-attempts" if again else "job:failed", tries, 0))
                status, due = "failed", None
        else:
            status = kind[what]
            due = due if status == "queued" else None
        held[job] = status, tries, due
    want += [(job, due, "requeued", tries, 0) for job, (_, tries, due) in held.items() if due is not None and due <= last]
    got = catalog.QUERIES["timed_retries"](spark, DIR).collect()
    assert sorted((r.job_id, r.at_ms, r.event, r.attempt, r.delay_ms) for r in got) == sorted(want) and any(w[2] == "requeued" for w in want)


def test_timed_retries_restart_in_a_delay(spark, tmp_path):
    """A stream stopped while retries wait goes on from its checkpoint; its batches make the rows of one run."""
    retries.use_timers(spark)
    source, state, out = tmp_path / "in", tmp_path / "state", tmp_path / "out"
    schema = "job_id long, event_id long, ts timestamp, event string, retryable boolean, delay_ms long"

    def add(k, rows):
        made = spark.createDataFrame(rows, "job_id long, event_id long, t long, event string, retryable boolean, delay_ms long")
        made.select("job_id", "event_id", F.timestamp_millis("t").alias("ts"), "event", "retryable", "delay_ms").coalesce(1).write.parquet(str(source / f"{k}"))

    def run():
        stream = retries.retries(spark.readStream.schema(schema).parquet(str(source / "*")), late="1 second")
        put = lambda b, n: b.write.mode("overwrite").parquet(str(out / f"batch={n}"))
        stream.writeStream.foreachBatch(put).option("checkpointLocation", str(state)).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r)[:5] for r in spark.read.option("basePath", str(out)).parquet(str(out / "*")).collect())

    add(0, [(1, 1, 10_000, "failed", True, 60_000), (2, 2, 10_000, "failed", True, 60_000), (3, 3, 10_000, "failed", True, 60_000)])
    first = [(j, 10_000, "retry:created", 1, 60_000) for j in (1, 2, 3)]
    assert run() == first
    add(1, [(2, 4, 20_000, "cancelled", None, None), (3, 5, 30_000, "queued", None, None), (9, 6, 500_000, "queued", None, None)])
    assert run() == sorted([*first, (1, 70_000, "requeued", 1, 0), (3, 70_000, "requeued", 1, 0)])


@needs_tables
def test_client_lists_equal_a_serial_replay(spark):
    kind = {"view": "queued", "click": "running", "purchase": "completed", "error": "failed", "signup": "cancelled"}
    want = {}
    for _, job, what, _ in events():
        q, a, log, n = want.get(job % 20, ([], [], [], 0))
        k, job = kind[what], str(job)
        q = q + [job] if k == "queued" else q if k in ("completed", "failed") else [j for j in q if j != job]
        a = [j for j in a if j != job] + [] if k not in ("queued", "running") else a + [job] * (k == "running")
        want[int(job) % 20] = q, a, [f"{job}:{k}", *log][:100], n + 1
    got = {r.client: (r.queued, r.active, r.activity, r.unread) for r in catalog.QUERIES["client_lists"](spark, DIR).collect()}
    assert got == {c: (",".join(q), ",".join(a), ",".join(log), n) for c, (q, a, log, n) in want.items()}


def test_fold_reads_and_clears():
    lists = clients.fold(clients.fold(clients.EMPTY, "queued", "a"), "running", "a")
    assert lists == {"queued": [], "active": ["a"], "activity": ["a:running", "a:queued"], "unread": 2}
    assert clients.fold(lists, "read", "")["unread"] == 0 and clients.fold(lists, "clear", "")["activity"] == [] and clients.fold(lists, "other", "a") == lists


@needs_tables
def test_client_channels_equal_a_serial_replay(spark):
    held, want, reach = {}, [], Counter()
    for i, user, what, _ in sorted(events()):
        own = held.setdefault(user % 50, [])
        asked = [f"k:{what}", f"u:{user % 97}", ("x" * 129 if i % 2 == 0 else "no name") if i % 5 == 0 else f"u:{i % 97}"]
        good = [c for c in asked if re.fullmatch(r"[a-zA-Z0-9_:.-]{1,128}", c)]
        taken = good[: 50 - len(own)]
        new = [c for k, c in enumerate(taken) if c not in own and c not in taken[:k]]
        own += new
        want.append((user % 50, i, ",".join(new), 3 - len(good), len(good) - len(taken)))
    got = catalog.QUERIES["client_channels"](spark, DIR).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    for _, user, _, _ in events():
        for client, own in held.items():
            reach[(client, f"u:{user % 97}")] += f"u:{user % 97}" in own
    assert {(r.client, r.channel): r.n for r in catalog.QUERIES["channel_events"](spark, DIR).collect()} == +reach


@needs_tables
def test_resolved_ids_equal_a_serial_pass(spark):
    used, want = set(), {}
    for i, user, *_ in sorted(events()):
        want[i] = reports.take_id(f"u{user % 60}" + (f"-{i % 5 + 1}" if i % 7 == 0 else ""), used, 100)
    assert {r.event_id: r.unique_id for r in scans.resolved_ids(spark, DIR).collect()} == want


@needs_tables
def test_retained_counters_equal_a_serial_replay(spark):
    kind = {"view": "queued", "click": "running", "purchase": "completed", "error": "failed", "signup": "cancelled"}
    keep, day = 2 * 86_400_000, 86_400_000
    held, changes = {}, Counter()
    for _, job, what, at in events():
        status, due = held.get(job, ("", None))
        if due is not None and due <= at:
            changes[(due // day, status)] -= 1
            status, due = "", None
        after = lifecycle.step(status, 0, 0, kind[what])[0]
        if after != status:
            changes[(at // day, status)] -= status in lifecycle.ENDED
            changes[(at // day, after)] += after in lifecycle.ENDED
            due = at + keep if after in lifecycle.ENDED else None
        held[job] = after, due
    last = max(e[3] for e in events()) - 600_000
    for status, due in held.values():
        if due is not None and due <= last:
            changes[(due // day, status)] -= 1
    n, want = Counter(), {}
    for d in sorted({d for d, _ in changes if (d + 1) * day <= last}):
        for s in lifecycle.ENDED:
            n[s] += changes[(d, s)]
            want[(d, s)] = n[s]
    got = {(r.day, r.status): r.n for r in catalog.QUERIES["retained_counters"](spark, DIR).collect()}
    from datetime import datetime, timezone

    of = lambda d: datetime.fromtimestamp(d * 86_400, timezone.utc).strftime("%Y-%m-%d")
    assert got and all(want[(d, s)] == got.get((of(d), s), want.get((d - 1, s), want[(d, s)])) for d, s in want) and set(got) <= {(of(d), s) for d, s in want}
    assert any(c < 0 for c in changes.values())


def test_page_parameters():
    from loomworks.operators.jobs import page_info, page_parameters

    cases = {(None, None): (50, 0), ("12abc", " -3"): (12, 0), (0, "7.9"): (1, 7), ("1e3", "0x10"): (1, 16), ("x", "y"): (50, 0), (5000, 10**9): (1000, 10**9), ("-4", ""): (1, 0), (3.7, None): (3, 0)}
    assert {k: page_parameters(*k) for k in cases} == cases
    assert page_info(10, 20, 30)["hasMore"] is False and page_info(10, 20, 31) == {"total": 31, "limit": 10, "offset": 20, "page": 2, "hasMore": True}
    assert page_info(10, 20, 30, returned=4)["hasMore"] is True and page_info(10, 26, 30, returned=4)["hasMore"] is False
