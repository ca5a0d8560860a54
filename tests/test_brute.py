"""The queries without SQL against plain Python on the smallest tables, and the layers' order on small blocks."""

import hashlib
import os
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomworks.functions import text
from loomworks.operators import duplicates
from loomworks.operators.graph import components
from loomworks.plans import catalog
from loomworks.streaming import lifecycle

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
SPACE = "[\t\n\x0b\x0c\r    -     　﻿]"


def norm(code):
    """The normal form, with Python's expressions."""
    kept = "|".join((*text.METHODS, *[o for o in text.OBJECTS if o[0].islower()]))
    upper = "|".join(("STR", "NUM", *[o for o in text.OBJECTS if o.isupper()]))
    out = re.sub(r"//[^\n]*?(?=\n|$)", "", code)
    out = re.sub(r"/\*.*?\*/", "", out, flags=re.S)
    out = re.sub(f"{SPACE}+", " ", out)
    for q in "'\"`":
        out = re.sub(f"{q}[^{q}]*{q}", f"{q}STR{q}", out)
    a, z = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    out = re.sub(f"{a}[0-9]+{z}", "NUM", out)
    out = re.sub(f"{a}(?!(?:{kept}){z})[a-z][a-zA-Z0-9_]*{z}", "var", out)
    out = re.sub(f"{a}(?!(?:{upper}){z})[A-Z][A-Z0-9_]*{z}", "CONST", out)
    out = re.sub(r"\s*([(){}\[\];,.])\s*", r"\1", out, flags=re.A)
    out = re.sub(r"\s*(=>|===?|!==?|[+\-*/%<>=&|])\s*", r" \1 ", out, flags=re.A)
    return re.sub(r"\s+", " ", out, flags=re.A).strip(" ")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


@tables
def test_normalize_code(spark):
    got = {r.page_id: (r.n, r.ast_hash) for r in catalog.normalize_code(spark, DIR).collect()}
    pages = {r.page_id: r.html for r in catalog.table(spark, DIR, "pages").select("page_id", "html").collect()}
    assert got == {i: (len(norm(h)), hashlib.sha256(norm(h).encode()).hexdigest()) for i, h in pages.items()}


def top(up, i):
    while up[i] != i:
        i = up[i]
    return i


def joined(nodes, links):
    up = {n: n for n in nodes}
    for i, j in links:
        a, b = sorted((top(up, i), top(up, j)))
        up[b] = a
    return {n: top(up, n) for n in nodes}


@tables
def test_peer_clusters(spark):
    rows = catalog._occurrences(spark, DIR).collect()
    sets, links = {r.id: set(r.tokens) for r in rows}, []
    by = defaultdict(list)
    for r in rows:
        by[r.literal].append(r.id)
    for ids in by.values():
        links += [(i, j) for i in ids for j in ids if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])]
    want = defaultdict(int)
    for root in joined(sets, links).values():
        want[root] += 1
    assert {r.cluster: r["size"] for r in catalog.peer_clusters(spark, DIR).collect()} == want


@pytest.mark.parametrize("kind", ["chain", "shuffled", "star", "copies"])
def test_components(spark, kind):
    names = list(range(2000))
    if kind == "shuffled":
        random.Random(3).shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(1999)] if kind in ("chain", "shuffled") else [(0, i) for i in range(1, 2000)] if kind == "star" else [(i, i + 1) for i in range(0, 2000, 2)] * 2
    frame = spark.createDataFrame(links, "i long, j long")
    nodes = spark.createDataFrame([(i,) for i in range(2001)], "id long")
    assert {r.id: r.cluster for r in components(nodes, frame).collect()} == joined(range(2001), links)


@tables
def test_stream_job_states(spark):
    rows = catalog.lifecycle_events(catalog.table(spark, DIR, "events")).orderBy("ts", "event_id").collect()
    want = {}
    for r in rows:
        want[r.job_id] = lifecycle.step(*want.get(r.job_id, ("", 0, 0)), r.event)
    assert {r.job_id: (r.status, r.retries, r.rejected) for r in catalog.stream_job_states(spark, DIR).collect()} == want


@tables
def test_circuit_breaker(spark):
    rows = catalog.lifecycle_events(catalog.table(spark, DIR, "events")).filter("event IN ('completed', 'failed')").orderBy("ts", "event_id").collect()
    held, want = {}, defaultdict(lambda: [0, 0])
    for r in rows:
        state, fails, opened = held.get(r.job_id, ("CLOSED", 0, None))
        waited = state == "OPEN" and (r.ts - opened).total_seconds() >= 86_400
        if r.event == "completed" and (waited or state == "CLOSED"):
            state, fails, opened = "CLOSED", 0, None
        elif waited:
            fails, opened = fails + 1, r.ts
        elif state == "CLOSED":
            fails += 1
            state, opened = ("OPEN", r.ts) if fails >= 2 else (state, opened)
        held[r.job_id] = state, fails, opened
        want[state][0] += 1
        want[state][1] += fails
    assert {r.state: [r.n, r.failures] for r in catalog.circuit_breaker(spark, DIR).collect()} == dict(want)


def test_breaker_carries_state_over_batches(spark):
    events = [(k % 2, i, k % 7 == 0) for k, i in enumerate(range(300))]
    frame = spark.createDataFrame(events, "job_id long, event_id long, ok boolean").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60))
    whole = sorted(map(tuple, lifecycle.breaker_states(frame, 2, 300.0).collect()))
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")
    try:
        assert sorted(map(tuple, lifecycle.breaker_states(frame, 2, 300.0).collect())) == whole
    finally:
        spark.conf.set(key, before)
    assert {s for _, _, s, _ in whole} == {"OPEN", "CLOSED"} or {s for _, _, s, _ in whole} == {"OPEN"}


BLOCK = "ord long, block_id string, pattern_id string, category string, language string, file_path string, repository string, line_start int, line_count int, source_code string, tags array<string>"


def blocks(n=40):
    """Blocks of a few templates with renamed names, other literals, changed methods and copies."""
    rng, out = random.Random(11), []
    shapes = (
        "const {0} = await {1}.find({{ id: {2} }});\nif ({0} === null) {{ return res.status({3}).json({{ error: '{1}' }}); }}",
        "const {0} = {1}.filter(x => x.ok).map(x => x.{1}).join('{0}');\nlogger.info({0});",
        "for (const {0} of {1}) {{\n  if ({0}.{4} > {2}) {{ total += {0}.{4}; }}\n}}",
    )
    for i in range(n):
        k = rng.randrange(3)
        code = shapes[k].format(rng.choice(["user", "row"]), rng.choice(["items", "db"]), rng.randrange(9), rng.choice([404, 500]), rng.choice(["size", "length"]))
        code += rng.choice(["", "", "\nconsole.log(total);"])
        tags = [f"function:f{rng.randrange(3)}"] if i % 5 == 0 else []
        out.append((i, f"b{i}", f"p{k}", ("api_handler", "utility", "utility")[k], "javascript", f"src/m{rng.randrange(4)}.js", f"r{i % 3}", i, code.count("\n") + 1, code, tags))
    return out


def structural(a, b):
    """The structural similarity of two codes."""
    if a == b:
        return 1.0
    na, nb = norm(a), norm(b)
    chains = [re.findall(r"\.([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", c) for c in (a, b)]
    x, y = [c if len(c) >= 2 else [] for c in chains]
    if x == y:
        chain = 1.0
    elif not x or not y:
        chain = 0.5
    elif len(x) != len(y):
        n = min(len(x), len(y))
        chain = n / max(len(x), len(y)) if x[:n] == y[:n] else 0.0
    else:
        chain = sum(p == q for p, q in zip(x, y)) / len(x)
    base = 0.95 if na == nb else lcs(na, nb) if chain == 1 else 0.7 * lcs(na, nb) + 0.3 * chain
    ops = lambda c: {n for p, n in ((r"!==", "!=="), (r"===", "==="), (r"!=", "!="), (r"==", "=="), (r"!\s*[^=]", "!"), (r"&&", "&&"), (r"\|\|", "||")) if re.search(p, c)}
    calls = lambda c: {n for n in ("Math.max", "console.log", "console.error", ".reverse", ".toUpperCase") if re.search(re.escape(n) + r"\s*\(", c)}
    for of, factor in ((lambda c: set(re.findall(r"\.status\(([0-9]{3})\)", c)), 0.70), (ops, 0.80), (calls, 0.75)):
        p, q = of(a), of(b)
        base *= factor if p and q and p != q else 1
    return base


def replay(rows, alike, fits):
    """The greedy pass: each block that is free leads, and takes all later free blocks that are alike."""
    taken, groups = set(), []
    for i, a in enumerate(rows):
        if a[0] in taken:
            continue
        own = [(b, s) for b in rows[i + 1 :] if b[0] not in taken and (s := alike(a, b)) is not None]
        if own:
            taken |= {a[0], *[b[0] for b, _ in own]}
            groups.append(([a, *[b for b, _ in own]], sum(s for _, s in own) / len(own)))
    return [(sorted(b[1] for b in g), s) for g, s in groups if fits(g) and good(g, s)]


def good(group, similarity):
    """The group's quality reaches 0.7."""
    cats, pats = len({b[3] for b in group}), len({b[2] for b in group})
    same = 1.0 if cats == pats == 1 else 0.7 if cats == 1 else 0.5 if pats == 1 else 0.3
    lines = sum(b[8] for b in group) / len(group)
    return similarity * 0.4 + min(len(group) / 4, 1) * 0.2 + min(lines / 10, 1) * 0.2 + same * 0.2 >= 0.7 - 1e-12


def told(layer):
    groups, members = layer
    by = defaultdict(list)
    for r in members.collect():
        by[(r.group_id, r.leader)].append(r.block_id)
    return sorted((sorted(by[(r.group_id, r.ord)]), round(r.similarity, 9)) for r in groups.collect())


FN = lambda b: next((t[9:] for t in b[10] if t.startswith("function:")), "")


def structurally(a, b):
    if a[2] != b[2] or a[3] != b[3] or min(a[8], b[8]) / max(a[8], b[8]) < 0.5 or FN(a) and FN(a) == FN(b) and a[5] == b[5]:
        return None
    s = structural(a[9], b[9])
    return s if s >= 0.85 - 1e-12 else None


def compatible(group):
    places = [(b[5], FN(b)) for b in group if FN(b)]
    return min(b[8] for b in group) >= 0.5 * max(b[8] for b in group) and len(places) == len(set(places))


def semantically(ann):
    def jaccard(x, y):
        return 1.0 if not x and not y else 0.5 if not x or not y else len(set(x) & set(y)) / len(set(x) | set(y))

    def alike(a, b):
        p, q = ann[a[0]], ann[b[0]]
        heads = [set(z.intent.split("|")[0].split("+")) - {""} for z in (p, q)]
        if a[3] != b[3] or "unknown" in (p.intent, q.intent) or not heads[0] & heads[1]:
            return None
        s = sum(w * jaccard(p[n], q[n]) for n, w in (("operations", 0.4), ("domains", 0.25), ("patterns", 0.2), ("data_types", 0.15)))
        return s if s >= 0.7 - 1e-12 else None

    return alike


def annotations_of(frame):
    return {r.ord: r.ann for r in duplicates.annotate(frame).select("ord", "ann").collect()}


def test_structural_layer(spark):
    rows = blocks()
    want = sorted((ids, round(s, 9)) for ids, s in replay(rows, structurally, compatible))
    assert len(want) >= 3 and told(duplicates.structural_groups(spark.createDataFrame(rows, BLOCK))) == want


def test_semantic_layer(spark):
    rows = blocks()
    frame = spark.createDataFrame(rows, BLOCK)
    want = sorted((ids, round(s, 9)) for ids, s in replay(rows, semantically(annotations_of(frame)), lambda g: True))
    assert want and told(duplicates.semantic_groups(frame)) == want


def same_meaning(a, b):
    """The four checks of two blocks of one hash."""
    chain = lambda c: (lambda n: n if len(n) >= 2 else [])(re.findall(r"\.([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", c))
    codes = lambda c: set(re.findall(r"(?:res|response)\.status\(([0-9]{3})\)", c))
    calls = lambda c: {m for m in ("max", "min", "floor", "ceil") if f"Math.{m}" in c}

    def ops(c):
        return {o for o, yes in (("!==", "!==" in c), ("===", "===" in c), ("!=", "!=" in c and "!==" not in c), ("==", "==" in c and "===" not in c)) if yes}

    if chain(a) != chain(b) or any(f(a) and f(b) and f(a) != f(b) for f in (codes, calls)):
        return False
    x, y = ops(a), ops(b)
    return not any(p in x and q in y or q in x and p in y for p, q in (("===", "!=="), ("==", "!=")))


def layered(rows, ann):
    """All layers in turn over the complex blocks, each on what the layers before left: (method, ids, similarity)."""
    words = lambda c: len(set(re.findall(r"[A-Za-z0-9_]+", c)))
    left = [b for b in rows if any(x.strip() for x in b[9].split("\n")) and (words(b[9]) >= 5 or any(w in b[9] for w in text.CONTROL))]
    by, out = defaultdict(list), []
    for b in left:
        by[re.sub(f"{SPACE}+", " ", b[9])].append(b)
    for g in by.values():
        if len(g) >= 2 and all(same_meaning(x[9], y[9]) for i, x in enumerate(g) for y in g[i + 1 :]) and good(g, 1.0):
            out.append(("exact_match", sorted(b[1] for b in g), 1.0))
    for method, alike, fits in (("structural", structurally, compatible), ("semantic", semantically(ann), lambda g: True)):
        used = {i for _, ids, _ in out for i in ids}
        out += [(method, ids, round(s, 9)) for ids, s in replay([b for b in left if b[1] not in used], alike, fits)]
    return sorted(out)


@pytest.mark.parametrize("seed", [11, 12])
def test_detect_equals_a_serial_replay(spark, seed):
    rows, rng = blocks(36), random.Random(seed)
    more = ["x", "if", "  \n", "const a = b === c || d !== e ? f(g) : h;", "const v = Math.max(a1, b1) + Math.min(c1, d1);", "res.status(404).send(a2, b2, c2)", "q.filter(x => x)\n  .map(y => y)", "let t = u == v && w != z;"]
    for k in range(30):
        code = rng.choice(more)
        code = code.replace(" ", rng.choice((" ", "  ", "\n\t", "\u00a0"))) if rng.random() < 0.6 else code
        i = len(rows)
        rows.append((i, f"b{i}", rng.choice(("p0", "p1")), rng.choice(("utility", "logger")), "javascript", f"src/n{rng.randrange(3)}.js", f"r{i % 3}", i, code.count("\n") + 1 + 9 * (k % 2), code, [f"function:g{k % 4}"] if k % 3 == 0 else []))
    frame = spark.createDataFrame(rows, BLOCK)
    groups, members = duplicates.detect(frame)
    by = defaultdict(list)
    for r in members.collect():
        by[(r.group_id, r.leader)].append(r.block_id)
    found = groups.collect()
    got = sorted((r.method, sorted(by[(r.group_id, r.ord)]), round(r.similarity, 9)) for r in found)
    want = layered(rows, annotations_of(frame))
    assert got == want and {m for m, *_ in want} >= {"exact_match", "structural"}
    held = {i: b for i, b in ((b[1], b) for b in rows)}
    for r in found:
        own = [held[i] for i in by[(r.group_id, r.ord)]]
        assert (r.occurrences, r.total_lines, r.files, r.repositories) == (len(own), sum(b[8] for b in own), len({b[5] for b in own}), len({b[6] for b in own}))


def test_layers_leave_no_block_twice(spark):
    groups, members = duplicates.detect(spark.createDataFrame(blocks(), BLOCK))
    ids = [r.block_id for r in members.collect()]
    assert len(ids) == len(set(ids)) and {r.method for r in groups.collect()} >= {"exact_match", "structural"}


@tables
def test_layer_queries_equal_operators(spark):
    parts = catalog.part_blocks(spark, DIR)
    made = duplicates.structural_groups(parts)[0].count(), duplicates.semantic_groups(parts)[0].count()
    assert (catalog.structural_groups(spark, DIR).count(), catalog.semantic_groups(spark, DIR).count()) == made
    assert {r.method for r in catalog.layered_groups(spark, DIR).collect()} <= {"exact_match", "structural", "semantic"}


def test_structural_links(spark):
    rows = blocks()
    got = duplicates.structural_links(spark.createDataFrame(rows, BLOCK)).collect()
    assert {r.kind for r in got} <= {"pair", "copy"} and any(r.kind == "pair" for r in got)
    by = {b[0]: b for b in rows}
    assert all(by[r.i][9] == by[r.j][9] and r.i < r.j for r in got if r.kind == "copy")
    linked = {(r.i, r.j): r.similarity for r in got if r.kind == "pair"}
    first = set(by) - {r.j for r in got if r.kind == "copy"}
    fn = lambda b: next((t[9:] for t in b[10] if t.startswith("function:")), "")
    for i in first:
        for j in first:
            a, b = by[i], by[j]
            if i < j and a[9] and b[9] and a[2:4] == b[2:4] and min(a[8], b[8]) / max(a[8], b[8]) >= 0.5 and not (fn(a) and fn(a) == fn(b) and a[5] == b[5]):
                s = structural(a[9], b[9])
                assert (abs(linked.pop((i, j)) - s) < 1e-9) if s >= 0.85 else (i, j) not in linked
    assert not linked


def test_ended_jobs_expire(spark, tmp_path):
    schema = "job_id long, event_id long, ts timestamp, event string"
    days = [[(1, 1, 0, "queued"), (1, 2, 0, "running"), (1, 3, 0, "completed"), (2, 4, 0, "queued")], [(2, 5, 10, "running")], [(3, 6, 20, "queued")]]
    for k, rows in enumerate(days):
        made = spark.createDataFrame([(j, e, d, x) for j, e, d, x in rows], "job_id long, event_id long, d long, event string")
        made.select("job_id", "event_id", F.timestamp_seconds(F.col("d") * 86_400 + F.col("event_id")).alias("ts"), "event").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "0")).schema
    stream = lifecycle.read_events(spark, str(tmp_path / "in" / "*"), schema)
    out = catalog.drain(lifecycle.job_states(stream, keep_seconds=86_400.0), "update").orderBy("batch").collect()
    last = {r.job_id: r.status for r in out}
    assert last == {1: "expired", 2: "running", 3: "queued"}
