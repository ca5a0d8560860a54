"""The scan of one JSON document of matches: blocks, groups, suggestions, metrics and report; bad input; standard input."""

import io
import json

import pytest
from test_brute import annotations_of, layered

from loomworks import scan
from loomworks.operators import extraction

LOOP = "for (const x of rows) {\n  if (x.size > 3) { total += x.size; }\n}\nlogger.info(total);\n"


def match(path, line, code, rule="console-statements", last=None, **more):
    return {"file_path": path, "rule_id": rule, "matched_text": code, "line_start": line, "line_end": last or line + code.count("\n"), **more}


MATCHES = [
    match("src/a.ts", 10, LOOP * 3),
    match("src/b.ts", 4, LOOP * 3),
    match("src/c.py", 7, LOOP * 3),
    match("src/b.ts", 4, "other(a, b, c, d)"),  # the place is taken
    match("src/d.ts", 30, "function twice(a) { return use(a, b, c); }"),
    match("src/d.ts", 20, "function twice(a) { return use(a, b, c, d); }"),  # the same function, above
    match("src/e.ts", 5, "send(one, two, three, four)"),  # named by a declaration above
    match("src/f.zig", 1, "x"),
]


@pytest.fixture()
def source(tmp_path):
    path = tmp_path / "in.json"
    path.write_text(json.dumps({"repository_info": {"path": "/code/repo", "name": "repo"}, "total_repo_lines": 900, "pattern_matches": MATCHES}))
    files = tmp_path / "files" / "src"
    files.mkdir(parents=True)
    (files / "e.ts").write_text("import x\n\nexport const sender = (a) => {\n  // so\n  send(one, two, three, four)\n}\n")
    return path


def test_scan(spark, source, tmp_path):
    out = tmp_path / "out"
    found = scan.run(spark, str(source), str(out), str(tmp_path / "files"))
    blocks = found.blocks.orderBy("ord").collect()
    assert [(b.ord, b.file_path, b.line_start, b.language, b.category, b.tags) for b in blocks] == [
        (0, "src/a.ts", 10, "typescript", "logger", []), (1, "src/b.ts", 4, "typescript", "logger", []), (2, "src/c.py", 7, "python", "logger", []),
        (5, "src/d.ts", 20, "typescript", "logger", ["function:twice"]), (6, "src/e.ts", 5, "typescript", "logger", ["function:sender"]), (7, "src/f.zig", 1, "unknown", "logger", []),
    ]
    want = layered([tuple(b) for b in blocks], annotations_of(found.blocks))
    assert [(r.method, r.occurrences, r.files) for r in found.groups.collect()] == [(m, len(ids), len(ids)) for m, ids, _ in want] == [("exact_match", 3, 3)]
    lines = [json.loads(x) for f in (out / "duplicate_groups").glob("part*") for x in f.read_text().splitlines()]
    assert lines[0]["group_id"].startswith("dg_") and lines[0]["occurrences"] == 3
    told = "".join(f.read_text() for f in (out / "report.md").glob("part*"))
    assert all(x in told for x in ("# Duplicate report", "## Metrics", "## Strategies", "## Groups by impact", "## Suggestions by return", "### cs_dg_", "1. "))
    page = "".join(f.read_text() for f in (out / "report.html").glob("part*"))
    assert page.startswith("<!DOCTYPE html>") and "<dt>total_duplicate_groups</dt><dd>1</dd>" in page and "<td>dg_" in page and "<td>cs_dg_" in page and page.endswith("</html>\n")
    told = found.metrics.first()
    assert told["total_duplicate_groups"] == 1 and told["duplication_percentage"] == round(100 * told["total_duplicated_lines"] / 900, 2)


def test_bad_input_gives_an_error_and_no_output(spark, tmp_path, capsys, monkeypatch):
    for k, (matches, problem) in enumerate((([match("../x", 1, "y")], "match 0: path outside"), ([match("x", 1, "y"), match("x", 3, "y", last=2)], "match 1: line end"))):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps({"repository_info": {"path": "/r"}, "pattern_matches": matches}))
        assert scan.main([str(path), str(tmp_path / "o")]) == 1 and problem in capsys.readouterr().err
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps({"pattern_matches": []})))
    assert scan.main(["-", str(tmp_path / "o")]) == 1 and not (tmp_path / "o").exists()


def test_standard_input_and_no_matches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps({"repository_info": {"path": "/r"}, "pattern_matches": []})))
    assert scan.main(["-", str(tmp_path / "o")]) == 0 and (tmp_path / "o" / "report.md").exists()


def test_blocks_of_odd_matches(spark):
    rows = [(0, "a.ts", "own", None, 3, None), (1, "b.ts", "own", "", 3, None), (2, "noext", "own", "let z = (", 9, 12)]
    got = extraction.code_blocks(spark.createDataFrame(rows, "ord long, file_path string, rule_id string, matched_text string, line_start int, line_end int"), "/r").orderBy("ord").collect()
    assert [(b.line_count, b.source_code, b.tags, b.category, b.language) for b in got] == [(1, "", [], "utility", "typescript"), (1, "", [], "utility", "typescript"), (4, "let z = (", ["function:z"], "utility", "unknown")]
