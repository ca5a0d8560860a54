"""Tables of fixed values, written out apart from the code that holds them."""

import pytest
from pyspark.sql import functions as F

from loomworks.functions import scoring, text
from loomworks.operators import reports

LOCAL, SHARED, SERVER = "local_util", "shared_package", "mcp_server"
STRATEGY = {
    "logger": [(2, LOCAL, "trivial", "minimal"), (5, LOCAL, "trivial", "minimal"), (6, SHARED, "simple", "low"), (90, SHARED, "simple", "low")],
    "config_access": [(5, LOCAL, "trivial", "minimal"), (6, SHARED, "simple", "low")],
    "api_handler": [(3, LOCAL, "simple", "low"), (4, SHARED, "moderate", "medium"), (10, SHARED, "moderate", "medium"), (11, SERVER, "complex", "high")],
    "auth_check": [(3, LOCAL, "simple", "low"), (10, SHARED, "moderate", "medium"), (11, SERVER, "complex", "high")],
    "error_handler": [(3, LOCAL, "simple", "low"), (10, SHARED, "moderate", "medium"), (11, SERVER, "complex", "high")],
    "database_operation": [(3, LOCAL, "moderate", "medium"), (4, SHARED, "complex", "high")],
    "utility": [(3, LOCAL, "simple", "minimal"), (4, SHARED, "simple", "low"), (8, SHARED, "simple", "low"), (9, SERVER, "moderate", "medium")],
    "validator": [(8, SHARED, "simple", "low"), (9, SERVER, "moderate", "medium")],
}


def test_strategies(spark):
    rows = [(c, n, 2, *want) for c, each in STRATEGY.items() for n, *want in each] + [(c, 40, 1, LOCAL, "trivial", "minimal") for c in STRATEGY]
    frame = spark.createDataFrame(rows, "category string, n int, files int, strategy string, complexity string, risk string")
    got = frame.withColumn("s", scoring.strategy(F.col("category"), F.col("n"), F.col("files")))
    assert got.filter("s.strategy <> strategy OR s.complexity <> complexity OR s.risk <> risk").collect() == []


@pytest.mark.parametrize(
    "category, n, files, want",
    [
        ("logger", 4, 1, "All 4 occurrences in same file - extract to local function"),
        ("logger", 4, 2, "Logger/config pattern used 4 times - extract to module constant"),
        ("config_access", 7, 3, "Logger/config pattern used 7 times across 3 files - centralize configuration"),
        ("auth_check", 2, 2, "API pattern used 2 times - extract to middleware/util"),
        ("api_handler", 9, 4, "API pattern used 9 times across 4 files - create shared middleware"),
        ("error_handler", 20, 4, "API pattern used 20 times - candidate for framework/MCP abstraction"),
        ("database_operation", 3, 2, "Database pattern used 3 times - extract to repository method"),
        ("database_operation", 4, 2, "Database pattern used 4 times - create shared query builder"),
        ("utility", 3, 2, "Utility pattern used 3 times in 2 files - extract to local util"),
        ("timing", 8, 5, "Utility pattern used 8 times across 5 files - create shared utility"),
        ("utility", 9, 5, "Utility pattern used 9 times - consider MCP tool or shared package"),
    ],
)
def test_rationales(spark, category, n, files, want):
    c, k, f = F.lit(category), F.lit(n), F.lit(files)
    assert spark.range(1).select(scoring.rationale(c, scoring.strategy(c, k, f)["strategy"], k, f).alias("r")).first()["r"] == want


def test_string_kinds(spark):
    want = {
        "Home page": "navigation", "sign up now": "navigation", "Menu": "navigation", "Submit order": "actions", "cancelled": "actions", "Close menu": "actions",
        "please open menu": "accessibility", "Keyboard help": "accessibility", "aria": "accessibility", "An error occurred": "messages", "Thank you": "messages", "is loading": "messages",
        "Welcome back": "headings", "The end": "headings", "frequently asked": "headings", "Email": "labels", "total": "labels", "totals": "misc", "zebra": "misc",
    }
    rows = spark.createDataFrame([(k,) for k in want], "s string").select("s", reports.string_kind(F.col("s")).alias("k")).collect()
    assert {r.s: r.k for r in rows} == want


def test_steps(spark):
    rows = spark.createDataFrame([(x,) for x in (LOCAL, SHARED, SERVER, "autonomous_agent")], "s string").select("s", scoring.steps(F.col("s")).alias("steps")).collect()
    assert {r.s: (len(r.steps), [x.step for x in r.steps if x.automated], r.steps[0].what, r.steps[-1].time) for r in rows} == {
        LOCAL: (5, [1, 3, 5], "Create utility function in local utils module", "10min"), SHARED: (7, [4, 5, 7], "Create shared package/module for utility", "20min"),
        SERVER: (8, [6], "Design MCP tool interface for functionality", "1h"), "autonomous_agent": (8, [], "Define agent capabilities and workflow", "2h"),
    }


def test_numeric_literals(spark):
    want = {"5_000,": 5000.0, " 12n": 12.0, "3.": 3.0, "0x1F": 31.0, "0b101;": 5.0, "0O17": 15.0, "-0x10": None, "-4.5": -4.5, "+.5": 0.5, "1e3": 1000.0, ".": None, "": None, "x": None, "1.2.3": None, "n": None}
    rows = spark.createDataFrame([(k,) for k in want], "s string").select("s", text.numeric_literal(F.col("s")).alias("v")).collect()
    assert {r.s: r.v for r in rows} == want


def test_languages_and_categories(spark):
    paths = {"a.js": "javascript", "b.MTS": "typescript", "x/c.h": "c", "d.cxx": "cpp", "e.kt": "kotlin", "f.svelte": "svelte", "g.cs": "csharp", "h": "unknown", ".py": "unknown", "i.tar.gz": "unknown", "j.php": "php"}
    rules = {"validation": "validator", "request-validation": "validator", "query-builders": "database_operation", "promise-chains": "async_pattern", "config-objects": "config_access", "logger-patterns": "logger", "process-io": "process_io", "timing-patterns": "timing", "tracing-patterns": "tracing", "type-checking": "utility", "other": "utility", "error-responses": "error_handler", "auth-checks": "auth_check"}
    for table, of in ((paths, text.language), (rules, text.category)):
        rows = spark.createDataFrame([(k,) for k in table], "s string").select("s", of(F.col("s")).alias("v")).collect()
        assert {r.s: r.v for r in rows} == table
