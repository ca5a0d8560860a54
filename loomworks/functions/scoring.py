"""Scores and rule tables of duplicate groups, suggestions, health and accuracy: plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import rounded

#: Multipliers of return on investment.
COMPLEXITY_FACTORS = {"trivial": 1.3, "simple": 1.1, "moderate": 0.9, "complex": 0.7}
RISK_FACTORS = {"minimal": 1.2, "low": 1.1, "medium": 0.9, "high": 0.7}
CROSS_COMPLEXITY_FACTORS = {"simple": 1.1, "moderate": 1.0, "complex": 0.8}
CROSS_RISK_FACTORS = {"low": 1.1, "medium": 1.0, "high": 0.8}
CROSS_BONUSES = {"api_handler": 10, "auth_check": 10, "database_operation": 8, "validator": 8, "error_handler": 6}
#: Hours of work by complexity; any other takes 2.
EFFORT_HOURS = {"trivial": 0.5, "simple": 1.0, "moderate": 3.0, "complex": 8.0}
#: By family of categories, (most occurrences or None, strategy, complexity, risk).
STRATEGIES = {
    ("logger", "config_access"): ((5, "local_util", "trivial", "minimal"), (None, "shared_package", "simple", "low")),
    ("api_handler", "auth_check", "error_handler"): ((3, "local_util", "simple", "low"), (10, "shared_package", "moderate", "medium"), (None, "mcp_server", "complex", "high")),
    ("database_operation",): ((3, "local_util", "moderate", "medium"), (None, "shared_package", "complex", "high")),
    (): ((3, "local_util", "simple", "minimal"), (8, "shared_package", "simple", "low"), (None, "mcp_server", "moderate", "medium")),
}
#: Places of shared code by category.
SHARED_PLACES = {"logger": "shared/logging/logger-utils.js", "api_handler": "shared/middleware/auth-middleware.js", "auth_check": "shared/middleware/auth-middleware.js", "database_operation": "shared/database/query-builder.js", "validator": "shared/validation/validators.js"}
#: Steps of each strategy, as (what, automated, time).
STEPS = {
    "local_util": (("Create utility function in local utils module", True, "15min"), ("Extract common logic from duplicate blocks", False, "30min"), ("Replace each occurrence with function call", True, "20min"), ("Add unit tests for extracted function", False, "30min"), ("Run existing tests to verify behavior", True, "10min")),
    "shared_package": (("Create shared package/module for utility", False, "1h"), ("Extract and parameterize common logic", False, "1h"), ("Add comprehensive tests to shared package", False, "45min"), ("Update each file to import from shared package", True, "30min"), ("Replace duplicates with shared function calls", True, "30min"), ("Update package.json/requirements.txt dependencies", False, "15min"), ("Run full test suite across affected projects", True, "20min")),
    "mcp_server": (("Design MCP tool interface for functionality", False, "2h"), ("Create MCP server with tool implementation", False, "4h"), ("Add MCP tool schema and documentation", False, "1h"), ("Test MCP tool independently", False, "1h"), ("Update projects to use MCP client", False, "2h"), ("Replace duplicates with MCP tool calls", True, "1h"), ("Add integration tests", False, "2h"), ("Document MCP tool usage", False, "1h")),
    "autonomous_agent": (("Define agent capabilities and workflow", False, "3h"), ("Design agent prompt and tool access", False, "2h"), ("Implement agent logic and orchestration", False, "8h"), ("Create agent tests and safety checks", False, "3h"), ("Integrate agent with existing systems", False, "4h"), ("Replace complex duplicate logic with agent calls", False, "2h"), ("Monitor agent performance and behavior", False, "ongoing"), ("Document agent usage and limitations", False, "2h")),
}


def lookup(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def impact(occurrences: Column, similarity: Column, lines: Column) -> Column:
    """0 to 100: 40 for occurrences (full at 20), 35 for similarity, 25 for lines (full at 100)."""
    return rounded(F.least(occurrences / 20.0, F.lit(1.0)) * 40 + similarity * 35 + F.least(lines / 100.0, F.lit(1.0)) * 25)


def priority(score: Column) -> Column:
    return F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "medium").otherwise("low")


def dedup_potential(occurrences: Column, lines: Column) -> Column:
    return F.when(occurrences <= 1, 0).otherwise(F.floor((occurrences - 1) * (lines / occurrences))).cast("long")


def consistency(categories: Column, patterns: Column) -> Column:
    """By the numbers of distinct categories and patterns in a group."""
    return F.when((categories == 1) & (patterns == 1), 1.0).when(categories == 1, 0.7).when(patterns == 1, 0.5).otherwise(0.3)


def group_quality(similarity: Column, members: Column, mean_lines: Column, consistent: Column) -> Column:
    """Groups of 0.7 or more are accepted; the order of the sum is kept, as some land on that value."""
    return similarity * 0.4 + F.least(members / 4.0, F.lit(1.0)) * 0.2 + F.least(mean_lines / 10.0, F.lit(1.0)) * 0.2 + consistent * 0.2


def strategy(category: Column, occurrences: Column, files: Column) -> Column:
    """Struct (strategy, complexity, risk) by the rule tables; all in one file is a local extraction."""

    def made(s: str, c: str, r: str) -> Column:
        return F.struct(F.lit(s).alias("strategy"), F.lit(c).alias("complexity"), F.lit(r).alias("risk"))

    def rules(rows) -> Column:
        out = None
        for most, *rest in rows:
            if most is None:
                out = made(*rest) if out is None else out.otherwise(made(*rest))
            else:
                out = F.when(occurrences <= most, made(*rest)) if out is None else out.when(occurrences <= most, made(*rest))
        return out

    out = F.when(files == 1, made("local_util", "trivial", "minimal"))
    for family, rows in STRATEGIES.items():
        out = out.when(category.isin(*family), rules(rows)) if family else out.otherwise(rules(rows))
    return out


#: Why each strategy is proposed, by the families of ``STRATEGIES``, in their order.
RATIONALES = {
    ("logger", "config_access"): ("Logger/config pattern used {occ} times - extract to module constant", "Logger/config pattern used {occ} times across {files} files - centralize configuration"),
    ("api_handler", "auth_check", "error_handler"): ("API pattern used {occ} times - extract to middleware/util", "API pattern used {occ} times across {files} files - create shared middleware", "API pattern used {occ} times - candidate for framework/MCP abstraction"),
    ("database_operation",): ("Database pattern used {occ} times - extract to repository method", "Database pattern used {occ} times - create shared query builder"),
    (): ("Utility pattern used {occ} times in {files} files - extract to local util", "Utility pattern used {occ} times across {files} files - create shared utility", "Utility pattern used {occ} times - consider MCP tool or shared package"),
}
ONE_FILE = "All {occ} occurrences in same file - extract to local function"


def rationale(category: Column, chosen: Column, occurrences: Column, files: Column) -> Column:
    """Why the ``chosen`` strategy of a group is proposed."""
    out = F.when(files == 1, F.lit(ONE_FILE))
    for family, rows in STRATEGIES.items():
        told = F.lit(None).cast("string")
        for (_, name, _, _), text in zip(rows, RATIONALES[family]):
            told = F.when(chosen == name, F.lit(text)).otherwise(told)
        out = out.when(category.isin(*family), told) if family else out.otherwise(told)
    return F.replace(F.replace(out, F.lit("{occ}"), occurrences.cast("string")), F.lit("{files}"), files.cast("string"))


def roi(score: Column, complexity: Column, risk: Column) -> Column:
    return F.least(score * lookup(complexity, COMPLEXITY_FACTORS, 1.0) * lookup(risk, RISK_FACTORS, 1.0), F.lit(100.0))


def effort(complexity: Column, files: Column) -> Column:
    return rounded(lookup(complexity, EFFORT_HOURS, 2.0) + files * 0.25 + 0.5, 1)


def confidence(similarity: Column) -> Column:
    return F.when(similarity >= 0.95, 0.9).otherwise(0.7)


def breaking(chosen: Column, category: Column) -> Column:
    return F.when(chosen == "local_util", False).when(chosen == "shared_package", category.isin("api_handler", "auth_check")).otherwise(True)


def target_place(chosen: Column, category: Column, pattern: Column, first_file: Column) -> Column:
    folder = F.regexp_extract(first_file, r"^(.*)/[^/]*$", 1)
    local = F.when(first_file.contains("/"), F.concat(folder, F.lit("/utils.js"))).otherwise("utils.js")
    shared = F.concat(F.lit("shared/utils/"), category, F.lit(".js"))
    for k, v in SHARED_PLACES.items():
        shared = F.when(category == k, F.lit(v)).otherwise(shared)
    server = F.concat(F.lit("mcp-servers/"), pattern, F.lit("-server/"))
    return F.when(chosen == "local_util", local).when(chosen == "shared_package", shared).when(chosen == "mcp_server", server).otherwise(F.concat(F.lit("agents/"), pattern, F.lit("-agent/")))


def steps(chosen: Column) -> Column:
    """Array of structs (step, what, automated, time)."""
    out = None
    for name, rows in STEPS.items():
        made = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(w).alias("what"), F.lit(a).alias("automated"), F.lit(t).alias("time")) for i, (w, a, t) in enumerate(rows)])
        out = F.when(chosen == name, made) if out is None else out.when(chosen == name, made)
    return out


def cross_impact(occurrences: Column, repositories: Column, lines: Column, category: Column) -> Column:
    raw = F.least(occurrences * 5, F.lit(40)) + repositories * 15 + F.least(lines / 2.0, F.lit(20.0)) + lookup(category, CROSS_BONUSES, 0)
    return F.least(raw.cast("double"), F.lit(100.0))


def cross_strategy(occurrences: Column, repositories: Column, category: Column) -> Column:
    few = (repositories <= 3) & (occurrences <= 10)
    server = (repositories >= 4) | F.coalesce(category.isin("api_handler", "database_operation"), F.lit(False))
    return F.when(few, "shared_package").when(server, "mcp_server").when(occurrences >= 20, "autonomous_agent").otherwise("shared_package")


def cross_complexity(repositories: Column) -> Column:
    return F.when(repositories == 2, "simple").when(repositories == 3, "moderate").otherwise("complex")


def cross_risk(chosen: Column) -> Column:
    return F.when(chosen == "shared_package", "medium").otherwise("high")


def cross_roi(score: Column, complexity: Column, risk: Column) -> Column:
    return F.least(score * 1.2 * lookup(complexity, CROSS_COMPLEXITY_FACTORS, 1.0) * lookup(risk, CROSS_RISK_FACTORS, 1.0), F.lit(100.0))


def health(issues: Column, warnings: Column, successes: Column) -> Column:
    total = issues + warnings + successes
    raw = 100 - (issues * 20 + warnings * 5) + successes * 10 / total
    return F.when(total == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


def schema_impact(seo: Column, rich: Column, description: Column, repository: Column) -> Column:
    return F.least(F.lit(100), seo * 15 + rich * 20 + F.when(description, 20).otherwise(0) + F.when(repository, 15).otherwise(0))


def schema_rating(score: Column) -> Column:
    return F.when(score >= 80, "Excellent").when(score >= 60, "Good").when(score >= 40, "Fair").otherwise("Needs Improvement")


def backoff(attempt: Column, base: float, factor: float, most: float) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt - 1), F.lit(most))


def cooldown_ms(failures: Column) -> Column:
    return F.least(60_000 * F.pow(F.lit(2.0), failures), F.lit(600_000.0)).cast("long")


def reduction_percent(movable: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(100 * movable / total + 0.5)).otherwise(0).cast("long")


def ratio(part: Column, *rest: Column) -> Column:
    """``part`` over the sum of all; 0 if that is 0."""
    total = part
    for r in rest:
        total = total + r
    return F.when(total == 0, 0.0).otherwise(part / total)


def grade(precision: Column, recall: Column, f1: Column, fpr: Column) -> Column:
    score = precision * 0.35 + recall * 0.35 + f1 * 0.20 + (1 - fpr) * 0.10
    out = F.when(score >= 0.95, "A+")
    for least, name in ((0.90, "A"), (0.85, "B+"), (0.80, "B"), (0.75, "C+"), (0.70, "C"), (0.60, "D")):
        out = out.when(score >= least, name)
    return out.otherwise("F")
