"""Code by its brackets: extents of calls and bodies, and the findings that need them.

A file is cut into segments: brackets, texts and comments, which count as one piece whatever they hold, and what is
between. Running sums over a file's segments give each one's place and line, and each bracket's level. At one level
brackets open and close in turn, so an opening one's partner is the next of its level; no stack is kept. All windows
are over one file's segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A comment or a text; in a template, what it holds counts as text.
_OPAQUE = r"//[^\n]*|/\*(?s:.*?)\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\(?s:.)|[^`\\])*`"
_SEGMENT = rf"{_OPAQUE}|[()\[\]{{}}]|(?:(?!//|/\*)[^()\[\]{{}}'\"`])+|(?s:.)"


def segments(files: DataFrame, key: str = "file_path", content: str = "content") -> DataFrame:
    """(key, at, text, begin, line, level) of the segments of every file, ``at`` from 0, ``begin`` and ``line`` from 0.

    An opening bracket and its partner have the level of what stands in between; other segments have 0.
    """
    rows = files.select(key, F.posexplode(F.regexp_extract_all(F.col(content), F.lit(_SEGMENT), F.lit(0))).alias("at", "text"))
    before = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens, closes = F.col("text").isin("(", "[", "{"), F.col("text").isin(")", "]", "}")
    sum_ = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0))
    depth = sum_(F.when(opens, 1).when(closes, -1).otherwise(0), so_far)
    return rows.select(
        key, "at", "text", sum_(F.length("text"), before).alias("begin"), sum_(F.length(F.regexp_replace("text", r"[^\n]", "")), before).alias("line"),
        F.when(opens, depth).when(closes, depth + 1).otherwise(0).alias("level"),
    )


def pairs(segments_: DataFrame, key: str = "file_path") -> DataFrame:
    """``segments_`` with ``partner``, the segment that closes an opening bracket, ``end`` and ``end_line`` behind it; null for all others."""
    bracket = F.col("text").isin("(", "[", "{", ")", "]", "}")
    w = Window.partitionBy(key, "level", bracket).orderBy("at")
    fits = F.translate("text", "([{", ")]}") == F.lead("text").over(w)
    told = F.when(F.col("text").isin("(", "[", "{") & fits, F.struct(F.lead("at").over(w).alias("at"), (F.lead("begin").over(w) + 1).alias("end"), F.lead("line").over(w).alias("line")))
    return segments_.withColumn("p", told).select("*", F.col("p.at").alias("partner"), F.col("p.end").alias("end"), F.col("p.line").alias("end_line")).drop("p")


def _near(n: int, key: str) -> Column:
    """The ``n``-th segment after this one (before it, if negative)."""
    return F.lead("text", n).over(Window.partitionBy(key).orderBy("at"))


def extents(files: DataFrame, key: str = "file_path", content: str = "content") -> DataFrame:
    """(key, kind, line_start, line_end, matched_text) of three things, lines from 0.

    ``race``: a ``Promise.race`` call whose one argument is an array. ``async``: an async function or method of a name,
    its parameters and its body, with nothing but white space between. ``loading``: a ``setLoading`` call with an argument.
    """
    rows = pairs(segments(files, key, content), key)
    # White space between brackets is a segment, too: partners are looked up with their neighbours.
    sides = rows.select(key, F.col("at").alias("p_at"), F.when(_near(1, key).rlike(r"^\s*$"), _near(2, key)).otherwise(_near(1, key)).alias("p_next"), F.when(_near(1, key).rlike(r"^\s*$"), 2).otherwise(1).alias("p_skip"))
    head = _near(-1, key)
    told = rows.withColumn("head", head).withColumn("next", F.when(_near(1, key).rlike(r"^\s*$"), _near(2, key)).otherwise(_near(1, key))).withColumn("skip", F.when(_near(1, key).rlike(r"^\s*$"), 2).otherwise(1))
    calls = told.filter((F.col("text") == "(") & F.col("partner").isNotNull())
    at = lambda p: F.length(F.regexp_extract("head", p, 0))
    race, async_, load = r"(?<![\w.$])Promise\s*\.\s*race\s*$", r"(?<![\w.$])async\s+(?:function\s+)?[A-Za-z_$][\w$]*\s*$", r"(?<![\w.$])setLoading\s*$"
    brackets = rows.filter(F.col("partner").isNotNull()).select(key, F.col("at").alias("b_at"), F.col("text").alias("b_text"), F.col("partner").alias("b_partner"), F.col("end").alias("b_end"), F.col("end_line").alias("b_line"))
    races = calls.filter(F.col("head").rlike(race) & (F.col("next") == "[")).withColumn("b_at", F.col("at") + F.col("skip")).join(brackets, [key, "b_at"])
    races = races.join(sides.withColumnRenamed("p_at", "b_partner"), [key, "b_partner"]).filter((F.col("b_partner") + F.col("p_skip") == F.col("partner")) & (F.col("p_next") == ")"))
    races = races.select(key, F.lit("race").alias("kind"), (F.col("begin") - at(race)).alias("begin"), "end", F.col("end_line").alias("line_end"))
    bodies = calls.filter(F.col("head").rlike(async_)).join(sides.withColumnRenamed("p_at", "partner"), [key, "partner"]).filter(F.col("p_next") == "{")
    bodies = bodies.withColumn("b_at", F.col("partner") + F.col("p_skip")).join(brackets, [key, "b_at"])
    bodies = bodies.select(key, F.lit("async").alias("kind"), (F.col("begin") - at(async_)).alias("begin"), F.col("b_end").alias("end"), F.col("b_line").alias("line_end"))
    loads = calls.filter(F.col("head").rlike(load) & (F.col("partner") > F.col("at") + 1))
    loads = loads.select(key, F.lit("loading").alias("kind"), (F.col("begin") - at(load)).alias("begin"), "end", F.col("end_line").alias("line_end"))
    found = races.unionByName(bodies).unionByName(loads).join(files.select(key, F.col(content).alias("__c")), key)
    text = F.substring("__c", F.col("begin") + 1, F.col("end") - F.col("begin"))
    line = F.length(F.regexp_replace(F.substring("__c", F.lit(1), F.col("begin")), r"[^\n]", ""))
    return found.select(key, "kind", line.alias("line_start"), "line_end", text.alias("matched_text"))


def findings(files: DataFrame, key: str = "file_path", content: str = "content", utility: str = "src/utils/timeout.ts") -> DataFrame:
    """(key, line_start, line_end, severity, category, matched_text) of the five pattern finders over script files.

    A race whose text has no timeout; every ``setLoading(true)``; an async body without try and catch in its text; the
    absence of the ``utility`` file; the first ``setLoading`` of a TypeScript file that somewhere sets it to true and
    has no safety net (effect, timer, reset and its clearing). Keys are paths and are distinct; null contents have none.
    """
    scripts = files.filter(F.col(key).rlike(r"\.(?:ts|tsx|js|jsx)$")).select(key, content)
    rows = extents(scripts, key, content)
    text, none = F.col("matched_text"), F.lower("matched_text")
    out = rows.filter((F.col("kind") == "race") & ~none.contains("timeout")).select(key, "line_start", "line_end", F.lit("high").alias("severity"), F.lit("promise_race_no_timeout").alias("category"), "matched_text")
    true = F.regexp_replace("matched_text", r"\s", "") == "setLoading(true)"
    out = out.unionByName(rows.filter((F.col("kind") == "loading") & true).select(key, "line_start", "line_end", F.lit("medium").alias("severity"), F.lit("loading_without_finally").alias("category"), "matched_text"))
    out = out.unionByName(rows.filter((F.col("kind") == "async") & ~(text.contains("try") & text.contains("catch"))).select(key, "line_start", "line_end", F.lit("medium").alias("severity"), F.lit("async_no_error_handling").alias("category"), "matched_text"))
    typed = rows.filter((F.col("kind") == "loading") & F.col(key).rlike(r"\.(?:ts|tsx)$"))
    first = typed.groupBy(key).agg(F.min(F.struct("line_start", "line_end", "matched_text")).alias("m"), F.max(text.contains("true")).alias("on")).filter("on")
    c = F.col(content)
    net = c.contains("useEffect") & c.contains("setTimeout") & c.contains("setLoading(false)") & c.contains("return () => clearTimeout")
    first = first.join(scripts.filter(~net).select(key), key, "left_semi")
    out = out.unionByName(first.select(key, "m.line_start", "m.line_end", F.lit("low").alias("severity"), F.lit("missing_loading_safety_net").alias("category"), "m.matched_text"))
    missing = files.agg(F.count_if(F.col(key) == utility).alias("n")).filter("n = 0")
    return out.unionByName(missing.select(F.lit(utility).alias(key), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit("info").alias("severity"), F.lit("missing_timeout_utility").alias("category"), F.lit("").alias("matched_text")))


def tally(found: DataFrame, key: str = "file_path") -> DataFrame:
    """One row of scan statistics: issues, affected files, and issues by severity."""
    by = {s: F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low", "info")}
    return found.agg(F.count("*").alias("total_issues"), F.countDistinct(key).alias("affected_files"), *by.values())
