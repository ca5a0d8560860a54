"""What test files repeat: patterns, texts and assertions, and what to do about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE

#: Patterns of test code by name.
PATTERNS = {
    "render_wait": f"render{SPACE}*\\([^)]+\\);{SPACE}*await{SPACE}+waitFor",
    "links": f"toHaveAttribute{SPACE}*\\({SPACE}*['\"]href['\"]",
    "semantic": f"getByRole{SPACE}*\\({SPACE}*['\"]heading['\"]|querySelector{SPACE}*\\({SPACE}*['\"]section#",
    "forms": f"userEvent\\.type|fireEvent\\.click|getByRole{SPACE}*\\({SPACE}*['\"]form['\"]",
}
TEXT, ASSERTION = f"getByText{SPACE}*\\({SPACE}*['\"]([^'\"]+)['\"]\\)", r"(expect\([^)]+\)\.[^;]+);"
#: A count beyond which something is recommended, and what.
ADVICE = (
    ("render_wait", 5, "Create renderAndWait helper to reduce render + waitFor boilerplate"),
    ("links", 5, "Create link assertion helpers (expectExternalLink, expectInternalLink, etc.)"),
    ("semantic", 5, "Create semantic validators (expectSectionWithId, expectHeadingLevel, etc.)"),
    ("forms", 5, "Create form helpers (fillContactForm, expectFormAccessibility, etc.)"),
    ("repeated_texts", 10, "Extract hardcoded strings to test-constants.ts"),
    ("repeated_assertions", 5, "Extract duplicate assertions to custom assertion helpers"),
)


def repeated_texts(files: DataFrame, content: str = "content", least: int = 3, longer_than: int = 5) -> DataFrame:
    """(text, n): texts longer than ``longer_than`` that all files together look for ``least`` times or more."""
    found = files.select(F.explode(F.regexp_extract_all(content, F.lit(TEXT), F.lit(1))).alias("text"))
    return found.filter(F.length("text") > longer_than).groupBy("text").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def repeated_assertions(files: DataFrame, content: str = "content", least: int = 3) -> DataFrame:
    """(assertion, n): assertions, up to their semicolon and with quoted texts left out, that occur ``least`` times or more."""
    found = files.select(F.explode(F.regexp_extract_all(content, F.lit(ASSERTION), F.lit(1))).alias("a"))
    return found.groupBy(F.regexp_replace("a", "['\"][^'\"]+['\"]", '""').alias("assertion")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def summary(files: DataFrame, content: str = "content") -> DataFrame:
    """One row: the files, the matches of each of ``PATTERNS``, and the numbers of repeated texts and assertions."""
    counts = [F.coalesce(F.sum(F.regexp_count(content, F.lit(p))), F.lit(0)).cast("long").alias(n) for n, p in PATTERNS.items()]
    out = files.agg(F.count("*").alias("files"), *counts)
    for name, rows in (("repeated_texts", repeated_texts(files, content)), ("repeated_assertions", repeated_assertions(files, content))):
        out = out.join(F.broadcast(rows.agg(F.count("*").alias(name))))  # one row each
    return out


def recommendations(summary_: DataFrame) -> DataFrame:
    """(advice): what the counts of ``summary`` recommend, in the order of ``ADVICE``."""
    told = F.filter(F.array(*[F.when(F.col(n) > most, F.lit(what)) for n, most, what in ADVICE]), lambda x: x.isNotNull())
    return summary_.select(F.posexplode(told).alias("at", "advice")).orderBy("at").select("advice")
