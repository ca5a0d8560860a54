"""Semantic annotations of code: operations, domains, patterns, data types, and the intent they add up to."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import jaccard

#: What each operation looks like (any case), by name.
OPERATIONS = {
    "filter": (r"\.filter\s{0,20}\(",),
    "map": (r"\.map\s{0,20}\(",),
    "reduce": (r"\.reduce\s{0,20}\(",),
    "find": (r"\.find\s{0,20}\(", r"\.findIndex\s{0,20}\(", r"\.indexOf\s{0,20}\("),
    "some": (r"\.some\s{0,20}\(",),
    "every": (r"\.every\s{0,20}\(",),
    "sort": (r"\.sort\s{0,20}\(",),
    "includes": (r"\.includes\s{0,20}\(",),
    "iterate": (r"\.forEach\s{0,20}\(", r"for\s{0,20}\(\s{0,20}(?:const|let|var)\s{1,20}\w+\s{1,20}(?:of|in)", r"for\s{0,20}\(\s{0,20}(?:let|var)\s{1,20}\w+\s{0,20}=", r"while\s{0,20}\("),
    "flatten": (r"\.flat\s{0,20}\(", r"\.flatMap\s{0,20}\("),
    "concat": (r"\.concat\s{0,20}\(",),
    "slice": (r"\.slice\s{0,20}\(",),
    "splice": (r"\.splice\s{0,20}\(",),
    "append": (r"\.push\s{0,20}\(",),
    "remove": (r"\.pop\s{0,20}\(", r"\.shift\s{0,20}\("),
    "prepend": (r"\.unshift\s{0,20}\(",),
    "read": (r"\.(get|fetch|read|load|retrieve)\s{0,20}\(",),
    "create": (r"\.(post|create|insert|add|save|write)\s{0,20}\(",),
    "update": (r"\.(put|update|patch|modify|set)\s{0,20}\(",),
    "delete": (r"\.(delete|remove|destroy|clear)\s{0,20}\(",),
    "fetch": (r"fetch\s{0,20}\(", r"axios\.(get|post|put|patch|delete)\s{0,20}\(", r"http\.(get|post|put|patch|delete)\s{0,20}\("),
    "parse": (r"JSON\.parse\s{0,20}\(", r"parseInt\s{0,20}\(", r"parseFloat\s{0,20}\("),
    "serialize": (r"JSON\.stringify\s{0,20}\(",),
    "transform": (r"\.toString\s{0,20}\(", r"\.toUpperCase\s{0,20}\(", r"\.toLowerCase\s{0,20}\(", r"\.trim\s{0,20}\(", r"Number\s{0,20}\(", r"String\s{0,20}\(", r"Boolean\s{0,20}\("),
    "split": (r"\.split\s{0,20}\(",),
    "join": (r"\.join\s{0,20}\(",),
    "replace": (r"\.replace\s{0,20}\(",),
    "extract": (r"Object\.keys\s{0,20}\(", r"Object\.values\s{0,20}\(", r"Object\.entries\s{0,20}\("),
    "merge": (r"Object\.assign\s{0,20}\(",),
    "spread": (r"\.\.\.\w+",),
    "validate": (r"(validate|isValid|check|verify|assert)\s{0,20}\(", r"\.test\s{0,20}\(", r"\.match\s{0,20}\(", r"schema\.(validate|parse|safeParse)\s{0,20}\(", r"z\.\w+\s{0,20}\(", r"joi\.\w+", r"yup\.\w+"),
}
#: Words of each domain (any case).
DOMAINS = {
    "user": "user|users|account|accounts|profile|profiles|member",
    "auth": "auth|authentication|login|logout|signin|signout|token|session|jwt|oauth|password|credential|secret|apikey|api_key",
    "payment": "payment|charge|invoice|billing|subscription|stripe|paypal",
    "commerce": "order|orders|cart|checkout|purchase",
    "notification": "email|mail|notification|alert|notify|message|sms",
    "file": "file|files|upload|download|attachment|blob|storage",
    "database": "database|db|query|record|table|document|prisma|mongoose|sequelize|typeorm|knex",
    "cache": "cache|redis|memcached|cached",
    "queue": "queue|job|jobs|worker|task|tasks|bull|rabbitmq",
    "api": "api|endpoint|route|routes|request|response|req|res",
    "webhook": "webhook|webhooks|callback|hook",
    "event": "event|events|emit|publish|subscribe|listener",
    "logging": "log|logs|logger|logging|trace|debug|info|warn|error",
    "config": "config|configuration|settings|options|env|environment",
    "test": r"test|tests|spec|describe|it\s{0,20}\(|expect\s{0,20}\(",
}
#: What each code pattern looks like (any case).
PATTERNS = {
    "guard_clause": (r"if\s{0,20}\([^)]+\)\s{0,20}(?:return|throw)", r"if\s{0,20}\(\s{0,20}!\s{0,20}\w+\s{0,20}\)\s{0,20}(?:return|throw)"),
    "null_check": (r"===?\s{0,20}null\b", r"!==?\s{0,20}null\b", r"===?\s{0,20}undefined\b", r"!==?\s{0,20}undefined\b", r"\?\?", r"\?\s{0,20}\.", r"typeof\s{1,20}\w+\s{0,20}[!=]==?\s{0,20}[\"']undefined[\"']"),
    "error_handling": (r"try\s{0,20}\{", r"catch\s{0,20}\(", r"\.catch\s{0,20}\(", r"finally\s{0,20}\{", r"throw\s{1,20}new\s{1,20}\w*Error"),
    "retry_logic": (r"retry|retries|attempts|maxAttempts|backoff",),
    "timeout": (r"timeout|setTimeout|setInterval|clearTimeout|clearInterval",),
    "async_await": (r"async\s{1,20}", r"await\s{1,20}"),
    "promise_chain": (r"\.then\s{0,20}\(",),
    "promise_composition": (r"Promise\.(all|race|allSettled|any)\s{0,20}\(",),
    "promise_creation": (r"new\s{1,20}Promise\s{0,20}\(",),
    "caching": (r"cache\.(get|set|has|delete)", r"memoize|memo|cached"),
    "pagination": (r"\b(page|pages|offset|limit|cursor|skip|take)\b",),
    "batching": (r"\b(batch|batches|chunk|chunks)\b",),
    "streaming": (r"\b(stream|streams|pipe|readable|writable)\b",),
    "locking": (r"\b(lock|unlock|mutex|semaphore)\b",),
    "rate_limiting": (r"\b(rateLimit|throttle|debounce)\b",),
}
#: What shows each data type (case counts).
DATA_TYPES = {
    "array": (r"\[\s{0,20}\]", r"\bArray\b", r"\.length\b", r"Array\.isArray\s{0,20}\(", r"\.push\s{0,20}\("),
    "object": (r"\{\s{0,20}\}", r"\bObject\b", r"\.keys\s{0,20}\(", r"\.values\s{0,20}\(", r"\.entries\s{0,20}\(", r"\.hasOwnProperty\s{0,20}\("),
    "string": (r"['\"][^'\"]*['\"]", r"`[^`]*`", r"\.toString\s{0,20}\(", r"\.trim\s{0,20}\(", r"\.substring\s{0,20}\(", r"\.substr\s{0,20}\("),
    "number": (r"\b\d+\.?\d*\b", r"Number\s{0,20}\(", r"parseInt\s{0,20}\(", r"parseFloat\s{0,20}\(", r"Math\.\w+"),
    "boolean": (r"\b(true|false)\b", r"Boolean\s{0,20}\("),
    "date": (r"new\s{1,20}Date\s{0,20}\(", r"Date\.(now|parse)\s{0,20}\(", r"\.toISOString\s{0,20}\(", r"moment\s{0,20}\(", r"dayjs\s{0,20}\("),
    "promise": (r"\bPromise\b", r"\.then\s{0,20}\(", r"async\s{1,20}", r"await\s{1,20}"),
    "null": (r"\bnull\b",),
    "undefined": (r"\bundefined\b",),
    "map": (r"new\s{1,20}Map\s{0,20}\(",),
    "set": (r"new\s{1,20}Set\s{0,20}\(",),
    "collection": (r"\.has\s{0,20}\(",),
    "buffer": (r"\bBuffer\b", r"ArrayBuffer", r"Uint8Array"),
    "regex": (r"/[^/]+/[gim]*", r"new\s{1,20}RegExp\s{0,20}\("),
}
#: What ``\b`` stands for before and after an ASCII word character; Java's own also knows other letters, its ``\w`` doesn't.
#: A class of ranges in its place takes many times as long, and longer where threads share a machine.
NO_WORD_BEFORE, NO_WORD_AFTER = r"(?<!\w)", r"(?!\w)"
#: Weights of the four similarities.
WEIGHTS = {"operations": 0.40, "domains": 0.25, "patterns": 0.20, "data_types": 0.15}


def _plain(p: str) -> list[str]:
    """The words of a pattern that is words between two ``\\b``."""
    found = re.fullmatch(r"\\b\(?([A-Za-z0-9_|]+)\)?\\b", p)
    return found[1].split("|") if found else []


def _lead(p: str) -> str:
    """What each match of a pattern starts with; empty if alternatives or a class do."""
    found = re.match(r"(?:\\b)?((?:\\[^\w\s]|[^\\\[\](){}.*+?|^$])+)(?![?*{])", p)
    return re.sub(r"\\(.)", r"\1", found[1]) if found and "|" not in re.sub(r"\(.*?\)|\[.*?\]", "", p) else ""


def _java(p: str) -> str:
    """A pattern of the tables, where ``\\b`` stands at the ends alone, beside a word character. Leading digits are taken
    whole, which finds the same: a long row of them would be tried in all its parts."""
    first, last = NO_WORD_BEFORE * p.startswith(r"\b"), NO_WORD_AFTER * p.endswith(r"\b")
    return first + p.removeprefix(r"\b").removesuffix(r"\b").replace(r"\d+\.?\d*", r"\d++\.?\d*") + last


def _named(text: Column, table: dict, any_case: bool = True) -> Column:
    """The names with a pattern that is found.

    The text is cut into words once, for all patterns that are plain words. Where case counts, another pattern is only
    tried where the letters that it starts with are found, as a search for them costs a small part of it.
    """
    fold = str.lower if any_case else str
    words = {name: [fold(w) for p in ps for w in _plain(p)] for name, ps in table.items()}
    others = {name: [p for p in ps if not _plain(p)] for name, ps in table.items()}
    strings = lambda xs: F.array(*map(F.lit, xs))

    def tried(p: str) -> Column:
        hit = text.rlike(("(?i)" if any_case else "") + _java(p))
        return hit if any_case or not _lead(p) else F.contains(text, F.lit(_lead(p))) & hit

    def hits(known: Column | None = None) -> Column:
        tests = {n: [*([F.arrays_overlap(known, strings(words[n]))] if words[n] else []), *map(tried, others[n])] for n in table}
        return F.filter(F.array(*[F.when(reduce(operator.or_, ts), F.lit(n)) for n, ts in tests.items()]), lambda x: x.isNotNull())

    listed = sorted({w for ws in words.values() for w in ws})
    if not listed:
        return hits()
    # Only ASCII is left where letters are lowered: no other letter becomes one of A-Z.
    ascii_ = F.regexp_replace(text, r"\W+", " ")
    known = F.array_intersect(F.split(F.lower(ascii_) if any_case else ascii_, " "), strings(listed))
    # Bound in a lambda, so that the text is cut once.
    return F.get(F.transform(F.array(known), hits), F.lit(0))


def _domain_patterns() -> dict:
    """``DOMAINS`` as patterns. An alternative with a bracket ends on it, where ``\\b`` asks for a word character next."""
    parts = {name: alternatives.split("|") for name, alternatives in DOMAINS.items()}
    return {name: tuple(rf"\b{p}\b" if re.fullmatch(r"\w+", p) else rf"\b{p}(?=\w)" for p in ps) for name, ps in parts.items()}


def annotate(code: Column, tags: Column | None = None) -> dict[str, Column]:
    """``operations``, ``domains``, ``patterns``, ``data_types``: sorted arrays.

    A loop that appends under a condition does what filter and map do, and counts as both.
    """
    named = _named(code, OPERATIONS)
    both = F.array(F.lit("filter"), F.lit("map"))
    # Bound in a lambda, so that the patterns are tried once.
    composite = lambda n: F.array_contains(n, "iterate") & F.array_contains(n, "append") & code.rlike(r"\bif\s{0,20}\(")
    named = F.get(F.transform(F.array(named), lambda n: F.when(composite(n), F.array_union(n, both)).otherwise(n)), F.lit(0))
    text = code if tags is None else F.concat_ws(" ", code, F.array_join(tags, " "))
    return {
        "operations": F.array_sort(named),
        "domains": F.array_sort(_named(text, _domain_patterns())),
        "patterns": F.array_sort(_named(code, PATTERNS)),
        "data_types": F.array_sort(_named(code, DATA_TYPES, any_case=False)),
    }


def intent(operations: Column, domains: Column, patterns: Column) -> Column:
    """``a+b|on:c|with:d``, parts without members left out; ``unknown`` without any."""
    parts = [F.when(F.size(x) > 0, F.concat(F.lit(lead), F.array_join(x, "+"))) for lead, x in (("", operations), ("on:", domains), ("with:", patterns))]
    out = F.concat_ws("|", *parts)
    return F.when(out == "", "unknown").otherwise(out)


def intents_meet(a: Column, b: Column) -> Column:
    """Whether the first parts of two intents share a member; ``unknown`` meets none."""

    def first(x: Column) -> Column:
        return F.filter(F.split(F.split_part(x, F.lit("|"), F.lit(1)), r"\+"), lambda t: t != "")

    return (a != "unknown") & (b != "unknown") & F.arrays_overlap(first(a), first(b))


def similarity(a: str, b: str) -> Column:
    """The weighted Jaccard similarity of two annotated structs, columns ``a`` and ``b``."""
    out = None
    for name, weight in WEIGHTS.items():
        part = jaccard(F.col(f"{a}.{name}"), F.col(f"{b}.{name}")) * weight
        out = part if out is None else out + part
    return out
