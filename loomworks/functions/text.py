"""Column functions on text and code: hashes, normal forms, features, names, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifiers that a normal form keeps.
METHODS = (
    "map", "filter", "reduce", "forEach", "find", "some", "every", "slice", "splice", "push", "pop", "shift", "unshift",
    "join", "split", "includes", "indexOf", "get", "set", "has", "delete", "keys", "values", "entries", "then", "catch",
    "finally", "async", "await", "reverse", "sort", "concat", "max", "min", "abs", "floor", "ceil", "round", "trim",
    "toLowerCase", "toUpperCase", "replace", "status", "json", "send", "redirect", "length", "name", "id", "type",
)
OBJECTS = ("Math", "Object", "Array", "String", "Number", "Boolean", "console", "process", "JSON", "Date", "Promise")
#: File extensions by language of a code block.
LANGUAGES = {
    "javascript": (".js", ".jsx", ".mjs", ".cjs"), "typescript": (".ts", ".tsx", ".mts", ".cts"), "python": (".py",), "ruby": (".rb",),
    "go": (".go",), "rust": (".rs",), "java": (".java",), "kotlin": (".kt",), "swift": (".swift",), "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp"), "csharp": (".cs",), "php": (".php",), "scala": (".scala",), "vue": (".vue",), "svelte": (".svelte",),
}
#: Categories of pattern rules; all others are "utility".
CATEGORIES = {
    "validator": ("validation", "request-validation"), "api_handler": ("express-route-handlers",), "auth_check": ("auth-checks",),
    "error_handler": ("error-responses",), "database_operation": ("prisma-operations", "query-builders", "connection-handling"),
    "async_pattern": ("await-patterns", "promise-chains"), "config_access": ("env-variables", "config-objects"),
    "logger": ("console-statements", "logger-patterns"), "process_io": ("process-io",), "timing": ("timing-patterns",), "tracing": ("tracing-patterns",),
}
#: Where a function's name stands, in the order in which they are tried.
FUNCTION_NAMES = (
    r"function\s+(\w+)\s*\(", r"const\s+(\w+)\s*=\s*(?:async\s+)?function", r"const\s+(\w+)\s*=\s*(?:async\s+)?\(",
    r"let\s+(\w+)\s*=\s*(?:async\s+)?function", r"let\s+(\w+)\s*=\s*(?:async\s+)?\(", r"var\s+(\w+)\s*=\s*(?:async\s+)?function",
    r"var\s+(\w+)\s*=\s*(?:async\s+)?\(", r"async\s+function\s+(\w+)\s*\(", r"(\w+)\s*:\s*function", r"(\w+)\s*:\s*async\s+function",
    r"export\s+function\s+(\w+)", r"export\s+const\s+(\w+)\s*=",
)
CONTROL = ("if", "else", "for", "while", "switch", "case", "try", "catch")
#: White space of ECMAScript regular expressions, which Java's \s lacks in part.
SPACE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: Words that carry no meaning in identifiers.
STOPWORDS = (
    "const", "let", "var", "function", "return", "true", "false", "null", "undefined", "import", "from", "export", "default",
    "async", "await", "new", "class", "extends", "public", "private", "protected", "static", "readonly", "string", "number",
    "boolean", "object", "record", "array", "json", "parse", "stringify", "error", "warn", "info", "debug", "log", "if", "else",
    "for", "while", "switch", "case", "try", "catch", "finally", "this", "that", "with", "without", "into", "then", "than",
    "and", "or", "file", "path", "line", "column", "message", "type", "value", "values",
)


def content_hash(text: Column, space: str = SPACE) -> Column:
    """First 16 hex digits of the sha256 of the text with each run of white space as one blank (not trimmed)."""
    return F.substring(F.sha2(F.regexp_replace(text, f"{space}+", " "), 256), 1, 16)


def block_id(path: Column, line: Column) -> Column:
    return F.concat(F.lit("cb_"), F.substring(F.sha2(F.concat_ws(":", path, line.cast("string")), 256), 1, 12))


def group_id(first_hash: Column, prefix: str = "dg_") -> Column:
    return F.concat(F.lit(prefix), F.substring(first_hash, 1, 12))


def cache_key(path: Column, commit: Column) -> Column:
    short = F.coalesce(F.substring(commit, 1, 7), F.lit("no-git"))
    return F.concat(F.lit("scan:"), F.substring(F.sha2(path, 256), 1, 16), F.lit(":"), short)


def normal_form(code: Column) -> Column:
    """Code with comments dropped, literals and names made alike, and spacing evened out.

    Names that begin with a small letter become ``var``, all-capital ones ``CONST``, but for ``METHODS`` and
    ``OBJECTS``. Comments go first, so a URL in a string is cut at its slashes.
    """
    kept = "|".join((*METHODS, *[o for o in OBJECTS if o[0].islower()]))
    upper = "|".join(("STR", "NUM", *[o for o in OBJECTS if o.isupper()]))
    out = F.regexp_replace(code, r"(?m)//.*?$", "")
    out = F.regexp_replace(out, r"(?s)/\*.*?\*/", "")
    out = F.regexp_replace(out, f"{SPACE}+", " ")
    for quote in ("'", '"', "`"):
        out = F.regexp_replace(out, f"{quote}[^{quote}]*{quote}", f"{quote}STR{quote}")
    word = r"(?<![A-Za-z0-9_])"
    end = r"(?![A-Za-z0-9_])"
    out = F.regexp_replace(out, rf"{word}[0-9]+{end}", "NUM")
    out = F.regexp_replace(out, rf"{word}(?!(?:{kept}){end})[a-z][a-zA-Z0-9_]*{end}", "var")
    out = F.regexp_replace(out, rf"{word}(?!(?:{upper}){end})[A-Z][A-Z0-9_]*{end}", "CONST")
    out = F.regexp_replace(out, r"\s*([(){}\[\];,.])\s*", "$1")
    out = F.regexp_replace(out, r"\s*(=>|===?|!==?|[+\-*/%<>=&|])\s*", " $1 ")
    return F.coalesce(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(""))


def _found(code: Column, pairs) -> Column:
    """Sorted distinct names whose pattern is found in the code."""
    hits = F.array(*[F.when(code.rlike(p), F.lit(name)) for p, name in pairs])
    return F.array_sort(F.array_distinct(F.filter(hits, lambda x: x.isNotNull())))


def status_codes(code: Column, receivers: bool = False) -> Column:
    """Sorted distinct three-digit codes of ``.status(...)``; with ``receivers``, of ``res`` and ``response`` alone."""
    pattern = r"(?:res|response)\.status\(([0-9]{3})\)" if receivers else r"\.status\(([0-9]{3})\)"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(code, F.lit(pattern), F.lit(1))))


def operators(code: Column) -> Column:
    return _found(code, ((r"!==", "!=="), (r"===", "==="), (r"!=", "!="), (r"==", "=="), (r"!\s*[^=]", "!"), (r"&&", "&&"), (r"\|\|", "||")))


def strict_operators(code: Column) -> Column:
    """Operators as the exact layer sees them: the loose ones only where the strict ones are absent."""
    has = code.contains
    hits = F.array(
        F.when(has("!=="), "!=="),
        F.when(has("==="), "==="),
        F.when(has("!=") & ~has("!=="), "!="),
        F.when(has("==") & ~has("==="), "=="),
        F.when(code.rlike(r"(?<![!=])!(?!=)"), "!"),
    )
    return F.array_sort(F.filter(hits, lambda x: x.isNotNull()))


def called_methods(code: Column) -> Column:
    names = ("Math.max", "Math.min", "Math.floor", "Math.ceil", "Math.round", "console.log", "console.error", "console.warn", ".reverse", ".toUpperCase", ".toLowerCase")
    return _found(code, [(n.replace(".", r"\.") + r"\s*\(", n) for n in names])


def math_methods(code: Column) -> Column:
    hits = F.array(*[F.when(code.contains(f"Math.{m}"), F.lit(f"Math.{m}")) for m in ("max", "min", "floor", "ceil")])
    return F.array_sort(F.filter(hits, lambda x: x.isNotNull()))


def method_chain(code: Column) -> Column:
    """Names of all ``.name(`` calls in order, if there are two or more; else none."""
    names = F.regexp_extract_all(code, F.lit(r"\.([a-zA-Z_][a-zA-Z0-9_]*)\s*\("), F.lit(1))
    return F.when(F.size(names) >= 2, names).otherwise(F.array().cast("array<string>"))


def chain_similarity(a: Column, b: Column) -> Column:
    """1 for equal chains, 0.5 if one is missing, the share of a prefix, or of equal places for equal lengths."""
    n, m = F.size(a), F.size(b)
    short, long = F.least(n, m), F.greatest(n, m)
    prefix = F.slice(a, 1, short) == F.slice(b, 1, short)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return (
        F.when(a == b, 1.0)
        .when((n == 0) | (m == 0), 0.5)
        .when(n != m, F.when(prefix, short / long).otherwise(0.0))
        .otherwise(same / n)
    )


def complexity(code: Column) -> dict[str, Column]:
    """Lines with text, distinct words, and whether a control word occurs anywhere, even within a word."""
    lines = F.size(F.filter(F.split(code, "\n"), lambda x: F.length(F.trim(F.regexp_replace(x, r"\s+", " "))) > 0))
    words = F.size(F.array_distinct(F.regexp_extract_all(code, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))))
    control = F.lit(False)
    for w in CONTROL:
        control = control | code.contains(w)
    return {"n_lines": lines, "n_tokens": words, "has_control": control}


def complex_enough(code: Column, min_lines: int = 1, min_tokens: int = 5) -> Column:
    c = complexity(code)
    return (c["n_lines"] >= min_lines) & ((c["n_tokens"] >= min_tokens) | c["has_control"])


def _from_lists(key: Column, lists: dict[str, tuple[str, ...]], default: str) -> Column:
    out = None
    for name, values in lists.items():
        out = F.when(key.isin(*values), name) if out is None else out.when(key.isin(*values), name)
    return out.otherwise(default)


def language(path: Column) -> Column:
    return _from_lists(F.lower(F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1)), LANGUAGES, "unknown")


def category(rule: Column) -> Column:
    return _from_lists(rule, CATEGORIES, "utility")


def function_name(code: Column) -> Column:
    """The name by the first pattern that is found; null if none is."""
    return F.coalesce(*[F.nullif(F.regexp_extract(code, p, 1), F.lit("")) for p in FUNCTION_NAMES])


def function_tag(tags: Column) -> Column:
    """What follows ``function:`` in the first such tag."""
    return F.substring(F.get(F.filter(tags, lambda t: t.startswith("function:")), F.lit(0)), len("function:") + 1, 1 << 20)


def identifier_tokens(text: Column) -> Column:
    """Small-letter words of identifiers, split at case changes and marks; no stopwords, numbers or single letters."""
    spaced = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    parts = F.regexp_extract_all(F.lower(spaced), F.lit(r"[a-z0-9]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_except(F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.rlike(r"^[0-9]+$")), stop)


def numeric_literal(text: Column) -> Column:
    """The number that a literal stands for: marks, ``n``, a last point and underscores dropped; 0x, 0o and 0b read."""
    t = F.regexp_replace(F.trim(text), r"[,;:]$", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"n$", ""), r"(?<=.)\.$", ""), "_", "")
    digits = F.lower(F.regexp_extract(t, r"^0[xXoObB](.*)$", 1))
    case = None
    for mark, of, base in (("[xX]", "[0-9A-Fa-f]+", 16), ("[oO]", "[0-7]+", 8), ("[bB]", "[01]+", 2)):  # these take no sign
        hit = t.rlike(f"^0{mark}{of}$")
        case = F.when(hit, F.conv(digits, base, 10).cast("double")) if case is None else case.when(hit, F.conv(digits, base, 10).cast("double"))
    return case.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def jaccard(a: Column, b: Column, both_empty: float = 1.0, one_empty: float = 0.5) -> Column:
    """Shared over all distinct items, with the values for empty sets as the caller's convention has them."""
    n, m = F.size(a), F.size(b)
    return F.when((n == 0) & (m == 0), both_empty).when((n == 0) | (m == 0), one_empty).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def safe_id(text: Column) -> Column:
    """Anything but letters, digits, ``_`` and ``-`` as ``-``, at most 100 characters."""
    return F.substring(F.regexp_replace(text, r"[^a-zA-Z0-9_-]", "-"), 1, 100)


def log_field(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"[\r\n\t]", " "), 1, 200)


def escape_html(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def format_bytes(n: Column) -> Column:
    """``0 B`` to ``x.y TB``, by powers of 1024."""
    units = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")])
    power = F.least(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0)) + 1e-12), F.lit(4)).cast("int")
    return F.when(n <= 0, "0 B").otherwise(F.concat_ws(" ", F.round(n / F.pow(F.lit(1024.0), power), 2).cast("string"), F.get(units, power)))


def redact_url(text: Column) -> Column:
    """A connection string without its user and password."""
    return F.regexp_replace(text, r"//[^@/]+@", "//***@")


def rounded(x: Column, digits: int = 2) -> Column:
    """Half up on the binary value, as ``floor(x * 10**digits + 0.5) / 10**digits``."""
    return F.floor(x * 10**digits + 0.5).cast("double") / 10**digits


def duration_text(seconds: Column) -> Column:
    """``1h 2m 3s``, ``2m 3s`` or ``3s``."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def report_kind(days: Column) -> Column:
    return F.when(days <= 7, "Weekly").when(days <= 31, "Monthly").otherwise(F.concat(days.cast("string"), F.lit("-Day")))
