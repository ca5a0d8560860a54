"""Error classification: code, then HTTP status, then message, then a safe default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Delays in milliseconds.
SERVER_DELAY, NETWORK_DELAY, RATE_DELAY = 10_000, 5_000, 60_000
#: Error codes that pass, by delay, and those that do not.
RETRYABLE_CODES = {SERVER_DELAY: ("ETIMEDOUT", "ERR_HTTP_500", "ERR_HTTP_502", "ERR_HTTP_503", "ERR_HTTP_504"), NETWORK_DELAY: ("ECONNRESET", "EHOSTUNREACH", "ENETUNREACH", "EPIPE", "EAGAIN", "EBUSY")}
PERMANENT_CODES = (
    "ENOENT", "ENOTDIR", "EISDIR", "EACCES", "EPERM", "EINVAL", "EEXIST", "ENOTFOUND", "ECONNREFUSED",
    "ERR_INVALID_ARG_TYPE", "ERR_INVALID_ARG_VALUE", "ERR_MODULE_NOT_FOUND", "ERR_REQUIRE_ESM", "ERR_UNKNOWN_FILE_EXTENSION",
    "ERR_HTTP_400", "ERR_HTTP_401", "ERR_HTTP_403", "ERR_HTTP_404", "ERR_HTTP_405", "ERR_HTTP_409", "ERR_HTTP_422",
)
#: Message parts in the order in which they are tried, with the delay of those that pass.
PERMANENT_MESSAGES = ("invalid repository path", "not a git repository", "permission denied", "access denied", "authentication failed", "invalid credentials", "malformed", "invalid format", "parse error", "syntax error", "validation error", "schema error")
RETRYABLE_MESSAGES = {"rate limit": RATE_DELAY, "too many requests": RATE_DELAY, "timeout": NETWORK_DELAY, "timed out": NETWORK_DELAY, "connection reset": NETWORK_DELAY, "service unavailable": NETWORK_DELAY, "temporarily unavailable": NETWORK_DELAY, "try again": NETWORK_DELAY}


def _told(retry: bool, reason: Column, delay: int = 0) -> Column:
    return F.struct(F.lit("retryable" if retry else "non_retryable").alias("category"), reason.alias("reason"), F.lit(delay).cast("long").alias("delay"))


def classify(code: Column, status: Column, message: Column) -> Column:
    """Struct (category, reason, delay) of an error's code, HTTP status and message; all three null is no error."""
    by_code = F.concat(F.lit("Error code '"), code, F.lit("' indicates "))
    by_status = F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" indicates "))
    text = F.lower(F.coalesce(message, F.lit("")))
    out = F.when(code.isNull() & status.isNull() & message.isNull(), _told(False, F.lit("No error provided")))
    for delay, codes in RETRYABLE_CODES.items():
        out = out.when(code.isin(*codes), _told(True, F.concat(by_code, F.lit("transient failure")), delay))
    out = out.when(code.isin(*PERMANENT_CODES), _told(False, F.concat(by_code, F.lit("permanent failure"))))
    out = out.when(status == 429, _told(True, F.concat(by_status, F.lit("rate limit")), RATE_DELAY))
    out = out.when(status.between(400, 499), _told(False, F.concat(by_status, F.lit("client error"))))
    out = out.when(status.between(500, 599), _told(True, F.concat(by_status, F.lit("server error")), SERVER_DELAY))
    for part in PERMANENT_MESSAGES:
        out = out.when(text.contains(part), _told(False, F.lit(f"Error message contains '{part}'")))
    for part, delay in RETRYABLE_MESSAGES.items():
        out = out.when(text.contains(part), _told(True, F.lit(f"Error message contains '{part}'"), delay))
    return out.otherwise(_told(False, F.lit("Unknown error type - treating as non-retryable for safety")))


def family(reason: Column) -> Column:
    """network, http, file_system or unknown, by words of the reason."""
    r = F.lower(reason)

    def has(*parts: str) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | r.contains(p)
        return out

    return F.when(has("network", "connection", "timeout"), "network").when(has("http"), "http").when(has("file", "directory", "permission"), "file_system").otherwise("unknown")


def next_attempt(category: Column, retries: Column, most: int = 3) -> Column:
    """``requeue`` while an error passes and retries are left, else ``fail``."""
    return F.when((category == "retryable") & (retries < most), "requeue").otherwise("fail")
