"""Report and bookkeeping operators: identifiers, listings, retention, summaries, caches, alerts, client feeds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Rounds

#: Keys that a caller may not set on a retried job.
RESERVED_KEYS = ("retriedFrom", "triggeredBy", "triggeredAt", "retryCount")
#: Kinds of texts on a page, by the first pattern that is found.
STRING_KINDS = {
    "navigation": r"^(home|about|contact|services|portfolio|blog|faq|help|login|signup|sign up|sign in|register|logout|sign out|menu|nav)",
    "actions": r"^(submit|cancel|save|delete|edit|update|add|remove|create|confirm|continue|next|back|previous|send|close|open|reset|clear|apply|done)",
    "accessibility": r"(open menu|close menu|toggle|expand|collapse|skip to|screen reader|aria|accessibility|keyboard|focus)",
    "messages": r"(error|success|warning|info|failed|invalid|required|please|thank you|completed|saved|deleted|updated|loading|processing)",
    "headings": r"^(welcome|get started|our |the |why |how |what |about us|contact us|frequently asked)",
    "labels": r"^(name|email|phone|address|password|username|message|subject|company|title|description|date|time|location|price|quantity|total)$",
}
FORMATS = {"html": ".html", "markdown": ".md"}


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``rows`` with their number from 1 in ``order``, which has no ties.

    Rows are dealt by ranges and sorted there; a partition's rows before it are a sum over one count a partition. So
    no task holds all rows, as a window without a key would.
    """
    rounds = Rounds(rows.sparkSession)
    dealt = rounds.put(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    out = dealt.withColumn("__part", part).join(F.broadcast(starts), "__part")  # one row a partition
    return out.select(*rows.columns, (F.col("__start") + place + 1).alias(name))


def sequence_ids(rows: DataFrame, at: str, order: str, lead: str = "job") -> DataFrame:
    """``rows`` with ``id``: ``lead-<ms>``, and ``-1``, ``-2`` ... for the further rows of one millisecond."""
    ms = F.unix_millis(F.col(at).cast("timestamp"))
    nth = F.row_number().over(Window.partitionBy(ms).orderBy(order)) - 1
    return rows.withColumn("id", F.concat(F.lit(f"{lead}-"), ms.cast("string"), F.when(nth > 0, F.concat(F.lit("-"), nth.cast("string"))).otherwise("")))


def _stems(id_: str, most: int) -> Column:
    """The ids that ``id_`` may be a suffixed form of: one, two ... trailing ``-1`` to ``-most`` dropped, and itself."""
    parts = F.split(F.col(id_), "-")
    k = F.size(parts)
    suffix = lambda p: p.rlike("^[1-9][0-9]{0,8}$") & (F.when(p.rlike("^[1-9][0-9]{0,8}$"), p).cast("int") <= most)
    cuts = F.filter(F.sequence(F.lit(0), k - 1), lambda n: F.forall(F.slice(parts, k - n + 1, n), suffix))
    return F.transform(cuts, lambda n: F.array_join(F.slice(parts, 1, k - n), "-"))


def take_id(asked: str, used: set[str], most: int) -> str | None:
    """The asked id, or it with the first of ``-1`` to ``-most`` that is not in use; null if all are. It is in use then."""
    for k in range(most + 1):
        made = f"{asked}-{k}" if k else asked
        if made not in used:
            used.add(made)
            return made
    return None


def unique_ids(rows: DataFrame, id_: str, order: str, most: int = 100) -> DataFrame:
    """``rows`` with ``unique_id``: in ``order``, the id, or with the first suffix that no earlier row's id has; null
    where all ``most`` are used.

    Only rows that may meet are taken in turn: an id that is asked for twice, and the ids that are suffixed forms of
    it, are a family. A family's rows are sorted by Spark and pass through a task with the ids in use, which are at
    most ``most`` and one for each distinct id. All other rows keep their id. Null ids stay null. ``order`` has no ties.
    """
    ids = rows.groupBy(F.col(id_).alias("__asked")).agg(F.count("*").alias("__n")).filter("__asked IS NOT NULL")
    stems = ids.select("__asked", F.explode(_stems("__asked", most)).alias("__stem"))
    twice = ids.filter("__n > 1").select(F.col("__asked").alias("__stem"))
    family = stems.join(twice, "__stem").groupBy("__asked").agg(F.min_by("__stem", F.length("__stem")).alias("__family"))
    told = rows.join(family, F.col(id_) == F.col("__asked"), "left").drop("__asked")
    alone = told.filter("__family IS NULL").withColumn("unique_id", F.col(id_)).drop("__family")
    place = [i for i, c in enumerate(told.columns) if c == id_][0]

    def run(batches):
        last, used = None, set()
        for b in batches:
            made = []
            for key, asked in zip(b.column(b.num_columns - 1).to_pylist(), b.column(place).to_pylist()):
                if key != last:
                    last, used = key, set()
                made.append(take_id(asked, used, most))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.string())], [*b.schema.names[:-1], "unique_id"])

    mixed = told.filter("__family IS NOT NULL").repartition("__family").sortWithinPartitions("__family", order)
    return alone.unionByName(mixed.mapInArrow(run, alone.schema))


def automatable(suggestions: DataFrame, least: float = 50.0) -> DataFrame:
    """Suggestions (automated, impact) that may be applied by a program and matter enough."""
    return suggestions.filter(F.col("automated") & (F.col("impact") >= least))


def alerts(groups: DataFrame, least: float = 75.0) -> DataFrame:
    """One row for groups of high impact: how many, the highest, the threshold; none without such groups."""
    found = groups.filter(F.col("impact") >= least).agg(F.count("*").alias("n"), F.max("impact").alias("top"), F.lit(float(least)).alias("threshold"))
    return found.filter("n > 0")


def report_listing(files: DataFrame, fmt: str | None = None, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Report files (name, modified) of a format (html, markdown, else json) and kind (summary or full), newest first."""
    if fmt:
        files = files.filter(F.col("name").endswith(FORMATS.get(fmt, ".json")))
    if kind:
        has = F.col("name").contains("summary")
        files = files.filter(has if kind == "summary" else ~has)
    return files.orderBy(F.desc("modified"), "name").limit(limit)


def without_reserved(parameters: Column, keys: tuple[str, ...] = RESERVED_KEYS) -> Column:
    """A map without the reserved keys."""
    return F.map_filter(parameters, lambda k, v: ~k.isin(*keys))


def split_record(record: Column, keys: tuple[str, ...]) -> Column:
    """Struct (metrics, details) of a map of JSON values: the ``keys``, objects among them opened, and all other entries."""
    metrics = F.map_filter(record, lambda k, v: k.isin(*keys))
    is_object = lambda v: F.coalesce(v.rlike(r"^\s*\{"), F.lit(False))
    flat = F.map_filter(metrics, lambda k, v: ~is_object(v))
    opened = F.aggregate(
        F.map_values(F.map_filter(metrics, lambda k, v: is_object(v))),
        F.map_entries(flat),
        lambda a, v: F.concat(a, F.map_entries(F.from_json(v, "map<string,string>"))),
    )
    return F.struct(F.map_from_entries(opened).alias("metrics"), F.map_filter(record, lambda k, v: ~k.isin(*keys)).alias("details"))


def age_days(at: str, now: Column) -> Column:
    """Whole days from ``at`` to ``now``."""
    return F.floor((F.unix_millis(now) - F.unix_millis(F.col(at).cast("timestamp"))) / 86_400_000).cast("long")


def retention(logs: DataFrame, at: str, now: Column, archive: int = 7, delete: int = 30) -> DataFrame:
    """``logs`` with ``fate``: delete or archive if older than so many days, else keep."""
    age = age_days(at, now)
    return logs.withColumn("fate", F.when(age > delete, "delete").when(age > archive, "archive").otherwise("keep"))


def log_summary(logs: DataFrame, failed: Column, at: str, now: Column, old: int = 7) -> DataFrame:
    """One row: logs, errors, old logs, and both as percentages; 0 without logs."""
    out = logs.agg(F.count("*").alias("logs"), F.count_if(failed).alias("errors"), F.count_if(age_days(at, now) > old).alias("old"))
    share = lambda c: F.when(F.col("logs") > 0, F.floor(F.col(c) / F.col("logs") * 1000 + 0.5) / 10).otherwise(0.0)
    return out.select("*", share("errors").alias("error_rate"), share("old").alias("old_rate"))


def action_counts(items: DataFrame, column: str, actions: tuple[str, ...]) -> DataFrame:
    """One row: all items, and those of each action."""
    return items.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == a).alias(a) for a in actions])


def literal_report(occurrences: DataFrame, literal: str = "literal") -> DataFrame:
    """Literals by occurrences, most first."""
    return occurrences.groupBy(literal).agg(F.count("*").alias("n")).orderBy(F.desc("n"), literal)


def largest_groups(groups: DataFrame, size: str = "occurrences", tie: str = "content_hash", n: int = 15) -> DataFrame:
    """The ``n`` largest groups."""
    return groups.orderBy(F.desc(size), tie).limit(n)


def cache_stats(entries: DataFrame, key: str, prefix: str, ttl_seconds: int) -> DataFrame:
    """One row: cached scans (keys of the prefix that are no index), time to live in seconds and whole days."""
    own = F.col(key).startswith(prefix) & ~F.col(key).endswith(":index")
    return entries.agg(F.count_if(own).alias("total_cached_scans"), F.lit(ttl_seconds).cast("long").alias("ttl_seconds"), F.lit(ttl_seconds // 86_400).cast("long").alias("ttl_days"))


def cache_health(files: DataFrame, name: str, at: str, now: Column, most_hours: float = 24.0, warn_hours: float = 12.0) -> DataFrame:
    """One row: the newest file, its age in hours and minutes, whether it is young enough, the severity, and how many
    there are. Older than ``most_hours`` is critical, than ``warn_hours`` a warning; no files at all are a warning."""
    age = F.unix_millis(now) - F.unix_millis(F.col("newest_at").cast("timestamp"))
    out = files.agg(F.count("*").alias("files"), F.max_by(name, F.struct(at, name)).alias("newest"), F.max(at).alias("newest_at"))
    hours, minutes = F.floor(age / 3_600_000).cast("long"), F.floor(age % 3_600_000 / 60_000).cast("long")
    severity = F.when(F.col("files") == 0, "warning").when(age > most_hours * 3_600_000, "critical").when(age > warn_hours * 3_600_000, "warning").otherwise("healthy")
    return out.select("files", "newest", F.coalesce(hours, F.lit(0)).alias("hours"), F.coalesce(minutes, F.lit(0)).alias("minutes"), F.coalesce(age <= most_hours * 3_600_000, F.lit(False)).alias("healthy"), severity.alias("severity"))


def suffix_counts(names: DataFrame, name: str, suffixes: dict[str, str]) -> DataFrame:
    """One row: names that are not hidden, and those with each suffix."""
    return names.agg(F.count_if(~F.col(name).startswith(".")).alias("visible"), *[F.count_if(F.col(name).endswith(s)).alias(k) for k, s in suffixes.items()])


def importers(imports: DataFrame) -> DataFrame:
    """(file, importer) from (file, module): who imports each file ``module.py`` that is itself in the table."""
    known = imports.select(F.col("file").alias("target")).distinct()
    told = imports.select(F.col("file").alias("importer"), F.concat("module", F.lit(".py")).alias("target")).distinct()
    return told.join(known, "target").select(F.col("target").alias("file"), "importer")


def ordered_distinct(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, first): each value at its first place, in that order."""
    return rows.groupBy(value).agg(F.min(order).alias("first")).orderBy("first")


def largest_with(files: DataFrame, log: DataFrame, key: str, size: str, n: int = 10) -> DataFrame:
    """The rows of ``log`` that belong to the ``n`` largest files."""
    return log.join(files.orderBy(F.desc(size), key).limit(n).select(key), key, "left_semi")


def string_kind(text: Column) -> Column:
    """The kind of a text on a page; null for a blank one."""
    trimmed, out = F.trim(text), None
    for kind, pattern in STRING_KINDS.items():
        hit = trimmed.rlike("(?i)" + pattern)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.when(trimmed != "", out.otherwise("misc"))


def repositories(rows: DataFrame, enabled: bool | None = None, priority: str | None = None, tag: str | None = None) -> DataFrame:
    """Repositories by any of the three; a tag alone does not ask for enabled ones."""
    if enabled:
        rows = rows.filter("enabled")
    if priority:
        rows = rows.filter(F.col("priority") == priority)
    return rows.filter(F.array_contains("tags", tag)) if tag else rows


def queue_counts(jobs: DataFrame, status: str = "status", slots: int = 5) -> DataFrame:
    """One row: jobs that run and that wait, if ``slots`` may run at once and the queue is first in, first out."""
    n = jobs.agg(F.count_if(F.col(status).isin("queued", "running")).alias("n"))
    return n.select(F.least("n", F.lit(slots)).alias("active"), F.greatest(F.col("n") - slots, F.lit(0)).alias("queued"))


def group_blocks(suggestions: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """(suggestion_id, group_id, block_id): each suggestion's group and the blocks in it."""
    return suggestions.select("suggestion_id", "group_id").join(groups.select("group_id"), "group_id").join(members, "group_id").select("suggestion_id", "group_id", "block_id")


def client_feed(events: DataFrame, client: str, at: str, tie: str, seen: Column, keep: int = 100) -> DataFrame:
    """(client, shown, unread): entries a client's list holds, at most ``keep``, and those newer than the last it saw."""
    mark = F.max(F.when(seen, F.struct(at, tie)))
    last = events.groupBy(client).agg(mark.alias("mark"), F.count("*").alias("n"))
    newer = events.join(last, client).filter(F.col("mark").isNull() | (F.struct(at, tie) > F.col("mark"))).groupBy(client).agg(F.count("*").alias("unread"))
    return last.join(newer, client, "left").select(client, F.least("n", F.lit(keep)).alias("shown"), F.coalesce("unread", F.lit(0)).alias("unread"))
