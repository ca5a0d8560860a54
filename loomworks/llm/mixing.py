"""Mixing sources to target weights by weighted fair queueing, in DataFrame and SQL functions only.

Every document of a source joins that source's queue in a seeded random order, once per repetition allowed. Its
virtual finish time is the source's tokens up to and with it, divided by the source's target. Documents of all
sources are taken in order of finish time until the budget, the sum of the targets, is used up: a source that
has had less of its share finishes earlier, so all approach their targets together.

Running sums never put a source, or the whole, in one task. Within a source, the random order is cut into cells
of the hash space whose sums are added up first (cells x sources rows); across sources, finish times are cut
into slots whose sums are added up the same way. Cells and slots grow with the shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, SharedTables, partitions, without

SHARE, REPEATS, WEIGHTS = 1.5, 2, (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = REPEATS) -> DataFrame:
    """(source, source_size, target) of sources (source, source_size): the budget dealt by weight under caps.

    Sources by code point, null last, weigh ``weights`` in turn. The budget is ``share`` of all sizes. A target
    stops at ``most`` times its source's size and the excess is dealt again by weight until none is above. With
    sources in order of cap per weight, the first k are at their caps and the rest share what is left; k is the
    number of those that the level so reached fills. One row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    listed = sizes.select("source", "source_size", ((F.row_number().over(by_name) - 1) % n).alias("turn"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") + 1).cast("int"))
    listed = listed.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    budget = F.sum("source_size").over(whole) * F.lit(float(share))
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levelled = listed.withColumn("level", left / F.sum("w").over(after)).withColumn("place", F.row_number().over(by_level))
    opens = F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct("place", "level"))
    open_level = F.min(opens).over(whole)["level"]
    target = F.when(open_level.isNull(), F.col("cap")).otherwise(F.least("cap", open_level * F.col("w")))
    return levelled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: Column, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", cells: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``copies`` is how often the mix takes the document, ``taken`` the tokens so taken (``copies`` x ``size``).
    Documents are taken whole: the first that would go beyond the budget ends the mix. None is taken more than
    ``repeats`` times.

    Null sources are a source of their own. Texts are only measured; a very long one is one row like any other. Null sizes count 0; documents of size 0 are taken, at no cost, if their
    place in the queue comes before the end. The order depends on seed, id and repetition, so reruns agree; rows
    of one id and equal size are interchangeable. An empty table gives an empty result. Sizes are worked out once
    and kept as a narrow table in the shared folder.
    """
    cells = cells or 2 * partitions(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    tables = SharedTables(docs.sparkSession, "mixing")
    queue = tables.put(base).withColumn("u", F.xxhash64(F.lit(seed), F.col("id").cast("string")))
    shares = targets(queue.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    # Cells are ranges of the upper 24 bits of the random order.
    queue = queue.withColumn("cell", F.floor(F.shiftrightunsigned("u", 40) * F.lit(cells / (1 << 24))).cast("long"))
    by_cell = queue.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    so_far = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_cell.select("source", "cell", F.coalesce(F.sum("cell_size").over(so_far), F.lit(0)).alias("start"))
    starts = starts.join(shares, starts["source"].eqNullSafe(shares["source"])).select(starts["source"].alias("s"), F.col("cell").alias("c"), "start", "source_size", "target")
    placed = queue.join(starts, queue["source"].eqNullSafe(starts["s"]) & (queue["cell"] == starts["c"]))
    within = Window.partitionBy("source", "cell").orderBy("u", "id", "size")
    upto = F.col("start") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.select("id", "source", "size", "source_size", "target", "u", "cell", upto.alias("upto"), F.row_number().over(within).alias("nth"))
    # Each repetition goes through the whole queue, so pass k begins k source sizes in.
    passes = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("pass"))
    finish = F.when(F.col("target") > 0, (F.col("upto") + F.col("pass") * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))
    # Slots of equal ratio: finish times of a source are even, so each slot has few of them at any target.
    slot = F.floor(F.log2(F.greatest(F.col("finish"), F.lit(2.0**-40))) * cells).cast("long")
    passes = tables.put(passes.withColumn("finish", finish).withColumn("slot", slot))
    slot_sums = passes.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slot_starts = slot_sums.select(F.col("slot").alias("at"), F.coalesce(F.sum("slot_size").over(earlier), F.lit(0)).alias("slot_start"))
    in_order = Window.partitionBy("slot").orderBy("finish", F.col("source").isNull(), "source", "u", "id", "size", "nth", "pass").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = passes.filter("pass = 0").agg(F.sum("size").alias("b")).first()["b"] or 0
    room = int(budget * min(share, float(repeats)) + 1e-6)
    merged = passes.join(slot_starts, passes["slot"] == slot_starts["at"])
    merged = merged.withColumn("fits", (F.col("slot_start") + F.sum("size").over(in_order) <= room).cast("long"))
    counted = merged.groupBy("id", "source", "size", "source_size", "target", "cell", "nth").agg(F.sum("fits").alias("copies"))
    return counted.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, size: Column, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` as the mix takes them: a document taken twice is two rows, one not taken whole is none.

    All columns pass through. Rows that share an id share their copies (the largest of any); a null id is such an id.
    Null texts have size 0 and a null source is a source. A very long document is taken whole or not at all. An empty
    table gives an empty result.
    """
    plan = mix(docs, size, id_col=id_col, **options).filter("copies > 0").groupBy(id_col).agg(F.max("copies").alias("__mix_copies"))
    docs = without(docs, ["__mix_copies", "__mix_n"])
    plan = plan.withColumnRenamed(id_col, "__mix_id")
    joined = docs.join(plan, docs[id_col].eqNullSafe(plan["__mix_id"]))
    return joined.withColumn("__mix_n", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select(*docs.columns)
