"""Document fingerprints: SimHash over weighted terms, and a search for all fingerprints within a Hamming radius.

All in DataFrame and SQL functions. Terms are a text's words in pairs (and single words where there is no
pair); a term votes with its length in characters, up to 24, so long, rare terms count more than pairs of
stop words. Repeated terms vote again. The votes of two bits share one long (32 bits each), so 64 bits take 32
sums, and two hashes give 128 bits. Partial sums run where a text is exploded; one row a text is shuffled.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, SharedTables, blocks_of, range_block

LANES = 0x100000001
MOST_WEIGHT = 24
SEEDS = (11, 23)
RADIUS, CROWD = 4, 256


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "next_text", blocks: int | None = None) -> DataFrame:
    """``docs`` (``id_col``, ``text_col``) with the next row's text and id in ascending ``id_col`` (after the last: the first).

    Rows go to blocks, ranges of the id; only a block's last row asks for the first row of the next block that has
    any, which is one row a block. Null ids come first; rows of one id are in order of their text. One row alone is
    its own next. Null texts count as empty.
    """
    blocks = blocks or blocks_of(docs, text_col, 4)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("block", range_block(rows, "id", blocks))
    order = Window.partitionBy("block").orderBy(F.col("id").asc_nulls_first(), "text")
    dealt = rows.select("id", "text", "block", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("after"))
    # The first row of each block, one text a block; block numbers alone go through one task to find the next one.
    heads = rows.withColumn("place", F.row_number().over(order)).filter("place = 1").select(F.col("block").alias("following"), F.col("text").alias("head"))
    around = Window.orderBy("block")
    numbers = rows.select("block").distinct().select("block", F.coalesce(F.lead("block").over(around), F.first("block").over(around)).alias("following"))
    first_rows = numbers.join(heads, "following").select("block", "head")
    out = dealt.join(first_rows, "block", "left")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.coalesce("after", "head").alias(out_col), "block", "place")


def fingerprint(texts: DataFrame, keys: list[str], text_col: str = "text", seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """``keys``, ``fp``: an array with a signed 64-bit SimHash for each seed, one row per row of ``texts``.

    ``keys`` must tell the rows apart. A bit is 1 if terms of more than half of the weight have it set. Texts
    without words, and null, have fingerprint 0 in every word; equal texts have equal fingerprints. Votes are
    counted in 32 bits: texts may have up to 2**31 characters.
    """
    words = F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), GAP, " ")), " ")
    listed = texts.select(*keys, words.alias("w"))
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))
    rows = listed.select(*keys, F.size("w").alias("n"), F.explode(zipped).alias("t"))
    rows = rows.select(*keys, "n", F.col("t.a").alias("a"), F.col("t.b").alias("b"))
    # The last word of a longer text has no pair of its own; a text of one word has only that.
    weight = F.when((F.col("n") > 1) & F.col("b").isNull(), 0).otherwise(F.least(F.length("a") + F.coalesce(F.length("b"), F.lit(0)), F.lit(MOST_WEIGHT))).cast("long")
    hashes = [F.xxhash64(F.lit(s), "a", "b").alias(f"h{k}") for k, s in enumerate(seeds)]
    rows = rows.select(*keys, weight.alias("weight"), *hashes)
    sums = [F.sum(F.shiftrightunsigned(f"h{k}", i).bitwiseAND(F.lit(LANES)) * F.col("weight")).alias(f"s{k}_{i}") for k in range(len(seeds)) for i in range(32)]
    voted = rows.groupBy(*keys).agg(F.sum("weight").alias("weight"), *sums)

    def word(k: int) -> Column:
        # One small expression over an array: the plan, its code and what the driver keeps of it don't grow with the bits.
        bit = lambda votes, at: F.when(votes * 2 > F.col("weight"), F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))
        pair = lambda s, i: bit(s.bitwiseAND(F.lit(0xFFFFFFFF)), i).bitwiseOR(bit(F.shiftrightunsigned(s, 32), i + 32))
        return F.aggregate(F.transform(F.array(*[F.col(f"s{k}_{i}") for i in range(32)]), pair), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    return voted.select(*keys, F.array(*[word(k) for k in range(len(seeds))]).alias("fp"))


def as_text(fp: Column) -> Column:
    """Lower-case hex digits of a fingerprint, 16 a word."""
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of differing bits; fingerprints of equal texts: 1."""
    differing = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return 1 - differing / (64.0 * F.size(a))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``with_next`` rows plus ``edited``: the last floor(n/2) characters replaced by the first as many of the next text."""
    rows = with_next(docs, id_col, text_col)
    n = F.length(text_col)
    half = F.floor(n / 2).cast("int")
    return rows.withColumn("edited", F.concat(F.substring(F.col(text_col), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", asks: Column | None = None, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; also to the next text's.

    With ``asks``, a condition on ``id_col``, two more columns tell what ``search`` finds for those rows among all
    rows: ``n_within``, the number of rows whose fingerprint is within ``radius`` bits, itself included, and
    ``first_within``, the smallest id of them. They are null for other rows.

    Rows of one id each count (see ``with_next``), null ids too, but they are never a ``first_within``. Null texts
    count as empty; all texts without words have one fingerprint. A long text is one row until its words are taken
    apart, and only its votes are shuffled. An empty table gives an empty result. Other columns are not read.
    """
    rows = edited(docs, id_col, text_col)
    both = rows.select("block", "place", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col(text_col).alias("x")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("x")))).alias("e"))
    made = fingerprint(both.select("block", "place", F.col("e.kind").alias("kind"), F.col("e.x").alias("x")), ["block", "place", "kind"], "x")
    one = made.groupBy("block", "place").agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("efp"))
    facts = rows.select("block", "place", id_col, F.length(text_col).cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    tables = SharedTables(docs.sparkSession, "fingerprints")
    told = tables.put(facts.join(one, ["block", "place"]))  # narrow: all that follows reads no text
    # The next document's fingerprint: the following place of the block, else the first place of the next block.
    order = Window.partitionBy("block").orderBy("place")
    heads = told.filter("place = 1").select("block", "fp")
    around = Window.orderBy("block")
    heads = heads.select("block", F.coalesce(F.lead("fp").over(around), F.first("fp").over(around)).alias("head"))
    out = told.withColumn("after", F.lead("fp").over(order)).join(heads, "block")
    out = out.select(
        id_col,
        "block",
        "place",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.coalesce("after", "head")).alias("near_next"),
    )
    if asks is None:
        return out.drop("block", "place")
    classes = told.groupBy("fp").agg(F.count("*").alias("n"), F.min(id_col).alias("least"), F.max(asks).alias("asked"))
    classes = tables.put(classes)
    found = within(classes.select("fp", "n", "least"), classes.filter("asked").select("fp"), radius)
    found = tables.put(found.select(as_text(F.col("fp")).alias("__at"), "n_within", "first_within"))
    # Rows that ask nothing get a key of their own, so that none of them meet in a task.
    own = F.concat(F.lit("o "), F.col("block").cast("string"), F.lit(" "), F.col("place").cast("string"))
    keyed = out.withColumn("__at", F.when(asks, F.col("fingerprint")).otherwise(own))
    return keyed.join(found.hint("merge"), "__at", "left").select(*[c for c in out.columns if c not in ("block", "place")], "n_within", "first_within")


def _blocks(fp: Column, words: int, radius: int) -> list[Column]:
    """``radius + 2`` runs of bits that make up the fingerprint, the same for every word of it."""
    n = radius + 2
    total, out = 64 * words, []
    cuts = [round(total * i / n) for i in range(n + 1)]
    for a, b in zip(cuts, cuts[1:]):
        parts = []
        for w in range(a // 64, (b - 1) // 64 + 1):
            low, high = max(a - 64 * w, 0), min(b - 64 * w, 64)
            bits = F.shiftrightunsigned(F.get(fp, F.lit(w)), low)
            parts.append(bits if high - low == 64 else bits.bitwiseAND(F.lit((1 << (high - low)) - 1)))
        out.append(parts[0] if len(parts) == 1 else F.xxhash64(*parts))
    return out


def pairs_within(index: DataFrame, asked: DataFrame, radius: int = RADIUS, words: int = len(SEEDS), crowd: int = CROWD) -> DataFrame:
    """(x, y, distance): all pairs of asked (``fp``) and indexed (``fp``) distinct fingerprints within ``radius`` bits.

    The fingerprint's bits, of all its words, are cut into ``radius + 2`` blocks. Two fingerprints within the radius
    agree in two blocks at least, so each pair of blocks is a table with those bits in front (a permuted table), and
    the tables are joined on them. A pair is taken in the first table that has it. Where more than ``crowd`` indexed
    fingerprints share a table's bits, they are dealt over salts that every asked one goes to, so no group is one
    task's and none is left out. A fingerprint on both sides meets itself at distance 0. Fingerprints must not be null;
    repeated ones give repeated pairs; either side may be empty.

    Spark sizes a side by its files, which are compressed and come before its rows are exploded to one a table, and
    would broadcast tables many times over the threshold; so sides that grow with the input are joined by sorting.
    """
    pairs = list(combinations(range(radius + 2), 2))

    def tables(classes: DataFrame, name: str) -> DataFrame:
        blocks = F.array(*_blocks(F.col("fp"), words, radius))
        made = classes.select(F.col("fp").alias(name), blocks.alias(f"{name}_blocks"))
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.get(f"{name}_blocks", F.lit(i)).alias("a"), F.get(f"{name}_blocks", F.lit(j)).alias("b")) for t, (i, j) in enumerate(pairs)])
        return made.select(name, f"{name}_blocks", F.explode(keys).alias("k")).select(name, f"{name}_blocks", "k.t", "k.a", "k.b")

    left, right = tables(asked, "x"), tables(index, "y")
    parts = right.groupBy("t", "a", "b").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("t", "a", "b", F.ceil(F.col("n") / crowd).cast("int").alias("parts"))
    left = left.join(parts, ["t", "a", "b"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    right = right.join(parts, ["t", "a", "b"], "left").withColumn("salt", F.pmod(F.xxhash64("y"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    distance = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)
    agree = [F.get("x_blocks", F.lit(i)) == F.get("y_blocks", F.lit(i)) for i in range(radius + 2)]
    first = None  # the number of the first pair of blocks that agree
    for t, (i, j) in enumerate(pairs):
        first = F.when(agree[i] & agree[j], t) if first is None else first.when(agree[i] & agree[j], t)
    met = left.hint("merge").join(right, ["t", "a", "b", "salt"]).filter((first == F.col("t")) & (distance <= radius))
    return met.select("x", "y", distance.alias("distance"))


def within(index: DataFrame, asked: DataFrame, radius: int = RADIUS, words: int = len(SEEDS)) -> DataFrame:
    """(fp, n_within, first_within) of the distinct asked fingerprints: the rows and least id of the indexed classes
    (``fp``, ``n``, ``least``) within ``radius`` bits. Copies are counted by their class, never expanded. An asked one
    without any indexed within the radius has no row; a null ``least`` is passed over where others are."""
    found = pairs_within(index, asked, radius, words)
    return found.join(index.hint("merge"), F.col("y") == F.col("fp")).groupBy("x").agg(F.sum("n").alias("n_within"), F.min("least").alias("first_within")).withColumnRenamed("x", "fp")


def search(index: DataFrame, asked: DataFrame, radius: int = RADIUS, words: int = len(SEEDS)) -> DataFrame:
    """(``asked_id``, ``id``, ``distance``): all rows of ``index`` within ``radius`` bits of the asked rows.

    Both tables have ``id`` and ``fp``, arrays of ``words`` longs. Equal fingerprints are searched as one class and
    expanded only in this result; ``within`` counts them instead. Null ids and repeated rows are rows like others; an
    empty side gives an empty result. Other columns are not read.
    """
    found = pairs_within(index.select("fp").distinct(), asked.select("fp").distinct(), radius, words)
    rows = asked.select(F.col("id").alias("asked_id"), F.col("fp").alias("x")).join(found.hint("merge"), "x").select("asked_id", "y", "distance")
    return rows.join(index.select("id", F.col("fp").alias("y")).hint("merge"), "y").select("asked_id", "id", "distance")
