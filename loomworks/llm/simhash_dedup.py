"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at few differing bits by pigeonhole blocks.

Plan: fingerprints are made once (Python, numpy) and written to the shared folder; all later steps work on
distinct fingerprints, so copies of one text are one row. A fingerprint is split into ``radius + 2`` blocks.
Fingerprints within ``radius`` bits agree in two blocks at least, so each goes to one table row per pair of
blocks, tables join on the pair's bits and keep pairs within the radius.

A pair of blocks that more than ``CROWD`` distinct fingerprints share (many near copies) would emit pairs with
the square of their number. Those go another exact way: each flips up to ``radius / 2`` bits (for an odd radius
one side flips one more). Two fingerprints within the radius meet at a flipped value, and linking each value's
fingerprints to the smallest gives the same components from a number of rows in proportion to the fingerprints.

Components: roots go under their smallest neighbour, pointers jump to the roots and links are kept between roots,
until none is left. Every round is a table in the shared folder.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SharedTables, small_batches

SHINGLE, RADIUS, SEED, CROWD = 3, 2, 42, 48
_SLICE = 1_000_000


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the unsigned hashes ``h``."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), _SLICE):
        part = np.ascontiguousarray(h[i : i + _SLICE], np.dtype("<u8"))
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def _fingerprint(text: bytes | None, shingle: int, seed: int) -> int:
    words = text.lower().split() if text else []  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    votes = np.zeros(64, np.int64)
    for i in range(0, len(begins), _SLICE):
        h = np.array([digest(whole[a:b], seed) for a, b in zip(begins[i : i + _SLICE], ends[i : i + _SLICE])], np.dtype("<u8"))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(begins), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp``, the 64-bit fingerprint as a long, of every row.

    A bit is 1 if it is set in over half of the XXH64 hashes of the text's shingles, repeats included. Texts of
    fewer words than a shingle hash as a whole; null, empty and blank texts have fingerprint 0.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).to_pylist()
            fps = np.array([_fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], [id_col, "fp"])

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("fp", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _tables(fps: DataFrame, radius: int) -> DataFrame:
    """A row (key, fp) for each pair of the fingerprint's blocks; key holds the pair's number and bits."""
    n = radius + 2
    cuts = [round(64 * i / n) for i in range(n + 1)]
    keys = []
    for t, pair in enumerate(combinations(range(n), 2)):
        parts = [F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in pair]
        keys.append(F.struct(F.lit(t).alias("t"), parts[0].alias("a"), parts[1].alias("b")))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp").select("key.t", "key.a", "key.b", "fp")


def _flips(bits: int) -> list[int]:
    """Masks of at most ``bits`` of 64 bits, as signed longs."""
    masks = [sum(1 << i for i in c) for k in range(bits + 1) for c in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Links (u, v), u < v, among distinct fingerprints ``fp`` whose components are those of all pairs within ``radius`` bits.

    In block tables of at most ``crowd`` fingerprints all pairs within the radius are links. In larger ones the
    fingerprints that share a flipped value link to its smallest. Radius 0 has no links; 1 to 3 are supported
    (beyond, the flipped values of a crowd grow too many).
    """
    if radius < 1:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).filter(F.lit(False))
    if radius > 3:
        raise ValueError("radius must be 0 to 3")
    rows = _tables(fps, radius)
    sizes = rows.groupBy("t", "a", "b").agg(F.count("*").alias("n")).filter("n > 1")
    shared = rows.join(sizes, ["t", "a", "b"])
    few = shared.filter(F.col("n") <= crowd)
    pairs = few.select("t", "a", "b", F.col("fp").alias("u")).join(few.select("t", "a", "b", F.col("fp").alias("v")), ["t", "a", "b"])
    pairs = pairs.filter((F.col("u") < F.col("v")) & (_distance("u", "v") <= radius)).select("u", "v")
    crowded = shared.filter(F.col("n") > crowd).select("fp").distinct()
    near = (radius + 1) // 2
    masks = ",".join(f"{m}L" if m != -(1 << 63) else "(-9223372036854775807L - 1L)" for m in _flips(near))
    flips = crowded.select("fp", F.explode(F.transform(F.expr(f"array({masks})"), lambda m: F.col("fp").bitwiseXOR(m))).alias("at"))
    met = flips.groupBy("at").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    stars = met.select("u", F.explode("all").alias("v"))
    if radius % 2:  # values within (r+1)/2 of both sides may be r + 1 apart: keep links by checking them
        stars = met.select(F.explode("all").alias("u"), "all").select("u", F.explode("all").alias("v"))
        stars = stars.filter(_distance("u", "v") <= radius)
    return pairs.union(stars.filter("u < v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest value reachable over ``edges`` (u, v) for each value that has a link.

    Each round, every root goes under its smallest neighbour if that is smaller, pointers jump until all show roots,
    and the edges are kept between roots only. It ends when no edge is left: the larger end of every edge goes
    under another root, so each round has fewer roots.
    """
    tables = SharedTables(edges.sparkSession, "components")
    left, roots, used = tables.put(edges.select("u", "v").filter("u <> v").distinct()), None, []
    while True:
        old, used = used, [tables.n]
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = tables.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "fp"))
        while True:
            up = hooks.select(F.col("fp").alias("at"), F.col("root").alias("up"))
            step = tables.put(hooks.join(up, F.col("root") == F.col("at")).select("fp", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
            tables.drop(tables.n - 1)
            hooks = step.select("fp", "root")
            if step.filter("moved").isEmpty():
                break
        to = hooks.select(F.col("fp").alias("at"), F.col("root").alias("to"))
        used.append(tables.n)
        roots = hooks if roots is None else tables.put(roots.join(to, F.col("root") == F.col("at"), "left").select("fp", F.coalesce("to", "root").alias("root")))
        ends = left.join(to, F.col("u") == F.col("at")).select(F.col("to").alias("u"), "v").join(to, F.col("v") == F.col("at")).select("u", F.col("to").alias("v"))
        left = tables.put(ends.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        if old:
            tables.drop(*old)
        if left.isEmpty():
            return roots


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``fp`` and ``component_id``, the smallest id reachable over links.

    Equal texts have equal fingerprints and are in one component; so are all texts without words. A null id
    takes part but is never a component's id unless all ids of the component are null. Rows of one id count
    each. A very long text is read whole, its shingles in slices. An empty table gives an empty result. Other columns
    are not read.
    """
    tables = SharedTables(docs.sparkSession, "simhash")
    made = tables.put(fingerprints(docs, shingle, seed, id_col, text_col))
    classes = tables.put(made.groupBy("fp").agg(F.min(id_col).alias("rep")))
    edges = tables.put(links(classes.select("fp"), radius))
    if edges.isEmpty():
        named = classes.select("fp", F.col("rep").alias("component_id"))
    else:
        roots = components(edges)
        rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = rooted.join(least, "root").select("fp", "component_id")
    return made.join(named, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the smallest id, once.

    Rows with a null id cannot be told apart and all stay. All columns pass through.
    """
    found = near_duplicates(docs, id_col=id_col, **options)
    kept = found.filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    named = docs.filter(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return named.select(*docs.columns).union(docs.filter(F.col(id_col).isNull()))
