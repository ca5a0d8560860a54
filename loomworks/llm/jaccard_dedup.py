"""Near-dedup on sets of word shingles: similarity is the Jaccard index of two texts' distinct five-word shingles.

Plan: SimHash comes first (``simhash_dedup``): a 64-bit fingerprint of the set of shingles, linked within ``RADIUS`` bits by
pigeonhole blocks, with exact ways for crowds. Its links are candidates, and those whose sets reach the threshold when
compared whole are links. What 64 bits can't bring together (at 0.8 two fingerprints differ in about 10) is then sought
among the classes that are not yet in one component: each text becomes ``BANDS`` keys of ``ROWS`` min-hashes each. Texts that share a key are candidates, and only
candidates whose sets, compared whole, reach the threshold are links; so no link is wrong. A pair of similarity s
shares a key with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8, more above.

Texts of equal sets are one class before any pairing. A key shared by more than ``CROWD`` classes would give pairs
with the square of their number. Its classes meet in two steps instead. First each is compared with a few heads of
its keys, which joins the bulk of a crowd into one component. Then classes of different components are paired by a
prefix filter, which is exact: with shingles in one order, rarest first, two sets of similarity t share one of their
first n - t * n + 1 shingles, with enough shingles left behind it on both sides. So only pairs that cannot reach the
threshold, or cannot change the components, are left out. The components of the links are the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SharedTables, small_batches
from .simhash_dedup import components, links, majority

SHINGLE, THRESHOLD, BANDS, ROWS, SEED, CROWD, SALTS, HEADS, RADIUS = 5, 0.8, 20, 5, 42, 32, 64, (1, 4), 2
_SLICE = 20_000


def _shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the text's shingles; fewer words than a shingle hash as a whole, none to 0."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(1, np.uint64)
    digest, whole = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    return np.unique(np.array([digest(whole[a:b], SEED) for a, b in zip(begins, (ends[shingle - 1 :] - 1).tolist())], np.uint64))


def _row(id_col: str, text_col: str) -> Column:
    """A key of a row's id and text; rows that agree in both are the same row."""
    parts = [F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(c).cast("string"))) for c in (id_col, text_col)]
    return F.md5(F.concat(parts[0], F.lit("|"), parts[1]))


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (``id_col``, row, cls, n, bands, fp) a row: its key, the hash and size of its shingle set, its band keys and SimHash.

    Null, empty and blank texts have one set, of the hash 0; texts of fewer words than a shingle hash as a whole. A very
    long text is hashed in slices. Repeated rows have equal rows; an empty table gives none. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    c = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for b in batches:
            classes, sizes, keys, prints = [], [], [], []
            for text in b.column(2).cast(pa.large_binary()).to_pylist():
                s = _shingles(text, shingle)
                least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(s), _SLICE):
                    part = s[i : i + _SLICE]
                    for k in range(0, bands * rows, 10):
                        least[k : k + 10] = np.minimum(least[k : k + 10], (part * a[k : k + 10, None] + c[k : k + 10, None]).min(axis=1))
                classes.append(digest(s.tobytes(), SEED))
                sizes.append(len(s))
                prints.append(majority(s))
                keys.append([digest(least[k : k + rows].tobytes(), k) for k in range(0, bands * rows, rows)])
            made = [np.array(x, np.uint64).view(np.int64) for x in (classes, keys, prints)]
            lists = pa.ListArray.from_arrays(np.arange(len(classes) + 1, dtype=np.int32) * bands, pa.array(made[1].reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made[0]), pa.array(sizes, pa.int64()), lists, pa.array(made[2])], [id_col, "row", "cls", "n", "bands", "fp"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("row", T.StringType()), T.StructField("cls", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())])
    return docs.select(id_col, _row(id_col, text_col).alias("row"), text_col).mapInArrow(run, schema)


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(cls, set) from rows (cls, text)."""

    def run(batches):
        for b in batches:
            sets = [_shingles(t, shingle).view(np.int64) for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["cls", "set"])

    return rows.mapInArrow(run, "cls bigint, set array<bigint>")


def _sizes_fit(n: Column, m: Column, threshold: float) -> Column:
    """Whether sets of ``n`` and ``m`` shingles can reach ``threshold`` at all."""
    return F.least(n, m) >= F.lit(threshold) * F.greatest(n, m)


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``pairs`` (u, v, ...) whose sets reach ``threshold``. Many pairs of one u are dealt by ``SALTS`` salts."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    left = salted.select("u", "salt").distinct().join(sets.select(F.col("cls").alias("u"), F.col("set").alias("x")), "u")
    both = salted.join(sets.select(F.col("cls").alias("v"), F.col("set").alias("y")), "v").join(left, ["u", "salt"])
    same = F.size(F.array_intersect("x", "y"))
    return both.filter(same >= F.lit(threshold) * (F.size("x") + F.size("y") - same)).select(*pairs.columns)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, row (the key of id and text), cls and root, which names its component.

    Rows of equal id and text have equal keys and components. Null, empty and blank texts are one class, so one
    component; a null id is an id like others here. Very long texts are compared by their whole sets. Components don't
    depend on the order of the rows. An empty table gives an empty result. Other columns are not read.
    """
    tables = SharedTables(docs.sparkSession, "jaccard")
    made = tables.put(signatures(docs, shingle, id_col=id_col, text_col=text_col))
    classes = made.groupBy("cls").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    classes = tables.put(classes)
    keyed = classes.select("cls", "row", "n", F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("k")).filter("k > 1")
    shared = tables.put(keyed.join(sizes, ["band", "key"]))
    met = tables.put(simhash_pairs(classes, threshold))
    named = made.select(id_col, "row", "cls")
    if shared.isEmpty() and met.isEmpty():
        return named.withColumn("root", F.col("cls"))
    texts = docs.select(_row(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    asked = classes.select("row", "cls").join(shared.select("cls").union(met.select("u")).union(met.select("v")).distinct(), "cls", "left_semi")
    texts = texts.join(asked, "row").dropDuplicates(["row"])
    sets = tables.put(_sets(texts.select("cls", "text"), shingle))
    edges = tables.put(_linked(met, sets, threshold))
    few = _rooted(shared.filter(F.col("k") <= crowd).select("band", "key", "cls", "n"), edges)
    pairs = few.select("band", "key", F.col("cls").alias("u"), F.col("n").alias("nu"), F.col("root").alias("ru")).join(few.select("band", "key", F.col("cls").alias("v"), F.col("n").alias("nv"), F.col("root").alias("rv")), ["band", "key"])
    apart = (F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")) & _sizes_fit(F.col("nu"), F.col("nv"), threshold)
    edges = tables.put(edges.union(_linked(pairs.filter(apart).select("u", "v").distinct(), sets, threshold)))
    left = tables.put(shared.filter(F.col("k") > crowd).select("band", "key", "cls", "n"))
    for slots in HEADS:
        if left.isEmpty():
            break
        left = tables.put(_apart(left, edges, slots))
        heads = left.groupBy("band", "key", F.pmod("x", F.lit(slots)).alias("slot")).agg(F.min(F.struct("x", "cls", "n", "root")).alias("h"))
        heads = tables.put(heads.select("band", "key", F.col("h.cls").alias("u"), F.col("h.n").alias("nu"), F.col("h.root").alias("ru")))
        stars = left.join(heads, ["band", "key"]).filter((F.col("root") != F.col("ru")) & _sizes_fit(F.col("nu"), F.col("n"), threshold))
        found = _linked(stars.select("u", F.col("cls").alias("v")).distinct(), sets, threshold)
        edges = tables.put(edges.union(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct())
    if not left.isEmpty():
        apart = tables.put(_apart(left, edges, 1).select("cls", "n", "root").distinct())
        found = _linked(_prefix_pairs(apart, sets, threshold, tables), sets, threshold)
        edges = tables.put(edges.union(found).distinct())
    out = named.withColumn("root", F.col("cls")) if edges.isEmpty() else named.join(components(edges), F.col("cls") == F.col("fp"), "left").withColumn("root", F.coalesce("root", "cls")).drop("fp")
    out = tables.put(out)
    tables.drop(*range(1, tables.n))
    return out


def simhash_pairs(classes: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(u, v), u < v: candidates among ``classes`` (cls, n, fp) by SimHash: of one fingerprint, each with the least of
    them, and the least of two fingerprints that ``simhash_dedup.links`` links. Sizes that can't reach the threshold are
    left out. Rows are in proportion to the classes and links, however many share a fingerprint."""
    heads = classes.groupBy("fp").agg(F.min(F.struct("cls", "n")).alias("h"))
    own = classes.join(heads, "fp").select(F.col("h.cls").alias("u"), F.col("h.n").alias("nu"), F.col("cls").alias("v"), F.col("n").alias("nv"))
    near = links(heads.select("fp"), radius).withColumnsRenamed({"u": "fu", "v": "fv"})
    side = lambda f, c, n: heads.select(F.col("fp").alias(f), F.col("h.cls").alias(c), F.col("h.n").alias(n))
    near = near.join(side("fu", "u", "nu"), "fu").join(side("fv", "v", "nv"), "fv").select("u", "nu", "v", "nv")
    fit = own.union(near).filter((F.col("u") != F.col("v")) & _sizes_fit(F.col("nu"), F.col("nv"), threshold))
    return fit.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _rooted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (cls, ...) with root, which names the component of ``edges`` that the class is in."""
    if edges.isEmpty():
        return rows.withColumn("root", F.col("cls"))
    return rows.join(components(edges).withColumnRenamed("fp", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _apart(left: DataFrame, edges: DataFrame, slots: int) -> DataFrame:
    """The rows of ``left`` (band, key, cls, n) of keys whose classes are not in one component, with root and a draw x."""
    told = _rooted(left.select("band", "key", "cls", "n"), edges).select("band", "key", "cls", "n", "root", F.xxhash64("cls", "band", F.lit(slots)).alias("x"))
    mixed = told.groupBy("band", "key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("band", "key")
    return told.join(mixed, ["band", "key"], "left_semi")


def _prefix_pairs(classes: DataFrame, sets: DataFrame, threshold: float, tables: SharedTables) -> DataFrame:
    """(u, v), u < v: all pairs of ``classes`` (cls, n, root) of different roots that may reach ``threshold``.

    ``place`` is a shingle's number in its set, from 0, rarest first: n - place shingles are left from it on. At a
    shingle, classes of the most frequent root there are only paired with the others.
    """
    tokens = tables.put(sets.join(classes, "cls").select("cls", "n", "root", F.explode("set").alias("t")))
    uses = tokens.groupBy("t").agg(F.count("*").alias("f"))
    order = Window.partitionBy("cls").orderBy("f", "t")
    placed = tokens.join(uses, "t").withColumn("place", F.row_number().over(order) - 1)
    placed = tables.put(placed.filter((F.col("f") > 1) & (F.col("n") - F.col("place") >= F.lit(threshold) * F.col("n"))).drop("f"))
    main = placed.groupBy("t", "root").agg(F.count("*").alias("k")).groupBy("t").agg(F.max(F.struct("k", "root"))["root"].alias("main"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
    marked = placed.join(main, "t")
    a = marked.filter("root <> main").select("t", F.col("cls").alias("u"), F.col("n").alias("nu"), F.col("root").alias("ru"), F.col("place").alias("pu"))
    b = marked.select("t", F.col("cls").alias("v"), F.col("n").alias("nv"), F.col("root").alias("rv"), F.col("place").alias("pv"))
    need = F.lit(threshold / (1 + threshold)) * (F.col("nu") + F.col("nv")) - 1e-9
    enough = (F.col("nu") - F.col("pu") >= need) & (F.col("nv") - F.col("pv") >= need)
    pairs = a.join(b, (a["t"] == b["t"]) & (F.col("ru") != F.col("rv")) & enough & _sizes_fit(F.col("nu"), F.col("nv"), threshold))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, once. Rows are told apart by id and text.

    Rows with a null id all stay; texts without words are one component. All columns pass through.
    """
    tables = SharedTables(docs.sparkSession, "kept")
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter(F.col(id_col).isNotNull())
    kept = tables.put(found.groupBy("root").agg(F.min(F.struct(id_col, "row")).alias("least")).select(F.col("least.row").alias("__row")).distinct())
    named = docs.filter(F.col(id_col).isNotNull()).withColumn("__row", _row(id_col, text_col)).join(kept, "__row", "left_semi").dropDuplicates(["__row"])
    return named.select(*docs.columns).union(docs.filter(F.col(id_col).isNull()))
