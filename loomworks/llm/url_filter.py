"""URL filters: explicit host and path rules, then a learned verdict on segmented hosts and paths.

Hosts are often names run together (``freecasinobets``). Each name of a URL, a run of letters, is split into the words
of the highest probability under a unigram model (Viterbi). A multinomial naive Bayes model then scores the words of
the host and the path.

The unigram model is the count of every word of all texts: a table, never cut or collected. Only distinct names are
segmented: their parts meet the words in a join, a name's parts that are words come back to it, and one Viterbi pass
over them, in a task, gives its words and scores. URLs then join their names, and rows their URLs. Names, words and
URLs that hold a large share of the rows are at most ``HEAVY`` in number, so those are broadcast and the rest joined
by shuffle.

The Bayes model learns from labelled URLs, at most ``TRAIN_ROWS``, each once; which words they have comes from the same
segmentation. No host, word or label is written here. Where a table of labels is missing, ``evidence`` makes one of the
pages themselves: a URL is to be blocked if the text of its page is what the quality classifier rejects.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality_pairs
from .common import SharedTables, small_batches, without

LONGEST, TRAIN_ROWS, HEAVY, SALTS = 24, 20_000, 1000, 32
#: The rules of the contract, as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"[\p{L}\p{M}]+|\p{N}+"
_NAMES = T.StructType([T.StructField("name", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("host_score", T.DoubleType()), T.StructField("path_score", T.DoubleType())])


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty for null and without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name (host + path) and verdict of the longest rule that fits; null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def viterbi(name: str, found: dict[tuple[int, int], int], total: int) -> list[str]:
    """The words of the highest unigram probability that make up ``name``.

    ``found`` has the counts of its parts (begin, end) that are words, of ``total``. Any other part, however long, has
    probability 10 / (total * 10**length), so long unknown words cost more than any split into known ones. Among equal
    splits the one with the longest last word is taken. Work grows with the name and with what was found.
    """
    ten, base, whole = math.log(10), math.log(10 / max(total, 10)), math.log(max(total, 1))
    ends: dict[int, list[tuple[int, float]]] = {}
    for (i, j), n in found.items():
        ends.setdefault(j, []).append((i, math.log(n) - whole))
    best, back = [0.0], [0]
    top, at = 0.0, 0  # of the unknown word that ends here: best[i] + i * log 10
    for j in range(1, len(name) + 1):
        value, begin = top + base - j * ten, at
        for i, p in ends.get(j, ()):
            if best[i] + p > value + 1e-9 or (best[i] + p > value - 1e-9 and i < begin):
                value, begin = best[i] + p, i
        best.append(value)
        back.append(begin)
        if value + j * ten > top + 1e-9:
            top, at = value + j * ten, j
    out, j = [], len(name)
    while j:
        out.append(name[back[j] : j])
        j = back[j]
    return out[::-1]


@dataclass
class Unigrams:
    """Every word and its count, as a table (word, n) with one row a word, and the sum of the counts."""

    words: DataFrame
    total: int


@dataclass
class Model:
    """The unigram table and the naive Bayes weights: log P(token | block) - log P(token | allow); path tokens begin with /."""

    unigrams: Unigrams
    weights: dict[str, float]
    prior: float


def is_word(word: str, longest: int = LONGEST) -> bool:
    """Whether a string is 2 to ``longest`` letters of any script, with combining marks behind the first."""
    if not 2 <= len(word) <= longest:
        return False
    return word.isalpha() or (word[0].isalpha() and all(c.isalpha() or unicodedata.category(c)[0] == "M" for c in word))


def unigrams(texts: DataFrame, text_col: str = "text", longest: int = LONGEST) -> Unigrams:
    """Counts of all words of 2 to ``longest`` letters and marks, of any script, in all texts.

    Words are runs without ASCII white space, lower-cased, less the punctuation around them. Null, empty and blank
    texts have none, repeated rows count each, and a very long text is read whole. Tasks count each batch first. Longer
    words are left out, as a name's part of that length is more likely several words run together.
    """
    small_batches(texts.sparkSession)

    def run(batches):
        for b in batches:
            n: dict[bytes, int] = {}
            for text in b.column(0).cast(pa.large_binary()).to_pylist():
                for w in (text or b"").split():
                    n[w] = n.get(w, 0) + 1
            by: dict[str, int] = {}
            for w, k in n.items():
                word = w.strip(b".,;:!?\"'()").decode().lower()
                if is_word(word, longest):
                    by[word] = by.get(word, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array(list(by.values()), pa.int64())], ["word", "n"])

    counted = SharedTables(texts.sparkSession, "unigrams").put(texts.select(text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    return Unigrams(counted, counted.agg(F.sum("n").alias("n")).first()["n"] or 0)


def _joined(left: DataFrame, right: DataFrame, key: str, heavy: int = HEAVY) -> DataFrame:
    """``left`` inner join ``right``, which has one row a ``key`` and ``uses``, the rows of ``left`` it meets.

    Keys of more than one in ``heavy`` of these rows are ``heavy`` at most, and are broadcast. No other key is a large
    share, so the rest is joined by shuffle.
    """
    most = (right.agg(F.sum("uses").alias("n")).first()["n"] or 0) // heavy
    hot, rest = right.filter(F.col("uses") > most).drop("uses"), right.filter(F.col("uses") <= most).drop("uses")
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def segment(names: DataFrame, known: Unigrams, weights: dict[str, float] | None = None, longest: int = LONGEST) -> DataFrame:
    """(name, words, host_score, path_score) of distinct ``names``: their Viterbi words and the sums of their weights.

    A name's parts of up to ``longest`` letters join the table of words. Short parts are in a great many names; words of
    up to 3 letters are copied to ``SALTS`` salts for them. A name of no known part is one word; a very long one takes
    memory in proportion to its length and its known parts. Names must not be null or empty, and equal ones be given
    once; no names, or no words, are no error. Among equal splits see ``viterbi``.
    """
    weights = weights or {}
    salt = lambda word, of: F.when(F.length(word) <= 3, of).otherwise(0)
    begun = names.select("name", F.explode(F.sequence(F.lit(1), F.greatest(F.length("name") - 1, F.lit(1)))).alias("i"))
    ends = begun.select("name", "i", F.explode(F.expr(f"sequence(2, greatest(2, least({int(longest)}, length(name) - i + 1)))")).alias("l"))
    parts = ends.filter("i + l - 1 <= length(name)").select("name", "i", "l", F.substring("name", F.col("i"), F.col("l")).alias("word"))
    parts = parts.withColumn("salt", salt("word", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int")))
    words = known.words.withColumn("salt", F.explode(F.sequence(F.lit(0), salt("word", F.lit(SALTS - 1)))))
    found = parts.join(words, ["word", "salt"]).groupBy("name").agg(F.collect_list(F.struct("i", "l", "n")).alias("found"))
    total = known.total

    def run(batches):
        for b in batches:
            rows = []
            for name, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                split = viterbi(name, {(f["i"] - 1, f["i"] - 1 + f["l"]): f["n"] for f in own or ()}, total)
                rows.append((name, split, math.fsum(weights.get(w, 0.0) for w in split), math.fsum(weights.get("/" + w, 0.0) for w in split)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.list_(pa.string()), pa.float64(), pa.float64()))], _NAMES.names)

    return names.join(found, "name", "left").select("name", "found").mapInArrow(run, _NAMES)


def _pieces(urls: DataFrame) -> DataFrame:
    """(url, at, name): the names of the host (at from 0) and of the path (at from -1 down) of rows (url, host, path); runs of digits are "0"."""
    of = lambda c: F.transform(F.regexp_extract_all(F.lower(c), F.lit(_PARTS), F.lit(0)), lambda x: F.when(x.rlike(r"^\p{N}"), "0").otherwise(x))
    host = urls.select("url", F.posexplode(of("host")).alias("at", "name"))
    return host.union(urls.select("url", F.posexplode(of("path")).alias("at", "name")).select("url", -1 - F.col("at"), "name"))


def _distinct(urls: DataFrame, url_col: str) -> DataFrame:
    """(url, host, path, uses) of the distinct URLs; null is the empty one."""
    made = urls.groupBy(F.coalesce(F.col(url_col), F.lit("")).alias("url")).agg(F.count("*").alias("uses"))
    host, path = host_path(F.col("url"))
    return made.select("url", host.alias("host"), path.alias("path"), "uses")


def learn(labelled: DataFrame, known: Unigrams, url_col: str = "url", label_col: str = "block", rows: int = TRAIN_ROWS) -> Model:
    """The naive Bayes model of at most ``rows`` labelled URLs (1: block, 0: allow), those of the smallest hash.

    A URL counts once, its tokens as often as it has them; URLs of both labels and null ones are left out. With no
    labelled URL, nothing is blocked. Equal rows in any order give the same model.
    """
    spark = labelled.sparkSession
    told = labelled.filter(F.col(url_col).isNotNull()).groupBy(F.col(url_col).alias("url")).agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).filter("lo = hi AND lo IN (0, 1)")
    drawn = told.orderBy(F.xxhash64("url"), "url").limit(rows).select("url", F.col("lo").cast("int").alias("block"))
    drawn = SharedTables(spark, "labelled").put(drawn)
    host, path = host_path(F.col("url"))
    pieces = _pieces(drawn.select("url", host.alias("host"), path.alias("path")))
    split = segment(pieces.select("name").distinct(), known)
    tokens = pieces.join(drawn, "url").join(split, "name").select("block", F.explode("words").alias("w"), "at").select("block", F.when(F.col("at") < 0, F.concat(F.lit("/"), "w")).otherwise(F.col("w")).alias("token"))
    counts = {(r["token"], r["block"]): r["n"] for r in tokens.groupBy("token", "block").agg(F.count("*").alias("n")).collect()}
    urls = {r["block"]: r["n"] for r in drawn.groupBy("block").agg(F.count("*").alias("n")).collect()}
    # Host and path tokens are two multinomials.
    weights = {}
    for in_path in (False, True):
        words = sorted({t for t, _ in counts if t.startswith("/") == in_path})
        total = [sum(counts.get((t, c), 0) for t in words) + len(words) for c in (0, 1)]
        weights |= {t: math.log((counts.get((t, 1), 0) + 1) / total[1]) - math.log((counts.get((t, 0), 0) + 1) / total[0]) for t in words}
    return Model(known, weights, math.log((urls.get(1, 0) + 1) / (urls.get(0, 0) + 2)))


def page_text(html: Column) -> Column:
    """The text of a page: its scripts, styles, comments, tags and character references become blanks."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;", " ")


def evidence(pages: DataFrame, quality: quality_pairs.Model, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, block): 1 where the quality model rejects the text of a URL's page, 0 where it keeps it.

    Pages without a URL or without text tell nothing. A URL whose pages disagree has both labels; ``learn`` leaves it
    out. Very long pages are judged whole; columns of any other name are not read.
    """
    texts = pages.select(F.col(url_col).alias("url"), page_text(F.col(html_col)).alias("text")).filter("url IS NOT NULL AND trim(text) <> ''")
    return quality_pairs.score(texts, quality).select("url", (1 - F.col("predicted")).alias("block"))


def judge(urls: DataFrame, model: Model, rules=RULES, url_col: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``verdict``, ``segments`` and ``block_score`` (log odds of block).

    The verdict is the longest fitting rule's; without one it is block if the log odds are above 0, else allow.
    Tokens that no labelled URL has count nothing. Null URLs, and those without ``://``, have empty host and path, no
    rule, and the prior's verdict. Repeated rows agree. A very long URL's names are segmented whole. An empty table
    gives an empty result. Columns named so are replaced; others pass through.
    """
    made = ["host", "path", "rule", "verdict", "segments", "block_score"]
    key = "__uf_url"
    rows = without(urls, [*made, key])
    tables = SharedTables(urls.sparkSession, "urls")
    each = tables.put(_distinct(rows, url_col))
    pieces = tables.put(_pieces(each))
    uses = pieces.groupBy("name").agg(F.count("*").alias("uses"))
    split = tables.put(segment(uses.select("name"), model.unigrams, model.weights).join(uses, "name"))
    scored = _joined(pieces, split, "name")
    score = F.when(F.col("at") < 0, F.col("path_score")).otherwise(F.col("host_score"))
    of_url = scored.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("at", score.alias("s"), "words"))).alias("p"))
    total = F.aggregate("p", F.lit(float(model.prior)), lambda a, x: a + x["s"])
    segments = F.array_join(F.flatten(F.transform(F.filter("p", lambda x: x["at"] >= 0), lambda x: x["words"])), " ")
    told = each.join(of_url.select("url", F.round(total, 9).alias("block_score"), segments.alias("segments")), "url", "left")
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    told = told.withColumn("block_score", F.coalesce("block_score", F.lit(float(model.prior)))).withColumn("segments", F.coalesce("segments", F.lit("")))
    told = told.withColumn("rule", name).withColumn("verdict", F.coalesce(verdict, F.when(F.col("block_score") > 0, "block").otherwise("allow")))
    told = tables.put(told.select(F.col("url").alias(key), *made, "uses"))
    out = _joined(rows.withColumn(key, F.coalesce(F.col(url_col), F.lit(""))), told, key)
    return out.select(*[f"`{c}`" for c in rows.columns], *made)
