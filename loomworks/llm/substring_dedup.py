"""Substring dedup: repeated windows of words, found by Rabin-Karp hashes, merged into removal intervals.

Every window of ``window`` consecutive words of one document gets a polynomial (Rabin-Karp) hash. A window
is repeated if its word sequence also starts earlier: at a smaller doc_id, or earlier in the same document.
Windows are judged on the input. The words that repeated windows cover form maximal intervals, which are cut.

Plan (three exchanges):

1. Documents go to blocks, ranges of doc_id. A block task hashes all its windows with numpy, keeps the first
   of equal windows (later ones in the block are repeats already), and sends the hashes, nine bytes a window,
   in chunks to buckets of the hash space. However often a window occurs, a bucket gets it once a block.
2. A bucket task groups equal hashes. The one of the lowest block and position is the first; the positions of
   the others go back to their blocks.
3. Each block meets its documents again (the first exchange is reused), merges intervals and cuts the text.

Two sums with different bases make the hash: 56 bits are sent, the bucket's number is from the other sum.
With B buckets, windows of different words are taken as equal with chance 2**-56 / B a pair.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks_of, range_block, small_batches, without

WINDOW = 20
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
BLOCK, BUCKET, DATA = "__sd_block", "__sd_bucket", "__sd_data"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_PA_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _window_sums(values: np.ndarray, starts: np.ndarray, window: int, base: int) -> np.ndarray:
    """Rabin-Karp sums, modulo 2**64, of the windows of word values that begin at ``starts``."""
    n = len(values)
    powers = np.full(n, base, np.uint64)
    inverse = np.full(n, pow(base, -1, 2**64), np.uint64)
    powers[:1] = inverse[:1] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    total = np.zeros(n + 1, np.uint64)
    np.multiply(values, powers, out=powers)
    np.cumsum(powers, out=total[1:])
    return _mix((total[starts + window] - total[starts]) * inverse[starts])


class _Block:
    """The documents of one block, by (doc_id, text), with the hashes of all windows in that order."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, window: int):
        table = table.sort_by([(id_col, "ascending"), (text_col, "ascending")]) if table.num_rows > 1 else table
        self.texts = table.column(text_col).cast(pa.large_binary()).to_pylist()
        self.table = table.drop_columns([text_col])
        seen: dict[bytes, int] = {}
        values = [np.zeros(0, np.uint64)]
        counts = np.zeros(len(self.texts), np.int64)
        digest = xxhash.xxh3_64_intdigest
        for i, text in enumerate(self.texts):
            words = text.split() if text else []
            counts[i] = len(words)
            for w in set(words).difference(seen):
                seen[w] = digest(w)
            values.append(np.fromiter(map(seen.__getitem__, words), np.uint64, len(words)))
        self.window, self.counts = window, counts
        self.offsets = np.concatenate([[0], np.cumsum(counts)])
        v = np.concatenate(values)
        fits = np.maximum(counts - window + 1, 0)
        self.starts = np.repeat(self.offsets[:-1] - np.concatenate([[0], np.cumsum(fits)])[:-1], fits) + np.arange(fits.sum())
        self.hashes = _window_sums(v, self.starts, window, BASES[0])
        order = np.argsort(self.hashes, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = self.hashes[order][1:] != self.hashes[order][:-1]
        self.first, self.later, self.values = np.sort(order[first]), order[~first], v

    def chunks(self, buckets: int):
        """(bucket, bytes) of the windows that are the first of their kind here, in order of position."""
        other = _window_sums(self.values, self.starts[self.first], self.window, BASES[1])
        bucket = ((other >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        by = np.argsort(bucket, kind="stable")
        at, h, bucket = self.first[by].astype(np.uint32), self.hashes[self.first[by]], bucket[by]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(by)]):
            if j > i:
                yield int(bucket[i]), _pack(h[i:j], at[i:j])


def _pack(h: np.ndarray, at: np.ndarray) -> bytes:
    """Seven bytes of each hash, then the ascending positions as byte planes of their differences."""
    gaps = np.diff(at, prepend=np.uint32(0)).astype("<u4")
    wide = bool(len(gaps)) and int(gaps.max()) > 0xFFFF
    gaps = gaps if wide else gaps.astype("<u2")
    planes = gaps.view(np.uint8).reshape(len(at), -1).T
    return bytes([wide]) + h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes() + planes.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = 4 if data[0] else 2
    n = (len(data) - 1) // (7 + width)
    raw = np.frombuffer(data, np.uint8, offset=1)
    h = np.zeros((n, 8), np.uint8)
    h[:, :7] = raw[: 7 * n].reshape(n, 7)
    gaps = np.ascontiguousarray(raw[7 * n :].reshape(width, n).T).view(f"<u{width}").ravel()
    return h.view("<u8").ravel(), np.cumsum(gaps, dtype=np.uint64).astype(np.int64)


def _repeats(table: pa.Table) -> pa.Table:
    """The positions, by block, of windows whose hash has a lower block or position in this bucket."""
    table = table.sort_by(BLOCK)
    blocks = table.column(BLOCK).to_numpy()
    parts = [_unpack(x) for x in table.column(DATA).to_pylist()]
    h = np.concatenate([p[0] for p in parts])
    order = np.argsort(h, kind="stable")  # within a hash, by block
    again = np.zeros(len(h), bool)
    h = h[order]
    again[order[1:][h[1:] == h[:-1]]] = True
    out, i = {BLOCK: [], DATA: []}, 0
    for block, (_, at) in zip(blocks, parts):
        found = at[again[i : i + len(at)]]
        i += len(at)
        if len(found):
            out[BLOCK].append(int(block))
            out[DATA].append(found.astype("<u4").tobytes())
    return pa.table({BLOCK: pa.array(out[BLOCK], pa.int64()), DATA: pa.array(out[DATA], pa.binary())})


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans``; what surrounds the words that stay is unchanged."""
    begins = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : begins[a]])
        at = begins[b]
    return b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, buckets: int | None = None) -> DataFrame:
    """``docs`` with the words of repeated windows cut from the text, plus ``n_words`` and ``spans``.

    ``n_words`` counts the words of the input text; ``spans`` has the maximal removed intervals as word
    numbers ``[start, end)``. A text without repeats returns unchanged; otherwise the words are cut in place
    and the white space before them stays. ``blocks`` and ``buckets`` default to twice the shuffle partitions, or as
    many as ``BLOCK_BYTES`` of text a block make. A very long text is one document of one block, held there whole.

    Null texts have no words and stay null. Texts of fewer words than the window have none removed. Rows of
    one doc_id count as separate documents in order of their text, equal ones in any order: all but the first
    copy lose their windows. A null doc_id precedes all others. An empty table gives an empty result. Input
    columns named ``n_words`` or ``spans`` are replaced; all others pass through.
    """
    small_batches(docs.sparkSession)
    if not blocks or not buckets:
        dealt_to = blocks_of(docs, text_col, 2)
        blocks, buckets = blocks or dealt_to, buckets or dealt_to
    docs = without(docs, ["n_words", "spans", BLOCK, BUCKET, DATA])
    dealt = docs.withColumn(BLOCK, range_block(docs, id_col, blocks))

    def chunked(table: pa.Table) -> pa.Table:
        block, rows = table.column(BLOCK)[0].as_py(), list(_Block(table, id_col, text_col, window).chunks(buckets))
        return pa.table({BUCKET: pa.array([r[0] for r in rows], pa.int64()), BLOCK: pa.array([block] * len(rows), pa.int64()), DATA: pa.array([r[1] for r in rows], pa.binary())})

    columns = [f for f in docs.schema.fields if f.name != text_col]

    def merged(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], t) for f, t in zip(out_schema, arrow_types)})
        b = _Block(table, id_col, text_col, window)
        lists = [np.frombuffer(x, "<u4") for x in replies.column(DATA).to_pylist()]
        starts = b.starts[np.concatenate([b.later, *lists]).astype(np.int64)]
        edge = np.bincount(starts, minlength=b.offsets[-1] + 1) - np.bincount(starts + window, minlength=b.offsets[-1] + 1)[: b.offsets[-1] + 1]
        covered = np.cumsum(edge)[: b.offsets[-1]] > 0
        spans, texts = [], []
        hit = np.zeros(len(b.counts), bool)
        hit[np.searchsorted(b.offsets, starts, side="right") - 1] = True
        for i, text in enumerate(b.texts):
            own: list[tuple[int, int]] = []
            if hit[i]:
                c = np.concatenate([[False], covered[b.offsets[i] : b.offsets[i + 1]], [False]])
                turns = np.flatnonzero(c[1:] != c[:-1])
                own = list(zip(turns[::2].tolist(), turns[1::2].tolist()))
                text = _cut(text, own)
            spans.append([{"start": s, "end": e} for s, e in own])
            texts.append(text)
        data = {f.name: b.table.column(f.name) for f in columns}
        data |= {text_col: pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(b.counts), "spans": pa.array(spans, _PA_SPANS)}
        return pa.table(data)

    chunk_schema = T.StructType([T.StructField(BUCKET, T.LongType()), T.StructField(BLOCK, T.LongType()), T.StructField(DATA, T.BinaryType())])
    reply_schema = T.StructType([T.StructField(BLOCK, T.LongType()), T.StructField(DATA, T.BinaryType())])
    out_schema = T.StructType([*columns, T.StructField(text_col, T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS)])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_types = [to_arrow_type(f.dataType) for f in out_schema]
    chunks = dealt.groupBy(BLOCK).applyInArrow(chunked, chunk_schema)
    replies = chunks.groupBy(BUCKET).applyInArrow(_repeats, reply_schema)
    out = dealt.groupBy(BLOCK).cogroup(replies.groupBy(BLOCK)).applyInArrow(merged, out_schema)
    return out.select(*[f"`{c}`" for c in docs.columns], "n_words", "spans")


def digest(result: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the sha256 of the kept words joined by one space."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    kept = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return result.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))
