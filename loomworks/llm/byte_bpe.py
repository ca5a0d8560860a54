"""Byte-level BPE encoding and decoding with a given vocabulary, by a global shuffle of distinct words.

Plan: documents form blocks of a few million characters. A block's pre-tokens are taken apart into distinct
words and positions. Distinct words go, packed, to buckets of the word-hash space, so every distinct word of
the corpus meets in one task and is encoded once; a common word is one entry a block there. The ids go back to
the blocks, where they join the sequence of word numbers by position. Positions never leave their block's row,
so one exchange of about two bytes a pre-token, and a smaller one of the ids, are all that moves.

Texts are read once. If an executor is lost they are read again, so ``docs`` must then give the same rows in the
same order: a file scan or a written table does. A block's checksum travels with its words; a difference raises
an error.

Decoding joins each id with the token-byte table. The table has one row an id of the vocabulary (50,256 here,
under 1 MB), so it is broadcast and joined by array lookup.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import blocks_of, small_batches, without

BLOCK_CHARS = 2_000_000
DECODE_BYTES = 4_000_000
#: The pattern of the byte-level vocabularies this was written for, which lets texts be cut before blanks.
BLANK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WIDE_GAP = regex.compile(r"\s ")
_ROWS = T.StructType([T.StructField(n, t) for n, t in (("key", T.LongType()), ("block", T.LongType()), ("sum", T.LongType()), ("data", T.BinaryType()))])
_REPLY_ROWS = T.StructType([T.StructField(n, t) for n, t in (("block", T.LongType()), ("bucket", T.LongType()), ("sum", T.LongType()), ("data", T.BinaryType()))])
_REPLIES = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("sum", pa.int64()), ("data", pa.binary())])


def read_ranks(path: str) -> list[bytes]:
    """The token bytes by id of a file of ``base64 rank`` lines; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        rows = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [rows[i] for i in range(len(rows))]


def _zip(*arrays: np.ndarray) -> bytes:
    """uint32 arrays as byte planes, compressed."""
    out = []
    for a in arrays:
        out.append(len(a).to_bytes(8, "little"))
        out.append(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unzip(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        planes = np.frombuffer(raw, np.uint8, 4 * n, at + 8).reshape(4, n).T
        out.append(np.ascontiguousarray(planes).view("<u4").ravel())
        at += 8 + 4 * n
    return out


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of consecutive runs: ``lengths[i]`` from ``starts[i]`` on."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _blocks(batches, most: int):
    """Lists of (row id scalar index, text): consecutive rows of about ``most`` characters; yields (ids array, texts)."""
    ids, texts, size = [], [], 0
    for b in batches:
        column, begin = b.column(1).to_pylist(), 0
        for i, t in enumerate(column):
            size += len(t) if t else 0
            texts.append(t)
            if size >= most:
                ids.append(b.column(0).slice(begin, i + 1 - begin))
                yield pa.concat_arrays(ids), texts
                ids, texts, size, begin = [], [], 0, i + 1
        if begin < len(column):
            ids.append(b.column(0).slice(begin))
    if texts:
        yield pa.concat_arrays(ids), texts


class _Words:
    """Distinct pre-tokens of a block in order of (bucket, first use), the sequence of their numbers, counts by text.

    With ``blanks``, a text is cut before its blanks, and each distinct piece is matched once. That is right for
    patterns whose matches hold a blank at their start alone or within a run of white space: texts in which a
    blank follows white space are matched as a whole.
    """

    def __init__(self, texts, find, buckets: int, blanks: bool):
        pieces: dict[str, int] = {}
        order: list[int] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if text:
                if blanks and not _WIDE_GAP.search(text):
                    first, *rest = text.split(" ")
                    units = [*find(first), *[" " + x for x in rest]]
                else:
                    units = find(text)
                order.extend([pieces.setdefault(u, len(pieces)) for u in units])
            ends[i + 1] = len(order)
        number: dict[str, int] = {}
        parts = [[number.setdefault(w, len(number)) for w in find(u)] for u in pieces]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter((w for p in parts for w in p), np.int64, int(lengths.sum()))
        at = np.array(order, np.int64)
        sequence = flat[_ragged((np.cumsum(lengths) - lengths)[at], lengths[at])]
        self.counts = np.diff(np.concatenate([[0], np.cumsum(lengths[at])])[ends])
        words = [w.encode() for w in number]
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        self.words, self.bucket = [words[i] for i in by], bucket[by]
        place = np.empty(len(words), np.int64)
        place[by] = np.arange(len(words))
        self.sequence = place[sequence]
        self.sum = int(np.bitwise_xor.reduce(hashes, initial=0).view(np.int64) if len(hashes) else 0) ^ len(sequence)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(``id_col``, ``ids``): the token ids of every row's whole text, each match of ``pattern`` encoded apart.

    The ids equal those of the tiktoken library's encode_ordinary. Null and empty texts have no ids. Rows of one
    id, and null ids, are rows of their own. A text is never split: a very long one is a block of its own. An empty
    table gives an empty result. Other columns are not read, so their names can't clash.
    """
    small_batches(docs.sparkSession)
    buckets = buckets or blocks_of(docs, text_col, 1)
    ranks = {b: i for i, b in enumerate(read_ranks(ranks_path))}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one row an id of the vocabulary
    source = docs.select(id_col, text_col)
    id_type = source.schema[id_col].dataType
    id_arrow = to_arrow_type(id_type)
    ready: dict = {}  # of one task

    def split(batches):
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        block = TaskContext.get().partitionId() << 32
        for ids, texts in _blocks(batches, BLOCK_CHARS):
            w = _Words(texts, find, buckets, pattern == BLANK_PATTERN)
            cuts = [0, *(np.flatnonzero(np.diff(w.bucket)) + 1), len(w.words)]
            keys, data = [], []
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    lengths = np.fromiter(map(len, w.words[i:j]), np.int64, j - i)
                    keys.append(-1 - int(w.bucket[i]))
                    data.append(zstandard.ZstdCompressor(level=3).compress(len(lengths).to_bytes(8, "little") + lengths.astype("<u4").tobytes() + b"".join(w.words[i:j])))
            uses = np.bincount(w.sequence, minlength=len(w.words))
            common = np.argsort(-uses, kind="stable")  # numbers by use are small for most positions
            place = np.empty(len(common), np.int64)
            place[common] = np.arange(len(common))
            keys.append(block)
            data.append(_zip(w.counts, common, place[w.sequence]))
            n = len(keys)
            owners = pa.ListArray.from_arrays(pa.array([0] * n + [len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([block] * n, pa.int64()), pa.array([w.sum] * n, pa.int64()), pa.array(data, pa.binary()), owners], names=["key", "block", "sum", "data", "owners"])
            block += 1

    def encoded(table: pa.Table) -> pa.Table:
        if table.column("key")[0].as_py() >= 0:  # the sequence of a block, which waits for the ids
            return _REPLIES.empty_table()
        if not ready:
            import tiktoken

            ready["one"] = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=shared.value, special_tokens={})._core_bpe.encode_single_piece
        one = ready["one"]
        known: dict[bytes, list[int]] = {}
        out = []
        for data in table.column("data").to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(data)
            n = int.from_bytes(raw[:8], "little")
            ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 8)) + 8 + 4 * n).tolist()
            lists, begin = [], 8 + 4 * n
            for end in ends:
                word, begin = raw[begin:end], end
                got = known.get(word)
                if got is None:
                    got = known[word] = one(word)
                lists.append(got)
            lengths = np.fromiter(map(len, lists), np.int64, n)
            out.append(_zip(lengths, np.fromiter((i for x in lists for i in x), np.int64, int(lengths.sum()))))
        return pa.table([table.column("block"), table.column("key"), table.column("sum"), pa.array(out, pa.binary())], schema=_REPLIES)

    def reassembled(order: pa.Table, replies: pa.Table) -> pa.Table:
        if order.num_rows and order.column("key")[0].as_py() < 0:  # words, which are encoded already
            return pa.table({id_col: pa.array([], id_arrow), "ids": pa.array([], pa.list_(pa.int32()))})
        if order.num_rows != 1:
            raise ValueError("a block came back without its documents: the input differs between reads")
        if len({order.column("sum")[0].as_py(), *replies.column("sum").to_pylist()}) != 1:
            raise ValueError("the words of a block differ between reads of the input; write it to a table first")
        counts, common, sequence = (x.astype(np.int64) for x in _unzip(order.column("data")[0].as_py()))
        parts = [_unzip(x) for x in replies.sort_by([("bucket", "descending")]).column("data").to_pylist()]
        lengths = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts]]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *[p[1] for p in parts]]).astype(np.int32)
        starts = np.cumsum(lengths) - lengths
        sequence = common[sequence]
        each = lengths[sequence]
        ids = flat[_ragged(starts[sequence], each)]
        totals = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
        owners = order.column("owners").combine_chunks().flatten()
        return pa.table({id_col: owners, "ids": pa.ListArray.from_arrays(pa.array(totals, pa.int32()), pa.array(ids))})

    row_schema = T.StructType([*_ROWS.fields, T.StructField("owners", T.ArrayType(id_type))])
    out_schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    # One pass over the texts: words go to their bucket, sequences wait at their block, in the same exchange.
    rows = source.mapInArrow(split, row_schema)
    replies = rows.groupBy("key").applyInArrow(encoded, _REPLY_ROWS)
    return rows.groupBy("key").cogroup(replies.groupBy("block")).applyInArrow(reassembled, out_schema)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col``, the bytes of the ids joined; null ids give null, no ids give no bytes.

    An id outside the vocabulary raises an error. A column named ``out_col`` is replaced; others pass through.
    """
    small_batches(encoded.sparkSession)
    tokens = read_ranks(ranks_path)
    ends = np.cumsum([len(t) for t in tokens])
    shared = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(tokens), np.uint8), ends))
    source = without(encoded, [out_col])
    names = source.columns

    def run(batches):
        raw, ends = shared.value
        lengths = np.diff(ends, prepend=0)
        for whole in batches:
            counts = pa.compute.fill_null(pa.compute.list_value_length(whole.column(names.index(ids_col))), 0).to_numpy(zero_copy_only=False)
            part = (np.cumsum(counts) * 4) // DECODE_BYTES  # about four bytes a token
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), whole.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if j == i:
                    continue
                b = whole.slice(i, j - i)
                lists = b.column(names.index(ids_col))
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = lengths[ids]
                text = raw[_ragged(ends[ids] - sizes, sizes)]
                at = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts[i:j])])]
                made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(text)]).cast(pa.binary())
                if lists.null_count:
                    made = pa.compute.if_else(lists.is_valid(), made, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*b.columns, made], [*names, out_col])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(out_col, T.BinaryType())]))


def digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, the sha256 of the decimal ids joined by one space, and of the decoded bytes."""
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
