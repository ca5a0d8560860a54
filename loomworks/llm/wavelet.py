"""Token-id output as wavelet matrices: one compressed, searchable file a shard.

A wavelet matrix stores a sequence of n ids below 2**L as L planes of n bits: plane k has bit L-1-k of every id,
in an order in which each plane's zeros come before its ones in the next. Rank on the planes gives any token,
the number of an id's occurrences before a place, and the places of an id, without decoding the rest.

A file holds each plane in blocks of ``BLOCK_BITS`` bits, compressed each alone, with a rank directory: the ones
before each block. A reader takes the blocks it asks for and keeps them; access, count and occurrence lookup
decompress a block a plane and place at most, whatever the shard's size.

Shards are ranges of doc_id of at most about ``BLOCK_BYTES`` of text: one exchange of the texts deals them out, a
task encodes its shard's distinct words and builds the matrix. A shard file is one row of a Parquet table (its bytes
are the file), so any store that Spark reads and writes will do, and a lost executor's shards are written again by
Spark's commit protocol.

File, little-endian: magic, then int64 n, levels, documents, block bits; ids of documents (int64) and a byte each that
is 1 if the id is null; int64 token counts of the documents; int64 zeros of each plane; the rank directory, int64 ones
before each block, plane by plane; int64 ends of the blocks' frames, counted from the first; the zstd frames of the
blocks' bits, least bit first in a byte.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks_of, range_block, small_batches

MAGIC, BLOCK_BITS = b"LOOMWM02", 1 << 19
SHARD_SCHEMA = T.StructType([T.StructField("shard", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("file", T.BinaryType())])
_WORDS_KEPT, _SPLIT_ROWS, _GATHER_WORDS = 400_000, 500, 1_000_000
#: The tokenizer's white space.
BLANKS = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Plain words: letters, then symbols; the apostrophe, which starts pre-tokens of its own, is no such symbol.
LETTERS = "".join(c for c in map(chr, [*range(0x41, 0x7B), *range(0xC0, 0x100)]) if c.isalpha())
SYMBOLS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
PLAIN = f"^[{LETTERS}]*[{re.escape(SYMBOLS)}]*$"


class WaveletMatrix:
    """A sequence of ids as bit planes in blocks, with rank and select; blocks are made or decompressed when asked for."""

    def __init__(self, n: int, zeros: np.ndarray, before: np.ndarray, frame, block_bits: int = BLOCK_BITS):
        """``before[k, b]``: ones of plane k before block b; ``frame(k, b)``: the bytes of that block's bits."""
        self.n, self.levels, self.zeros, self.before, self.block_bits = n, len(zeros), zeros, before, block_bits
        self._frame, self._loaded = frame, {}

    @classmethod
    def build(cls, ids: np.ndarray, levels: int, block_bits: int = BLOCK_BITS) -> WaveletMatrix:
        """The matrix of ``ids``; ``block_bits`` is a multiple of 64."""
        v = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], np.zeros(levels, np.int64)
        for k in range(levels):
            bits = (v >> v.dtype.type(levels - 1 - k)).astype(np.uint8) & np.uint8(1)
            packed = np.packbits(bits, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]))
            ones = bits.view(bool)
            low = v[~ones]
            zeros[k] = len(low)
            v = np.concatenate([low, v[ones]])
        size = block_bits // 8
        starts = np.arange(0, max(-(-len(ids) // 8), 1), size)
        sums = [[int(np.bitwise_count(p[i : i + size]).sum(dtype=np.int64)) for i in starts] for p in planes]
        before = np.cumsum(np.array(sums, np.int64).reshape(levels, -1), axis=1) - np.array(sums, np.int64).reshape(levels, -1)
        return cls(len(ids), zeros, before, lambda k, b: planes[k][b * size : (b + 1) * size].tobytes(), block_bits)

    def frame(self, k: int, b: int) -> bytes:
        """The bits of block ``b`` of plane ``k``, as bytes."""
        return self._frame(k, b)

    def _block(self, k: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Block ``b`` of plane ``k`` as 64-bit words, and the ones of the plane before each word and after the last."""
        got = self._loaded.get((k, b))
        if got is None:
            words = np.frombuffer(self.frame(k, b), "<u8")
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]) + self.before[k, b]
            got = self._loaded[k, b] = (np.append(words, np.uint64(0)), ones)
        return got

    def decode(self) -> np.ndarray:
        """All ids: the partitions undone from the last plane to the first."""
        v = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for k in reversed(range(self.levels)):
            packed = np.frombuffer(b"".join(self.frame(k, b) for b in range(self.before.shape[1])), np.uint8)
            ones = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            z, out = int(self.zeros[k]), np.empty_like(v)
            out[~ones] = v[:z]
            out[ones] = v[z:] | v.dtype.type(1 << (self.levels - 1 - k))
            v = out
        return v

    def _by_block(self, blocks: np.ndarray):
        """(block, indexes) of equal values."""
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            yield int(blocks[part[0]]), part

    def _rank(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones of plane ``k`` before each place, and the bit there (0 behind the end)."""
        ones, bits = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for b, part in self._by_block(np.minimum(at // self.block_bits, self.before.shape[1] - 1)):
            words, before = self._block(k, b)
            inside = at[part] - b * self.block_bits
            word, bit = inside >> 6, (inside & 63).astype(np.uint64)
            ones[part] = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            bits[part] = (words[word] >> bit) & np.uint64(1)
        return ones, bits

    def _select(self, k: int, one: int, nth: np.ndarray) -> np.ndarray:
        """The places in plane ``k`` of the ``nth`` (from 0) bits of value ``one``."""
        out = np.zeros(len(nth), np.int64)
        starts = self.before[k] if one else np.arange(self.before.shape[1]) * self.block_bits - self.before[k]
        for b, part in self._by_block(np.searchsorted(starts, nth, side="right") - 1):
            words, before = self._block(k, b)
            upto = before if one else b * self.block_bits + 64 * np.arange(len(before)) - before
            word = np.searchsorted(upto, nth[part], side="right") - 1
            bits = np.unpackbits(words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") == one
            hit = (np.cumsum(bits, axis=1) == (nth[part] - upto[word] + 1)[:, None]) & bits
            out[part] = b * self.block_bits + 64 * word + hit.argmax(axis=1)
        return out

    def access(self, at) -> np.ndarray:
        """The ids at the places ``at``."""
        at = np.atleast_1d(np.asarray(at, np.int64)).copy()
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("no such place")
        out = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            ones, bit = self._rank(k, at)
            out = (out << 1) | bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return out

    def _down(self, symbol: int, ends: np.ndarray) -> np.ndarray:
        """Where the occurrences of ``symbol`` before each of ``ends`` stop, behind the last plane."""
        for k in range(self.levels):
            ones = self._rank(k, ends)[0]
            ends = self.zeros[k] + ones if symbol >> (self.levels - 1 - k) & 1 else ends - ones
        return ends

    def counts(self, symbol: int, ends) -> np.ndarray:
        """Occurrences of ``symbol`` before each of the places ``ends``."""
        ends = np.atleast_1d(np.asarray(ends, np.int64))
        if symbol < 0 or symbol >> self.levels:
            return np.zeros(len(ends), np.int64)
        found = self._down(symbol, np.concatenate([[0], ends]))
        return found[1:] - found[0]

    def count(self, symbol: int, end: int | None = None) -> int:
        """Occurrences of ``symbol`` before place ``end`` (default: all)."""
        return int(self.counts(symbol, self.n if end is None else end)[0])

    def positions(self, symbol: int, first: int = 0, most: int | None = None) -> np.ndarray:
        """The places of the occurrences of ``symbol``, ascending, from number ``first`` on: select, plane by plane upwards."""
        if symbol < 0 or symbol >> self.levels:
            return np.zeros(0, np.int64)
        low, high = self._down(symbol, np.array([0, self.n], np.int64)).tolist()
        low = min(low + first, high)
        at = np.arange(low, high if most is None else min(high, low + most))
        for k in reversed(range(self.levels)):
            one = symbol >> (self.levels - 1 - k) & 1
            at = self._select(k, one, at - self.zeros[k] * one)
        return at


def to_file(matrix: WaveletMatrix, doc_ids: list[int | None], counts: np.ndarray) -> bytes:
    """The shard file of a matrix whose documents have ``counts`` tokens each."""
    known = np.array([0 if i is None else i for i in doc_ids], "<i8")
    null = np.array([i is None for i in doc_ids], np.uint8)
    head = np.array([matrix.n, matrix.levels, len(doc_ids), matrix.block_bits], "<i8")
    press = zstandard.ZstdCompressor(level=1).compress
    frames = [press(matrix.frame(k, b)) for k in range(matrix.levels) for b in range(matrix.before.shape[1])]
    ends = np.cumsum([len(x) for x in frames]).astype("<i8")
    tables = [known, null, np.asarray(counts, "<i8"), matrix.zeros.astype("<i8"), matrix.before.astype("<i8"), ends]
    return b"".join([MAGIC, head.tobytes(), *[t.tobytes() for t in tables], *frames])


def from_file(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, document ids and token counts of a shard file; blocks stay compressed until they are asked for."""
    if data[:8] != MAGIC:
        raise ValueError("not a shard file")
    n, levels, docs, block_bits = np.frombuffer(data, "<i8", 4, 8).tolist()
    blocks, at = max(1, -(-n // block_bits)), 40
    taken = []
    for kind, size in (("<i8", docs), (np.uint8, docs), ("<i8", docs), ("<i8", levels), ("<i8", levels * blocks), ("<i8", levels * blocks)):
        taken.append(np.frombuffer(data, kind, size, at))
        at += taken[-1].nbytes
    ids, null, counts, zeros, before, ends = taken
    open_frame = zstandard.ZstdDecompressor().decompress

    def frame(k: int, b: int) -> bytes:
        i = k * blocks + b
        return open_frame(data[at + (int(ends[i - 1]) if i else 0) : at + int(ends[i])])

    matrix = WaveletMatrix(n, zeros.astype(np.int64), before.astype(np.int64).reshape(levels, blocks), frame, block_bits)
    return matrix, [None if z else i for i, z in zip(ids.tolist(), null)], counts.astype(np.int64)


class _Encoder:
    """Ids of whole texts by the tokenizers library, each distinct word of a shard encoded once.

    The tokenizer's pre-tokens never hold white space and its normalizer works within words, so a text's ids are
    its words' ids in order (tests hold this against whole texts). Arrow splits the texts and numbers the words.
    Plain words, Latin-1 letters with ASCII symbols behind them, are at most two pre-tokens, which go straight to
    the library's BPE model; any other word goes through the whole tokenizer.

    Not every tokenizer file is like that. ``_PROBES`` are tried when the file is opened: where they show that words
    aren't independent, whole texts are encoded; where plain words aren't two pieces, every word is tokenized in whole.
    """

    _PROBES = (*LETTERS, *SYMBOLS, "Hello,", "WORLD!?", "straße.", "Été;", "a<|>", "(x", "...", "foo_bar", "na-ive&&")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        letters = [chr(i) for i in range(0xC0, 0x100) if chr(i).isalpha()]
        self.table = str.maketrans({c: "".join(p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(c)) for c in letters})
        self.pieces: dict[str, list[int]] = {}
        self.others: dict[str, list[int]] = {}
        alone = [self._other(p) for p in self._PROBES]
        flat = [i for ids in alone for i in ids]
        self.by_word = all(self._other(gap.join(self._PROBES)) == flat for gap in (" ", "\n", "\t", " \r\n ", "\u00a0"))
        self.by_piece = self.by_word and all(self._plain(p) == ids for p, ids in zip(self._PROBES, alone) if re.match(PLAIN, p))

    @staticmethod
    def _split(texts: pa.ChunkedArray) -> tuple[pa.ChunkedArray, np.ndarray]:
        """The words of all texts, some of them empty, and the number of words of each text."""
        words, counts = [], [np.zeros(0, np.int64)]
        for chunk in texts.chunks:
            for i in range(0, len(chunk), _SPLIT_ROWS):
                part = chunk.slice(i, _SPLIT_ROWS)
                # Arrow's own splitting also cuts at the separators 1C to 1F, which are no white space to the tokenizer.
                odd = pc.any(pc.match_substring_regex(part, "[\x1c-\x1f]")).as_py()
                lists = pc.split_pattern_regex(part, BLANKS) if odd else pc.utf8_split_whitespace(part)
                words.append(lists.flatten())
                counts.append(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        return pa.chunked_array(words, pa.string()), np.concatenate(counts)

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.table))] if piece else []

    def _plain(self, word: str) -> list[int]:
        """The ids of a plain word: of its letters, then of its symbols."""
        return self._piece(word.rstrip(SYMBOLS).lower()) + self._piece(word.lstrip(LETTERS))

    def _other(self, word: str) -> list[int]:
        return self.whole.encode(word, add_special_tokens=False).ids

    def _vocabulary(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all their ids joined."""
        plain = pc.match_substring_regex(words, PLAIN if self.by_piece else "^$")
        known, others = words.filter(plain), words.filter(pc.invert(plain)).to_pylist()
        heads, tails = pc.utf8_lower(pc.utf8_rtrim(known, SYMBOLS)), pc.utf8_ltrim(known, LETTERS)
        pieces, at = _numbered(pa.chunked_array([heads, tails, pa.array([""])]))
        lists = [*_cached(self.pieces, pieces.to_pylist(), self._piece), *_cached(self.others, others, self._other)]
        unit = np.full((len(words), 2), at[-1])  # a word is two pieces, or another word and the empty piece
        is_plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        unit[is_plain, 0], unit[is_plain, 1] = at[: len(known)], at[len(known) : 2 * len(known)]
        unit[~is_plain, 0] = len(pieces) + np.arange(len(others))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        return sizes[unit].sum(axis=1), flat[_runs(starts[unit.ravel()], sizes[unit.ravel()])]

    def __call__(self, texts: pa.ChunkedArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by ``end_id``, and the count of each."""
        if not self.by_word:
            lists = [[*self._other(t or ""), end_id] for t in texts.to_pylist()]
            return np.fromiter((i for x in lists for i in x), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))
        split, counts = self._split(texts)
        words, at = _numbered(split)
        sizes, flat = self._vocabulary(words)
        flat, starts = np.append(flat, np.uint32(end_id)), np.append(np.cumsum(sizes) - sizes, len(flat))
        sizes = np.append(sizes, 1)
        ends = np.cumsum(counts + 1) - 1
        sequence = np.full(len(at) + len(counts), len(words), np.int32)
        inner = np.ones(len(sequence), bool)
        inner[ends] = False
        sequence[inner] = at
        stops = np.cumsum(sizes[sequence])
        ids = np.empty(int(stops[-1]) if len(stops) else 0, np.uint32)
        for i in range(0, len(sequence), _GATHER_WORDS):
            some = sequence[i : i + _GATHER_WORDS]
            got = flat[_runs(starts[some], sizes[some])]
            stop = int(stops[i + len(some) - 1])
            ids[stop - len(got) : stop] = got
        return ids, np.diff(stops[ends], prepend=0)


def _numbered(values: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values, and each value's number among them."""
    chunks = values.dictionary_encode().chunks
    words = chunks[-1].dictionary if chunks else pa.array([], values.type)
    return words, np.concatenate([np.zeros(0, np.int32), *[c.indices.to_numpy() for c in chunks]])


def _cached(known: dict, keys: list[str], make) -> list[list[int]]:
    """``make`` of each key; ``known`` keeps ``_WORDS_KEPT`` results and these keys'."""
    if len(known) > _WORDS_KEPT:
        known.clear()
    out = []
    for key in keys:
        got = known.get(key)
        if got is None:
            got = known[key] = make(key)
        out.append(got)
    return out


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of consecutive runs: ``sizes[i]`` from ``starts[i]`` on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> _Encoder:
    """The encoder of this Python worker, which its tasks share with the words it knows (``_WORDS_KEPT`` and a shard's)."""
    return _Encoder(path)


def shards(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", n_shards: int | None = None) -> DataFrame:
    """One row a shard: ``shard``, ``n_docs``, ``n_tokens``, ``file``; shards and the documents in them ascend by ``id_col``.

    Null and empty texts have the end id alone. Null ids come first; rows of one id are in order of their text,
    in one shard. A very long text is one document of one shard, held in memory there. Empty tables give no shards.
    Other columns are not read, so their names can't clash.
    """
    small_batches(docs.sparkSession)
    n_shards = n_shards or blocks_of(docs, text_col, 2)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.withColumn("shard", range_block(rows, "id", n_shards))

    def build(table: pa.Table) -> pa.Table:
        encoder = _encoder(tokenizer_path)
        order = pc.sort_indices(table, [("id", "ascending"), ("text", "ascending")], null_placement="at_start")
        table = table.take(order)
        ids, counts = encoder(table.column("text"), end_id)
        levels = max(1, int(max(encoder.whole.get_vocab_size(), end_id + 1) - 1).bit_length())
        data = to_file(WaveletMatrix.build(ids, levels), table.column("id").to_pylist(), counts)
        return pa.table({"shard": [table.column("shard")[0].as_py()], "n_docs": [len(counts)], "n_tokens": [len(ids)], "file": pa.array([data], pa.binary())})

    return dealt.groupBy("shard").applyInArrow(build, SHARD_SCHEMA)


def write(shard_rows: DataFrame, path: str) -> None:
    """Writes the shard files; they are compressed already."""
    shard_rows.write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The shard files of ``path``."""
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def documents_of(files: DataFrame, id_col: str = "doc_id", end_id: int | None = None) -> DataFrame:
    """One row a document, from the files: ``id_col``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    With ``end_id``, also what the matrix itself tells: ``first_id``, by access at the start, ``n_end_ids``, by rank at
    both ends, and ``end_at``, the place in the document of its last ``end_id``, by select.
    """
    extra = [] if end_id is None else ["first_id", "n_end_ids", "end_at"]
    names = ["shard", "id", "at", "n_tokens", "ids_crc32", *extra]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])

    def run(batches):
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1)):
                matrix, doc_ids, counts = from_file(data.as_py())
                ends = np.cumsum(counts)
                begins = ends - counts
                more = []
                if extra:
                    upto = matrix.counts(end_id, np.concatenate([begins, ends[-1:]]))
                    last = matrix.positions(end_id)[upto[1:] - 1]
                    more = [matrix.access(begins), np.diff(upto), last - begins]
                raw = memoryview(matrix.decode().astype("<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(sums), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(begins), pa.array(counts), pa.array(sums, pa.int64()), *map(pa.array, more)], names)

    told = files.select("shard", "file").mapInArrow(run, schema)
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("first"))
    return told.join(starts, "shard").select(F.col("id").alias(id_col), (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *extra)


def occurrences(files: DataFrame, symbol: int) -> DataFrame:
    """(``shard``, ``n``, ``positions``): how often and where in each shard the id ``symbol`` occurs, by rank and select."""
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("n", T.LongType()), T.StructField("positions", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1)):
                matrix = from_file(data.as_py())[0]
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([matrix.count(symbol)]), pa.array([matrix.positions(symbol)], pa.list_(pa.int64()))], ["shard", "n", "positions"])

    return files.select("shard", "file").mapInArrow(run, schema)
