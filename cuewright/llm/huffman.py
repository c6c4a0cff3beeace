"""Operator 4, token-id files: canonical length-limited Huffman coding with table-driven decoding.

The code comes from the id counts of the whole corpus (package-merge, at most `limit` bits), and only its
lengths are stored, in the file set's head: the codes are canonical. So a set (a folder with `head` and `blocks`)
is decoded from itself alone. A file is a sequence of independent blocks of whole documents;
a block holds its documents' ids and sizes, the coded ids, and the number of bits of every `step` ids, so
that decoding can start at any of these checkpoints. The decoder walks all stretches between checkpoints of
a block at once, one table look-up per id. Blocks are in ascending doc_id order (null ids last, equal ids in
a fixed order); a document's start is the sum of the sizes before it, from block totals.

If the input's parts already hold ascending, disjoint ranges of doc_id, the blocks are made where the ids
are; else the rows are dealt into ranges of (doc_id, place in the input) and sorted, so that null ids, or many
rows of one id, are spread like any others. What reaches the driver besides the id counts is one narrow row
per part of the input.

Defined cases: a null or empty text is its end id alone; null and repeated doc_ids are rows of their own; an
empty table gives an empty file set; one document may be larger than a block's usual size and is then a block
of its own. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_or_join, stage
from .tokens import encoder, token_table

LIMIT, STEP, BLOCK_IDS = 18, 64, 1 << 16
_HEAD = struct.Struct("<4sIQQ")  # magic, documents, ids, bytes of coded ids
_BLOCKS = "part int, seq long, low long, n_docs long, n_ids long, blob binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Package-merge: the length of each symbol's code, 0 for symbols that do not occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    packages, is_symbol = np.zeros(0), []
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        is_symbol.append(rank < n)
        merged = both[rank]
        merged = merged[: len(merged) // 2 * 2]
        packages = merged[0::2] + merged[1::2]
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for level in reversed(is_symbol):
        symbols = int(level[:take].sum())
        lengths[:symbols] += 1
        take = 2 * (take - symbols)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for s in sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


class Codec:
    """Codes and the decoding table for one vector of lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths, canonical(lengths)
        self.bits = int(lengths.max()) if len(lengths) else 0
        self._table = None

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length for every string of `bits` bits."""
        if self._table is None:
            symbols = np.flatnonzero(self.lengths)
            symbols = symbols[np.lexsort((symbols, self.lengths[symbols]))]
            spans = 1 << (self.bits - self.lengths[symbols].astype(np.int64))
            rest = (1 << self.bits) - int(spans.sum())
            self._table = np.concatenate([np.repeat(symbols, spans), np.zeros(rest, np.int64)]).astype(np.uint32), np.concatenate([np.repeat(self.lengths[symbols], spans), np.ones(rest, np.uint8)]).astype(np.int64)
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The coded ids, and the bits of every STEP ids."""
        lengths = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        total = int(ends[-1]) if len(ends) else 0
        word, shift = starts >> 5, starts & 31
        wide = self.codes[ids].astype(np.uint64) << (np.uint64(64) - lengths.astype(np.uint64) - shift.astype(np.uint64))
        out = np.zeros(total // 32 + 3, np.uint64)
        if total:  # codes never overlap, so sums are unions; words come in ascending order
            first = np.flatnonzero(np.diff(word, prepend=-1))
            high, low = np.add.reduceat(wide >> np.uint64(32), first), np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
            out[word[first]] += high
            out[word[first] + 1] += low
        marks = ends[np.minimum(np.arange(STEP, len(ids) + STEP, STEP), len(ids)) - 1] if len(ids) else np.zeros(0, np.int64)
        return out.astype(">u4").tobytes(), np.diff(marks, prepend=0).astype("<u2")

    def decode(self, data: bytes, marks: np.ndarray, n: int) -> np.ndarray:
        """The n ids of one block; all stretches between checkpoints advance together."""
        if not n:
            return np.zeros(0, np.uint32)
        symbols, lengths = self.table
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        four = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
        pos = np.cumsum(marks.astype(np.int64)) - marks
        out = np.empty((STEP, len(pos)), np.uint32)
        mask, last = np.int64((1 << self.bits) - 1), len(four) - 1
        for t in range(STEP):
            at = (four[np.minimum(pos >> 3, last)].astype(np.int64) >> (32 - self.bits - (pos & 7))) & mask
            out[t] = symbols[at]
            pos = pos + lengths[at]
        return out.T.reshape(-1)[:n]


def block(docs: list, sizes: list[int], ids: np.ndarray, codec: Codec) -> bytes:
    """One block of whole documents."""
    data, marks = codec.encode(ids)
    nulls = np.array([d is None for d in docs], np.uint8)
    names = np.array([d or 0 for d in docs], "<i8")
    return _HEAD.pack(b"HUF1", len(docs), len(ids), len(data)) + names.tobytes() + nulls.tobytes() + np.array(sizes, "<u4").tobytes() + marks.tobytes() + data


def unblock(blob: bytes, codec: Codec) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, sizes and all ids of a block."""
    magic, docs, n, size = _HEAD.unpack_from(blob)
    if magic != b"HUF1":
        raise ValueError("not a block of this format")
    at = _HEAD.size
    names = np.frombuffer(blob, "<i8", docs, at)
    nulls = np.frombuffer(blob, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(blob, "<u4", docs, at + 9 * docs)
    marks = np.frombuffer(blob, "<u2", -(-n // STEP), at + 13 * docs)
    data = blob[len(blob) - size :]
    return [None if x else int(d) for d, x in zip(names, nulls, strict=True)], sizes, codec.decode(data, marks, n)


def id_counts(tokens: DataFrame, size: int, wide) -> np.ndarray:
    """How often each id occurs in the whole table; at most `size` rows reach the driver."""

    def tally(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), wide), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(tally, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_head(spark, folder: str, lengths: np.ndarray) -> None:
    """The head of a file set: one row with the checkpoint step and each symbol's code length, a byte each, with their checksum."""
    raw = lengths.astype(np.uint8).tobytes()
    spark.createDataFrame([("HUF1", STEP, bytearray(raw), zlib.crc32(raw))], "magic string, step int, lengths binary, crc long").coalesce(1).write.parquet(f"{folder}/head")


def read_head(spark, folder: str) -> np.ndarray:
    head = spark.read.parquet(f"{folder}/head").first()
    if head is None or (head["magic"], head["step"], head["crc"]) != ("HUF1", STEP, zlib.crc32(bytes(head["lengths"]))):
        raise ValueError(f"{folder} has no head of this format")
    return np.frombuffer(bytes(head["lengths"]), np.uint8)


def encode_files(docs: DataFrame, vocabulary: str) -> str:
    """Writes the file set, its head and its blocks (part, seq, low, n_docs, n_ids, blob); returns its folder."""
    size = encoder(vocabulary).size
    wide = np.uint16 if size <= 1 << 16 else np.uint32
    tokens = stage(token_table(docs, vocabulary).drop("queue", "before"), "huffman-tokens")
    lengths = code_lengths(id_counts(tokens, size, wide))
    shared = docs.sparkSession.sparkContext.broadcast(lengths)
    # one row per part of the input: does it hold an ascending range of its own?
    parts = tokens.groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.bool_and("in_order").alias("ok")).orderBy("low").collect()
    ordered = all(p["ok"] for p in parts) and all(a["high"] < b["low"] for a, b in zip(parts, parts[1:], strict=False))
    rows = tokens.select("part", "seq", "doc_id", "n", "ids")
    if not ordered:
        keys = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("part"), F.col("seq")]
        rows = rows.repartitionByRange(max(1, len(parts)), *keys).sortWithinPartitions(*keys)

    def build(batches):
        codec = Codec(shared.value)
        now, names, sizes, chunks, held, row, task = None, [], [], [], 0, 0, TaskContext.get().partitionId()

        def done():
            ids = np.frombuffer(b"".join(chunks), wide)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([names[0]], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([block(names, sizes, ids, codec)], pa.binary())], names=["part", "seq", "low", "n_docs", "n_ids", "blob"])

        for batch in batches:
            for part, own, doc, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = (part, own) if ordered else (task, row)
                if names and (place[0] != now[0] or held + n > BLOCK_IDS):
                    yield done()
                    names, sizes, chunks, held = [], [], [], 0
                if not names:
                    now = place
                names.append(doc)
                sizes.append(n)
                chunks.append(raw)
                held += n
                row += 1
        if names:
            yield done()

    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/stage/huffman-{uuid.uuid4().hex}"
    write_head(spark, folder, lengths)
    rows.mapInArrow(build, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    return folder


def decode_files(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the file set, from its folder alone."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    shared = spark.sparkContext.broadcast(read_head(spark, folder))
    # one row per part of the file set; parts with equal or no ids come in the order of their numbers
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min("low").alias("low")).orderBy(F.asc_nulls_last("low"), "part").collect()
    first, run = [], 0
    for r in totals:
        first.append((r["part"], run))
        run += r["n"]
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index = blocks.select("part", "seq", before.alias("before")).join(small_or_join(spark.createDataFrame(first, "part int, first long")), "part")
    index = stage(index.select("part", "seq", (F.col("before") + F.col("first")).alias("base")), "huffman-index")

    def run_blocks(batches):
        codec = Codec(shared.value)
        for batch in batches:
            for base, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, sizes, ids = unblock(blob, codec)
                ends = np.cumsum(sizes.astype(np.int64))
                data = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(base + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "seq", "blob").join(small_or_join(index), ["part", "seq"]).select("base", "blob").mapInArrow(run_blocks, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_huffman_files(spark, sf_dir: str) -> DataFrame:
    """All documents written as block files in doc_id order and read back."""
    import public_tokenizers

    return decode_files(spark, encode_files(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")))
