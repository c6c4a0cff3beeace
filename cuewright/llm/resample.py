"""Operator 11, importance resampling towards a target distribution, over hashed word runs.

A feature is a run of one to `runs` consecutive words; its bucket is its CRC-32 modulo `buckets`. The CRC is linear
over XOR, so that of a span is the XOR of one precomputed contribution for each byte and its distance from the
span's end, and of a constant of the span's length: `PositionCrc` looks all contributions of a slice of text up at
once and folds them by `bitwise_xor.reduceat`. A span longer than the table is cut into blocks from its end; a
block's value is moved past the blocks behind it by tables for that many zero bytes, one for each power of two.

Both passes read the documents where they are: the first gives a count for each bucket and task, the second the
gains of every document. What the driver sees is bounded: `buckets` counts, and one row for each score that occurs
(a few ten thousand: gains and noise are bounded by the logarithms of the counts). Ranks are given per score.

Defined cases: a null or empty text has no features, weight 0, and takes no part in the draw (unless `least_words`
is 0); a null doc_id is hashed as empty text and comes last among ties; rows that share a doc_id are rows of their
own; ties beyond doc_id go by n_features, then weight; an empty table gives an empty result, an empty target leaves
t and T at 0. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, stage

#: Fixed values of the contract.
BUCKETS, RUNS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of spans that are looked up at once.
SLICE = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IN_WORD = np.array([b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])


class PositionCrc:
    """CRC-32 (the reflected polynomial 0xEDB88320, as zlib has it) of many spans of a buffer."""

    def __init__(self, reach: int = 64):
        self.reach = reach
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
        past = lambda x: (x >> np.uint32(8)) ^ one[x & np.uint32(255)]  # noqa: E731  # a register after one zero byte
        rows, registers = [one], [np.array([0xFFFFFFFF], np.uint32)]
        zeros = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        for _ in range(reach):
            rows.append(past(rows[-1]))
            registers.append(past(registers[-1]))
            zeros = past(zeros)
        self.contributions = np.concatenate(rows[:reach])  # at 256 * distance + byte
        self.registers = np.concatenate(registers)  # the first register after so many zero bytes
        self.moves = [zeros]  # moves[r]: for each byte of a register, what reach * 2**r zero bytes make of it

    def _moved(self, x: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Registers after that many blocks of zero bytes each."""
        x, r = x.copy(), 0
        while (blocks >> r).any():
            if r == len(self.moves):
                self.moves.append(self._past(self.moves[-1], self.moves[-1]))
            some = (blocks >> r & 1).astype(bool)
            x[some] = self._past(self.moves[r], x[some])
            r += 1
        return x

    @staticmethod
    def _past(move: np.ndarray, x: np.ndarray) -> np.ndarray:
        return move[0][x & 255] ^ move[1][x >> 8 & 255] ^ move[2][x >> 16 & 255] ^ move[3][x >> 24]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """data: bytes; spans are not empty, and may overlap."""
        sizes = ends - starts
        whole, rest = np.divmod(sizes - 1, self.reach)  # whole blocks behind the first, whose size is rest + 1
        first = np.cumsum(whole + 1) - (whole + 1)
        behind = np.repeat(first + whole, whole + 1) - np.arange(len(sizes) + int(whole.sum()))
        until = np.repeat(ends, whole + 1) - behind * self.reach
        length = np.full(len(behind), self.reach)
        length[first] = rest + 1
        at = np.cumsum(length) - length
        place = np.arange(int(length.sum()))
        distance = np.repeat(at + length, length) - 1 - place
        found = self.contributions[distance * 256 + data[np.repeat(until, length) - 1 - distance]]
        blocks = np.bitwise_xor.reduceat(found, at)
        long = behind > 0
        if long.any():
            blocks[long] = self._moved(blocks[long], behind[long])
        spans = np.bitwise_xor.reduceat(blocks, first)
        constant = self.registers[rest + 1]
        far = whole > 0
        if far.any():
            constant[far] = self._moved(constant[far], whole[far])
        return spans ^ constant ^ np.uint32(0xFFFFFFFF)


_crc: list[PositionCrc] = []


def features(texts: list[bytes | None], runs: int = RUNS):
    """n_words of each text; then (text number, CRC-32) of the features in slices, shorter runs first, in order of the text."""
    if not _crc:
        _crc.append(PositionCrc())
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    data = np.frombuffer(b"\n".join(t or b"" for t in texts).translate(_LOWER) + b"\n", np.uint8) if texts else np.empty(0, np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = _IN_WORD[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the last byte is in no word
    text_of = np.searchsorted(np.cumsum(sizes), starts, side="right")

    def slices():
        nonlocal data, starts, ends
        if runs > 1:  # words apart by one space each
            kept = np.zeros(len(data), bool)
            kept[ends] = True
            kept |= _IN_WORD[data]
            moved = np.cumsum(kept) - 1
            data = np.where(_IN_WORD[data], data, np.uint8(32))[kept]
            starts, ends = moved[starts], moved[ends]
        for k in range(1, runs + 1):
            one = np.flatnonzero(text_of[: len(text_of) - k + 1] == text_of[k - 1 :])
            a, b, of = starts[one], ends[one + k - 1], text_of[one]
            filled = np.cumsum(b - a)
            low = 0
            while low < len(a):
                high = max(low + 1, int(np.searchsorted(filled, (filled[low - 1] if low else 0) + SLICE, side="right")))
                yield of[low:high], _crc[0](data, a[low:high], b[low:high])
                low = high

    return np.bincount(text_of, minlength=len(texts)), slices()


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """bucket, n: how many features of all texts fall in each bucket (needs text)."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            _, found = features(batch.column(0).cast(pa.binary()).to_pylist(), runs)
            for _, crc in found:
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    arrow_limits(texts.sparkSession)
    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, runs: int = RUNS) -> np.ndarray:
    """The gain of every bucket: its share in the target over that in the documents, as a floored logarithm."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, side in ((s, docs), (t, target)):
        for row in bucket_counts(side, buckets, runs).collect():  # at most `buckets` rows
            counts[row.bucket] = row.n
    # whole numbers are exact in doubles up to 2**53; Python's division rounds once beyond
    total, goal = int(s.sum()), int(t.sum())
    ratio = np.array([((int(b) + 1) * (total + buckets)) / ((int(a) + 1) * (goal + buckets)) for a, b in zip(s, t, strict=True)])
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of each document's features (needs doc_id, text)."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def score(batches):
        for batch in batches:
            words, found = features(batch.column(1).cast(pa.binary()).to_pylist(), runs)
            n, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for of, crc in found:
                heads = np.flatnonzero(np.diff(of, prepend=-1))
                total[of[heads]] += np.add.reduceat(held.value[crc % np.uint32(buckets)], heads)
                n += np.bincount(of, minlength=len(words))
            columns = [batch.column(0), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: the documents with the highest noisy weights are drawn and numbered from 1.

    docs: doc_id, text. target: text. Noise is Gumbel's, from a hash of the seed and doc_id, so that the draw is one
    without replacement in proportion to the weights' exponentials, and the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = stage(weigh(docs, gains(docs, target, buckets, runs), runs).withColumn("score", F.col("weight") + noise), "resample-scores")
    able = F.col("n_words") >= least_words
    tally = sorted(((r.score, r.n) for r in weighed.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # one row for each score
    wanted, before, ahead = percent * sum(n for _, n in tally) // 100, 0, []
    for score, n in tally:
        if before >= wanted:
            break
        ahead.append((score, before))
        before += n
    columns = ("doc_id", "n_features", "weight", "score")
    if not ahead:
        return weighed.select(*columns, F.lit(None).cast("long").alias("rank"))
    high = able & (F.col("score") >= ahead[-1][0])
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    starts = F.broadcast(docs.sparkSession.createDataFrame(ahead, "score long, before long"))
    drawn = weighed.filter(high).join(starts, "score").withColumn("rank", (F.col("before") + place).cast("long"))
    drawn = drawn.select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return drawn.unionByName(weighed.filter(~high).select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Contract query: documents towards the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


#: DuckDB twin of op11_importance_resampling: each distinct word's CRC is folded byte by byte.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range::BIGINT AS b, range::BIGINT AS x, 0 AS step FROM range(256)
  UNION ALL SELECT b, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, step + 1 FROM bits WHERE step < 8
), tab AS (SELECT list(x ORDER BY b) AS t FROM bits WHERE step = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT doc_id, unnest(words) AS w FROM d), bw AS (SELECT unnest(words) AS w FROM b),
vocab AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
octets AS (SELECT w, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT) AS o FROM vocab),
hashed AS (SELECT w, xor(list_reduce(o, lambda acc, y: xor(t[(xor(acc, y) & 255) + 1], acc >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM octets, tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY 1),
tot AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
gain AS (SELECT range AS bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * (tot.s + 10000))::DOUBLE / ((coalesce(s.n, 0) + 1) * (tot.t + 10000))::DOUBLE))::BIGINT AS g
         FROM range(10000) LEFT JOIN s ON s.bucket = range LEFT JOIN t ON t.bucket = range, tot),
sums AS (SELECT doc_id, sum(g) AS g FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT d.doc_id, len(words)::BIGINT AS n_features, CASE WHEN len(words) = 0 THEN 0 ELSE floor(sums.g::DOUBLE / len(words)) END::BIGINT AS weight,
                  floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS noise
           FROM d LEFT JOIN sums USING (doc_id)),
ranked AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked
"""
