"""Operator 1, exact dedup by content-defined chunk recipes.

Every text is cut into chunks at positions that its own content decides (a rolling hash over the last 32
bytes), so equal texts get equal cuts. A chunk is named by a 64-bit identifier; the identifiers are verified
over the whole corpus against the chunk's SHA-256 and length, and one that stands for two contents is split
into (identifier, ordinal). Two texts are equal exactly when their ordered identifier lists are. Only
identifiers and digests are shuffled: a long document crosses the network never, its recipe once or twice.

Defined cases: a null text counts as empty; an empty text has an empty recipe, and all empty texts are one
group; rows with one doc_id are rows of their own (exactly one row of a group is kept, the first by doc_id,
nulls last, then by an arbitrary but fixed order of equal ids); an empty table gives an empty result. Other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, small_or_join, stage, tidy

_RECIPE = "doc_id long, row_no long, text_sha256 string, recipe array<struct<id: long, digest: binary, size: int>>"
#: A random but fixed value for each byte, from which the rolling hash is made.
_GEAR = np.random.default_rng(20240601).integers(0, 1 << 32, 256, dtype=np.uint32)
_LEAST, _MOST = 256, 16384


def normalise(text: str | None) -> bytes:
    """White-space runs as one space, in UTF-8."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return raw
    words = b" ".join(raw.split())
    if not words:
        return b" "
    return (b" " if raw[:1].isspace() else b"") + words + (b" " if raw[-1:].isspace() else b"")


def cuts(data: bytes, mask_bits: int) -> list[int]:
    """Ends of the chunks: where the hash of the last 32 bytes has mask_bits zero bits, between the size bounds."""
    n = len(data)
    if n <= _LEAST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < 32:  # doubling: afterwards h[i] is the sum of gear[i-j] << j for j < 32
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
        step *= 2
    marks = np.flatnonzero(h >> np.uint32(32 - mask_bits) == 0) + 1
    ends, start = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - start > _MOST:
            start += _MOST
            ends.append(start)
        if mark - start >= _LEAST or mark == n and mark > start:
            ends.append(mark)
            start = mark
    return ends


def recipes(docs: DataFrame, mask_bits: int = 11, id_bits: int = 64) -> DataFrame:
    """One row per document with its recipe; id_bits under 64 exists to test identifiers that collide."""
    drop = 64 - id_bits

    def make(batches):
        for batch in batches:
            ids, texts, rows = batch.column(0), batch.column(1), batch.column(2)
            sha, lists = [], []
            for text in texts:
                data, chunks, start = normalise(text.as_py()), [], 0
                sha.append(hashlib.sha256(data).hexdigest())
                for end in cuts(data, mask_bits):
                    chunk = data[start:end]
                    name = xxhash.xxh3_64_intdigest(chunk) >> drop
                    chunks.append({"id": name - (1 << 64) if name >> 63 else name, "digest": hashlib.sha256(chunk).digest(), "size": end - start})
                    start = end
                lists.append(chunks)
            kind = pa.list_(pa.struct([("id", pa.int64()), ("digest", pa.binary()), ("size", pa.int32())]))
            yield pa.RecordBatch.from_arrays([ids, rows, pa.array(sha, pa.string()), pa.array(lists, kind)], names=["doc_id", "row_no", "text_sha256", "recipe"])

    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row_no"))
    return rows.mapInArrow(tidy(make), _RECIPE)


def verified_identifiers(staged: DataFrame) -> DataFrame:
    """(doc_id, row_no, text_sha256, names): each chunk's verified identifier, in order."""
    # collisions: identifiers that stand for more than one content; one row per identifier after the map-side combine
    tally = staged.select(F.explode("recipe").alias("c")).groupBy("c.id").agg(
        F.min("c.digest").alias("low"), F.max("c.digest").alias("high"), F.min("c.size").alias("least"), F.max("c.size").alias("most"))
    clash = stage(tally.filter((F.col("low") != F.col("high")) | (F.col("least") != F.col("most"))).select("id"), "dedup-clash")
    plain = F.transform("recipe", lambda c: F.struct(c["id"].alias("id"), F.lit(0).alias("ordinal")))
    if clash.isEmpty():
        return staged.withColumn("names", plain).drop("recipe")
    contents = staged.select(F.explode("recipe").alias("c")).select("c.id", "c.digest").join(clash, "id", "left_semi").distinct()
    ordinals = stage(contents.withColumn("ordinal", F.row_number().over(Window.partitionBy("id").orderBy("digest"))), "dedup-ordinals")
    parts = staged.select("doc_id", "row_no", "text_sha256", F.posexplode_outer("recipe").alias("pos", "c"))
    named = parts.select("*", F.col("c.id").alias("id"), F.col("c.digest").alias("digest")).join(small_or_join(ordinals), ["id", "digest"], "left")
    listed = named.groupBy("doc_id", "row_no", "text_sha256").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id", F.coalesce("ordinal", F.lit(0)).alias("ordinal"))))).alias("all"))
    return listed.select("doc_id", "row_no", "text_sha256", F.transform("all", lambda c: F.struct(c["id"].alias("id"), c["ordinal"].alias("ordinal"))).alias("names"))


def exact_dedup(docs: DataFrame, mask_bits: int = 11, id_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks: one row per row of docs (needs doc_id, text)."""
    staged = stage(recipes(docs, mask_bits, id_bits), "dedup-recipes")
    named = verified_identifiers(staged)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")
    groups = named.groupBy("names").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    # staged, so that both sides of the join come from exchanges: a hot group is then split by adaptive execution
    groups = stage(groups.select("names", "first", "group_size"), "dedup-groups")
    joined = named.join(groups, "names", "left")
    keep = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row_no") == F.col("row_no"), F.lit(True)).alias("kept"), "text_sha256", F.size("names").cast("long").alias("n_chunks"), "row_no")


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query over documents."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("row_no", "n_chunks")


#: DuckDB twin of op1_exact_dedup.
SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
