"""The corpus pipeline: toxicity, exact dedup, near dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, so each works on what the one before it kept. `run` writes each stage as Parquet to the shared
folder and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.common import normalised, small_or_join, stage
from cuewright.llm.decontaminate import decontaminate
from cuewright.llm.exact_dedup import exact_dedup
from cuewright.llm.minhash import near_dedup
from cuewright.llm.packing import pack
from cuewright.llm.toxicity import score_chain, train_chain

#: Parts of text that a worker remembers while packing; after four stages an executor has less memory to spare than at first.
REMEMBERED = 60_000
#: Ids up to which the list of documents to drop is broadcast; beyond, the texts are joined by shuffle.
DROP_ROWS = 1_000_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in `dropped`; a null doc_id is never dropped."""
    ids = stage(dropped.select("doc_id").distinct(), "pipeline-dropped")
    return docs.join(small_or_join(ids, DROP_ROWS), "doc_id", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the chain calls toxic go."""
    model = train_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, score_chain(docs, model).filter("toxic").select("doc_id"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of equal texts the one with the smallest doc_id stays; a row repeated whole stays once."""
    found = stage(exact_dedup(docs.select("doc_id", "text")).filter("not kept").select("doc_id", "keep_id"), "pipeline-copies")
    rest = without(docs, found.filter("doc_id <> keep_id"))
    repeats = found.filter("doc_id = keep_id").select("doc_id").distinct()
    if repeats.isEmpty():
        return rest
    again = stage(repeats, "pipeline-repeats")
    once = rest.join(small_or_join(again, DROP_ROWS), "doc_id", "left_semi").withColumn("_text", F.sha2(normalised(F.col("text")).cast("binary"), 256)).dropDuplicates(["doc_id", "_text"])
    return rest.join(small_or_join(again, DROP_ROWS), "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return without(docs, near_dedup(docs.select("doc_id", "text")).filter("not kept").select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item go."""
    return without(docs, decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: what is left, packed into sequences in the proportions of the sources."""
    return pack(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED).drop("ids")


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("decontamination", decontamination), ("packing", packing)]

#: SQL cannot express the stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read back as the next stage's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"), "snappy")
    return docs
