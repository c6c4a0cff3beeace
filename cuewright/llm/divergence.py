"""Operator 13, source divergence audit: in which terms, and from which other sources, each source departs.

Each language keeps the terms that at least `least_docs` of its documents have. A source's share of a term, and the
language's, are whole numbers p = 1 + floor(10^9 (count + 5) / (N + 5 V)). They depend on the count alone, so the
terms of a source are grouped into cells by (count in the source, count in the language): f is evaluated once a
cell, equal values of a source are merged, and the values are ranked by the cumulative number of their terms. Only
the values that reach the wanted ranks are expanded into terms, in UTF-8 order. The first `top` values suffice,
since each has a term; Spark takes them in every task before the shuffle, and likewise the first terms.

Distances between sources are sums over all kept terms. Sources of a language are dealt into blocks, kept terms into
slices, and a task sums |p - q| for a pair of blocks over a slice in a dense table (at most 2 BLOCK sources by about
SLICE terms); terms that neither block has in a slice add a constant for each pair, from their number. So no term's
sources are ever paired as rows; what comes out is a row for each pair and slice, and the pairs are the result.

Counting is one pass over the texts: every task sums its documents' terms before the shuffle and lets go of them
whenever it holds TERMS of them, so a frequent term is a few rows for each task.

Arithmetic is exact: shares are computed in decimals, sums in 64-bit integers (a share is below 1.1e9).

Defined cases: null text, lang and source count as ''; a source without terms, or a language without kept terms,
has its pairs at their defined values and no terms; a language with one source has no pairs; repeated rows count
repeatedly; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, small_or_join, stage

LEAST_DOCS, TOP = 30, 50
#: Terms that a task holds before it lets them go; bytes of text that are cut into terms at once.
TERMS, PIECE = 400_000, 1 << 20
#: Sources of a block and kept terms of a slice.
BLOCK, SLICE = 64, 1024

#: Letters in small form, what is no term character as a space; all bytes of other scripts stay.
_CUT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> Counter:
    """The terms of one text and their numbers; a long text is cut at spaces."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE].translate(_CUT)
        end = len(piece) if at + PIECE >= len(text) else piece.rfind(b" ") + 1
        size = PIECE
        while not end:  # a term longer than a piece
            size *= 2
            piece = text[at : at + size].translate(_CUT)
            end = len(piece) if at + size >= len(text) else piece.rfind(b" ") + 1
        found.update(piece[:end].split())
        at += end
    return found


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents that have the term; a row with a null term for every (lang, source)."""

    def count(batches):
        held: dict[tuple, list] = {}
        size = 0

        def out():
            keys, terms, n, d = [], [], [], []
            for key, (names, total, own) in held.items():
                keys += [key] * (len(total) + 1)
                terms += [None, *total]
                n += [0, *total.values()]
                d += [0, *(own[t] for t in total)]
            texts = pa.array(terms, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), texts, pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                _, total, own = held.setdefault((lang, source), (None, Counter(), Counter()))
                found = terms_of(text.as_py())
                size -= len(total)
                total.update(found)
                own.update(found.keys())
                size += len(total)
                if size > TERMS:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    arrow_limits(docs.sparkSession)
    parts = docs.select(blank("lang"), blank("source"), blank("text")).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exactly; where nothing is kept there is no share."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.when(kept > 0, 1 + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (wide(count) + 5), wide(total) + 5 * wide(kept)))


def prepared(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(counts, groups), staged. counts: lang, source, term, n, c (the language's count), p, q. groups: lang, source, v, p0."""
    every = stage(term_counts(docs), "divergence-counts")
    named = every.filter("term is not null")
    kept = named.groupBy("lang", "term").agg(F.sum("n").alias("c"), F.sum("docs").alias("d")).filter(F.col("d") >= least_docs).drop("d")
    kept = stage(kept, "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("lang_n"))
    counts = stage(named.select("lang", "source", "term", "n").join(small_or_join(kept), ["lang", "term"]), "divergence-terms")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    groups = every.filter("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    filled = groups.fillna(0, ["source_n", "v", "lang_n"]).withColumn("p0", share(F.lit(0), F.col("source_n"), F.col("v")))
    groups = stage(filled, "divergence-groups")
    shared = counts.join(small_or_join(groups), ["lang", "source"])
    return shared.select("lang", "source", "term", "n", "c", share(F.col("n"), F.col("source_n"), F.col("v")).alias("p"), share(F.col("c"), F.col("lang_n"), F.col("v")).alias("q")), groups


def term_ranks(counts: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the terms that a source has beyond the language's share, the first `top`."""
    own = ["lang", "source"]
    cells = counts.groupBy(*own, "n", "c", "p", "q").agg(F.count(F.lit(1)).alias("m")).filter("p > q").withColumn("value", F.col("p") - F.col("q"))
    values = cells.groupBy(*own, "value").agg(F.sum("m").alias("m"))
    first = values.withColumn("_r", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("value")))).filter(F.col("_r") <= top)
    before = F.sum("m").over(Window.partitionBy(*own).orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1))
    placed = first.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < top).drop("_r", "m")
    reached = stage(cells.join(placed, [*own, "value"]).select(*own, "n", "c", "value", "before"), "divergence-cells")
    within = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("value"), "term"))
    found = counts.select(*own, "term", "n", "c").join(small_or_join(reached), [*own, "n", "c"]).withColumn("rank", within).filter(F.col("rank") <= top)
    return found.select(*own, F.col("term").alias("item"), "value", "rank")


def pair_ranks(counts: DataFrame, groups: DataFrame, block: int = BLOCK, terms: int = SLICE) -> DataFrame:
    """lang, source, item, value, rank: every other source of the language by its distance."""
    numbered = stage(groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "divergence-numbered")
    blocks = F.floor(F.col("no") / block).cast("int")
    last = F.floor((F.count(F.lit(1)).over(Window.partitionBy("lang")) - 1) / block).cast("int")
    dealt = stage(numbered.select("lang", "source", "no", "p0", "v", blocks.alias("b"), last.alias("last"), F.greatest(F.lit(1), F.ceil(F.col("v") / terms)).cast("int").alias("slices")), "divergence-blocks")
    side = small_or_join(dealt)
    told = counts.select("lang", "source", "term", "p").join(side, ["lang", "source"]).select("lang", "no", "b", "last", "p0", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), F.xxhash64("term").alias("key"), "term", "p")
    # a source without a term in a slice is there as well, with its share of absent terms
    roster = dealt.select("lang", "no", "b", "last", "p0", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).cast("long").alias("key"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"))
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    met = told.unionByName(roster).withColumn("o", other).select("lang", "slice", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "no", "p0", "term", "p")

    def distances(rows: pd.DataFrame) -> pd.DataFrame:
        lang, b1, b2 = rows["lang"].iloc[0], int(rows["b1"].iloc[0]), int(rows["b2"].iloc[0])
        here = rows["term"].isna()
        roll = rows[here].drop_duplicates("no").sort_values("no")
        numbers, absent = roll["no"].to_numpy(np.int64), roll["p0"].fillna(0).to_numpy(np.int64)
        had = rows[~here]
        column, names = pd.factorize(had["term"])
        table = np.repeat(absent[:, None], len(names), axis=1)
        table[np.searchsorted(numbers, had["no"].to_numpy(np.int64)), column] = had["p"].to_numpy(np.int64)
        left, right = np.flatnonzero(numbers // block == b1), np.flatnonzero(numbers // block == b2)
        out = []
        for i in left:
            to = right[right > i] if b1 == b2 else right
            out.append(pd.DataFrame({"lang": lang, "a": numbers[i], "b": numbers[to], "part": np.abs(table[to] - table[i]).sum(axis=1), "present": len(names)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "part": [], "present": []})

    parts = met.groupBy("lang", "slice", "b1", "b2").applyInPandas(distances, "lang string, a long, b long, part long, present long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("present").alias("present"))
    name = lambda no, tag: small_or_join(dealt.select("lang", F.col("no").cast("long").alias(no), F.col("source").alias(f"s{tag}"), F.col("p0").alias(f"p{tag}"), *(["v"] if tag == 1 else [])))
    both = sums.join(name("a", 1), ["lang", "a"]).join(name("b", 2), ["lang", "b"])
    value = F.when(F.col("v") > 0, F.col("part") + (F.col("v") - F.col("present")) * F.abs(F.col("p1") - F.col("p2"))).otherwise(F.lit(0)).cast("long")
    each = both.select("lang", value.alias("value"), F.explode(F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("item")), F.struct(F.col("s2").alias("source"), F.col("s1").alias("item")))).alias("x")).select("lang", "x.source", "x.item", "value")
    return each.select("lang", "source", "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of docs (needs text, lang, source)."""
    counts, groups = prepared(docs, least_docs)
    columns = ("lang", "source", "part", "item", "value", "rank")
    pairs = pair_ranks(counts, groups).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(term_ranks(counts, top).withColumn("part", F.lit("term")).select(*columns))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Contract query over documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


#: DuckDB twin of op13_source_divergence, over the full table of sources and kept terms.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 30),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n) AS n FROM own GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS c,
             1 + (1000000000::HUGEINT * (coalesce(own.n, 0) + 5)) // (coalesce(total.n, 0) + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (kept.c + 5)) // (l.n + 5 * l.v) AS q
      FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term LEFT JOIN total ON total.lang = g.lang AND total.source = g.source),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(dist.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS r FROM p WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
UNION ALL SELECT lang, source, 'term', item, value, r::INT FROM term WHERE r <= 50
"""
