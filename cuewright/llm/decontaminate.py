"""Operator 6, benchmark decontamination by SimHash windows. DataFrame functions only.

A benchmark item of L words is looked for in windows of L words. Windows and items carry a 64-bit SimHash of
their five-word shingles; a multi-index over RADIUS + 1 bit blocks finds every item of a window's size within RADIUS
bits of it (two fingerprints that differ in RADIUS bits agree in at least one of RADIUS + 1 blocks). Each candidate
is verified exactly: the weighted Jaccard similarity of the two bags of shingles (weights are multiplicities) must
reach `threshold`. At a similarity of 0.8 about ten bits differ, so that RADIUS is more than three deviations away.

Which windows are fingerprinted: one of similarity t to an item of n shingles holds at least t * n of them, and, if it
has n shingles, at least 2 t n / (1 + t). So a window needs that many places whose shingle occurs in some item of its
size, of whichever item: this leaves out windows that cannot match, and says nothing of what the others match. That
is for the index alone, whose key is (size, block, bits).

Both costs are linear in the text, whatever repeats in it and however long the items are. Neighbouring windows are
fingerprinted by sliding: a shingle's bits are spread over counters of 21 bits, three in a 64-bit number, the window's
counters are a sum, and a step adds one place and drops one; windows of one fingerprint in a row are one posting. The
exact similarity comes from events: the i-th place of a shingle that an item has m times counts for the windows from
after the (i-m)-th such place to the place itself, so a running sum over such stretches' ends gives the bags' exact
intersection for every window of a document, and no bag is ever copied. Items of up to 2,097,151 words fit the counters.

The anchors of one document and item size are one group, bounded by the document's length. Documents without a shared
shingle leave the plan behind the first join; the texts of the others are read again. The benchmark's shingle hashes
and the keys of those documents are broadcast while they are at most IN_MEMORY narrow rows, and joined by shuffle
beyond that.

Words are runs of other than \\x20 and \\x09-\\x0D, A-Z in lower case. Defined cases: null texts count as
empty; items of fewer than five words are too short to be evidence and match nothing; repeated items match
alike, and items that share shingles are each looked for; very long texts and items are taken whole; repeated or
null doc_ids: rows with one doc_id give one result per (doc_id, item), a null doc_id is a document like others;
empty tables give an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_or_join, stage, union_all

WIDTH, RADIUS, THRESHOLD, IN_MEMORY = 5, 19, 0.8, 1_000_000
_BREAK = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _BREAK), lambda w: w != "")


def with_shingles(df: DataFrame) -> DataFrame:
    """Adds length (words) and hs (hashes of the WIDTH-word shingles in order) to a table with column text.

    The steps are projections of their own: each array is computed once, not inside the next one's lambda."""
    df = df.withColumn("w", words(F.col("text"))).withColumn("hw", F.transform("w", lambda w: F.xxhash64(w))).drop("w", "text")
    last = F.size("hw") - (WIDTH - 1)
    each = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(*(F.element_at("hw", i + j) for j in range(WIDTH))))
    return df.withColumn("hs", F.when(last > 0, each).otherwise(F.array().cast("array<bigint>"))).withColumn("length", F.size("hw")).drop("hw")


def let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: Counters of FIELD bits, three to a number; the bits of a nibble of three in their counters.
FIELD, GROUPS = 21, 22
_SPREAD = [b & 1 | (b >> 1 & 1) << FIELD | (b >> 2 & 1) << 2 * FIELD for b in range(8)]
_NONE = [0] * GROUPS


def numbers(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def counted(h: Column) -> Column:
    """A hash's 64 bits, each in a counter of its own."""
    return F.array(*(F.get(numbers(_SPREAD), F.shiftrightunsigned(h, 3 * g).bitwiseAND(F.lit(7).cast("long")).cast("int")) for g in range(GROUPS)))


def fingerprint(counts: Column, n: Column) -> Column:
    """64 bits: bit b is one if more than half of the n counted hashes have it."""
    terms = []
    for b in range(64):
        ones = F.shiftrightunsigned(F.get(counts, F.lit(b // 3)), FIELD * (b % 3)).bitwiseAND(F.lit((1 << FIELD) - 1))
        terms.append(F.when(ones * 2 > n, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    while len(terms) > 1:
        terms = [x.bitwiseOR(y) for x, y in zip(terms[::2], terms[1::2], strict=True)]
    return terms[0]


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def total_of(hs: Column) -> Column:
    return F.aggregate(hs, numbers(_NONE), lambda acc, h: plus(acc, counted(h)))


def simhash(hs: Column) -> Column:
    return let(total_of(hs), lambda counts: fingerprint(counts, F.size(hs)))


def slide(hs: Column, n: Column, first: Column, last: Column) -> Column:
    """array<struct<start, print>>: the fingerprints of the windows of n places that start from first to last, one entry
    where it changes. Windows over an edge of hs hold what there is of it."""
    size = lambda s: F.greatest(F.least(s + n, F.size(hs)) - F.greatest(s, F.lit(0)), F.lit(0))
    entry = lambda s, p: F.struct(s.alias("start"), p.alias("print"))

    def step(acc: Column, s: Column) -> Column:
        come, gone = F.get(hs, s + n - 1), F.get(hs, s - 1)  # null beyond the edges
        more = F.when(come.isNotNull(), plus(acc["counts"], counted(come))).otherwise(acc["counts"])
        return let(more, lambda m: let(F.when(gone.isNotNull(), minus(m, counted(gone))).otherwise(m), lambda counts: let(
            fingerprint(counts, size(s)), lambda p: F.struct(counts.alias("counts"), p.alias("print"), F.when(p == acc["print"], acc["runs"]).otherwise(F.array_append(acc["runs"], entry(s, p))).alias("runs")))))

    # by place: Spark's slice would turn all of hs into objects first
    held = F.when(size(first) > 0, F.sequence(F.greatest(first, F.lit(0)), F.least(first + n, F.size(hs)) - 1)).otherwise(F.array().cast("array<int>"))
    begin = let(F.aggregate(held, numbers(_NONE), lambda acc, i: plus(acc, counted(F.get(hs, i)))), lambda counts: let(
        fingerprint(counts, size(first)), lambda p: F.struct(counts.alias("counts"), p.alias("print"), F.array(entry(first, p)).alias("runs"))))
    rest = F.when(last > first, F.sequence(first + 1, last)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rest, begin, step)["runs"]


def blocks(fingerprint: Column) -> Column:
    """The RADIUS + 1 blocks of a fingerprint as (number, bits)."""
    n = RADIUS + 1
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*(F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fingerprint, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)).alias("bits")) for i in range(n)))


def ranges(at: Column, n: Column, least: Column) -> Column:
    """array<struct<first, last>>: the starts of windows of n places that hold `least` of the ascending places `at`, ascending and apart.

    The places from the i-th on are enough if the window reaches the one `least` - 1 further and starts no later
    than the i-th; starts up to the place before the i-th belong to an earlier i."""
    after = F.transform(F.sequence(F.lit(0), F.size(at) - least), lambda i: F.struct(F.greatest(F.get(at, i + least - 1) - n + 1, F.coalesce(F.get(at, i - 1) + 1, F.get(at, i + least - 1) - n + 1)).alias("first"), F.get(at, i).alias("last")))
    return F.when((F.size(at) >= least) & (least > 0), F.filter(after, lambda r: r["first"] <= r["last"]))


def window_ranges(anchors: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """key, length, first, last: stretches of starts whose windows hold enough anchors, in pieces of about a window. sizes: length, h."""
    held = anchors.join(small_or_join(sizes), "h").groupBy("key", "total", "length").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    n = F.col("length") - (WIDTH - 1)
    # inside the text a window has n shingles; over its edges it has fewer and can do with fewer
    cuts = ((2 * threshold / (1 + threshold), F.lit(0), F.col("total") - n), (threshold, F.lit(None).cast("int"), F.lit(-1)), (threshold, F.greatest(F.col("total") - n + 1, F.lit(0)), F.lit(None).cast("int")))
    parts = []
    for share, low, high in cuts:
        each = held.select("key", "length", F.explode(ranges(F.col("at"), n, F.ceil(n * share - 1e-9).cast("int"))).alias("r"), low.alias("low"), high.alias("high"))
        parts.append(each.select("key", "length", F.greatest("r.first", "low").alias("first"), F.least("r.last", "high").alias("last")).filter("first <= last"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    own = Window.partitionBy("key", "length").orderBy("first", "last")  # of one document
    opens = F.coalesce(F.col("first") > F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    joined = every.withColumn("o", opens.cast("int")).withColumn("no", F.sum("o").over(own.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "length", "no").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    piece = F.greatest(F.lit(256), F.col("length"))
    starts = joined.select("key", "length", "first", "last", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - F.col("first")) / piece).cast("int"))).alias("k"))
    return starts.select("key", "length", (F.col("first") + F.col("k") * piece).alias("first"), F.least("last", F.col("first") + (F.col("k") + 1) * piece - 1).alias("last"))


def within_radius(prints: DataFrame, own: DataFrame) -> DataFrame:
    """key, total, length, item, start, until: the multi-index. Equal bits in one block, then the Hamming distance; each pair is taken at its first equal block.

    prints: key, total, length, start, until, print. own: length, item, item_print."""
    index = stage(own.select("length", "item", "item_print", F.explode(blocks(F.col("item_print"))).alias("b")).select("length", "item", "item_print", "b.no", "b.bits"), "leak-index")
    posted = prints.select("key", "total", "length", "start", "until", "print", F.explode(blocks(F.col("print"))).alias("b")).select("key", "total", "length", "start", "until", "print", "b.no", "b.bits")
    differ = F.col("print").bitwiseXOR(F.col("item_print"))
    met = posted.join(small_or_join(index), ["length", "no", "bits"]).filter(F.bit_count(differ) <= RADIUS)
    n, earlier = RADIUS + 1, F.lit(False)
    for i in range(n - 1):
        same = F.shiftrightunsigned(differ, 64 * i // n).bitwiseAND(F.lit((1 << (64 * (i + 1) // n - 64 * i // n)) - 1)) == 0
        earlier = earlier | ((F.col("no") > i) & same)
    return met.filter(~earlier).select("key", "total", "length", "item", "start", "until")


def verified(met: DataFrame, anchors: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """key, item, similarity, start, n_windows of the windows that reach the threshold, exactly, for all of met's at once.

    bags: item, h, m (how often the item has it)."""
    pairs = stage(met.select("key", "total", "length", "item").distinct(), "leak-pairs")
    n = F.col("length") - (WIDTH - 1)
    held = anchors.select("key", "pos", "h").join(small_or_join(pairs), "key").join(small_or_join(bags), ["item", "h"]).groupBy("key", "total", "length", "item", "h", "m").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    counts = F.transform("at", lambda p, i: F.struct(F.greatest(p - n + 1, F.get("at", i - F.col("m")) + 1).alias("first"), p.alias("last")))
    counts = held.select("key", "total", "length", "item", F.explode(counts).alias("c"))
    key = ["key", "total", "length", "item"]
    events = [(counts, "c.first", 1, 0), (counts, F.col("c.last") + 1, -1, 0), (met, "start", 0, 1), (met, F.col("until") + 1, 0, -1)]
    every = union_all([df.select(*key, (F.col(s) if isinstance(s, str) else s).alias("s"), F.lit(i).alias("di"), F.lit(m).alias("dm")) for df, s, i, m in events])
    sums = every.groupBy(*key, "s").agg(F.sum("di").alias("di"), F.sum("dm").alias("dm"))
    over = Window.partitionBy(*key).orderBy("s")  # of one document and item
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    told = sums.select(*key, "s", F.sum("di").over(upto).alias("both"), F.sum("dm").over(upto).alias("asked"), (F.lead("s").over(over) - 1).alias("e")).filter("asked > 0 and both > 0")
    # a window's size falls towards the edges only, so of a stretch with one intersection an end is the best
    size = lambda s: F.least(s + n, F.col("total")) - F.greatest(s, F.lit(0))
    like = lambda s: F.col("both") / (size(s) + n - F.col("both"))
    most = F.floor(F.col("both") * (1 + 1 / threshold) - n + 1e-9)  # the largest window that reaches the threshold
    large = F.greatest(F.least(F.col("e"), F.col("total") - most - 1) - F.greatest(F.col("s"), most - n + 1) + 1, F.lit(0))
    good = F.col("e") - F.col("s") + 1 - F.when((n > most) & (F.col("total") > most), large).otherwise(F.lit(0))
    best = F.when(like(F.col("s")) >= like(F.col("e")), F.struct(like(F.col("s")).alias("similarity"), (-F.col("s")).alias("minus"))).otherwise(F.struct(like(F.col("e")).alias("similarity"), (-F.col("e")).alias("minus")))
    return told.select(*key, best.alias("best"), good.alias("good")).filter("good > 0").groupBy("key", "item").agg(F.max("best").alias("best"), F.sum("good").alias("n_windows")).select("key", "item", F.col("best.similarity").alias("similarity"), (-F.col("best.minus")).alias("start"), "n_windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_windows: one row per document and benchmark item found in it."""
    items = stage(with_shingles(benchmark.select("item_id", "text")).filter(F.col("length") >= WIDTH).withColumn("item", F.xxhash64("hs")), "leak-items")
    bags = stage(items.dropDuplicates(["item"]).select("item", "length", F.explode("hs").alias("h")).groupBy("item", "length", "h").agg(F.count(F.lit(1)).cast("int").alias("m")), "leak-bags")
    known = stage(bags.select("h").distinct(), "leak-known")
    # the key stands for a row's id and text; rows that agree in both are one row here
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    every = with_shingles(text.select("key", "text")).select("key", F.size("hs").alias("total"), F.posexplode_outer("hs").alias("pos", "h"))  # outer: no inferred filter that would compute hs twice
    anchors = stage(every.join(small_or_join(known, IN_MEMORY), "h").select("key", "total", "pos", "h"), "leak-anchors")
    listed = window_ranges(anchors, stage(bags.select("length", "h").distinct(), "leak-sizes"), threshold).groupBy("key").agg(F.collect_list(F.struct("length", "first", "last")).alias("pieces"))  # of one document
    listed = stage(listed, "leak-windows")
    rows = stage(with_shingles(text.join(small_or_join(listed.select("key"), IN_MEMORY), "key", "left_semi").dropDuplicates(["key"])).drop("length"), "leak-rows")
    # a document's shingles come to its windows once
    slid = lambda w: F.struct(w["length"].alias("length"), w["last"].alias("last"), slide(F.col("hs"), w["length"] - (WIDTH - 1), w["first"], w["last"]).alias("runs"))
    cut = rows.join(listed, "key").select("key", F.size("hs").alias("total"), F.explode(F.transform("pieces", slid)).alias("w"))
    until = F.transform("w.runs", lambda r, i: F.struct(r["start"].alias("start"), F.coalesce(F.get("w.runs", i + 1)["start"] - 1, F.col("w.last")).alias("until"), r["print"].alias("print")))
    prints = stage(cut.select("key", "total", F.col("w.length").alias("length"), F.explode(until).alias("r")).select("key", "total", "length", "r.start", "r.until", "r.print"), "leak-prints")
    own = stage(items.dropDuplicates(["item"]).select("length", "item", simhash(F.col("hs")).alias("item_print")), "leak-item-prints")
    met = stage(within_radius(prints, own), "leak-met")
    sure = verified(met, anchors, bags.drop("length"), threshold)
    named = sure.join(rows.select("key", "doc_id"), "key").join(items.select("item", "item_id"), "item")
    best = named.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best"), F.sum("n_windows").alias("n_windows"))
    return best.select("doc_id", "item_id", F.round("best.similarity", 6).alias("similarity"), (-F.col("best.s")).cast("long").alias("start_word"), "n_windows")


def op6_simhash_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item; a row per contaminated document and item."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
