"""Operator 8, MinHash near-dedup by a signature-coordinate inverted join.

Documents with equal shingle sets form one class; one member of each class goes on, under its least doc_id or,
where another class has that too or there is none, a negative number of its own. A class has a signature
of COORDINATES values, each made of GROUP minimum hashes, and is posted under (coordinate, value) for its first coordinates only: a pair
that agrees in at least LEAST of all coordinates must agree in one of the first COORDINATES - LEAST + 1
(prefix). A short posting list gives its pairs; pairs are counted over the whole signature and those under
LEAST are dropped (skip). At a similarity of 0.8 a pair falls below LEAST with a chance under 2 in
100,000 (binomial with 48 trials of 0.8^3), at 0.85 under one in ten million. What is left is confirmed on the full shingle sets.

A long posting list does not give all its pairs. Every member is paired with the first one, then, twice, with
a member that is still outside the group's largest component; that connects groups of near copies. What is
outside even then (members of groups with a common passage, or copies that differ too much) is paired by an
exact prefix join on rare shingles with those members of other components that can have the similarity
(never all with all).
Components are found by label spreading with tables in the shared folder.

Defined cases: a null text counts as empty; a text without words has no shingles and is linked with nothing;
a text with fewer words than a shingle has its whole sequence as the one shingle; a null doc_id is a document
that is linked like others but never names a component (one of null ids only has a null component and all its
rows are kept); rows with one doc_id are documents of their own, whatever their texts, and kept says for each
whether its doc_id names its component; very long texts are taken whole; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, small_or_join, stage, tidy, unstage

COORDINATES, GROUP, LEAST, SHORT, ROUNDS, COUNTERS = 48, 3, 11, 24, 2, 1 << 20
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_RNG = np.random.default_rng(8)
_MUL = _RNG.integers(1, 1 << 63, COORDINATES * GROUP, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, COORDINATES * GROUP, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        total = _mix(total + h[i : len(h) - width + 1 + i] + np.uint64(i + 1))
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES values of 32 bits, each made of GROUP minimum hashes."""
    out = np.full(COORDINATES * GROUP, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        out = np.minimum(out, (shingles[at : at + 1024] * _MUL[:, None] + _ADD[:, None]).min(axis=1))
    value = np.zeros(COORDINATES, np.uint64)
    for g in range(GROUP):
        value = _mix(value + out[g::GROUP])
    return (value >> np.uint64(32)).astype(np.uint32).view(np.int32)


def describe(docs: DataFrame, width: int) -> DataFrame:
    """key, doc_id, n_shingles, set_hash (of the whole set), sign: one row per document."""

    def run(batches):
        for batch in batches:
            n, names, signs = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), width)
                n.append(len(s))
                names.append(xxhash.xxh3_128_digest(s.tobytes()))
                signs.append(signature(s) if len(s) else np.zeros(COORDINATES, np.int32))
            flat = np.concatenate(signs) if signs else np.zeros(0, np.int32)
            sign = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, COORDINATES), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(names, pa.binary()), sign], names=["key", "doc_id", "n_shingles", "set_hash", "sign"])

    return keyed(docs).mapInArrow(tidy(run), "key long, doc_id long, n_shingles long, set_hash binary, sign array<int>")


def keyed(docs: DataFrame) -> DataFrame:
    """key, doc_id, text: the key stands for a row's id and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def agree(sign_a, sign_b):
    """Column: in how many coordinates two signatures agree."""
    return F.aggregate(F.zip_with(sign_a, sign_b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def posting_lists(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(short, long): postings (list_key, id) of lists of up to SHORT members; and members of longer lists, as groups.

    Only keys and ids are shuffled. Long lists with one first member are one group, named by it: a near-copy
    group shares its head under most coordinates."""
    prefix = COORDINATES - LEAST + 1
    deal = F.explode(F.transform(F.sequence(F.lit(0), F.lit(prefix - 1)), lambda j: F.xxhash64(j, F.col("sign")[j])))
    now = classes.select("id", deal.alias("list_key"))
    counts = stage(now.groupBy("list_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head")).filter("n > 1"), "minhash-counts")
    # both sides come from exchanges, so a hot key is split by adaptive execution
    shared = stage(now.join(counts, "list_key"), "minhash-shared")
    return shared.filter(F.col("n") <= SHORT).select("list_key", "id"), stage(shared.filter(F.col("n") > SHORT).select(F.col("head").alias("list_key"), "id").distinct(), "minhash-long")


def agreeing(pairs: DataFrame, classes: DataFrame, per_cent: int) -> DataFrame:
    """Distinct (a, b) whose signatures agree in at least LEAST coordinates and whose sizes allow the similarity."""
    of = lambda x: classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sign").alias(f"sign_{x}"))
    told = pairs.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    fits = 100 * F.least("n_a", "n_b") >= per_cent * F.greatest("n_a", "n_b")
    return told.filter(fits).filter(agree("sign_a", "sign_b") >= LEAST).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= per_cent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= per_cent * (len(p) + len(q) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b")
    return two.select("a", "b", "of_a", "of_b").mapInArrow(tidy(run), "a long, b long")


def rare_pairs(members: DataFrame, outside: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) of different components, one of them outside, which can have the similarity: an exact prefix join.

    All sets are put in one order, rare shingles first; sets as similar as per_cent share one of the first
    n - ceil(per_cent * n / 100) + 1 shingles of each. Near copies that are apart differ in just those, so
    hardly any of their pairs come up. The order is that of a table of COUNTERS counts by hash: a bounded
    broadcast, and counts that fall together only make the order worse, never wrong."""
    spark = sets.sparkSession
    own = stage(sets.join(members.select("id"), "id", "left_semi"), "minhash-own", "uncompressed")

    def tally(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                slot, n = np.unique((np.frombuffer(raw, np.uint64) & np.uint64(COUNTERS - 1)).astype(np.int64), return_counts=True)
                total[slot] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["slot", "n"])

    counted = own.select("shingles").mapInArrow(tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(COUNTERS, np.int64)
    table[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    shared = spark.sparkContext.broadcast(table)

    def prefixes(batches):
        counts = shared.value
        for batch in batches:
            ids, keys, places, sizes = [], [], [], []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(raw, np.uint64)
                n = counts[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
                first = np.lexsort((h, n))[: len(h) + per_cent * -len(h) // 100 + 1]
                place = np.flatnonzero(n[first] > 1)  # a count of one: no other set has it
                keys.append(h[first[place]].view(np.int64))
                places.append(place)
                ids.append(np.full(len(place), doc, np.int64))
                sizes.append(np.full(len(place), len(h), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, ids, places, sizes)], names=["h", "id", "place", "size"])

    posted = own.select("id", "shingles").mapInArrow(prefixes, "h long, id long, place long, size long")
    posted = stage(posted.join(members, "id").join(outside.withColumn("out", F.lit(True)), "id", "left").select("h", "id", "place", "size", "component", F.coalesce("out", F.lit(False)).alias("out")), "minhash-rare")
    # lists that lie in one component have nothing to tell
    mixed = stage(posted.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("h"), "minhash-mixed")
    posted = stage(posted.join(mixed, "h", "left_semi"), "minhash-rare-mixed")
    x = posted.filter("out").select("h", *(F.col(c).alias(f"{c}_a") for c in ("id", "component", "place", "size")))
    y = posted.select("h", "out", *(F.col(c).alias(f"{c}_b") for c in ("id", "component", "place", "size")))
    # at the first shingle that two sets share, what is left of the shorter rest bounds their intersection (positional filter)
    rest = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    able = (100 + per_cent) * rest >= per_cent * (F.col("size_a") + F.col("size_b"))
    met = x.join(y, "h").filter((F.col("component_a") != F.col("component_b")) & (~F.col("out") | (F.col("id_a") < F.col("id_b"))) & able).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge.

    Each round takes the smallest label among the neighbours and then the label's own label; labels only fall,
    and a long chain is halved in every round. Tables of both sides lie in the shared folder."""
    spark = edges.sparkSession
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "components-edges")
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label"), "components-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        seen = stage(labels.join(near, labels["id"] == near["a"]).select("id", "label", F.least("label", "near").alias("next")), "components-near")
        own = seen.select(F.col("id").alias("next"), F.col("next").alias("jump"))
        after = stage(seen.join(own, "next", "left").select("id", F.least("next", F.coalesce("jump", "next")).alias("label"), F.col("label").alias("before")), "components-labels")
        moved = not after.filter(F.col("label") != F.col("before")).isEmpty()
        unstage(spark, seen, labels)
        labels = after.select("id", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")


def near_dedup(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document of docs (needs doc_id, text)."""
    spark = docs.sparkSession
    arrow_limits(spark)
    described = stage(describe(docs, width), "minhash-signs")
    # classes of equal sets: the copies are one row each from here on
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    classes = described.filter(F.col("n_shingles") > 0).groupBy("set_hash").agg(F.min("doc_id").alias("least"), F.min_by("key", first).alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("sign").alias("sign"))
    classes = stage(classes.withColumn("seq", F.monotonically_increasing_id()), "minhash-sets-once")
    # a class goes by its least doc_id (a group's first document is the one its copies resemble most: the best head of a long list), unless that is no name
    shared = stage(classes.filter("least >= 0").groupBy("least").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("least", F.lit(True).alias("shared")), "minhash-shared-ids")
    own = F.when(F.col("shared") | F.col("least").isNull() | (F.col("least") < 0), -1 - F.col("seq")).otherwise(F.col("least"))
    classes = stage(classes.join(small_or_join(shared), "least", "left").select("set_hash", "least", "key", "n_shingles", "sign", own.alias("id")), "minhash-classes")
    short, long = posting_lists(classes)
    near = short.withColumnRenamed("id", "a").join(short.withColumnRenamed("id", "b"), "list_key").filter("a < b")
    stars = long.filter("list_key < id").select(F.col("list_key").alias("a"), F.col("id").alias("b"))
    candidates = stage(agreeing(near.select("a", "b").unionByName(stars.select("a", "b")), classes, per_cent), "minhash-candidates")
    # the sets of documents that are in any candidate pair or in a long list, from their whole texts
    wanted = stage(candidates.select(F.col("a").alias("id")).union(candidates.select("b")).union(long.select("id")).distinct(), "minhash-wanted")

    def make_sets(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(2)]
            same = pa.array([xxhash.xxh3_128_digest(s) == h for s, h in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())  # of another row with this key else
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(same), pa.array(sets, pa.binary()).filter(same)], names=["id", "shingles"])

    wanted = stage(wanted.join(classes.select("id", "key", "set_hash"), "id"), "minhash-wanted-keys")
    texts = keyed(docs).select("key", "text").join(small_or_join(wanted, 1_000_000), "key").select("id", "set_hash", "text")
    sets = stage(texts.mapInArrow(make_sets, "id long, shingles binary").dropDuplicates(["id"]), "minhash-sets", "uncompressed")
    edges = stage(confirmed(candidates, sets, per_cent), "minhash-edges")
    found = components(edges)
    for turn in range(ROUNDS + 1):
        # members outside their group's largest component
        told = stage(long.join(found, "id", "left").select("list_key", "id", F.coalesce("component", "id").alias("component")), "minhash-told")
        largest = stage(told.groupBy("list_key", "component").count().groupBy("list_key").agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.count(F.lit(1)).alias("parts")).filter("parts > 1"), "minhash-largest")
        outside = stage(told.join(small_or_join(largest), "list_key").filter(F.col("component") != F.col("largest")).select("list_key", F.col("id").alias("a"), F.col("component").alias("c_a")), "minhash-outside")
        if outside.isEmpty():
            break
        if turn < ROUNDS:  # one of them meets the members of other components
            some = stage(outside.groupBy("list_key").agg(F.min_by(F.struct("a", "c_a"), F.xxhash64("a", F.lit(turn))).alias("h")).select("list_key", "h.a", "h.c_a"), "minhash-some")
            met = some.join(told.select("list_key", F.col("id").alias("b"), F.col("component").alias("c_b")), "list_key").filter("c_a != c_b")
            more = agreeing(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), classes, per_cent)
        else:  # all of them, by rare shingles
            more = rare_pairs(told.select("id", "component").distinct(), outside.select(F.col("a").alias("id")).distinct(), sets, per_cent)
        new = stage(confirmed(stage(more, "minhash-more"), sets, per_cent), "minhash-edges")
        if not new.isEmpty():
            edges = edges.unionByName(new)
            found = components(edges)
    labelled = stage(classes.select("set_hash", "id", "least").join(found, "id", "left").select("set_hash", "least", F.coalesce("component", "id").alias("label")), "minhash-labels")
    names = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = stage(labelled.join(names, "label").select("set_hash", "component_id"), "minhash-named")
    joined = described.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)) | F.col("component_id").isNull())


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: four-word shingles over documents, 100 * intersection >= 80 * union."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=4)
