"""Operator 3, mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' ids; each window of `window` ids takes from each queue its share of
the window, and what a queue is owed but did not get (a fraction of an id) is carried on as its deficit. The
round-robin's state after b rounds has a closed form, floor(T * b / rounds) ids of a queue with T ids in all,
so any task can start at any round with the right deficits: nothing runs in sequence over the corpus. A
document's place in its queue is a prefix sum (within a part while it is encoded, then over parts), its
pieces are where the rounds cut that stretch, and a piece's place in the output follows from the closed form
of all queues.

Sources with at least one id a window (there can be no more than `window` of them, so the plan that tasks
hold is bounded) and those with a target have a queue each. Of smaller sources a window's share is less than
one id. They share one more queue, in which each is served a document at a time, when its deficit has come to
the middle of it: in order of (ids before it in its source + half its own) / (ids of its source), after a first
deficit that a hash of the source's name gives it (its queue goes round from there). So the small sources, too,
run side by side from the first window to the last, however many they are, and sources of a document or two do
not all come due at once.

With the targets equal to the corpus' own proportions all queues end together and there is one stretch of
rounds. With other `targets` the stretch ends when the first queue with a target runs dry; the others go on in
their relative proportions, sources without a target come when no other is left, in the proportions of their
sizes: every id is packed exactly once in either case.

Defined cases: a null or empty text is its end id alone; a null source is a queue of its own; null or
repeated doc_ids are packed as rows of their own; an empty table gives an empty result; only the last
sequence is padded. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_or_join, stage, tidy
from .tokens import REMEMBERED, encoder, token_table

WINDOW = 4096
#: Rows of (part, queue) up to which the queues' places are broadcast; beyond, they are joined by shuffle.
PLACES = 1_000_000
#: Stretches of the small sources' common queue that are summed apart.
LANES = 65_536
#: Cells of the table of queues and rounds that a task works on at once.
CELLS = 1 << 20


def stretches(totals: list[int], targets: list[float] | None, window: int) -> list[dict]:
    """The rounds: per stretch, ids of each queue before it, ids in it, its rounds and its first position."""
    left, before, start, out = list(totals), [0] * len(totals), 0, []
    weights = list(targets) if targets else [float(t) for t in totals]
    while any(left):
        alive = [i for i, n in enumerate(left) if n and weights[i] > 0] if targets else []
        first = min(alive, key=lambda i: left[i] / weights[i]) if alive else None
        take = [0] * len(left) if alive else list(left)
        for i in alive:
            take[i] = left[i] if i == first else min(left[i], int(left[first] * (weights[i] / weights[first])))
        total = sum(take)
        out.append({"before": before, "ids": take, "rounds": max(1, -(-total // window)), "start": start})
        before = [b + n for b, n in zip(before, take, strict=True)]
        left = [n - t for n, t in zip(left, take, strict=True)]
        start += total
    return out


def pieces_of(slot: int, a: int, b: int, plan: list[dict], window: int) -> list[tuple[int, int, int]]:
    """(position in the queue, length, position in the output) of the pieces of ids [a, b) of a queue."""
    out = []
    for s in plan:
        lo, n, rounds = s["before"][slot], s["ids"][slot], s["rounds"]
        x, y = max(a, lo) - lo, min(b, lo + n) - lo
        if x >= y:
            continue
        kind = object if max(s["ids"]) * (rounds + 1) >= 1 << 62 else np.int64
        each = np.array(s["ids"], kind)
        first, last = ((x + 1) * rounds - 1) // n, (y * rounds - 1) // n + 1
        many = max(1, CELLS // len(each))  # a long text goes through many rounds of all queues: some at a time
        for low in range(first, last, many):
            r = np.arange(low, min(last, low + many) + 1).astype(kind)
            reached = each[:, None] * r // rounds  # ids of every queue before each round
            now, then = reached[:, :-1], reached[:, 1:]
            shift = s["start"] + then[:slot].sum(axis=0) + now[slot + 1 :].sum(axis=0)  # output position minus queue position
            for c, d, off in zip(np.maximum(now[slot], x).tolist(), np.minimum(then[slot], y).tolist(), shift.tolist(), strict=True):
                while c < d:
                    e = min(d, c + window - (c + off) % window)
                    out.append((lo + c, e - c, c + off))
                    c = e
    return out


def queue_places(tokens: DataFrame) -> DataFrame:
    """part, queue, base: a queue's ids before each part, by prefix sums over lanes of parts and then within them."""
    sizes = stage(tokens.groupBy("part", "queue").agg(F.sum("n").alias("n"), F.shiftright("part", 8).alias("lane")), "packing-sizes")
    before = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lanes = stage(sizes.groupBy("queue", "lane").agg(F.sum("n").alias("n")), "packing-lanes")
    lanes = lanes.select("queue", "lane", before(["queue"], "lane").alias("first"), F.sum("n").over(Window.partitionBy("queue")).alias("total"))
    placed = sizes.withColumn("run", before(["queue", "lane"], "part")).join(lanes, ["queue", "lane"])
    return stage(placed.select("part", "queue", (F.col("run") + F.col("first")).alias("base"), "total"), "packing-places")


def small_places(small: DataFrame) -> DataFrame:
    """part, seq, place: documents of small sources in their common queue. small: part, seq, queue, n, time (0 to 1)."""
    spark = small.sparkSession
    dealt = stage(small.withColumn("lane", F.least(F.floor(F.col("time") * LANES), F.lit(LANES - 1)).cast("int")), "packing-small")
    run, first = 0, []
    for r in dealt.groupBy("lane").agg(F.sum("n").alias("n")).orderBy("lane").collect():  # at most LANES rows
        first.append((r["lane"], run))
        run += r["n"]
    order = Window.partitionBy("lane").orderBy("time", "queue", "part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.select("part", "seq", "lane", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("run"))
    return stage(within.join(F.broadcast(spark.createDataFrame(first, "lane int, first long")), "lane").select("part", "seq", (F.col("run") + F.col("first")).alias("place")), "packing-small-places")


def pack(docs: DataFrame, vocabulary: str, source: str = "source", window: int = WINDOW, targets: dict[str, float] | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids. remembered: parts of text that a worker remembers, a matter of its memory alone."""
    spark = docs.sparkSession
    tokens = stage(token_table(docs, vocabulary, source, remembered), "packing-tokens")
    places = queue_places(tokens)
    totals = stage(places.select("queue", "total").distinct(), "packing-totals")  # a row per source
    total = totals.agg(F.sum("total")).first()[0] or 0
    aimed = {f"s{name}": float(weight) for name, weight in (targets or {}).items()}
    large = (F.col("total") >= max(1, -(-total // window))) | (F.col("queue").isin(list(aimed)) if aimed else F.lit(False))
    named = totals.filter(large).orderBy(F.desc("total"), "queue").collect()  # at most `window` sources and the targets
    rest = total - sum(r["total"] for r in named)
    slots = F.broadcast(spark.createDataFrame([(r["queue"], i) for i, r in enumerate(named)], "queue string, slot int"))
    plan = spark.sparkContext.broadcast(stretches([*(r["total"] for r in named), rest], [*(aimed.get(r["queue"], 0.0) for r in named), 0.0] if targets else None, window))

    def cut(batches):
        wide = np.uint16 if encoder(vocabulary, remembered).size <= 1 << 16 else np.uint32
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for doc, n, place, slot, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(raw, wide).astype("<u4").tobytes()
                for at, length, out in pieces_of(slot, place, place + n, plan.value, window):
                    own = data[4 * (at - place) : 4 * (at - place + length)]
                    for column, x in zip(rows, (doc, at - place, length, zlib.crc32(own), n, out // window, out % window, own), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:7]), pa.array(rows[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    own = small_or_join(stage(places.join(slots, "queue").select("part", "queue", "slot", "base"), "packing-bases"), PLACES)
    placed = tokens.select("doc_id", "n", "before", "part", "queue", "ids").join(own, ["part", "queue"])
    placed = placed.select("doc_id", "n", (F.col("base") + F.col("before")).alias("place"), "slot", "ids")
    if rest:
        few = tokens.join(slots, "queue", "left_anti")
        shares = few.select("part", "seq", "queue", "n", "before").join(places, ["part", "queue"])
        owed = F.pmod(F.xxhash64("queue"), F.lit(1 << 32)) / float(1 << 32)  # the source's first deficit
        due = (F.col("base") + F.col("before") + F.col("n") / 2) / F.col("total") + owed
        shared = small_places(shares.select("part", "seq", "queue", "n", (due - F.floor(due)).alias("time")))
        placed = placed.unionByName(few.select("doc_id", "n", "part", "seq", "ids").join(shared, ["part", "seq"]).select("doc_id", "n", "place", F.lit(len(named)).alias("slot"), "ids"))
    return placed.mapInArrow(tidy(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op3_mixture_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, in the proportions of their sources."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
