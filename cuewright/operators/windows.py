"""Windows over a signal, slot votes, hit runs, clips, spans and peaks. Times are whole numbers (samples or microseconds)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list, starts: Column, name: str) -> DataFrame:
    """Number the islands of each key from 0: a row for which `starts` holds (or is null, the first) opens one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    flagged = df.withColumn("_opens", F.coalesce(starts, F.lit(True)).cast("long"))
    return flagged.withColumn(name, F.sum("_opens").over(w) - 1).drop("_opens")


def chunked_islands(df: DataFrame, keys: list[str], order: list, chunk: Column, name: str, starts, summary: dict[str, Column], carried: dict[str, Column]) -> tuple[DataFrame, Callable]:
    """Islands of very long keys in two phases: within chunks of a key, then stitched at the chunks' borders.

    A chunk is a stretch of a key in `order`. `summary` are aggregates of a chunk, `carried` are what a row needs of
    the chunks before its own, as columns over the summaries in a window of them; `starts(before, carry)` says
    whether a row opens an island, where before(f) is f over the chunk's rows before it and carry(c) a carried column.
    Every chunk is sorted by itself; what meets in one task for a key is one row for each chunk. Returns the rows with
    a number within the chunk, and a function that merges aggregates of theirs by island: (df, aggregates by name, how
    to merge them), where merging takes place after the map-side part, so a long island is a row for each chunk."""
    cut = df.withColumn("_c", chunk)
    over = Window.partitionBy(*keys).orderBy("_c")
    carry = cut.groupBy(*keys, "_c").agg(*(c.alias(n) for n, c in summary.items()))
    carry = carry.select(*keys, "_c", *(c(over).alias(f"_carry_{n}") for n, c in carried.items()))
    own = Window.partitionBy(*keys, "_c").orderBy(*order)
    met = cut.join(carry, [*keys, "_c"])
    before = lambda f: f.over(own.rowsBetween(Window.unboundedPreceding, -1))
    flagged = met.withColumn("_opens", F.coalesce(starts(before, lambda n: F.col(f"_carry_{n}")), F.lit(True)).cast("long"))
    local = flagged.withColumn("_l", F.sum("_opens").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens", *(f"_carry_{n}" for n in carried))

    def merge(first: dict[str, Column], again: dict[str, Column]) -> DataFrame:
        parts = local.groupBy(*keys, "_c", "_l").agg(*(c.alias(n) for n, c in first.items()))
        opened = parts.groupBy(*keys, "_c").agg(F.max("_l").alias("_n"))
        offsets = opened.select(*keys, "_c", F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
        # what a chunk holds before its first opening belongs to the island before
        numbered = parts.join(offsets, [*keys, "_c"]).withColumn(name, F.col("_o") + F.col("_l") - 1)
        return numbered.groupBy(*keys, name).agg(*(c.alias(n) for n, c in again.items()))

    return local, merge


def chunk_of(start: str, chunk_n: int) -> Column:
    """The stretch of time in which a row starts."""
    return F.floor(F.col(start) / chunk_n)


def tail_windows(lengths: DataFrame, window_n: int, step_n: int) -> DataFrame:
    """run_id, win_idx, start_n, end_n: overlapping windows, and one anchored at the end if the tail is uncovered."""
    last = F.col("n") - window_n
    starts = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last, F.lit(step_n).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    whole = F.when((last >= 0) & (last % step_n != 0), F.array_append("starts", last)).otherwise(F.col("starts"))
    listed = lengths.select("run_id", F.col("n").cast("long").alias("n")).filter(F.col("n") >= window_n).withColumn("starts", starts)
    return listed.select("run_id", F.posexplode(whole).alias("win_idx", "start_n")).withColumn("end_n", F.col("start_n") + window_n)


def mark_hits(scored: DataFrame, threshold) -> DataFrame:
    """is_hit: the score is above the threshold (a number, or a Column such as a settings field)."""
    return scored.withColumn("is_hit", F.col("score") > threshold)


def hits_only(df: DataFrame) -> DataFrame:
    return df.filter("is_hit")


def covered_slots(scored: DataFrame, hop_n: int) -> DataFrame:
    """One row per window and slot it covers; needs total_n, the signal's length, of which the last slot is the rest."""
    last = F.when(F.col("end_n") >= F.col("total_n"), F.ceil(F.col("total_n") / hop_n) - 1).otherwise(F.floor(F.col("end_n") / hop_n) - 1)
    first = F.ceil(F.col("start_n") / hop_n)
    return scored.filter(last >= first).withColumn("slot", F.explode(F.sequence(first, last)))


def slot_votes(scored: DataFrame, signal_len: DataFrame, hop_n: int) -> DataFrame:
    """run_id, slot, start_n, end_n, is_hit, covering, hits, score: the vote of the windows that cover each slot.

    A slot is a hit if enough windows say so: half of those that can cover it, or all where fewer do. The score
    is the mean over the windows that agree with the verdict. Needs hop_n <= window length."""
    first = scored.groupBy("run_id").agg(F.min_by(F.col("end_n") - F.col("start_n"), "start_n").alias("first_len"))
    told = covered_slots(scored.join(signal_len.select("run_id", F.col("n").alias("total_n")), "run_id"), hop_n)
    votes = told.groupBy("run_id", "slot", "total_n").agg(F.count(F.lit(1)).alias("covering"), F.count_if("is_hit").alias("hits"), F.avg(F.when(F.col("is_hit"), F.col("score"))).alias("yes"), F.avg(F.when(~F.col("is_hit"), F.col("score"))).alias("no"))
    needed = F.floor(F.floor(F.col("first_len") / hop_n) / 2) + 1
    return votes.join(first, "run_id").withColumn("is_hit", F.col("hits") >= F.least(needed, "covering")).select(
        "run_id", "slot", (F.col("slot") * hop_n).alias("start_n"), F.least((F.col("slot") + 1) * hop_n, F.col("total_n")).alias("end_n"), "is_hit", "covering", "hits",
        F.when(F.col("is_hit"), F.col("yes")).otherwise(F.col("no")).alias("score"))


def vector_mean(df: DataFrame, key_cols: list[str], vec_col: str) -> DataFrame:
    """Element-wise mean of vectors per key."""
    parts = df.select(*key_cols, F.posexplode(vec_col).alias("pos", "x")).groupBy(*key_cols, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*key_cols).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vec_col))


def hit_runs(slots: DataFrame, gap_n: int, chunk_n: int | None = None) -> DataFrame:
    """run_id, run_idx, start_n, end_n, n_slots: hits with at most gap_n between them; the end is the last hit's end.

    With chunk_n, a length of time, runs of any length are worked on in chunks of it by many tasks."""
    last = F.max_by("end_n", F.struct("start_n", "end_n"))
    if chunk_n is None:
        w = Window.partitionBy("run_id").orderBy("start_n", "end_n")
        numbered = islands(hits_only(slots), ["run_id"], ["start_n", "end_n"], F.col("start_n") - F.lag("end_n").over(w) > gap_n, "run_idx")
        return numbered.groupBy("run_id", "run_idx").agg(F.min("start_n").alias("start_n"), last.alias("end_n"), F.count(F.lit(1)).alias("n_slots"))
    _, merge = chunked_islands(
        hits_only(slots).select("run_id", "start_n", "end_n"), ["run_id"], ["start_n", "end_n"], chunk_of("start_n", chunk_n), "run_idx",
        lambda before, carry: F.col("start_n") - F.coalesce(before(F.last("end_n")), carry("end")) > gap_n,
        {"end": last}, {"end": lambda over: F.lag("end").over(over)})
    told = merge({"start_n": F.min("start_n"), "last": F.max(F.struct("start_n", "end_n")), "n_slots": F.count(F.lit(1))}, {"start_n": F.min("start_n"), "last": F.max("last"), "n_slots": F.sum("n_slots")})
    return told.select("run_id", "run_idx", "start_n", F.col("last.end_n").alias("end_n"), "n_slots")


def cut_runs(runs: DataFrame, window_n: int | None) -> DataFrame:
    """run_id, clip_idx, start_n, end_n: clips of window_n from each run's start, the tail anchored at its end; whole runs without a length."""
    if not window_n:
        pieces = runs.select("run_id", "start_n", "end_n")
    else:
        full = F.floor((F.col("end_n") - F.col("start_n")) / window_n)
        whole = F.transform(F.sequence(F.lit(0).cast("long"), full - 1), lambda k: F.struct((F.col("start_n") + k * window_n).alias("s"), (F.col("start_n") + (k + 1) * window_n).alias("e")))
        whole = F.when(full > 0, whole).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))
        tail = F.struct(F.greatest("start_n", F.col("end_n") - window_n).alias("s"), F.col("end_n").alias("e"))
        clips = F.when(F.col("start_n") + full * window_n < F.col("end_n"), F.array_append(whole, tail)).otherwise(whole)
        pieces = runs.select("run_id", F.explode(clips).alias("c")).select("run_id", F.col("c.s").alias("start_n"), F.col("c.e").alias("end_n"))
    return pieces.withColumn("clip_idx", F.row_number().over(Window.partitionBy("run_id").orderBy("start_n", "end_n")) - 1)


def verdict_spans(slots: DataFrame, chunk_n: int | None = None) -> DataFrame:
    """run_id, span_idx, start_n, end_n, is_hit, n_slots: neighbouring slots with one verdict; chunk_n as in hit_runs."""
    if chunk_n is None:
        w = Window.partitionBy("run_id").orderBy("start_n")
        numbered = islands(slots, ["run_id"], ["start_n"], F.col("is_hit") != F.lag("is_hit").over(w), "span_idx")
        return numbered.groupBy("run_id", "span_idx", "is_hit").agg(F.min("start_n").alias("start_n"), F.max("end_n").alias("end_n"), F.count(F.lit(1)).alias("n_slots"))
    _, merge = chunked_islands(
        slots.select("run_id", "start_n", "end_n", "is_hit"), ["run_id"], ["start_n"], chunk_of("start_n", chunk_n), "span_idx",
        lambda before, carry: F.col("is_hit") != F.coalesce(before(F.last("is_hit")), carry("hit")),
        {"hit": F.max_by("is_hit", "start_n")}, {"hit": lambda over: F.lag("hit").over(over)})
    told = merge({"is_hit": F.bool_or("is_hit"), "start_n": F.min("start_n"), "end_n": F.max("end_n"), "n_slots": F.count(F.lit(1))}, {"is_hit": F.bool_or("is_hit"), "start_n": F.min("start_n"), "end_n": F.max("end_n"), "n_slots": F.sum("n_slots")})
    return told.select("run_id", "span_idx", "is_hit", "start_n", "end_n", "n_slots")


def peak_envelope(samples: DataFrame, rate: int, points_per_s: int = 5, cap: int = 60_000, fine: int = 64) -> DataFrame:
    """run_id, point_idx, peak: largest magnitude per block, scaled to the run's largest, 3 digits. Needs run_id, idx, x.

    A run's block is known only with its length, so its samples are first reduced where they are, to stretches of
    `fine` samples (by run and stretch, no run's samples meet in one task). A stretch within one block is one value;
    only stretches that a block's border cuts keep their samples, in an array of at most `fine`."""
    first = F.floor(F.col("idx") / fine)
    parts = samples.groupBy("run_id", first.alias("_f")).agg(F.count(F.lit(1)).alias("_n"), F.collect_list(F.struct("idx", F.abs("x").alias("a"))).alias("_all"))
    sizes = parts.groupBy("run_id").agg(F.sum("_n").alias("len"))
    wanted = F.least(F.greatest(F.lit(1), F.bround(F.col("len") / rate * points_per_s).cast("long")), F.lit(cap), "len")
    sizes = sizes.withColumn("points", wanted).withColumn("block", F.greatest(F.lit(1), F.floor(F.col("len") / F.col("points")))).drop("points")
    place = lambda i: F.floor(i / F.col("block"))
    # joined by stretch of the run as well, so that a long run is no hot key
    dealt = sizes.withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / (fine << 10)))))
    whole = parts.withColumn("_g", F.floor(F.col("_f") / 1024)).join(dealt, ["run_id", "_g"])
    one = place(F.col("_f") * fine) == place(F.col("_f") * fine + fine - 1)
    top = F.transform("_all", lambda s: s["a"])
    split = F.transform("_all", lambda s: F.struct(place(s["idx"]).alias("p"), s["a"].alias("a")))
    cells = F.when(one, F.array(F.struct(place(F.col("_f") * fine).alias("p"), F.array_max(top).alias("a")))).otherwise(split)
    peaks = whole.select("run_id", "len", "block", F.explode(cells).alias("c")).select("run_id", F.col("c.p").alias("point_idx"), "c.a", "len", "block").filter((F.col("point_idx") + 1) * F.col("block") <= F.col("len"))
    peaks = peaks.groupBy("run_id", "point_idx").agg(F.max("a").alias("top"))
    most = F.max("top").over(Window.partitionBy("run_id"))  # at most about twice `cap` points a run
    return peaks.select("run_id", "point_idx", F.when(most > 0, F.round(F.col("top") / most, 3)).otherwise(F.lit(0.0)).alias("peak"))


def class_log(scored: DataFrame, k: int = 3, labels: Column | None = None) -> DataFrame:
    """Per window: score to 4 digits, the verdict and the k likeliest classes."""
    from cuewright.functions.text import top_classes

    return scored.select("run_id", "start_n", "end_n", F.round("score", 4).alias("score"), "is_hit", top_classes(F.col("probs"), k, labels).alias("classes"))
