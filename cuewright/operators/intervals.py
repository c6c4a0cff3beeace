"""Interval algebra: unions, coalescing of equal titles, and point look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import chunk_of, chunked_islands, islands


def interval_union(df: DataFrame, chunk_n: int | None = None) -> DataFrame:
    """run_id, start_n, end_n, n: touching or overlapping intervals merged. With chunk_n, runs of any length are worked on in chunks of that time."""
    merged = {"start_n": F.min("start_n"), "end_n": F.max("end_n")}
    if chunk_n is None:
        before = Window.partitionBy("run_id").orderBy("start_n", "end_n").rowsBetween(Window.unboundedPreceding, -1)
        numbered = islands(df, ["run_id"], ["start_n", "end_n"], F.col("start_n") > F.max("end_n").over(before), "_i")
        return numbered.groupBy("run_id", "_i").agg(*(c.alias(n) for n, c in merged.items()), F.count(F.lit(1)).alias("n")).drop("_i")
    # an interval can reach over many chunks: what is carried is the furthest end of all before
    _, merge = chunked_islands(
        df.select("run_id", "start_n", "end_n"), ["run_id"], ["start_n", "end_n"], chunk_of("start_n", chunk_n), "_i",
        lambda before, carry: F.col("start_n") > F.greatest(before(F.max("end_n")), carry("end")),
        {"end": F.max("end_n")}, {"end": lambda over: F.max("end").over(over.rowsBetween(Window.unboundedPreceding, -1))})
    return merge(merged | {"n": F.count(F.lit(1))}, merged | {"n": F.sum("n")}).drop("_i")


def coalesce_titles(df: DataFrame, gap_n: int, chunk_n: int | None = None) -> DataFrame:
    """run_id, start_n, end_n, title, n: neighbours of one title at most gap_n after what they extend; other titles break it. chunk_n as in interval_union."""
    order, merged = ["start_n", "end_n", "title"], {"start_n": F.min("start_n"), "end_n": F.max("end_n")}
    if chunk_n is None:
        w = Window.partitionBy("run_id").orderBy(*order)
        split = islands(df, ["run_id"], order, ~F.col("title").eqNullSafe(F.lag("title").over(w)) | F.lag("start_n").over(w).isNull(), "_t")
        before = Window.partitionBy("run_id", "_t").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        numbered = islands(split, ["run_id", "_t"], order, F.col("start_n") - F.max("end_n").over(before) > gap_n, "_i")
        return numbered.groupBy("run_id", "_t", "_i", "title").agg(*(c.alias(n) for n, c in merged.items()), F.count(F.lit(1)).alias("n")).drop("_t", "_i")
    # first stretches of one title, as islands of their own, then gaps within them
    rows = df.select("run_id", "start_n", "end_n", "title", F.struct(F.col("title").alias("t")).alias("_s"))
    stretches, merge = chunked_islands(
        rows, ["run_id"], order, chunk_of("start_n", chunk_n), "_t",
        lambda before, carry: ~F.col("_s").eqNullSafe(F.coalesce(before(F.last("_s")), carry("s"))),
        {"s": F.max_by("_s", F.struct(*order))}, {"s": lambda over: F.lag("s").over(over)})
    # the furthest end of a stretch before a row: within its chunk, else carried over the chunks that the stretch fills
    own = Window.partitionBy("run_id", "_c", "_l").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = stretches.groupBy("run_id", "_c", "_l").agg(F.max("end_n").alias("_end"))
    chunks = parts.groupBy("run_id", "_c").agg(F.max("_l").alias("_n"), F.max_by("_end", "_l").alias("_tail"))
    # a chunk with an opening begins a segment; the stretch that is open at its end goes on in the chunks after it without one
    over = Window.partitionBy("run_id").orderBy("_c")
    segments = chunks.withColumn("_g", F.sum((F.col("_n") > 0).cast("long")).over(over))
    within = Window.partitionBy("run_id", "_g").orderBy("_c")
    reached = segments.withColumn("_r", F.max("_tail").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    reached = reached.select("run_id", "_c", F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.lag("_r").over(over).alias("_before"))
    told = stretches.join(reached, ["run_id", "_c"])
    far = F.greatest(F.max("end_n").over(own), F.when(F.col("_l") == 0, F.col("_before")))
    told = told.withColumn("_opens", F.coalesce(F.col("start_n") - far > gap_n, F.lit(True)).cast("long")).withColumn("_t", F.col("_o") + F.col("_l") - 1)
    told = told.withColumn("_i", F.sum("_opens").over(Window.partitionBy("run_id", "_c", "_l").orderBy(*order)))
    # number within the stretch: that within the chunk, after those of the stretch's earlier chunks
    pieces = told.groupBy("run_id", "_t", "_c", "_l", "_i", "title").agg(*(c.alias(n) for n, c in merged.items()), F.count(F.lit(1)).alias("n"))
    ahead = pieces.groupBy("run_id", "_t", "_c").agg(F.max("_i").alias("_m"))
    ahead = ahead.select("run_id", "_t", "_c", F.coalesce(F.sum("_m").over(Window.partitionBy("run_id", "_t").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_p"))
    numbered = pieces.join(ahead, ["run_id", "_t", "_c"]).withColumn("_i", F.col("_p") + F.col("_i"))
    return numbered.groupBy("run_id", "_t", "_i", "title").agg(*(c.alias(n) for n, c in merged.items()), F.sum("n").alias("n")).drop("_t", "_i")


def postings(intervals: DataFrame, bucket_n: int) -> DataFrame:
    """intervals with _level and _node: the fewest aligned stretches of 1, 2, 4, ... buckets that cover the interval's buckets.

    At most two on each level, so an interval of n buckets is posted about 2 log2(n) times."""
    low, high = F.floor(F.col("start_n") / bucket_n), F.floor((F.col("end_n") - 1) / bucket_n) + 1
    # on level k the interval still to cover is [ceil(low / 2^k), floor(high / 2^k)): its ends are posted where they are odd
    levels = F.sequence(F.lit(0), F.ceil(F.log2((high - low).cast("double") + 1)).cast("int"))
    right = lambda k: F.call_function("shiftright", F.col("_high"), k)
    left = lambda k: -F.call_function("shiftright", -F.col("_low"), k)
    odd = lambda x: F.pmod(x, F.lit(2)) == 1
    node = lambda k, x: F.struct(k.alias("level"), x.cast("long").alias("node"))
    each = F.flatten(F.transform("_levels", lambda k: F.array(F.when((left(k) < right(k)) & odd(left(k)), node(k, left(k))), F.when((left(k) < right(k)) & odd(right(k)), node(k, right(k) - 1)))))
    told = intervals.filter("end_n > start_n").withColumn("_low", low).withColumn("_high", high).withColumn("_levels", levels)
    return told.withColumn("_p", F.explode(F.array_compact(each))).select(*intervals.columns, F.col("_p.level").alias("_level"), F.col("_p.node").alias("_node"))


def stab_lookup(points: DataFrame, intervals: DataFrame, bucket_n: int, priority: str = "priority") -> DataFrame:
    """Each point (run_id, point_id, t) with the best interval that holds it (start <= t < end), or nulls.

    Intervals are posted under aligned stretches of buckets, each point asks for its own stretch on every level that
    occurs (at most 63), so the join is on (run_id, level, stretch) and a long interval is a few rows; best is the
    smallest priority, then the start."""
    dealt = postings(intervals, bucket_n)
    levels = F.array(*(F.lit(r[0]) for r in dealt.select("_level").distinct().collect())) if not dealt.isEmpty() else F.array(F.lit(0))
    own = points.withColumn("_level", F.explode(levels)).withColumn("_node", F.call_function("shiftright", F.floor(F.col("t") / bucket_n), F.col("_level")))
    inside = own.join(dealt, ["run_id", "_level", "_node"]).filter("t >= start_n and t < end_n")
    held = [c for c in intervals.columns if c != "run_id"]
    best = inside.groupBy("run_id", "point_id").agg(F.min_by(F.struct(*held), F.struct(priority, "start_n", "end_n")).alias("best"))
    return points.join(best, ["run_id", "point_id"], "left").select("run_id", "point_id", "t", *(F.col(f"best.{c}").alias(c) for c in held))
