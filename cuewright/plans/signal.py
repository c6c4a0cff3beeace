"""Adapters over events, orders, embeddings and lineitem for the signal, interval and grouping operators, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions import text
from cuewright.operators import answers as A
from cuewright.operators import cues as C
from cuewright.operators import intervals as I  # noqa: E741
from cuewright.operators import windows as S

HOUR = 3_600_000_000
STEP, SPAN, ORIGIN = 6 * HOUR, 24 * HOUR, 1_704_067_200_000_000
SLOTS = 120


def read(spark, sf_dir, table) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def grid(spark, sf_dir) -> DataFrame:
    """Scored windows: cents per user in 24 h windows every 6 h over 30 days; a hit is over 10,000 cents."""
    ev = read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - ORIGIN) / STEP).alias("b"), F.bround(F.col("value") * 100).cast("long").alias("cents"))
    parts = ev.groupBy("run_id", "b").agg(F.sum("cents").alias("cents"))
    seen = parts.withColumn("win_idx", F.explode(F.sequence(F.greatest(F.col("b") - 3, F.lit(0)), F.least(F.col("b"), F.lit(SLOTS - 4))))).groupBy("run_id", "win_idx").agg(F.sum("cents").alias("score"))
    every = ev.select("run_id").distinct().withColumn("win_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 4).cast("long"))))
    scored = every.join(seen, ["run_id", "win_idx"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    return S.mark_hits(scored.select("run_id", "win_idx", (F.col("win_idx") * STEP).alias("start_n"), (F.col("win_idx") * STEP + SPAN).alias("end_n"), "score"), 10_000)


def slots(spark, sf_dir) -> DataFrame:
    scored = grid(spark, sf_dir)
    return S.slot_votes(scored, scored.select("run_id", F.lit(SLOTS * STEP).alias("n")).distinct(), STEP)


def clips(spark, sf_dir) -> DataFrame:
    """One clip of an hour per event, in order of time; errors and signups have no title, signups were skipped."""
    ev = read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start_n"), F.col("event_type").alias("kind"))
    order = Window.partitionBy("run_id").orderBy("start_n", "event_id")
    titled = ~F.col("kind").isin("error", "signup")
    return ev.select(
        "run_id", "event_id", (F.row_number().over(order) - 1).cast("long").alias("clip_idx"), "start_n", (F.col("start_n") + HOUR).alias("end_n"), F.when(titled, F.col("kind")).alias("title"), F.lit(None).cast("string").alias("artist"),
        (F.col("kind") == "signup").alias("skipped"), F.when(titled, F.concat(F.lit("album "), F.col("event_id") % 7)).alias("album"), F.lit("one").alias("provider"), ((F.col("kind") == "error") & (F.col("event_id") % 7 == 0)).alias("rate_limited"))


def q_slot_votes(spark, sf_dir):
    return slots(spark, sf_dir).withColumn("score", F.round("score", 4))


def q_hit_runs(spark, sf_dir):
    return S.hit_runs(slots(spark, sf_dir), STEP)


def q_cut_runs(spark, sf_dir):
    return S.cut_runs(S.hit_runs(slots(spark, sf_dir), STEP), 30 * HOUR).select("run_id", F.col("clip_idx").cast("long").alias("clip_idx"), "start_n", "end_n")


def q_verdict_spans(spark, sf_dir):
    return S.verdict_spans(slots(spark, sf_dir))


def q_tail_windows(spark, sf_dir):
    lengths = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.floor("o_totalprice").alias("n"))
    return S.tail_windows(lengths, 10_230, 5_000).withColumn("win_idx", F.col("win_idx").cast("long"))


def q_softmax_score(spark, sf_dir):
    probs = read(spark, sf_dir, "embeddings").select("vec_id", text.softmax(F.col("embedding")).alias("p"))
    return probs.select("vec_id", F.round(text.label_score(F.col("p"), [0, 3, 5]), 8).alias("score"))


def q_top_classes(spark, sf_dir):
    top = read(spark, sf_dir, "embeddings").select("vec_id", text.top_classes(text.softmax(F.col("embedding")), 3).alias("c"))
    return top.select("vec_id", *(F.col("c")[i]["label"].cast("long").alias(f"label{i + 1}") for i in range(3)))


def q_vector_mean(spark, sf_dir):
    mean = S.vector_mean(read(spark, sf_dir, "embeddings").select("label", "embedding"), ["label"], "embedding")
    return mean.select("label", F.posexplode("embedding").alias("pos", "x")).select(F.col("label").cast("long").alias("label"), F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark, sf_dir) -> DataFrame:
    """lineitem with rk, a dense number of each order's lines (the line number is not unique)."""
    return read(spark, sf_dir, "lineitem").withColumn("rk", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("long"))


def q_peak_envelope(spark, sf_dir):
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    samples = lines(spark, sf_dir).select(F.col("l_orderkey").alias("run_id"), (F.col("rk") - 1).alias("idx"), signed.alias("x"))
    return S.peak_envelope(samples, rate=10)


def q_group_answers(spark, sf_dir):
    return C.group_answers(clips(spark, sf_dir), 12 * HOUR).select("run_id", "event_id", "clip_idx", "group_idx")


def q_build_cues(spark, sf_dir):
    return C.build_cues(C.group_answers(clips(spark, sf_dir), 12 * HOUR)).drop("artist")


def q_mode_first(spark, sf_dir):
    return C.mode_first(clips(spark, sf_dir), ["run_id"], "album", ["clip_idx"])


def q_interval_union(spark, sf_dir):
    return I.interval_union(clips(spark, sf_dir).select("run_id", "start_n", "end_n"))


def q_coalesce_titles(spark, sf_dir):
    return I.coalesce_titles(clips(spark, sf_dir).select("run_id", "start_n", "end_n", "title"), 6 * HOUR)


def one_run(df: DataFrame) -> DataFrame:
    """All runs as one very long one."""
    return df.withColumn("run_id", F.lit(0).cast("long"))


def all_slots(spark, sf_dir) -> DataFrame:
    """The slots of all users one after the other, as one recording."""
    span = SLOTS * STEP
    return one_run(slots(spark, sf_dir).select((F.col("run_id") * span + F.col("start_n")).alias("start_n"), (F.col("run_id") * span + F.col("end_n")).alias("end_n"), "is_hit"))


def q_hit_runs_long(spark, sf_dir):
    return S.hit_runs(all_slots(spark, sf_dir), STEP, chunk_n=50 * SLOTS * STEP)


def q_verdict_spans_long(spark, sf_dir):
    return S.verdict_spans(all_slots(spark, sf_dir), chunk_n=50 * SLOTS * STEP)


def q_interval_union_long(spark, sf_dir):
    return I.interval_union(one_run(clips(spark, sf_dir).select("start_n", (F.col("start_n") + HOUR // 60).alias("end_n"))), chunk_n=24 * HOUR)


def q_coalesce_titles_long(spark, sf_dir):
    return I.coalesce_titles(one_run(clips(spark, sf_dir).select("start_n", (F.col("start_n") + HOUR // 60).alias("end_n"), "title")), HOUR // 120, chunk_n=24 * HOUR)


def q_stab_lookup(spark, sf_dir):
    c = clips(spark, sf_dir)
    points = c.select("run_id", F.col("event_id").alias("point_id"), (F.col("start_n") + HOUR // 2).alias("t"))
    spans = c.select("run_id", F.col("event_id").alias("held_by"), "start_n", "end_n", F.when(F.col("title").isNotNull(), 0).otherwise(1).cast("long").alias("priority"))
    return I.stab_lookup(points, spans, HOUR)


def q_breaker(spark, sf_dir):
    return A.breaker(clips(spark, sf_dir), ["clip_idx"]).select("run_id", "event_id", "skipped")


def q_progress_counts(spark, sf_dir):
    return A.progress_counts(clips(spark, sf_dir).withColumn("title", F.col("title")))


def q_stall_gaps(spark, sf_dir):
    ev = clips(spark, sf_dir).select("run_id", F.col("event_id"), F.col("start_n").alias("at_n"))
    return A.stall_gaps(ev, 12 * HOUR, 40 * HOUR)


_GRID = f"""
ev AS (SELECT user_id AS run_id, (epoch_us(ts) - {ORIGIN}) // {STEP} AS b, CAST(round_even(value * 100, 0) AS BIGINT) AS cents FROM events),
win AS (SELECT r.run_id, k AS win_idx, k * {STEP} AS start_n, k * {STEP} + {SPAN} AS end_n, CAST(coalesce(sum(cents), 0) AS BIGINT) AS score
        FROM (SELECT DISTINCT run_id FROM ev) r CROSS JOIN range({SLOTS - 3}) t(k) LEFT JOIN ev ON ev.run_id = r.run_id AND ev.b BETWEEN k AND k + 3 GROUP BY ALL),
cov AS (SELECT run_id, s AS slot, count(*) AS covering, count(*) FILTER (score > 10000) AS hits, avg(score) FILTER (score > 10000) AS yes, avg(score) FILTER (score <= 10000) AS no
        FROM win JOIN range({SLOTS}) t(s) ON start_n <= s * {STEP} AND end_n >= (s + 1) * {STEP} GROUP BY ALL),
slots AS (SELECT run_id, slot, slot * {STEP} AS start_n, (slot + 1) * {STEP} AS end_n, hits >= least(3, covering) AS is_hit, covering, hits, CASE WHEN hits >= least(3, covering) THEN yes ELSE no END AS score FROM cov)
"""
_RUNS = f"""
flag AS (SELECT *, CASE WHEN start_n - lag(end_n) OVER w <= {STEP} THEN 0 ELSE 1 END AS o FROM slots WHERE is_hit WINDOW w AS (PARTITION BY run_id ORDER BY start_n)),
numb AS (SELECT *, sum(o) OVER (PARTITION BY run_id ORDER BY start_n) - 1 AS run_idx FROM flag),
runs AS (SELECT run_id, CAST(run_idx AS BIGINT) AS run_idx, min(start_n) AS start_n, max(end_n) AS end_n, count(*) AS n_slots FROM numb GROUP BY ALL)
"""
_ALL = f"every AS (SELECT 0::BIGINT AS run_id, run_id * {SLOTS * STEP} + start_n AS start_n, run_id * {SLOTS * STEP} + end_n AS end_n, is_hit FROM slots)"
_CLIPS = f"""
c AS (SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS clip_idx, epoch_us(ts) AS start_n, epoch_us(ts) + {HOUR} AS end_n,
             CASE WHEN event_type NOT IN ('error', 'signup') THEN event_type END AS title, event_type = 'signup' AS skipped,
             CASE WHEN event_type NOT IN ('error', 'signup') THEN 'album ' || (event_id % 7) END AS album, event_type = 'error' AND event_id % 7 = 0 AS rate_limited FROM events)
"""
_GROUPS = f"""
p AS (SELECT *, lag(clip_idx) OVER w AS pi, lag(title) OVER w AS pt, lag(end_n) OVER w AS pe, lag(skipped) OVER w AS ps FROM c WINDOW w AS (PARTITION BY run_id ORDER BY clip_idx)),
g1 AS (SELECT *, sum(CASE WHEN pi IS NULL OR title IS DISTINCT FROM pt OR start_n - pe > {12 * HOUR} OR skipped OR ps THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY clip_idx) AS g FROM p),
gr AS (SELECT run_id, g, min(title) AS k, min(start_n) AS s, max(end_n) AS e FROM g1 GROUP BY ALL),
br AS (SELECT *, coalesce(k IS NULL AND lag(k) OVER w IS NOT NULL AND lag(k) OVER w = lead(k) OVER w AND lead(s) OVER w - lag(e) OVER w <= {12 * HOUR}, false) AS b FROM gr WINDOW w AS (PARTITION BY run_id ORDER BY g)),
nw AS (SELECT *, CASE WHEN b OR coalesce(lag(b) OVER (PARTITION BY run_id ORDER BY g), false) THEN 0 ELSE 1 END AS o FROM br),
g2 AS (SELECT run_id, g, CAST(sum(o) OVER (PARTITION BY run_id ORDER BY g) - 1 AS BIGINT) AS group_idx FROM nw),
grouped AS (SELECT g1.*, group_idx FROM g1 JOIN g2 USING (run_id, g))
"""
_LINES = f"ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS rk FROM lineitem)"
_SOFT = "e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS p FROM embeddings), q AS (SELECT vec_id, list_transform(p, lambda x: x / list_sum(p)) AS p FROM e)"

QUERIES = {k[2:]: f for k, f in list(globals().items()) if k.startswith("q_")}
SQL = {
    "slot_votes": f"WITH {_GRID} SELECT run_id, slot, start_n, end_n, is_hit, covering, hits, round(score, 4) AS score FROM slots",
    "hit_runs": f"WITH {_GRID}, {_RUNS} SELECT * FROM runs",
    "cut_runs": f"""WITH {_GRID}, {_RUNS}, n AS (SELECT *, (end_n - start_n) // {30 * HOUR} AS f FROM runs),
        piece AS (SELECT run_id, start_n + k * {30 * HOUR} AS start_n, start_n + (k + 1) * {30 * HOUR} AS end_n FROM n JOIN range(1000) t(k) ON k < f
                  UNION ALL SELECT run_id, greatest(start_n, end_n - {30 * HOUR}), end_n FROM n WHERE start_n + f * {30 * HOUR} < end_n)
        SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY start_n, end_n) - 1 AS clip_idx, start_n, end_n FROM piece""",
    "verdict_spans": f"""WITH {_GRID}, f AS (SELECT *, CASE WHEN is_hit = lag(is_hit) OVER (PARTITION BY run_id ORDER BY start_n) THEN 0 ELSE 1 END AS o FROM slots),
        n AS (SELECT *, CAST(sum(o) OVER (PARTITION BY run_id ORDER BY start_n) - 1 AS BIGINT) AS span_idx FROM f)
        SELECT run_id, span_idx, is_hit, min(start_n) AS start_n, max(end_n) AS end_n, count(*) AS n_slots FROM n GROUP BY ALL""",
    "hit_runs_long": f"""WITH {_GRID}, {_ALL}, {_RUNS.replace('FROM slots', 'FROM every')} SELECT * FROM runs""",
    "verdict_spans_long": f"""WITH {_GRID}, {_ALL}, f AS (SELECT *, CASE WHEN is_hit = lag(is_hit) OVER (ORDER BY start_n) THEN 0 ELSE 1 END AS o FROM every),
        n AS (SELECT *, CAST(sum(o) OVER (ORDER BY start_n) - 1 AS BIGINT) AS span_idx FROM f)
        SELECT run_id, span_idx, is_hit, min(start_n) AS start_n, max(end_n) AS end_n, count(*) AS n_slots FROM n GROUP BY ALL""",
    "tail_windows": """WITH l AS (SELECT o_orderkey AS run_id, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders), s AS (
        SELECT run_id, k * 5000 AS start_n FROM l JOIN range(200) t(k) ON k * 5000 <= n - 10230
        UNION ALL SELECT run_id, n - 10230 FROM l WHERE n >= 10230 AND (n - 10230) % 5000 <> 0)
        SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY start_n) - 1 AS win_idx, start_n, start_n + 10230 AS end_n FROM s""",
    "softmax_score": f"WITH {_SOFT} SELECT vec_id, round(p[1] + p[4] + p[6], 8) AS score FROM q",
    "top_classes": """WITH u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rk FROM u)
        SELECT vec_id, max(i) FILTER (rk = 1) AS label1, max(i) FILTER (rk = 2) AS label2, max(i) FILTER (rk = 3) AS label3 FROM r WHERE rk <= 3 GROUP BY vec_id""",
    "vector_mean": """WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
        SELECT label::BIGINT AS label, pos, round(avg(x), 6) AS x FROM u GROUP BY ALL""",
    "peak_envelope": f"""WITH {_LINES}, s AS (SELECT l_orderkey AS run_id, rk - 1 AS idx, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS x, count(*) OVER (PARTITION BY l_orderkey) AS len FROM ln),
        b AS (SELECT *, greatest(1, len // least(greatest(1, CAST(round_even(len / 10.0 * 5, 0) AS BIGINT)), 60000, len)) AS block FROM s),
        t AS (SELECT run_id, idx // block AS point_idx, max(abs(x)) AS top FROM b WHERE (idx // block + 1) * block <= len GROUP BY ALL)
        SELECT run_id, point_idx, CASE WHEN max(top) OVER (PARTITION BY run_id) > 0 THEN round(top / max(top) OVER (PARTITION BY run_id), 3) ELSE 0 END AS peak FROM t""",
    "group_answers": f"WITH {_CLIPS}, {_GROUPS} SELECT run_id, event_id, clip_idx, group_idx FROM grouped",
    "build_cues": f"""WITH {_CLIPS}, {_GROUPS}, m AS (SELECT run_id, group_idx, album, count(*) AS n, min(clip_idx) AS seen FROM grouped WHERE title IS NOT NULL GROUP BY ALL),
        a AS (SELECT run_id, group_idx, first(album ORDER BY n DESC, seen) AS album FROM m GROUP BY ALL),
        q AS (SELECT run_id, group_idx, min(start_n) AS start_n, max(end_n) - min(start_n) AS duration_n, bool_and(skipped) AS pending, min(title) AS title, count(*) AS n_clips FROM grouped GROUP BY ALL)
        SELECT run_id, format('seg_{{:03d}}', group_idx + 1) AS segment_id, start_n, duration_n, pending, CASE WHEN title IS NOT NULL THEN 'one' END AS provider, title, album, n_clips FROM q LEFT JOIN a USING (run_id, group_idx)""",
    "mode_first": f"WITH {_CLIPS}, m AS (SELECT run_id, album, count(*) AS n, min(clip_idx) AS seen FROM c WHERE album IS NOT NULL GROUP BY ALL) SELECT run_id, first(album ORDER BY n DESC, seen) AS album FROM m GROUP BY run_id",
    "interval_union": f"""WITH {_CLIPS}, f AS (SELECT *, CASE WHEN start_n <= max(end_n) OVER (PARTITION BY run_id ORDER BY start_n, end_n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM c),
        i AS (SELECT *, sum(o) OVER (PARTITION BY run_id ORDER BY start_n, end_n) AS g FROM f)
        SELECT run_id, min(start_n) AS start_n, max(end_n) AS end_n, count(*) AS n FROM i GROUP BY run_id, g""",
    "coalesce_titles": f"""WITH {_CLIPS}, a AS (SELECT *, CASE WHEN lag(start_n) OVER w IS NOT NULL AND title IS NOT DISTINCT FROM lag(title) OVER w THEN 0 ELSE 1 END AS o FROM c WINDOW w AS (PARTITION BY run_id ORDER BY start_n, end_n)),
        b AS (SELECT *, sum(o) OVER (PARTITION BY run_id ORDER BY start_n, end_n) AS t FROM a),
        d AS (SELECT *, CASE WHEN start_n - max(end_n) OVER (PARTITION BY run_id, t ORDER BY start_n, end_n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {6 * HOUR} THEN 0 ELSE 1 END AS p FROM b),
        e AS (SELECT *, sum(p) OVER (PARTITION BY run_id, t ORDER BY start_n, end_n) AS i FROM d)
        SELECT run_id, title, min(start_n) AS start_n, max(end_n) AS end_n, count(*) AS n FROM e GROUP BY run_id, t, i, title""",
    "interval_union_long": f"""WITH {_CLIPS}, d AS (SELECT start_n, start_n + {HOUR // 60} AS end_n FROM c), f AS (SELECT *, CASE WHEN start_n <= max(end_n) OVER (ORDER BY start_n, end_n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM d),
        i AS (SELECT *, sum(o) OVER (ORDER BY start_n, end_n ROWS UNBOUNDED PRECEDING) AS g FROM f)
        SELECT 0::BIGINT AS run_id, min(start_n) AS start_n, max(end_n) AS end_n, count(*) AS n FROM i GROUP BY g""",
    "coalesce_titles_long": f"""WITH {_CLIPS}, z AS (SELECT start_n, start_n + {HOUR // 60} AS end_n, title, row_number() OVER (ORDER BY start_n, title NULLS FIRST) AS k FROM c),
        a AS (SELECT *, CASE WHEN k > 1 AND title IS NOT DISTINCT FROM lag(title) OVER (ORDER BY k) THEN 0 ELSE 1 END AS o FROM z), b AS (SELECT *, sum(o) OVER (ORDER BY k) AS t FROM a),
        d AS (SELECT *, CASE WHEN start_n - max(end_n) OVER (PARTITION BY t ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {HOUR // 120} THEN 0 ELSE 1 END AS p FROM b),
        e AS (SELECT *, sum(p) OVER (PARTITION BY t ORDER BY k) AS i FROM d)
        SELECT 0::BIGINT AS run_id, title, min(start_n) AS start_n, max(end_n) AS end_n, count(*) AS n FROM e GROUP BY t, i, title""",
    "stab_lookup": f"""WITH {_CLIPS}, j AS (SELECT a.run_id, a.event_id AS point_id, a.start_n + {HOUR // 2} AS t, b.event_id AS held_by, b.start_n, b.end_n, CASE WHEN b.title IS NOT NULL THEN 0 ELSE 1 END AS priority
        FROM c a LEFT JOIN c b ON a.run_id = b.run_id AND a.start_n + {HOUR // 2} >= b.start_n AND a.start_n + {HOUR // 2} < b.end_n),
        k AS (SELECT *, row_number() OVER (PARTITION BY run_id, point_id ORDER BY priority, start_n, end_n) AS rk FROM j)
        SELECT run_id, point_id, t, held_by, start_n, end_n, priority::BIGINT AS priority FROM k WHERE rk = 1""",
    "breaker": f"WITH {_CLIPS} SELECT run_id, event_id, skipped OR coalesce(max(rate_limited::INT) OVER (PARTITION BY run_id ORDER BY clip_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 OR rate_limited AS skipped FROM c",
    "progress_counts": f"WITH {_CLIPS} SELECT run_id, count(*) FILTER (NOT skipped) AS answered, count(*) AS total, count(title) AS found FROM c GROUP BY run_id",
    "stall_gaps": f"""WITH {_CLIPS}, d AS (SELECT run_id, event_id, start_n AS at_n, lead(start_n) OVER (PARTITION BY run_id ORDER BY start_n, event_id) - start_n AS gap_n FROM c)
        SELECT run_id, event_id, at_n, gap_n, CASE WHEN gap_n >= {40 * HOUR} THEN 'strong' ELSE 'warning' END AS level FROM d WHERE gap_n >= {12 * HOUR}""",
}
