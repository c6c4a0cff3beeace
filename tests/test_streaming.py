"""Streaming twins give what the batch operators give, over shuffled replays in several micro-batches."""

import random
import time

from pyspark.sql import functions as F

from cuewright.operators import windows as S
from cuewright.streaming import operators as K

#: Event time of a run: its start and a second for each unit of time.
AT = "timestamp_seconds(1700000000 + start_n)"


def replay(spark, df, tmp_path, transform, name, mode="append"):
    """The batches in order, each in files of its own; the table of the results and the query."""
    folder = str(tmp_path / name)
    for i in sorted(r.batch for r in df.select("batch").distinct().collect()):
        df.filter(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name), q


def held(q):
    return [o.numRowsTotal for o in q.lastProgress.stateOperators]


def windows(spark, closing=True):
    """Runs that arrive in any order within 100 seconds; at last a far row of another run moves the watermark on."""
    rng, data = random.Random(5), []
    for run in range(6):
        n = rng.randint(8, 20)
        for i in range(n):
            s = rng.random()
            last = i == n - 1
            data.append((f"r{run}", i * 5, i * 5 + 20, s, s > 0.4, closing and last, (n - 1) * 5 + 20 if last and closing else None, max(0, int((i * 5 + rng.uniform(-60, 60)) // 25))))
    rng.shuffle(data)
    data += [("far", 500_000, 500_020, 0.1, False, True, None, 90), ("far", 900_000, 900_020, 0.1, False, True, None, 91), ("far", 990_000, 990_020, 0.1, False, True, None, 92)]
    df = spark.createDataFrame(data, "run_id string, start_n long, end_n long, score double, is_hit boolean, closes boolean, total_n long, batch int")
    return df.withColumn("event_ts", F.expr(AT))


def slot_key(d):
    return sorted((r.run_id, r.slot, r.start_n, r.end_n, r.is_hit, r.covering, r.hits, round(r.score, 9)) for r in d.filter("run_id <> 'far'").collect())


def batch_slots(df):
    own = df.filter("run_id <> 'far'")
    return S.slot_votes(own.select("run_id", "start_n", "end_n", "score", "is_hit"), own.groupBy("run_id").agg(F.max("end_n").alias("n")), 5)


def test_slots_from_a_shuffled_replay(spark, tmp_path):
    df = windows(spark)
    got, q = replay(spark, df, tmp_path, lambda s: K.on_time(K.stream_slot_votes(s, 5, delay="3 minutes")), "slots")
    assert slot_key(got) == slot_key(batch_slots(df)) and len(slot_key(got)) > 60
    assert held(q) == [0]


def test_slots_of_runs_that_fall_idle(spark, tmp_path):
    df = windows(spark, closing=False)
    got, q = replay(spark, df, tmp_path, lambda s: K.on_time(K.stream_slot_votes(s, 5, delay="3 minutes", idle="10 minutes")), "idle_slots")
    assert slot_key(got) == slot_key(batch_slots(df))
    assert max(o for p in q.recentProgress for o in [p.stateOperators[0].numRowsTotal]) > 0
    assert held(q) == [0]  # the far run closes by its own rows


def test_clips_from_a_shuffled_replay(spark, tmp_path):
    df = windows(spark)
    slots = batch_slots(df)
    last = slots.groupBy("run_id").agg(F.max("slot").alias("last"))
    rows = slots.join(last, "run_id").select("run_id", "start_n", "end_n", "is_hit", (F.col("slot") == F.col("last")).alias("closes"), F.pmod(F.hash("run_id", "slot"), F.lit(4)).alias("batch"))
    rows = rows.unionByName(df.filter("run_id = 'far'").select("run_id", "start_n", "end_n", "is_hit", "closes", "batch")).withColumn("event_ts", F.expr(AT))
    got, q = replay(spark, rows.cache(), tmp_path, lambda s: K.on_time(K.stream_clips(s, 5, 12, delay="5 minutes")), "clips")
    want = S.cut_runs(S.hit_runs(slots, 5), 12)
    key = lambda d: sorted((r.run_id, r.start_n, r.end_n) for r in d.collect())
    assert key(got) == key(want) and len(key(want)) > 10
    assert held(q) == [0]


def test_late_rows_are_counted_and_given_out(spark, tmp_path):
    row = lambda run, t, batch: (run, t, t + 20, 0.5, True, False, None, batch)
    data = [row("a", 0, 0), row("a", 5, 0), row("b", 4_000, 1), row("b", 8_000, 2), row("a", 10, 3), row("c", 7_990, 3), row("b", 12_000, 4), row("b", 7_000, 5)]
    df = spark.createDataFrame(data, "run_id string, start_n long, end_n long, score double, is_hit boolean, closes boolean, total_n long, batch int").withColumn("event_ts", F.expr(AT))
    got, q = replay(spark, df, tmp_path, lambda s: K.count_late(K.stream_slot_votes(s, 5, delay="1 minute", idle="5 minutes")), "late")
    assert sorted((r.run_id, r.start_n, r.end_n) for r in K.late_rows(got).collect()) == [("a", 10, 30), ("b", 7_000, 7_020)]
    told = [p.observedMetrics["lateness"] for p in q.recentProgress if "lateness" in p.observedMetrics]
    assert sum(t.late for t in told) == 2 and sum(t.results for t in told) == K.on_time(got).count()
    assert sorted((r.slot, r.covering) for r in K.on_time(got).filter("run_id = 'a'").collect()) == [(0, 1), (1, 2), (2, 2), (3, 2), (4, 1)]  # the late window changes nothing


def test_steps_are_told_in_order(spark, tmp_path):
    told = []
    listener = K.StepListener("steps", lambda step, detail="", **fields: told.append((step, fields)))
    spark.streams.addListener(listener)
    try:
        df = spark.createDataFrame([(f"r{i}", i % 2 == 0, i % 3) for i in range(30)], "run_id string, is_hit boolean, batch int")
        def plan(s):
            scored = K.observe_step(s, "classifying", windows=F.count(F.lit(1)))
            return K.observe_step(scored.filter("is_hit"), "identified", found=F.count(F.lit(1)))
        replay(spark, df, tmp_path, plan, "steps")
        for _ in range(100):
            if told and told[-1][0] == "done":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    steps = [s for s, _ in told]
    assert steps[0] == "loading" and steps[-2:] == ["writing", "done"]
    middle = steps[1:-2]
    assert middle == ["classifying", "identified"] * (len(middle) // 2) and len(middle) >= 6
    assert [f for s, f in told if s == "classifying"][-1] == {"windows": 30} and [f for s, f in told if s == "identified"][-1] == {"found": 15}


def test_answers_join_and_pending(spark, tmp_path):
    ts = "timestamp'2024-01-01 00:00:00'"
    clips = spark.sql(f"select 'r' run_id, id clip_idx, {ts} + make_dt_interval(0, 0, cast(id as int)) event_ts from range(6) union all select 'z', 0, timestamp'2024-01-02 00:00:00' union all select 'z', 1, timestamp'2024-01-03 00:00:00'")
    answers = spark.sql(f"select 'r' run_id, id * 2 clip_idx, {ts} + make_dt_interval(0, 0, cast(id * 2 + 1 as int)) event_ts, concat('t', id * 2) title from range(3) union all select 'z', 9, timestamp'2024-01-02 00:00:00', 'x' union all select 'z', 9, timestamp'2024-01-03 00:00:00', 'x'")
    for name, df in (("c", clips), ("a", answers)):
        for early in (True, False):  # the second file moves the watermark on
            df.filter(F.col("event_ts") < "2024-01-02" if early else F.col("event_ts") >= "2024-01-02").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    load = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    joined = K.stream_join_answers(load("c", clips), load("a", answers))
    q = joined.writeStream.format("memory").queryName("joined").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.clip_idx: (r.title, r.pending) for r in spark.table("joined").filter("run_id = 'r'").collect()}
    assert got == {i: (f"t{i}", False) if i % 2 == 0 else (None, True) for i in range(6)}


def test_progress_in_update_mode(spark, tmp_path):
    """Each micro-batch gives the runs that changed, and only those."""
    df = spark.createDataFrame([("r", False, "t", 0), ("s", False, "u", 0), ("r", True, None, 1), ("q", False, None, 1)], "run_id string, skipped boolean, title string, batch int")
    batches = []
    folder = str(tmp_path / "p")
    for i in range(2):
        df.filter(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = K.stream_progress(stream).writeStream.foreachBatch(lambda d, _: batches.append(sorted(tuple(r) for r in d.collect()))).outputMode("update").option("checkpointLocation", str(tmp_path / "pcp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [b for b in batches if b] == [[("r", 1, 1, 1), ("s", 1, 1, 1)], [("q", 1, 1, 0), ("r", 1, 2, 1)]]


def test_stall_watch(spark, tmp_path):
    """Silence gives a warning, then a strong one, each once; then the run's state is gone."""
    folder = str(tmp_path / "w")
    spark.createDataFrame([("r", "loading"), ("r", "classifying")], "run_id string, step string").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("run_id string, step string").parquet(folder)
    q = K.stall_watch(stream, warn_s=1, hard_s=2).writeStream.format("memory").queryName("stalls").outputMode("append").option("checkpointLocation", str(tmp_path / "wcp")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(300):
            if spark.table("stalls").count() >= 2:
                break
            time.sleep(0.2)
        time.sleep(1.5)
        assert [tuple(r) for r in spark.table("stalls").collect()] == [("r", "warning", "classifying"), ("r", "strong", "classifying")]
        assert held(q) == [0]
    finally:
        q.stop()
