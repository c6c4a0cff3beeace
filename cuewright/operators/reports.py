"""Reports over saved cues: tracks of a run, and the list of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.text import confidence_class, track_key


def tracks_report(cues: DataFrame, listed: str | None = None) -> DataFrame:
    """One row per run and track, in order of first appearance: the best-agreed cue stands for it.

    With `listed`, a column that names a cue, also cues: the track's cues in order.

    Needs run_id, seq, title, artist, agreement_count, anachronistic, duration_n; cues without a title are no track."""
    named = cues.withColumn("track_key", track_key(F.col("title"), F.col("artist"))).filter("track_key is not null")
    agreed = F.coalesce("agreement_count", F.lit(0))
    per = named.groupBy("run_id", "track_key").agg(
        F.max_by(F.struct("title", "artist", "agreement_count"), F.struct(agreed, -F.col("seq"))).alias("best"), F.bool_and("anachronistic").alias("anachronistic"), F.count(F.lit(1)).alias("n_cues"), F.sum("duration_n").alias("duration_n"), F.min("seq").alias("first_seq"),
        *([F.transform(F.array_sort(F.collect_list(F.struct("seq", listed))), lambda c: c[listed]).alias("cues")] if listed else []))
    order = F.row_number().over(Window.partitionBy("run_id").orderBy("first_seq"))
    return per.select("run_id", "track_key", order.cast("long").alias("track_no"), "best.title", "best.artist", confidence_class(F.col("best.title"), F.col("best.agreement_count")).alias("confidence"), "anachronistic", "n_cues", "duration_n", "first_seq", *(["cues"] if listed else []))


def run_summary(cues: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: name, time, cues in all, identified and pending; newest first."""
    counts = cues.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_cues"), F.count_if(F.nullif("title", F.lit("")).isNotNull()).alias("identified_cues"), F.count_if("pending").alias("pending_cues"))
    listed = runs.join(counts, "run_id", "left").select(*runs.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total_cues", "identified_cues", "pending_cues")))
    return listed.orderBy(F.desc("created_at"), "run_id")
