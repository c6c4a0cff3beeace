"""From the answers about clips to cues: grouping with bridges, most frequent album, alternatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import islands


def group_answers(answers: DataFrame, gap_n: int, absorb_skipped: bool = True) -> DataFrame:
    """Adds group_idx: neighbouring clips with one (title, artist), then groups joined over one unidentified group.

    Needs run_id, clip_idx, start_n, end_n, title, artist, skipped. With absorb_skipped (as the original does) a
    skipped clip between two groups of one track is joined too."""
    w = Window.partitionBy("run_id").orderBy("clip_idx")
    key = F.when(F.col("title").isNotNull(), F.struct("title", "artist"))
    keyed = answers.withColumn("_key", key)
    apart = ~F.col("_key").eqNullSafe(F.lag("_key").over(w)) | (F.col("start_n") - F.lag("end_n").over(w) > gap_n) | F.col("skipped") | F.lag("skipped").over(w)
    first = islands(keyed, ["run_id"], ["clip_idx"], apart | F.lag("clip_idx").over(w).isNull(), "_g")
    groups = first.groupBy("run_id", "_g").agg(F.min_by("_key", "clip_idx").alias("k"), F.min_by("start_n", "clip_idx").alias("s"), F.max_by("end_n", "clip_idx").alias("e"), F.bool_or("skipped").alias("skip"))
    g = Window.partitionBy("run_id").orderBy("_g")
    bridge = F.col("k").isNull() & F.lag("k").over(g).isNotNull() & F.lag("k").over(g).eqNullSafe(F.lead("k").over(g)) & (F.lead("s").over(g) - F.lag("e").over(g) <= gap_n)
    if not absorb_skipped:
        bridge = bridge & ~F.col("skip")
    bridged = groups.withColumn("_bridge", F.coalesce(bridge, F.lit(False)))
    joined = islands(bridged, ["run_id"], ["_g"], ~(F.col("_bridge") | F.coalesce(F.lag("_bridge").over(g), F.lit(False))), "group_idx")
    return first.join(joined.select("run_id", "_g", "group_idx"), ["run_id", "_g"]).drop("_g", "_key")


def mode_first(df: DataFrame, key_cols: list[str], value_col: str, order_cols: list[str]) -> DataFrame:
    """key_cols, value_col: the most frequent value that is not missing; of equals the one seen first."""
    counted = df.filter(F.nullif(F.col(value_col), F.lit("")).isNotNull()).groupBy(*key_cols, value_col).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order_cols)).alias("_at"))
    return counted.groupBy(*key_cols).agg(F.min_by(value_col, F.struct(-F.col("_n"), "_at")).alias(value_col))


def match_fields(title: str, fields: list[str]) -> list:
    """The fields of an answer, null without a title."""
    return [F.when(F.col(title).isNotNull(), F.col(f)).alias(f) for f in fields]


def build_cues(grouped: DataFrame, fields: tuple[str, ...] = ("provider", "title", "artist")) -> DataFrame:
    """One cue per group: segment_id, start_n, duration_n, pending, the first identified answer's fields, album by majority."""
    named = F.when(F.col("title").isNotNull(), F.struct("clip_idx", *fields))
    cues = grouped.groupBy("run_id", "group_idx").agg(
        F.min_by("start_n", "clip_idx").alias("start_n"), F.max_by("end_n", "clip_idx").alias("_end"), F.bool_and("skipped").alias("pending"), F.min(named).alias("_first"), F.count(F.lit(1)).alias("n_clips"))
    album = mode_first(grouped.filter("title is not null"), ["run_id", "group_idx"], "album", ["clip_idx"])
    return cues.join(album, ["run_id", "group_idx"], "left").select(
        "run_id", F.format_string("seg_%03d", F.col("group_idx") + 1).alias("segment_id"), "start_n", (F.col("_end") - F.col("start_n")).alias("duration_n"), "pending", *(F.col(f"_first.{f}").alias(f) for f in fields), "album", "n_clips")


def named_songs(answers: DataFrame) -> DataFrame:
    """Every song a clip names: run_id, segment_id, clip_idx, pos, provider and song fields, score.

    Needs votes ARRAY<STRUCT<provider,title,artist,isrc,album,release_year,score,matched,candidates>>; a vote stands
    for its candidates if it has any, else for itself. With a column candidates (and provider and the song fields of
    the clip's own answer) a vote of acrcloud without candidates stands for the clip's, and a clip without votes
    names its candidates, else its own answer if that has a title."""
    fields = ("title", "artist", "isrc", "album", "release_year", "score")
    song = lambda provider, c: F.struct(provider.alias("provider"), *(c[f].alias(f) for f in fields))
    listed = lambda provider, found: F.transform(found, lambda c: song(provider, c))
    general = "candidates" in answers.columns

    def of_vote(v):
        some = F.when(F.size(v["candidates"]) > 0, listed(v["provider"], v["candidates"]))
        if general:
            some = some.when((v["provider"] == "acrcloud") & (F.size("candidates") > 0), listed(v["provider"], F.col("candidates")))
        return some.otherwise(F.array(song(v["provider"], v)))

    each = F.transform(F.filter("votes", lambda v: v["matched"]), of_vote)
    if general:
        own = F.when(F.nullif("title", F.lit("")).isNotNull(), F.array(F.struct("provider", *fields)))
        alone = F.when(F.size("candidates") > 0, listed(F.col("provider"), F.col("candidates"))).otherwise(own)
        each = F.when(F.size("votes") > 0, each).otherwise(F.array(alone))
    return answers.select("run_id", "segment_id", "clip_idx", F.posexplode(F.flatten(F.array_compact(each))).alias("pos", "s")).select("run_id", "segment_id", "clip_idx", "pos", "s.*")


def alternatives(songs: DataFrame) -> DataFrame:
    """Songs named for a segment, once each: windows (clips naming it), best score, rank in order of first naming."""
    song = ["provider", "title", "artist", "isrc", "album", "release_year"]
    per_clip = songs.groupBy("run_id", "segment_id", "clip_idx", *song).agg(F.min(F.struct("pos", "score")).alias("first"))
    every = per_clip.groupBy("run_id", "segment_id", *song).agg(F.count(F.lit(1)).alias("windows"), F.max("first.score").alias("score"), F.min(F.struct("clip_idx", F.col("first.pos").alias("pos"))).alias("seen"))
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "segment_id").orderBy("seen"))).drop("seen")


def pending_cues(cues: DataFrame) -> DataFrame:
    return cues.filter("pending and audio_file is not null")


def identified(cues: DataFrame) -> DataFrame:
    return cues.filter(F.nullif(F.col("title"), F.lit("")).isNotNull())


def with_isrc(cues: DataFrame) -> DataFrame:
    return cues.filter(F.nullif(F.col("isrc"), F.lit("")).isNotNull())
