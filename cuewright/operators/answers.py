"""Answers of identification sources: parsing, outcomes, the circuit breaker, and the vote among sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.text import isrc_key, missing, norm_artist, norm_title, parse_year

#: Sources in order of trust.
PRIORITY = ("acrcloud", "shazam", "audd")

RANKED = "status struct<code:int>, metadata struct<music:array<struct<title:string,artists:array<struct<name:string>>,album:struct<name:string,release_date:string>,release_date:string,score:double,external_ids:struct<isrc:string>,external_metadata:struct<spotify:struct<track:struct<id:string>>,youtube:struct<vid:string>>>>>"
SINGLE = "status string, error struct<error_code:int>, result struct<title:string,artist:string,album:string,release_date:string,song_link:string,apple_music:struct<isrc:string,url:string>,spotify:struct<external_ids:struct<isrc:string>,external_urls:struct<spotify:string>>,musicbrainz:array<struct<id:string,isrcs:array<string>>>>"
TRACK = "track struct<title:string,subtitle:string,isrc:string,url:string,genres:struct<primary:string>,sections:array<struct<type:string,metadata:array<struct<title:string,text:string>>,youtubeurl:string>>,hub:struct<actions:array<struct<uri:string>>,options:array<struct<actions:array<struct<uri:string>>>>>>, title string, artist string, isrc string, url string, id string"


def priority_of(provider: Column, priority=PRIORITY) -> Column:
    """Place in the order of trust; unknown sources last."""
    at = F.array_position(F.array(*map(F.lit, priority)), provider)
    return F.when(at > 0, at).otherwise(F.lit(len(priority) + 1)).cast("int")


def classify_outcome(raw: DataFrame) -> DataFrame:
    """Adds outcome: match, no_match, rate_limited or auth_error. Needs provider, http_status, payload (JSON text)."""
    ranked, single, track = (F.from_json("payload", s) for s in (RANKED, SINGLE, TRACK))
    code = ranked["status"]["code"]
    acr = F.when(code == 0, F.when(F.size(ranked["metadata"]["music"]) > 0, "match").otherwise("no_match")).when(code.isin(3001, 3014), "auth_error").when(code.between(3000, 3999), "rate_limited").otherwise("no_match")
    no_json = F.col("payload").isNull() | single["status"].isNull()
    audd = F.when(F.col("http_status").isNull() | no_json, "rate_limited").when(single["error"]["error_code"] == 900, "auth_error").when(single["error"]["error_code"] == 901, "rate_limited").when(single["result"]["title"].isNotNull(), "match").otherwise("no_match")
    busy = F.col("http_status").isNull() | (F.col("http_status") == 429) | (F.col("http_status") >= 500)
    shazam = F.when(busy, "rate_limited").when(F.coalesce(track["track"]["title"], track["title"]).isNotNull(), "match").otherwise("no_match")
    return raw.withColumn("outcome", F.when(F.col("provider") == "acrcloud", acr).when(F.col("provider") == "audd", audd).otherwise(shazam))


def _link(prefix: str, part: Column) -> Column:
    return F.when(missing(part).isNotNull(), F.concat(F.lit(prefix), part))


def normalize_ranked_answers(raw: DataFrame, floor: float = 0.0, most: int = 5) -> DataFrame:
    """Adds candidates (the first `most`, in rank order) and the first one's fields, unless its score is under the floor."""
    def song(m: Column) -> Column:
        year = F.coalesce(parse_year(m["release_date"]), parse_year(m["album"]["release_date"]))
        names = F.array_join(F.filter(F.transform(m["artists"], lambda a: missing(a["name"])), lambda n: n.isNotNull()), ", ")
        return F.struct(m["title"].alias("title"), missing(names).alias("artist"), m["album"]["name"].alias("album"), year.alias("release_year"), isrc_key(m["external_ids"]["isrc"]).alias("isrc"),
                        _link("https://open.spotify.com/track/", m["external_metadata"]["spotify"]["track"]["id"]).alias("spotify_url"), _link("https://www.youtube.com/watch?v=", m["external_metadata"]["youtube"]["vid"]).alias("youtube_link"), m["score"].alias("score"))

    told = raw.withColumn("_j", F.from_json("payload", RANKED))
    music = F.when(F.col("_j.status.code") == 0, F.slice("_j.metadata.music", 1, most))
    told = told.withColumn("candidates", F.coalesce(F.transform(music, song), F.from_json(F.lit("[]"), "array<struct<title:string,artist:string,album:string,release_year:int,isrc:string,spotify_url:string,youtube_link:string,score:double>>")))
    top = F.get("candidates", F.lit(0))
    best = F.when(F.coalesce(top["score"], F.lit(0.0)) >= floor, top)
    return told.withColumn("_b", best).select(*raw.columns, "candidates", *(F.col(f"_b.{f}").alias(f) for f in ("title", "artist", "album", "release_year", "isrc", "spotify_url", "score")))


def normalize_single_answers(raw: DataFrame) -> DataFrame:
    """Adds the one result's fields; the ISRC is Apple's, else Spotify's, else the first of MusicBrainz."""
    r = F.from_json("payload", SINGLE)["result"]
    first = F.get(r["musicbrainz"], F.lit(0))
    return raw.select(*raw.columns, r["title"].alias("title"), r["artist"].alias("artist"), r["album"].alias("album"), parse_year(r["release_date"]).alias("release_year"),
                      F.coalesce(isrc_key(r["apple_music"]["isrc"]), isrc_key(r["spotify"]["external_ids"]["isrc"]), isrc_key(F.get(first["isrcs"], F.lit(0)))).alias("isrc"),
                      r["song_link"].alias("song_link"), r["apple_music"]["url"].alias("apple_music_url"), r["spotify"]["external_urls"]["spotify"].alias("spotify_url"), first["id"].alias("musicbrainz_recording_id"))


def normalize_track_answers(raw: DataFrame) -> DataFrame:
    """Adds the track's fields, from the nested or the flat shape."""
    j = F.from_json("payload", TRACK)
    t = j["track"]
    first = F.get(t["sections"], F.lit(0))
    album = F.get(first["metadata"], F.lit(0))["text"]
    released = F.get(F.filter(first["metadata"], lambda m: F.lower(F.trim(m["title"])) == "released"), F.lit(0))["text"]
    video = F.get(F.filter(t["sections"], lambda s: s["type"] == "VIDEO"), F.lit(0))["youtubeurl"]
    return raw.select(*raw.columns, F.coalesce(t["title"], j["title"]).alias("title"), F.coalesce(t["subtitle"], j["artist"]).alias("artist"), album.alias("album"), parse_year(released).alias("release_year"),
                      F.coalesce(isrc_key(t["isrc"]), isrc_key(j["isrc"])).alias("isrc"), t["genres"]["primary"].alias("genre"), video.alias("youtube_link"), F.coalesce(t["url"], j["url"]).alias("song_link"),
                      F.coalesce(F.get(t["hub"]["actions"], F.lit(0))["uri"], F.get(F.get(t["hub"]["options"], F.lit(0))["actions"], F.lit(0))["uri"]).alias("hub_uri"))


def min_score(answers: DataFrame, floor: float) -> DataFrame:
    return answers.filter(F.coalesce("score", F.lit(0.0)) >= floor)


def breaker(answers: DataFrame, order_cols: list[str]) -> DataFrame:
    """skipped: after the first rate-limited answer of a run everything counts as skipped, that answer included."""
    before = Window.partitionBy("run_id").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    return answers.withColumn("skipped", F.col("skipped") | F.max("rate_limited").over(before))


#: Outcomes of one source for a clip, the gravest first; those that answer are the last two.
OUTCOMES = ("auth_error", "match", "no_match", "rate_limited", "error")


def clip_outcomes(answers: DataFrame) -> DataFrame:
    """run_id, clip_idx, outcome, asked, answered: the outcome of a clip from those of its sources (run_id, clip_idx, outcome).

    A refused key is that of the whole clip, whatever the others say; else the clip is answered if any source answered,
    with a match if any has one; nobody answering, it is rate-limited if any was, else an error. That is the first of
    OUTCOMES that occurs, so a minimum by place folds it in the map-side part."""
    place = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome"))
    folded = answers.groupBy("run_id", "clip_idx").agg(F.min(F.when(place > 0, place)).alias("_p"), F.count(F.lit(1)).alias("asked"), F.count_if(F.col("outcome").isin("match", "no_match")).alias("answered"))
    return folded.select("run_id", "clip_idx", F.get(F.array(*map(F.lit, OUTCOMES)), F.coalesce("_p", F.lit(len(OUTCOMES))).cast("int") - 1).alias("outcome"), "asked", "answered")


def run_outcomes(clips: DataFrame) -> DataFrame:
    """run_id, outcome, answered, pending, limited_at, failed_at: how a run ends, from its clips' outcomes in order.

    Clips are asked in order of clip_idx. The first rate-limited one ends the asking: it and all after it are pending.
    A refused key before that fails the run, which then has no results; an error leaves only its own clip pending.
    outcome: failed, limited, partial (errors) or complete."""
    at = lambda what: F.min(F.when(F.col("outcome") == what, F.col("clip_idx")))
    # two folds that need no order in a task: the first limit and refusal, then what lies before the limit
    stops = clips.groupBy("run_id").agg(at("rate_limited").alias("limited_at"), at("auth_error").alias("failed_at"))
    fails = F.col("failed_at").isNotNull() & F.coalesce(F.col("failed_at") < F.col("limited_at"), F.lit(True))
    stops = stops.withColumn("failed", fails)
    asked = F.coalesce(F.col("clip_idx") < F.col("limited_at"), F.lit(True))
    counts = clips.join(stops, "run_id").groupBy("run_id", "failed", "limited_at", "failed_at").agg(
        F.count_if(asked & F.col("outcome").isin("match", "no_match")).alias("answered"), F.count_if(~asked | F.col("outcome").isin("rate_limited", "error")).alias("pending"))
    outcome = F.when(F.col("failed"), "failed").when(F.col("limited_at").isNotNull(), "limited").when(F.col("pending") > 0, "partial").otherwise("complete")
    none = lambda c: F.when(F.col("failed"), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
    return counts.select("run_id", outcome.alias("outcome"), none("answered"), none("pending"), F.when(~F.col("failed"), F.col("limited_at")).alias("limited_at"), F.when(F.col("failed"), F.col("failed_at")).alias("failed_at"))


def progress_counts(answers: DataFrame) -> DataFrame:
    """answered, total and found per run."""
    return answers.groupBy("run_id").agg(F.count_if(~F.col("skipped")).alias("answered"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("title").isNotNull()).alias("found"))


def stall_gaps(progress: DataFrame, warn_n: int, hard_n: int) -> DataFrame:
    """Events after which nothing happened for warn_n (warning) or hard_n (strong). Needs run_id, event_id, at_n."""
    w = Window.partitionBy("run_id").orderBy("at_n", "event_id")
    gaps = progress.withColumn("gap_n", F.lead("at_n").over(w) - F.col("at_n")).filter(F.col("gap_n") >= warn_n)
    return gaps.select("run_id", "event_id", "at_n", "gap_n", F.when(F.col("gap_n") >= hard_n, "strong").otherwise("warning").alias("level"))


def union_answers(*frames: DataFrame) -> DataFrame:
    """Answers of several sources, with prio."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumn("prio", priority_of(F.col("provider")))


_FOLD = """
aggregate(_votes, cast(array() as array<struct<isrcs:array<string>,songs:array<string>,members:array<int>>>), (acc, v) ->
  case when array_position(transform(acc, c -> coalesce(array_contains(c.isrcs, v.isrc_k), false) or coalesce(array_contains(c.songs, v.song_k), false)), true) > 0
  then transform(acc, (c, i) -> case when i + 1 = array_position(transform(acc, d -> coalesce(array_contains(d.isrcs, v.isrc_k), false) or coalesce(array_contains(d.songs, v.song_k), false)), true)
       then struct(concat(c.isrcs, array_compact(array(v.isrc_k))) as isrcs, concat(c.songs, array_compact(array(v.song_k))) as songs, concat(c.members, array(v.at)) as members) else c end)
  else concat(acc, array(struct(array_compact(array(v.isrc_k)) as isrcs, array_compact(array(v.song_k)) as songs, array(v.at) as members))) end)
"""


def vote_consensus(votes: DataFrame, fields: tuple[str, ...] = ("album", "release_year"), keys: tuple[str, ...] = ("run_id", "clip_idx")) -> DataFrame:
    """The winning cluster of a clip's votes: title, artist, isrc, merged fields, and the agreement.

    votes: keys, provider, prio, title, artist, isrc, matched and the fields; one row per source asked. Votes are
    taken in order of prio; each joins the first cluster that shares its ISRC or its normalised title and artist
    (clusters are never merged later); most members win, then the smallest prio. A clip has few votes: one per source."""
    song = norm_title(F.col("title"))
    told = votes.withColumn("_isrc", isrc_key(F.col("isrc"))).withColumn("_song", F.when(song != "", F.concat_ws("\u0001", song, norm_artist(F.col("artist")))))
    vote = F.struct("prio", "provider", "title", "artist", F.col("isrc").alias("isrc"), *fields, F.col("_isrc").alias("isrc_k"), F.col("_song").alias("song_k"))
    rows = told.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("matched") & missing("title").isNotNull(), vote))).alias("_all"), F.count(F.lit(1)).alias("total"))
    named = ("prio", "provider", "title", "artist", "isrc", *fields, "isrc_k", "song_k")
    rows = rows.withColumn("_votes", F.transform("_all", lambda v, i: F.struct(i.alias("at"), *(v[n].alias(n) for n in named))))
    rows = rows.withColumn("_clusters", F.expr(_FOLD)).withColumn("_win", F.get(F.array_sort(F.transform("_clusters", lambda c: F.struct((-F.size(c["members"])).alias("n"), c["members"].alias("members")))), F.lit(0))["members"])
    rows = rows.withColumn("_members", F.transform("_win", lambda i: F.get("_votes", i)))
    first = F.get("_members", F.lit(0))
    merged = lambda f: F.get(F.filter(F.transform("_members", lambda m: m[f]), lambda x: x.isNotNull()), F.lit(0))
    return rows.select(*keys, first["title"].alias("title"), first["artist"].alias("artist"), merged("isrc").alias("isrc"), *(merged(f).alias(f) for f in fields),
                       F.coalesce(F.size("_win"), F.lit(0)).alias("_n"), "total", F.coalesce(F.transform("_members", lambda m: m["provider"]), F.array().cast("array<string>")).alias("providers")).withColumn("agreement", F.greatest("_n", F.lit(0)).cast("long")).drop("_n")
