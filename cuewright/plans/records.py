"""Adapters for film resolution, outcomes, typed edits, derived columns, scorers and saved documents, with DuckDB twins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.operators import answers as A
from cuewright.operators import catalog as K
from cuewright.operators import cues as C
from cuewright.operators import edits as E
from cuewright.operators import films as M
from cuewright.operators import ranking as R
from cuewright.operators import reports as P
from cuewright.operators import windows as W
from cuewright.operators.extension import answer_with, score_with
from cuewright.sources import results as S

from .signal import _SOFT, read

x = F.expr


def cast(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# --- films ------------------------------------------------------------------------------------------------------

def film_sources(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    sup, cust = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    movies = sup.select(F.lit("movie").alias("media_type"), F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("rank"), x("case when s_suppkey % 2 = 0 then concat('tt', s_suppkey) end").alias("imdb_id"), x("concat('T', s_suppkey div 3)").alias("title"), x("case when s_suppkey % 7 <> 0 then cast(1990 + s_suppkey % 10 as int) end").alias("year"),
                        x("case when s_suppkey % 4 <> 0 then s_name end").alias("director"), x("case when s_suppkey % 3 = 0 then 1980 end").alias("director_death_year"), F.lit(None).cast("string").alias("music_composer"))
    series = cust.select(F.lit("tv").alias("media_type"), F.col("c_custkey").alias("id"), F.col("c_custkey").alias("rank"), x("concat('tt', c_custkey + 50)").alias("imdb_id"), x("concat('T', c_custkey div 3)").alias("title"), x("case when c_custkey % 5 <> 0 then cast(1990 + c_custkey % 10 as int) end").alias("year"),
                         F.col("c_mktsegment").alias("director"), F.lit(None).cast("int").alias("director_death_year"), F.lit("Some Composer").alias("music_composer"))
    second = cust.filter("c_custkey % 4 <> 3").select(x("concat('tt', c_custkey)").alias("imdb_id"), x("concat('T', c_custkey div 3)").alias("title"), x("cast(1990 + c_custkey % 10 as int)").alias("year"), x("case when c_custkey % 3 = 0 then 'second' end").alias("director"), x("case when c_nationkey % 2 = 0 then cast(1900 + c_nationkey as int) end").alias("director_death_year"), F.col("c_custkey").alias("rank"))
    third = cust.select(x("concat('tt', c_custkey)").alias("imdb_id"), F.lit("third").alias("title"), F.lit(1950).alias("year"), F.lit("someone").alias("director"), x("case when c_custkey % 2 = 0 then 1999 end").alias("director_death_year"))
    return movies.unionByName(series), second, third


def film_hints(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hint_id"), x("case when o_orderkey % 4 = 0 then o_custkey end").alias("tmdb_id"), x("case when o_orderkey % 8 in (0, 1, 3) then concat('tt', o_custkey) end").alias("imdb_id"), x("case when o_orderkey % 3 <> 0 then concat('T', o_custkey div 3) end").alias("title"),
                                                x("case when o_orderkey % 2 = 0 then cast(1990 + o_custkey % 10 as int) end").alias("year"), x("case o_orderkey % 5 when 0 then 'tv' when 1 then 'movie' end").alias("media_type"))


def q_film_resolve(spark, sf_dir):
    told = M.film_resolve(film_hints(spark, sf_dir), *film_sources(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))
    return cast(told, "year", "director_death_year")


# --- outcomes ---------------------------------------------------------------------------------------------------

def source_answers(spark, sf_dir) -> DataFrame:
    """The events of a user by day and source, the clips of a run: up to three sources and what each said."""
    ev = read(spark, sf_dir, "events")
    said = x("case when event_id % 1201 = 0 then 'auth_error' when event_type = 'error' then if(event_id % 3 = 0, 'rate_limited', 'error') when event_type in ('click', 'purchase') then 'match' else 'no_match' end")
    return ev.select(F.col("user_id").alias("run_id"), F.expr("datediff(ts, date'2024-01-01')").cast("long").alias("clip_idx"), said.alias("outcome"))


def q_clip_outcomes(spark, sf_dir):
    return A.clip_outcomes(source_answers(spark, sf_dir))


def q_run_outcomes(spark, sf_dir):
    return A.run_outcomes(A.clip_outcomes(source_answers(spark, sf_dir)))


def q_answer_with(spark, sf_dir):
    """Two providers that answer the same clips."""
    clips = read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("clip_idx"), "event_type")
    one = lambda c: c.select("run_id", "clip_idx", F.lit("shazam").alias("provider"), F.when(F.col("event_type") == "click", "heard").alias("title"), x("if(clip_idx % 10 = 0, 'rate_limited', if(event_type = 'click', 'match', 'no_match'))").alias("outcome"))
    two = lambda c: c.select("run_id", "clip_idx", F.lit("other").alias("provider"), F.upper("event_type").alias("title"), F.lit("match").alias("outcome"), F.lit(1.5).alias("score"))
    return cast(answer_with(clips, [one, two]), "prio")


# --- saved cues -------------------------------------------------------------------------------------------------

def q_typed_edits(spark, sf_dir):
    """Edits as they were typed: some name no cue, some name one twice, some have a number or a list for a text."""
    o = read(spark, sf_dir, "orders")
    saved = o.select(F.col("o_custkey").alias("run_id"), x("concat('seg_', o_orderkey)").alias("segment_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("artist"), F.lit("own").alias("album"), F.lit("Old").alias("composer"))
    value = "case o_orderkey % 60 when 0 then '5' when 1 then '[1]' when 2 then 'null' else concat('\"t', o_orderkey, '\"') end"
    edit = x(f"concat('{{\"segment_id\": \"seg_', if(o_orderkey % 97 = 0, 'x', ''), o_orderkey, '\", \"title\": ', {value}, if(o_orderkey % 3 = 0, ', \"artist\": \"typed\"', ''), ', \"enrichment\": ', case o_orderkey % 80 when 3 then '\"no\"' when 4 then 'null' else '{{\"composer\": \"New\"}}' end, '}}')")
    typed = o.filter("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("run_id"), edit.alias("edit"))
    typed = typed.unionByName(typed.filter("run_id % 11 = 1"))
    edits = E.typed_edits(typed).withColumn("composer", F.col("new_composer"))
    cues, rejects = E.apply_edits(saved, edits, ("title", "artist", "album", "composer"))
    told = cues.select("run_id", "segment_id", "title", "artist", "album", "composer", "edited", F.lit(None).cast("string").alias("reason"))
    return told.unionByName(rejects.select("run_id", "segment_id", *(F.lit(None).cast("string").alias(c) for c in ("title", "artist", "album", "composer")), F.lit(None).cast("boolean").alias("edited"), "reason"))


def q_resume_edited(spark, sf_dir):
    """A resume whose answers have no title for every third cue, while some pending cues got one by hand."""
    o = read(spark, sf_dir, "orders")
    saved = o.select(F.col("o_custkey").alias("run_id"), x("concat('seg_', o_orderkey)").alias("segment_id"), "o_orderkey", x("case when o_orderkey % 5 = 0 then 'typed by hand' when o_orderstatus <> 'P' then o_orderpriority end").alias("title"), x("case when o_orderkey % 5 = 0 then 'me' end").alias("artist"), x("o_orderstatus = 'P' or o_orderkey % 2 = 0").alias("pending"), x("concat(o_orderkey, '.wav')").alias("audio_file"))
    changes = saved.select("run_id", "segment_id", x("element_at(array('answered', 'gone', 'failed', 'answered'), cast(o_orderkey % 4 as int) + 1)").alias("outcome"), x("case when o_orderkey % 3 <> 0 then concat('found ', o_orderkey) end").alias("title"), x("case when o_orderkey % 3 <> 0 then 'F' end").alias("artist"))
    return E.resume_merge(saved, changes).drop("segment_id")


def q_refresh(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    cues = o.select(F.col("o_orderkey").alias("cue_id"), F.lit("La Song!").alias("title"), x("if(o_orderkey % 2 = 0, 'The Bo Ray Band', 'Nobody')").alias("artist"), x("cast(year(o_orderdate) + 5 as int)").alias("release_year"), x("case when o_orderkey % 9 = 0 then 1990 + o_orderkey % 12 end").cast("int").alias("original_year"),
                    F.lit(None).cast("int").alias("composer_death_year"), F.lit(None).cast("string").alias("composer"), x("cast(1992 + o_orderkey % 6 as int)").alias("film_year"), x("case when o_orderkey % 3 = 0 then 'Ann Lee and Bo Ray' end").alias("music_composer"), x("o_orderkey % 4 = 3").alias("authors_partial"),
                    x("case when o_orderkey % 7 <> 0 then array(named_struct('birth_year', 1850, 'death_year', cast(1930 + o_custkey % 60 as int))) end").alias("authors"), x("o_orderkey % 2 = 0").alias("public_domain"),
                    x("array(named_struct('title', 'a', 'artist', 'x', 'release_year', cast(1990 + o_orderkey % 15 as int)), named_struct('title', 'b', 'artist', 'bo ray', 'release_year', 2005))").alias("alternatives"))
    told = R.refresh(cues, 2026)
    return told.select("cue_id", "anachronistic", "track_key", "public_domain", F.col("latest_author_death_year").cast("long").alias("latest"), F.array_join(F.transform("alternatives", lambda a: a["anachronistic"].cast("string")), ",").alias("alternatives"))


def q_alternatives_any(spark, sf_dir):
    """Clips with votes, with candidates alone, with an answer alone, and without any."""
    song = "named_struct('title', {}, 'artist', 'a', 'isrc', cast(null as string), 'album', 'b', 'release_year', 1990, 'score', cast({} as double))".format
    vote = "named_struct('provider', {}, 'matched', {}, 'title', {}, 'artist', 'a', 'isrc', cast(null as string), 'album', 'b', 'release_year', 1990, 'score', cast(null as double), 'candidates', {})".format
    none = f"filter(array({song(repr('z'), 1)}), c -> false)"
    o = read(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 200).alias("run_id"), F.lit("s").alias("segment_id"), F.col("o_orderkey").alias("clip_idx"), F.lit("own").alias("provider"), x("if(o_orderkey % 6 < 5, o_orderpriority, null)").alias("title"), F.lit("a").alias("artist"), F.lit(None).cast("string").alias("isrc"), F.lit("b").alias("album"), F.lit(1990).alias("release_year"), F.lit(None).cast("double").alias("score"),
        x(f"if(o_orderkey % 3 = 0, array({song('o_orderpriority', 'o_orderkey % 50')}, {song(repr('second'), 40)}), {none})").alias("candidates"),
        x(f"if(o_orderkey % 4 = 1, array({vote(repr('acrcloud'), 'true', repr('voted'), none)}, {vote(repr('audd'), 'o_orderkey % 8 = 1', repr('heard'), 'array(' + song(repr('cand'), 7) + ')')}), null)").alias("votes"))
    return cast(C.alternatives(C.named_songs(o)).select("run_id", "provider", "title", "windows", "score", "rank"), "rank")


def q_track_cues(spark, sf_dir):
    cues = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.col("role").alias("title"), F.lit("A").alias("artist"), (F.length("text") % 4).alias("agreement_count"), F.lit(False).alias("anachronistic"), F.lit(1).cast("long").alias("duration_n"), x("concat('seg_', turn)").alias("segment_id"))
    return P.tracks_report(cues, "segment_id").select("run_id", "track_key", F.array_join("cues", ",").alias("cues"))


def q_match_fields(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select("o_orderkey", x("if(o_orderstatus = 'P', null, o_orderpriority)").alias("title"), F.col("o_orderkey").alias("link"))
    return a.select("o_orderkey", *C.match_fields("title", ["title", "link"]))


def documents(spark, sf_dir) -> DataFrame:
    """A saved document of version 6 for each customer with orders, as JSON text."""
    cue = F.struct(x("concat('seg_', o_orderkey)").alias("segment_id"), x("o_orderkey % 1000 / 4.0d").alias("start"), x("10.5d").alias("duration"), x("o_orderstatus = 'P'").alias("pending"), x("if(o_orderstatus = 'P', null, o_orderpriority)").alias("title"), F.lit("A").alias("artist"), x("cast(year(o_orderdate) as int)").alias("release_year"),
                   x("named_struct('composer', 'C', 'authors', array(named_struct('name', 'C', 'roles', array('composer'), 'birth_year', 1900, 'death_year', cast(1930 + o_orderkey % 60 as int))), 'latest_author_death_year', 1)").alias("enrichment"),
                   x("array(named_struct('provider', 'audd', 'title', 'alt', 'release_year', cast(1990 + o_orderkey % 12 as int), 'windows', 2))").alias("alternatives"))
    film = x("named_struct('title', 'F', 'year', cast(1990 + o_custkey % 9 as int), 'imdb_id', concat('tt', o_custkey), 'tmdb_id', o_custkey, 'media_type', 'movie', 'director_death_year', 1999, 'sources', array('tmdb'))")
    per = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(cue)).alias("cues"))
    return per.select(F.col("o_custkey").alias("run_id"), F.to_json(F.struct(F.lit(6).alias("version"), x("concat('film ', o_custkey)").alias("source"), film.alias("film"), F.array(F.lit("shazam"), F.lit("audd")).alias("providers"), x("named_struct('classifier', 'C', 'hop', 5.0d, 'max_segment_duration', 30.0d)").alias("settings"), x("named_struct('file', 'v.mp4', 'fps', 24.0d)").alias("video"), "cues")).alias("text"))


def q_published_results(spark, sf_dir):
    """Documents written as JSON files, read, published, some of them published again after an edit, and read back."""
    folder = S.work_folder(spark, "published")
    docs = documents(spark, sf_dir)
    docs.select("text").write.text(f"{folder}/saved")
    saved = S.migrate_results(spark.read.schema(S.RESULTS).json(f"{folder}/saved")).withColumn("run_id", F.col("film.tmdb_id"))
    S.publish_results(saved, f"{folder}/store", 2026)
    held = S.read_published(spark, f"{folder}/store")
    edited = held.filter("run_id % 5 = 0").withColumn("film", F.col("film").withField("year", F.col("film.year") - 20))
    S.publish_results(edited, f"{folder}/store", 2026)
    cues = S.read_published(spark, f"{folder}/store").select("run_id", "source", F.col("film.imdb_id").alias("imdb_id"), F.col("film.year").cast("long").alias("film_year"), F.array_join("providers", "+").alias("providers"), F.col("settings.hop").alias("hop"), F.col("video.fps").alias("fps"), F.explode("cues").alias("c"))
    return cues.select("run_id", "source", "imdb_id", "film_year", "providers", "hop", "fps", "c.segment_id", "c.track_key", "c.anachronistic", F.col("c.enrichment.public_domain").alias("public_domain"), F.col("c.enrichment.latest_author_death_year").cast("long").alias("latest"), F.col("c.alternatives")[0]["anachronistic"].alias("alternative_late"))


# --- catalogue and texts ----------------------------------------------------------------------------------------

def q_work_by_name_forms(spark, sf_dir):
    """Authors and artists of which some have no ASCII form, and an artist with a mark between two names."""
    cust = read(spark, sf_dir, "customer")
    works = cust.select(F.col("c_custkey").alias("work_id"), x("concat('Work ', c_custkey % 90)").alias("title"), F.col("c_custkey").alias("rank"))
    names = cust.select(F.col("c_custkey").alias("work_id"), F.array(F.struct(x("case c_custkey % 4 when 0 then 'Дмитрий' when 1 then 'Ann Orff' when 2 then '' else 'Bob' end").alias("name")), F.struct(x("if(c_custkey % 8 = 3, 'Ann', null)").alias("name"))).alias("authors"))
    cues = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cue_id"), x("concat('Work ', o_custkey % 90)").alias("title"), x("element_at(array('Ann & Bob', 'Дмитрий, X', '&', 'Orff, C.'), cast(o_custkey % 4 as int) + 1)").alias("artist"))
    return cast(K.work_by_title(cues, works, names).select("cue_id", "work_id", "score"), "score")


def q_original_year_edges(spark, sf_dir):
    """Dates by composer and by performer; repeated edges count once."""
    cust = read(spark, sf_dir, "customer")
    edge = lambda person, year: cust.select(x("concat('Work ', c_custkey % 50)").alias("title"), x(person).alias("person"), x(year).alias("published"), F.lit(None).cast("string").alias("inception"))
    dates = K.person_edges(edge("c_mktsegment", "concat(1900 + c_custkey % 80, '-05-01')"), edge("concat('n', c_nationkey)", "cast(1880 + c_custkey % 70 as string)"))
    cues = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cue_id"), x("concat('Work ', o_custkey % 60)").alias("title"), F.array(F.lit("BUILDING"), x("concat('n', o_custkey % 25)")).alias("names"))
    return cast(K.original_year(cues, dates), "original_year")


def q_title_forms(spark, sf_dir):
    """Titles with guests, words that begin like the mark of guests, notes, brackets and line ends."""
    forms = ("{} feat. Someone", "{} Feather Song", "{}\nfeat x\nmore", "{} (Live [x) y]", "{} - Remastered 2011", "{}-remaster", "defeat {}", "{} [a (b] c)")
    said = F.element_at(F.array(*(F.concat(F.lit(f.split("{}")[0]), F.col("p_type"), F.lit(f.split("{}")[1])) for f in forms)), (F.col("p_partkey") % len(forms) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", T.norm_title(said).alias("title_key"))


def q_to_year_int(spark, sf_dir):
    typed = x("case p_partkey % 5 when 0 then ' 1950 ' when 1 then 'c. 1950' when 2 then '' when 3 then cast(p_size as string) else '19.5' end")
    return cast(read(spark, sf_dir, "part").select("p_partkey", T.to_year_int(typed).alias("year")), "year")


def q_provider_priority(spark, sf_dir):
    named = x("element_at(array('acrcloud', 'shazam', 'audd', 'nobody', cast(null as string)), cast(p_partkey % 5 as int) + 1)")
    return cast(read(spark, sf_dir, "part").select("p_partkey", A.priority_of(named).alias("prio")), "prio")


# --- scorers ----------------------------------------------------------------------------------------------------

def q_class_log(spark, sf_dir):
    probs = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("run_id"), F.lit(0).cast("long").alias("start_n"), F.lit(1).cast("long").alias("end_n"), T.softmax(F.col("embedding")).alias("probs"))
    scored = W.mark_hits(probs.withColumn("score", T.label_score(F.col("probs"), [0, 3, 5])), 0.05)
    return W.class_log(scored).select("run_id", "score", "is_hit", *(F.col("classes")[i]["label"].cast("long").alias(f"label{i + 1}") for i in range(3)))


def _spread():
    """A scorer without a model: the largest coordinate's distance from the smallest."""
    return lambda batch: pd.DataFrame({"score": [float(max(v)) - float(min(v)) for v in batch["embedding"]], "probs": [[float(len(v))] for v in batch["embedding"]]})


def q_score_with(spark, sf_dir):
    scored = score_with(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _spread, name="spread of coordinates, 1")
    return scored.select("vec_id", F.round("score", 5).alias("score"), F.col("probs")[0].cast("long").alias("n"))


QUERIES = {k[2:]: f for k, f in list(globals().items()) if k.startswith("q_")}

_ANSWERS = """a AS (SELECT user_id AS run_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS clip_idx, CASE WHEN event_id % 1201 = 0 THEN 'auth_error' WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'rate_limited' ELSE 'error' END WHEN event_type IN ('click', 'purchase') THEN 'match' ELSE 'no_match' END AS outcome FROM events),
  c AS (SELECT run_id, clip_idx, CASE WHEN bool_or(outcome = 'auth_error') THEN 'auth_error' WHEN bool_or(outcome = 'match') THEN 'match' WHEN bool_or(outcome = 'no_match') THEN 'no_match' WHEN bool_or(outcome = 'rate_limited') THEN 'rate_limited' ELSE 'error' END AS outcome,
        count(*) AS asked, count(*) FILTER (outcome IN ('match', 'no_match')) AS answered FROM a GROUP BY ALL)"""

SQL = {
    "film_resolve": """WITH f AS (SELECT 'movie' AS kind, 0 AS turn, s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'tt' || s_suppkey END AS imdb, 'T' || (s_suppkey // 3) AS title, CASE WHEN s_suppkey % 7 <> 0 THEN 1990 + s_suppkey % 10 END AS year, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS director, CASE WHEN s_suppkey % 3 = 0 THEN 1980 END AS death, NULL AS composer FROM supplier
        UNION ALL SELECT 'tv', 1, c_custkey, 'tt' || (c_custkey + 50), 'T' || (c_custkey // 3), CASE WHEN c_custkey % 5 <> 0 THEN 1990 + c_custkey % 10 END, c_mktsegment, NULL, 'Some Composer' FROM customer),
      h AS (SELECT o_orderkey AS hint_id, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS g_id, CASE WHEN o_orderkey % 8 IN (0, 1, 3) THEN 'tt' || o_custkey END AS g_imdb, CASE WHEN o_orderkey % 3 <> 0 THEN 'T' || (o_custkey // 3) END AS g_title, CASE WHEN o_orderkey % 2 = 0 THEN 1990 + o_custkey % 10 END AS g_year, CASE o_orderkey % 5 WHEN 0 THEN 'tv' WHEN 1 THEN 'movie' END AS g_kind FROM orders),
      c AS (SELECT hint_id, f.*, 1 AS step FROM h JOIN f ON id = g_id AND kind = coalesce(g_kind, 'movie')
        UNION ALL SELECT hint_id, f.*, 2 FROM h JOIN f ON imdb = g_imdb AND (g_kind IS NULL OR g_kind = kind)
        UNION ALL SELECT hint_id, f.*, 3 FROM h JOIN f ON title = g_title AND (g_kind IS NULL OR g_kind = kind) AND (g_year IS NULL OR g_year = year)),
      p AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY hint_id ORDER BY step, turn, id) = 1),
      a AS (SELECT h.*, p.* EXCLUDE (hint_id), title IS NOT NULL AND year IS NOT NULL AND (coalesce(kind = 'tv', false) OR director IS NOT NULL AND death IS NOT NULL) AS done FROM h LEFT JOIN p USING (hint_id)),
      s AS (SELECT 'tt' || c_custkey AS imdb, 'T' || (c_custkey // 3) AS title, 1990 + c_custkey % 10 AS year, CASE WHEN c_custkey % 3 = 0 THEN 'second' END AS director, CASE WHEN c_nationkey % 2 = 0 THEN 1900 + c_nationkey END AS death, c_custkey AS rank FROM customer WHERE c_custkey % 4 <> 3),
      w AS (SELECT hint_id, s.* FROM a JOIN s ON s.imdb = coalesce(a.imdb, g_imdb) WHERE NOT done UNION ALL SELECT hint_id, s.* FROM a JOIN s ON s.title = coalesce(a.title, g_title) AND (coalesce(a.year, g_year) IS NULL OR coalesce(a.year, g_year) = s.year) WHERE NOT done AND coalesce(a.imdb, g_imdb) IS NULL),
      v AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY hint_id ORDER BY rank) = 1),
      b AS (SELECT a.hint_id, g_id, g_imdb, g_kind, a.kind, a.id, a.composer, a.step, coalesce(a.imdb, v.imdb) AS imdb, coalesce(a.title, v.title) AS title, coalesce(a.year, v.year) AS year, coalesce(a.director, v.director) AS director, coalesce(a.death, v.death) AS death,
          (a.imdb IS NULL AND v.imdb IS NOT NULL) OR (a.title IS NULL AND v.title IS NOT NULL) OR (a.year IS NULL AND v.year IS NOT NULL) OR (a.director IS NULL AND v.director IS NOT NULL) OR (a.death IS NULL AND v.death IS NOT NULL) AS two FROM a LEFT JOIN v USING (hint_id)),
      d AS (SELECT *, title IS NOT NULL AND year IS NOT NULL AND (coalesce(kind = 'tv', false) OR director IS NOT NULL AND death IS NOT NULL) AS done FROM b),
      t AS (SELECT d.hint_id, 'tt' || c_custkey AS imdb, CASE WHEN c_custkey % 2 = 0 THEN 1999 END AS death FROM d JOIN customer ON 'tt' || c_custkey = coalesce(d.imdb, g_imdb) WHERE NOT done)
      SELECT d.hint_id, coalesce(d.title, CASE WHEN t.imdb IS NOT NULL THEN 'third' END) AS title, coalesce(d.year, CASE WHEN t.imdb IS NOT NULL THEN 1950 END) AS year, coalesce(d.director, CASE WHEN t.imdb IS NOT NULL THEN 'someone' END) AS director, coalesce(d.death, t.death)::BIGINT AS director_death_year,
        coalesce(d.imdb, t.imdb, g_imdb) AS imdb_id, coalesce(d.id, g_id) AS tmdb_id, coalesce(d.kind, g_kind) AS media_type, composer AS music_composer,
        concat_ws(',', CASE WHEN step IS NOT NULL THEN 'first' END, CASE WHEN two THEN 'second' END, CASE WHEN t.imdb IS NOT NULL AND (d.imdb IS NULL OR d.title IS NULL OR d.year IS NULL OR d.director IS NULL OR (d.death IS NULL AND t.death IS NOT NULL)) THEN 'third' END) AS sources,
        CASE step WHEN 1 THEN 'id' WHEN 2 THEN 'imdb' WHEN 3 THEN 'title' END AS found_by
      FROM d LEFT JOIN t USING (hint_id)""",
    "clip_outcomes": f"WITH {_ANSWERS} SELECT * FROM c",
    "run_outcomes": f"""WITH {_ANSWERS}, s AS (SELECT run_id, min(clip_idx) FILTER (outcome = 'rate_limited') AS l, min(clip_idx) FILTER (outcome = 'auth_error') AS f FROM c GROUP BY 1),
      n AS (SELECT run_id, l, f, f IS NOT NULL AND (l IS NULL OR f < l) AS failed, count(*) FILTER (outcome IN ('match', 'no_match') AND (l IS NULL OR clip_idx < l)) AS a, count(*) FILTER (outcome IN ('rate_limited', 'error') OR clip_idx >= l) AS p FROM c JOIN s USING (run_id) GROUP BY ALL)
      SELECT run_id, CASE WHEN failed THEN 'failed' WHEN l IS NOT NULL THEN 'limited' WHEN p > 0 THEN 'partial' ELSE 'complete' END AS outcome, CASE WHEN failed THEN 0 ELSE a END AS answered, CASE WHEN failed THEN 0 ELSE p END AS pending, CASE WHEN NOT failed THEN l END AS limited_at, CASE WHEN failed THEN f END AS failed_at FROM n""",
    "answer_with": """SELECT user_id AS run_id, event_id AS clip_idx, 'shazam' AS provider, CASE WHEN event_type = 'click' THEN 'heard' END AS title, CASE WHEN event_id % 10 = 0 THEN 'rate_limited' WHEN event_type = 'click' THEN 'match' ELSE 'no_match' END AS outcome, NULL::DOUBLE AS score, 2::BIGINT AS prio FROM events
      UNION ALL SELECT user_id, event_id, 'other', upper(event_type), 'match', 1.5, 4 FROM events""",
    "typed_edits": """WITH s AS (SELECT o_custkey AS run_id, 'seg_' || o_orderkey AS segment_id, o_orderkey AS k, o_orderpriority AS title, o_orderstatus AS artist FROM orders),
      e AS (SELECT *, k % 97 = 0 AS lost, concat_ws(', ', CASE WHEN k % 60 < 2 THEN 'title' END, CASE WHEN k % 80 = 3 THEN 'enrichment' END) AS wrong, run_id % 11 = 1 AS twice FROM s WHERE run_id % 3 <> 0),
      r AS (SELECT run_id, CASE WHEN lost THEN 'seg_x' || k ELSE segment_id END AS segment_id, CASE WHEN lost THEN 'unknown segment' WHEN twice THEN 'repeated segment' WHEN wrong <> '' THEN wrong || ' of the wrong type' END AS reason, k FROM e),
      b AS (SELECT DISTINCT run_id FROM r WHERE reason IS NOT NULL)
      SELECT s.run_id, segment_id, CASE WHEN ok THEN CASE WHEN k % 60 <> 2 THEN 't' || k END ELSE title END AS title, CASE WHEN ok THEN CASE WHEN k % 3 = 0 THEN 'typed' END ELSE artist END AS artist, CASE WHEN NOT ok THEN 'own' END AS album,
        CASE WHEN ok THEN CASE WHEN k % 80 <> 4 THEN 'New' END ELSE 'Old' END AS composer, ok AS edited, NULL AS reason FROM (SELECT s.*, run_id % 3 <> 0 AND run_id NOT IN (SELECT run_id FROM b) AS ok FROM s) s
      UNION ALL SELECT run_id, segment_id, NULL, NULL, NULL, NULL, NULL, reason FROM r WHERE reason IS NOT NULL""",
    "resume_edited": """WITH s AS (SELECT o_custkey AS run_id, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'typed by hand' WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS title, CASE WHEN o_orderkey % 5 = 0 THEN 'me' END AS artist, o_orderstatus = 'P' OR o_orderkey % 2 = 0 AS pending FROM orders),
      d AS (SELECT *, pending AND o_orderkey % 4 <> 2 AS done, pending AND o_orderkey % 4 IN (0, 3) AND o_orderkey % 3 <> 0 AS named FROM s)
      SELECT run_id, o_orderkey, CASE WHEN named THEN 'found ' || o_orderkey ELSE title END AS title, CASE WHEN named THEN 'F' ELSE artist END AS artist, pending AND NOT done AS pending, CASE WHEN NOT done THEN o_orderkey || '.wav' END AS audio_file FROM d""",
    "refresh": """WITH c AS (SELECT o_orderkey AS k, year(o_orderdate) + 5 AS rel, CASE WHEN o_orderkey % 9 = 0 THEN 1990 + o_orderkey % 12 END AS orig, 1992 + o_orderkey % 6 AS film, o_orderkey % 3 = 0 AS credited, 1930 + o_custkey % 60 AS death, o_orderkey % 7 <> 0 AS known FROM orders)
      SELECT k AS cue_id, CASE WHEN orig IS NOT NULL THEN orig > film + 3 ELSE rel > film + 3 AND NOT (credited AND k % 2 = 0) END AS anachronistic, CASE WHEN k % 2 = 0 THEN 'la song|the bo ray band' ELSE 'la song|nobody' END AS track_key,
        CASE WHEN NOT known THEN k % 2 = 0 WHEN 2026 - death <= 70 THEN false WHEN k % 4 = 3 THEN NULL ELSE true END AS public_domain, CASE WHEN known THEN death END AS latest,
        (1990 + k % 15 > film + 3)::VARCHAR || ',' || (2005 > film + 3 AND NOT credited)::VARCHAR AS alternatives FROM c""",
    "published_results": """WITH c AS (SELECT o_custkey AS run_id, 1990 + o_custkey % 9 - CASE WHEN o_custkey % 5 = 0 THEN 20 ELSE 0 END AS film_year, o_orderkey AS k, o_orderstatus = 'P' AS p, lower(o_orderpriority) AS t, year(o_orderdate) AS rel, 1930 + o_orderkey % 60 AS death FROM orders)
      SELECT run_id, 'film ' || run_id AS source, 'tt' || run_id AS imdb_id, film_year, 'shazam+audd' AS providers, 5.0::DOUBLE AS hop, 24.0::DOUBLE AS fps, 'seg_' || k AS segment_id, CASE WHEN NOT p THEN trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')) || '|a' END AS track_key,
        rel > film_year + 3 AS anachronistic, 2026 - death > 70 AS public_domain, death AS latest, 1990 + k % 12 > film_year + 3 AS alternative_late FROM c""",
    "alternatives_any": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 200 AS run_id, o_orderpriority AS t FROM orders),
      n AS (SELECT run_id, k, 1 AS pos, 'acrcloud' AS provider, t AS title, (k % 50)::DOUBLE AS score FROM o WHERE k % 4 = 1 AND k % 3 = 0 UNION ALL SELECT run_id, k, 2, 'acrcloud', 'second', 40 FROM o WHERE k % 4 = 1 AND k % 3 = 0
        UNION ALL SELECT run_id, k, 1, 'acrcloud', 'voted', NULL FROM o WHERE k % 4 = 1 AND k % 3 <> 0 UNION ALL SELECT run_id, k, 3, 'audd', 'cand', 7 FROM o WHERE k % 8 = 1
        UNION ALL SELECT run_id, k, 1, 'own', t, (k % 50)::DOUBLE FROM o WHERE k % 4 <> 1 AND k % 3 = 0 UNION ALL SELECT run_id, k, 2, 'own', 'second', 40 FROM o WHERE k % 4 <> 1 AND k % 3 = 0
        UNION ALL SELECT run_id, k, 1, 'own', t, NULL FROM o WHERE k % 4 <> 1 AND k % 3 <> 0 AND k % 6 < 5),
      g AS (SELECT run_id, provider, title, count(*) AS windows, max(score) AS score, min({'k': k, 'pos': pos}) AS seen FROM n GROUP BY ALL)
      SELECT run_id, provider, title, windows, score, row_number() OVER (PARTITION BY run_id ORDER BY seen) AS rank FROM g""",
    "track_cues": r"""SELECT conv_id AS run_id, trim(regexp_replace(lower(role), '[^\p{L}\p{N}_]+', ' ', 'g')) || '|a' AS track_key, string_agg('seg_' || turn, ',' ORDER BY turn) AS cues FROM conversations WHERE role <> '' GROUP BY ALL""",
    "match_fields": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS title, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS link FROM orders",
    "work_by_name_forms": """WITH w AS (SELECT c_custkey AS id, c_custkey % 90 AS t, row_number() OVER (PARTITION BY c_custkey % 90 ORDER BY c_custkey) AS r FROM customer),
      q AS (SELECT o_orderkey AS cue_id, id, r, CASE o_custkey % 4 WHEN 0 THEN (id % 4 = 3)::INT + (id % 8 = 3)::INT WHEN 3 THEN (id % 4 = 1)::INT ELSE 0 END AS score FROM orders JOIN w ON t = o_custkey % 90 WHERE r <= 4)
      SELECT cue_id, first(id ORDER BY score DESC, r) AS work_id, max(score)::BIGINT AS score FROM q WHERE score > 0 GROUP BY 1""",
    "original_year_edges": """WITH e AS (SELECT c_custkey % 50 AS t, c_mktsegment AS p, 1900 + c_custkey % 80 AS y FROM customer UNION SELECT c_custkey % 50, 'n' || c_nationkey, 1880 + c_custkey % 70 FROM customer)
      SELECT o_orderkey AS cue_id, min(y) AS original_year FROM orders JOIN e ON t = o_custkey % 60 AND p IN ('BUILDING', 'n' || (o_custkey % 25)) GROUP BY 1""",
    "title_forms": """WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS t FROM part)
      SELECT p_partkey, CASE p_partkey % 8 WHEN 2 THEN t || ' feat x more' WHEN 3 THEN t || ' y' WHEN 6 THEN 'defeat ' || t WHEN 7 THEN t || ' a' ELSE t END AS title_key FROM p""",
    "to_year_int": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1950 WHEN 3 THEN p_size END::BIGINT AS year FROM part",
    "provider_priority": "SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN p_partkey % 5 + 1 ELSE 4 END AS prio FROM part",
    "class_log": f"""WITH {_SOFT}, s AS (SELECT vec_id, p[1] + p[4] + p[6] AS score FROM q), u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
      r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rk FROM u)
      SELECT vec_id AS run_id, round(any_value(score), 4) AS score, any_value(score) > 0.05 AS is_hit, max(i) FILTER (rk = 1) AS label1, max(i) FILTER (rk = 2) AS label2, max(i) FILTER (rk = 3) AS label3 FROM r JOIN s USING (vec_id) WHERE rk <= 3 GROUP BY vec_id""",
    "score_with": "SELECT vec_id, round(list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE, 5) AS score, len(embedding) AS n FROM embeddings",
}
