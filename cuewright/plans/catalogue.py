"""Adapters over the order tables, texts and pages for answers, ranking, rights, catalogue, film and saved-cue operators, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.operators import answers as A
from cuewright.operators import catalog as K
from cuewright.operators import cues as C
from cuewright.operators import edits as E
from cuewright.operators import films as M
from cuewright.operators import ranking as R
from cuewright.operators import reports as P
from cuewright.operators import rights as L
from cuewright.sources import results as S

from .signal import LINE_ORDER, lines, read

_LN = f"ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS rk FROM lineitem)"
x = F.expr


def text_of(number: str) -> Column:
    return F.col(number).cast("string")


# --- votes and candidates ---------------------------------------------------------------------------------------

def votes(spark, sf_dir) -> DataFrame:
    """An order's lines by threes, the clips of a run: three sources answer each, the part's type under three spellings, an ISRC for some."""
    ln = lines(spark, sf_dir).join(read(spark, sf_dir, "part"), x("l_partkey = p_partkey"))
    ln = ln.withColumn("clip_idx", x("(rk - 1) div 3")).withColumn("rk", x("(rk - 1) % 3 + 1"))
    return ln.select(F.col("l_orderkey").alias("run_id"), "clip_idx", "rk", x("element_at(array('acrcloud', 'shazam', 'audd'), cast(rk as int))").alias("provider"), F.col("rk").cast("int").alias("prio"),
                     x("case rk when 1 then p_type when 2 then concat(p_type, ' (Live)') else concat(p_type, ' - Remastered 2011') end").alias("title"), x("concat('Some One ', p_size)").alias("artist"),
                     x("case when l_suppkey % 3 = 0 then concat('i', l_partkey % 20) end").alias("isrc"), x("l_returnflag <> 'R'").alias("matched"), F.col("p_brand").alias("album"), x("cast(null as int)").alias("release_year"), x("2 * l_quantity").alias("score"))


def q_vote_consensus(spark, sf_dir):
    won = A.vote_consensus(votes(spark, sf_dir).withColumn("artist", F.lit("Some One")), fields=("album",))
    return won.select("run_id", "clip_idx", "title", "isrc", "album", "agreement", F.col("total").cast("long").alias("total"), F.array_join("providers", ",").alias("providers"))


def q_norm_title(spark, sf_dir):
    ln = votes(spark, sf_dir)
    return ln.select("run_id", "clip_idx", "rk", T.norm_title(F.col("title")).alias("title_key"), T.norm_artist(F.concat(F.col("artist"), F.lit(" & Friends feat. "), F.col("album"))).alias("artist_key"))


def q_alternatives(spark, sf_dir):
    v = votes(spark, sf_dir)
    none = x("cast(array() as array<struct<title:string,artist:string,isrc:string,album:string,release_year:int,score:double>>)")
    vote = F.struct("rk", "provider", "title", "artist", "isrc", "album", "release_year", "score", "matched", none.alias("candidates"))
    # sixteen order keys to a run: as many more runs as there are orders
    answers = v.groupBy(x("run_id div 16").alias("run"), x("run_id % 16 * 1000 + clip_idx").alias("clip_idx")).agg(F.array_sort(F.collect_list(vote)).alias("votes"))
    songs = C.named_songs(answers.select(F.col("run").alias("run_id"), F.lit("all").alias("segment_id"), "clip_idx", "votes"))
    return C.alternatives(songs).select("run_id", "provider", "title", "artist", "isrc", "album", "windows", "score", F.col("rank").cast("long").alias("rank"))


def candidates(spark, sf_dir) -> DataFrame:
    song = F.struct("rk", x("concat('song ', l_partkey)").alias("title"), F.year("l_shipdate").alias("release_year"), x("2 * l_quantity").alias("score"))
    per = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(song)).alias("candidates"))
    return per.select(F.col("l_orderkey").alias("run_id"), "candidates", F.get("candidates", F.lit(0))["title"].alias("title"), F.get("candidates", F.lit(0))["release_year"].alias("release_year"), (1992 + F.col("l_orderkey") % 4).cast("int").alias("film_year"))


def q_date_rerank(spark, sf_dir):
    return R.date_rerank(candidates(spark, sf_dir)).select("run_id", "title", F.col("release_year").cast("long").alias("release_year"), "temporal_pick")


def q_anachronistic(spark, sf_dir):
    first = lines(spark, sf_dir).filter("rk = 1")
    cues = first.select(F.col("l_orderkey").alias("run_id"), F.year("l_shipdate").alias("release_year"), x("case when l_suppkey % 5 = 0 then 1990 + l_partkey % 12 end").alias("original_year"), x("case when l_suppkey % 4 = 0 then 1993 + l_partkey % 8 end").alias("composer_death_year"),
                        x("case when l_suppkey % 2 = 0 then 'The Bo Ray Band' else 'Nobody' end").alias("artist"), F.lit(None).cast("string").alias("composer"))
    films = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (1992 + F.col("o_orderkey") % 4).alias("film_year"), x("case when o_orderkey % 6 = 0 then 'Ann Lee and Bo Ray' end").alias("music_composer"))
    return R.anachronistic(R.with_film(cues, films)).select("run_id", "anachronistic")


# --- rights and catalogue ---------------------------------------------------------------------------------------

def authors(spark, sf_dir) -> DataFrame:
    birth = x("cast(1750 + l_partkey % 200 as int)")
    entry = F.struct("rk", birth.alias("birth_year"), F.when(x("l_suppkey % 4 <> 0"), birth + 40 + 5 * F.col("l_linenumber")).alias("death_year"))
    return lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("authors"), F.max(x("rk = 1 and l_linestatus = 'F'")).alias("partial"))


def q_rights_verdict(spark, sf_dir):
    v = L.rights_verdict(authors(spark, sf_dir), "authors", "partial", 2026)
    return v.select(F.col("l_orderkey").alias("run_id"), F.col("latest_author_death_year").cast("long").alias("latest"), "authors_complete", "public_domain", "pd_presumption")


def q_rights_label(spark, sf_dir):
    v = L.rights_verdict(authors(spark, sf_dir), "authors", "partial", 2026).withColumn("has_authors", F.size("authors") > 0)
    return L.rights_label(v).select(F.col("l_orderkey").alias("run_id"), "label", F.col("free_from_year").cast("long").alias("free_from_year"), "reason")


def q_work_authors(spark, sf_dir):
    rel = lines(spark, sf_dir).select(F.col("l_orderkey").alias("work_id"), F.col("rk").alias("rank"), x("element_at(array('composer', 'lyricist', 'writer', 'publisher'), cast(l_linenumber % 4 as int) + 1)").alias("role"), x("concat('s', l_suppkey)").alias("artist_id"), x("concat('Name ', l_suppkey)").alias("name"))
    sup = read(spark, sf_dir, "supplier")
    artists = sup.select(x("concat('s', s_suppkey)").alias("artist_id"), x("case s_nationkey % 3 when 0 then 'Person' when 1 then 'Group' end").alias("type"), x("concat(1700 + s_nationkey * 5, '-01-01')").alias("begin"), x("case when s_suppkey % 2 = 1 then concat(1760 + s_nationkey * 5, '-12-01') end").alias("end"), x("concat('http://example.org/entity/Q', s_suppkey)").alias("wikidata_url"))
    lives = sup.select(x("concat('s', s_suppkey)").alias("artist_id"), F.lit("1800").alias("birth"), F.lit("1870-02-03").alias("death"))
    said = lambda a: F.concat_ws("/", a["name"], F.array_join(a["roles"], "+"), F.coalesce(a["birth_year"].cast("string"), F.lit("-")), F.coalesce(a["death_year"].cast("string"), F.lit("-")), F.regexp_extract(a["wikidata_url"], "Q.*", 0))
    return K.work_authors(rel, artists, lives).select("work_id", F.array_join(F.transform("authors", said), "; ").alias("authors"))


def q_author_chain(spark, sf_dir):
    cues = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cue_id"), x("concat('c', o_custkey)").alias("isrc"))
    cust = read(spark, sf_dir, "customer")
    recordings = cust.select(x("concat('c', c_custkey)").alias("isrc"), x("explode(array(2, 1))").alias("rank"), "c_custkey").select("isrc", "rank", x("concat('r', c_custkey, '-', rank)").alias("recording_id"))
    works = cust.filter("c_custkey % 3 <> 0").select(x("concat('r', c_custkey, '-1')").alias("recording_id"), F.lit("performance").alias("rel_type"), F.lit(1).alias("rank"), x("c_custkey div 60").alias("work_id"))
    suppliers = read(spark, sf_dir, "supplier").select(x("s_suppkey div 4").alias("work_id"), F.col("s_suppkey").alias("rank"), F.lit("composer").alias("role"), F.lit(None).cast("string").alias("artist_id"), F.col("s_name").alias("name"))
    chain = K.author_chain(cues, recordings, works, K.work_authors(suppliers))
    return chain.select("cue_id", "recording_id", F.col("work_id").cast("long").alias("work_id"), F.coalesce(F.size("authors"), F.lit(-1)).cast("long").alias("n_authors"))


def q_work_by_title(spark, sf_dir):
    cust = read(spark, sf_dir, "customer")
    works = cust.select(F.col("c_custkey").alias("work_id"), x("concat('Work ', c_custkey % 50)").alias("title"), F.col("c_custkey").alias("rank"))
    names = cust.select(F.col("c_custkey").alias("work_id"), F.array(F.struct(x("concat(c_mktsegment, ' n', c_nationkey)").alias("name"))).alias("authors"))
    cues = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cue_id"), x("concat('Work ', o_custkey % 50)").alias("title"), x("element_at(array('Building', 'Machinery n4', 'Zed N7'), cast(o_custkey % 3 as int) + 1)").alias("artist"))
    return K.work_by_title(cues, works, names).select("cue_id", "work_id", F.col("score").cast("long").alias("score"))


def q_author_fallback(spark, sf_dir):
    composers = read(spark, sf_dir, "customer").select(x("concat('Work ', c_custkey % 500)").alias("title"), F.col("c_name").alias("composer"), F.col("c_custkey").alias("rank"), F.lit(1800).alias("birth_year"), F.lit(1870).alias("death_year"))
    cues = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cue_id"), x("concat('Work ', o_custkey % 600)").alias("title"))
    return K.author_fallback(cues, composers).select("cue_id", "composer", "authors_partial")


def q_original_year(spark, sf_dir):
    cust = read(spark, sf_dir, "customer")
    dates = cust.select(x("concat('Work ', c_custkey % 50)").alias("title"), F.col("c_mktsegment").alias("person"), x("case when c_custkey % 3 <> 0 then concat(1900 + c_custkey % 80, '-05-01') end").alias("published"), x("concat('c. ', 1890 + c_custkey % 90)").alias("inception"))
    cues = read(spark, sf_dir, "orders").join(cust, x("o_custkey = c_custkey")).select(F.col("o_orderkey").alias("cue_id"), x("concat('Work ', o_custkey % 60)").alias("title"), F.array("c_mktsegment", F.lit("BUILDING"), F.lit("")).alias("names"))
    return K.original_year(cues, dates).select("cue_id", F.col("original_year").cast("long").alias("original_year"))


def q_enrich_once(spark, sf_dir):
    cues = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("run_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("track_key"), x("case when o_orderkey % 3 <> 0 then concat('i', o_orderkey) end").alias("isrc"))
    return K.enrich_once(cues, lambda first: first.select("run_id", "track_key", F.col("seq").alias("asked_by"))).select("run_id", "seq", "asked_by")


# --- films ------------------------------------------------------------------------------------------------------

def q_film_candidates(spark, sf_dir):
    film = lambda t, key, kind: read(spark, sf_dir, t).select(F.lit(kind).alias("media_type"), F.col(key).alias("id"), F.concat(F.lit("tt"), text_of(key)).alias("imdb_id"), F.concat(F.lit("T"), (F.col(key) / 3).cast("long").cast("string")).alias("title"), (1990 + F.col(key) % 10).alias("year"), F.col(key).alias("rank"))
    films = film("supplier", "s_suppkey", "movie").unionByName(film("customer", "c_custkey", "tv"))
    hints = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hint_id"), x("case when o_orderkey % 4 = 0 then o_custkey end").alias("tmdb_id"), x("case when o_orderkey % 4 = 1 then concat('tt', o_custkey) end").alias("imdb_id"), x("concat('T', o_custkey div 3)").alias("title"), x("case when o_orderkey % 2 = 0 then 1990 + o_orderkey % 10 end").alias("year"))
    return M.film_candidates(hints, films)


def q_film_merge(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("film_id"), "c_name", "c_nationkey", "c_mktsegment")
    a = c.filter("film_id % 2 = 0").select("film_id", F.col("c_name").alias("title"), x("cast(null as int)").alias("year"), F.lit("").alias("director"))
    b = c.filter("film_id % 3 <> 0").select("film_id", F.lit("second").alias("title"), x("1900 + c_nationkey").alias("year"), x("case when film_id % 5 = 0 then c_mktsegment end").alias("director"))
    d = c.select("film_id", F.lit("third").alias("title"), F.lit(1950).alias("year"), F.lit("someone").alias("director"))
    merged = M.film_merge(c.select("film_id"), [a, b, d], ["title", "year", "director"])
    return merged.select("film_id", "title", F.col("year").cast("long").alias("year"), "director", F.concat_ws(",", F.transform("sources", lambda s: s.cast("string"))).alias("sources"))


def q_crew_rank(spark, sf_dir):
    crew = lines(spark, sf_dir).join(read(spark, sf_dir, "supplier"), x("l_suppkey = s_suppkey")).select(F.col("l_orderkey").alias("film_id"), F.col("rk").alias("rank"), F.col("s_name").alias("name"), x("case l_returnflag when 'A' then 'Director' when 'N' then 'Original Music Composer' else 'Writer' end").alias("job"), F.col("l_quantity").cast("long").alias("episode_count"))
    return M.film_credits(crew).join(M.crew_rank(crew, "Original Music Composer").withColumnRenamed("names", "ranked"), "film_id", "left")


def q_film_hint(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    tags = F.create_map(F.lit("TITLE"), F.col("c_name"), F.lit("day"), x("concat('released ', 1950 + c_nationkey)"), F.lit("director"), x("case when c_custkey % 2 = 0 then concat('{', c_mktsegment, '}') else c_mktsegment end"), F.lit("IMDB"), x("case when c_custkey % 3 = 0 then 'nm1' else concat('tt', c_custkey) end"), F.lit("tmdb"), x("case when c_custkey % 4 = 0 then 'x' else cast(c_custkey as string) end"))
    return c.select("c_custkey", M.film_hint_from_tags(tags).alias("h")).select("c_custkey", "h.title", F.col("h.year").cast("long").alias("year"), "h.director", "h.imdb_id", "h.tmdb_id")


# --- texts, links and JSON ----------------------------------------------------------------------------------------

def q_track_key(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.track_key(F.col("text"), F.col("source")).alias("track_key"))


def q_norm_name(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.norm_name(F.col("text")).alias("name"))


def q_parse_year(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.parse_year(F.col("text")).cast("long").alias("year"))


def q_clean_url(spark, sf_dir):
    url = x("case page_id % 3 when 0 then url when 1 then concat('https://music.apple.com/us/album/x/', page_id, '?uo=4&i=', page_id, '#top') else concat('ftp://host/', page_id) end")
    return read(spark, sf_dir, "pages").select("page_id", T.clean_url(url).alias("url"))


def q_tracks_report(spark, sf_dir):
    cues = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.col("role").alias("title"), F.lit("A. Nyone").alias("artist"), (F.length("text") % 4).alias("agreement_count"), (F.length("text") % 3 == 0).alias("anachronistic"), F.length("text").cast("long").alias("duration_n"))
    return P.tracks_report(cues).drop("artist")


def q_answer_outcome(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    acr = F.format_string('{"status":{"code":%d},"metadata":{"music":[%s]}}', F.element_at(F.array(*map(F.lit, (0, 3001, 3003, 2000, 0))), k % 5 + 1), F.when(F.col("value") > 100, '{"title":"a"}').otherwise(""))
    audd = F.when(k % 4 == 0, '{"status":"success","result":{"title":"a"}}').when(k % 4 == 1, '{"status":"error","error":{"error_code":900}}').when(k % 4 == 2, "<html>").otherwise('{"status":"error","error":{"error_code":300}}')
    shazam = F.when(F.col("value") > 100, '{"title":"a"}').otherwise("{}")
    provider = F.element_at(F.array(F.lit("acrcloud"), F.lit("audd"), F.lit("shazam")), (F.col("event_id") % 3 + 1).cast("int"))
    raw = read(spark, sf_dir, "events").select("event_id", provider.alias("provider"), F.when(k % 7 != 0, F.when(k % 11 == 0, 429).otherwise(200)).alias("http_status"), F.when(provider == "acrcloud", acr).when(provider == "audd", audd).otherwise(shazam).alias("payload"))
    return A.classify_outcome(raw).select("event_id", "outcome")


def q_ranked_answers(spark, sf_dir):
    song = F.struct("rk", x("concat('song ', l_partkey)").alias("title"), x("array(named_struct('name', 'Ann'), named_struct('name', cast(l_suppkey as string)))").alias("artists"), F.struct(x("concat('album ', l_linenumber)").alias("name")).alias("album"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("release_date"), x("2 * l_quantity").alias("score"), F.struct(x("concat(' i', l_partkey % 20)").alias("isrc")).alias("external_ids"))
    per = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(song)).alias("music"))
    raw = per.select(F.col("l_orderkey").alias("run_id"), F.to_json(F.struct(F.struct(F.lit(0).alias("code")).alias("status"), F.struct("music").alias("metadata"))).alias("payload"))
    got = A.normalize_ranked_answers(raw, floor=20.0)
    return got.select("run_id", F.size("candidates").cast("long").alias("n"), "title", "artist", "album", F.col("release_year").cast("long").alias("release_year"), "isrc", "score")


def q_single_answers(spark, sf_dir):
    result = F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), x("concat(1950 + p_size, '-01-02')").alias("release_date"), F.struct(x("case when p_partkey % 3 = 0 then 'ap1' end").alias("isrc")).alias("apple_music"), F.struct(F.struct(x("case when p_partkey % 3 = 1 then 'sp1' end").alias("isrc")).alias("external_ids")).alias("spotify"), x("array(named_struct('id', concat('m', p_partkey), 'isrcs', array('mb1', 'mb2')))").alias("musicbrainz"))
    raw = read(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.lit("success").alias("status"), result.alias("result"))).alias("payload"))
    return A.normalize_single_answers(raw).select("p_partkey", "title", "artist", F.col("release_year").cast("long").alias("release_year"), "isrc", "musicbrainz_recording_id")


def q_track_answers(spark, sf_dir):
    sections = x("array(named_struct('type', 'SONG', 'metadata', array(named_struct('title', 'Album', 'text', p_type), named_struct('title', ' Released', 'text', cast(1950 + p_size as string))), 'youtubeurl', null), named_struct('type', 'VIDEO', 'metadata', null, 'youtubeurl', concat('v', p_partkey)))")
    nested = F.to_json(F.struct(F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("subtitle"), F.lit("us1").alias("isrc"), sections.alias("sections")).alias("track")))
    flat = F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.lit("de9").alias("isrc")))
    raw = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, nested).otherwise(flat).alias("payload"))
    return A.normalize_track_answers(raw).select("p_partkey", "title", "artist", "album", F.col("release_year").cast("long").alias("release_year"), "isrc", "youtube_link")


# --- saved cues ---------------------------------------------------------------------------------------------------

def saved(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), x("concat('seg_', o_orderkey)").alias("segment_id"), "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("artist"), F.lit(None).cast("string").alias("album"), (F.col("o_orderstatus") == "P").alias("pending"))


def q_apply_edits(spark, sf_dir):
    s = saved(spark, sf_dir)
    listed = s.filter("run_id % 3 = 0 and o_orderkey % 5 <> 0").select("run_id", "segment_id", x("concat('new ', o_orderkey)").alias("title"), "artist", F.lit("edited").alias("album"))
    wrong = s.filter("run_id % 21 = 0").select("run_id", F.lit("seg_none").alias("segment_id"), F.lit("x").alias("title"), "artist", "album").distinct()
    return E.apply_edits(s, listed.unionByName(wrong))[0].drop("pending")


def q_resume_merge(spark, sf_dir):
    s = saved(spark, sf_dir)
    changes = s.select("run_id", "segment_id", x("element_at(array('answered', 'gone', 'failed'), cast(o_orderkey % 3 as int) + 1)").alias("outcome"), x("concat('found ', o_orderkey)").alias("title"), F.lit("F").alias("artist"))
    return E.resume_merge(s, changes).drop("album", "segment_id")


def q_choose_song(spark, sf_dir):
    s = saved(spark, sf_dir).drop("album", "pending").withColumn("alternatives", x("array(named_struct('title', 'first', 'artist', 'a'), named_struct('title', 'second', 'artist', cast(null as string)))"))
    choices = s.select("run_id", "segment_id", x("case when o_orderkey % 4 < 3 then cast(o_orderkey % 4 as int) end").alias("idx"), x("case when o_orderkey % 8 = 3 then ' typed ' else ' ' end").alias("typed_title"), F.lit("me").alias("typed_artist"))
    return E.choose_song(s, choices)[0].select("o_orderkey", "title", "artist", F.coalesce("temporal_pick", F.lit(True)).alias("untouched"))


def q_migrate_results(spark, sf_dir):
    song = "named_struct('title', {}, 'score', o_orderkey % 7)".format
    cue = F.struct(x("concat('seg_', o_orderkey)").alias("segment_id"), x("case when o_orderstatus <> 'P' then o_orderpriority end").alias("title"), x("case o_orderkey % 9 when 0 then 'vocals_removed' when 1 then 'none' end").alias("conditioning"), F.lit("acrcloud").alias("provider"),
                   x(f"case when o_orderkey % 2 = 0 then array({song('o_orderpriority')}, {song(repr('other'))}, named_struct('title', 'other', 'score', 9)) end").alias("candidates"),
                   x("case when o_orderkey % 3 = 0 then array(named_struct('provider', 'acrcloud', 'matched', true, 'title', 'voted'), named_struct('provider', 'audd', 'matched', o_orderkey % 5 = 0, 'title', 'heard')) end").alias("votes"),
                   x("case when o_orderkey % 4 = 0 then array(named_struct('title', 'saved', 'windows', 3)) end").alias("alternatives"))
    doc = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.collect_list(cue).alias("cues"))
    text = F.to_json(F.struct((1 + F.col("run_id") % 6).alias("version"), (F.col("run_id") % 4 < 2).alias("rate_limited"), "cues"))
    parsed = doc.select("run_id", F.from_json(text, S.RESULTS).alias("d")).select("run_id", "d.*")
    told = S.migrate_results(parsed).select("run_id", F.col("settings.isolation").alias("isolation"), F.explode("cues").alias("c"))
    said = F.array_join(F.transform("c.alternatives", lambda a: F.concat_ws("/", a["provider"], a["title"], a["windows"].cast("string"))), ",")
    return told.select("run_id", "isolation", F.col("c.segment_id").alias("segment_id"), F.col("c.pending").alias("pending"), said.alias("alternatives"))


def q_run_summary(spark, sf_dir):
    runs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("created_at"))
    return P.run_summary(saved(spark, sf_dir), runs)


def q_export_flat(spark, sf_dir):
    nested = saved(spark, sf_dir).select("run_id", "segment_id", F.struct("title", "artist").alias("song"), F.array("artist", "title").alias("names"))
    return S.flat_columns(nested)


def timed(spark, sf_dir) -> DataFrame:
    return saved(spark, sf_dir).select("run_id", (F.col("o_orderkey") * 1_100_500).alias("start_n"), (F.col("o_orderkey") % 50 * 1_000_000 + 250_000).alias("duration_n"), "title", "artist", "o_orderkey")


def q_annotation_series(spark, sf_dir):
    return S.annotation_series(timed(spark, sf_dir))


def q_display_year(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", T.display_year(x("case when o_orderkey % 3 = 0 then 1900 + o_orderkey % 99 end"), x("case when o_orderkey % 4 <> 0 then year(o_orderdate) end")).alias("y"))
    return o.select("o_orderkey", F.col("y.year").cast("long").alias("year"), F.col("y.is_hint").alias("is_hint"))


def q_duration_text(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", T.duration_text((F.col("o_orderkey") % 400_000).cast("double") / 4).alias("said"))


def q_film_hint_clean(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    raw = c.select("c_custkey", x("case c_custkey % 3 when 0 then ' ' else concat(' ', c_name, ' ') end").alias("title"), x("case when c_custkey % 4 = 0 then 'soon' else concat(' ', 1900 + c_nationkey) end").alias("year"), x("case when c_custkey % 5 = 0 then 'x1' else cast(c_custkey as string) end").alias("tmdb_id"), x("case when c_custkey % 2 = 0 then '' else concat('tt', c_custkey) end").alias("imdb_id"), x("element_at(array('TV ', 'movie', 'radio'), cast(c_custkey % 3 as int) + 1)").alias("media_type"))
    return M.film_hint_clean(raw).withColumn("year", F.col("year").cast("long"))


def q_pending_cues(spark, sf_dir):
    cues = saved(spark, sf_dir).withColumn("audio_file", x("case when o_orderkey % 3 <> 0 then concat(segment_id, '.wav') end"))
    return C.pending_cues(cues).select("run_id", "segment_id", "audio_file")


def q_hide_anachronistic(spark, sf_dir):
    shown, hidden = R.hide_anachronistic(timed(spark, sf_dir).select("run_id", "o_orderkey", x("o_orderkey % 7 = 0").alias("anachronistic")), count=True)
    return shown.groupBy("run_id").agg(F.count(F.lit(1)).alias("shown")).join(hidden, "run_id", "full").select("run_id", F.coalesce("shown", F.lit(0)).alias("shown"), F.coalesce("hidden", F.lit(0)).alias("hidden"))


def q_replace_composer(spark, sf_dir):
    author = lambda name, role: f"named_struct('name', {name}, 'roles', array({role!r}), 'birth_year', 1800, 'death_year', 1860)"
    cues = read(spark, sf_dir, "orders").select("o_orderkey", x(f"array({author('o_orderpriority', 'composer')}, {author('o_orderstatus', 'lyricist')})").alias("authors"), F.col("o_orderpriority").alias("composer"), F.lit(1800).alias("composer_birth_year"), F.lit(1860).alias("composer_death_year"), F.lit(False).alias("authors_partial"),
                                                x("case o_orderkey % 4 when 0 then 'New Name' when 1 then '' when 2 then o_orderpriority end").alias("new_composer"))
    said = F.array_join(F.transform("authors", lambda a: F.concat_ws(":", a["name"], F.coalesce(a["birth_year"].cast("string"), F.lit("-")))), ",")
    return E.replace_composer(cues).select("o_orderkey", "composer", F.col("composer_death_year").cast("long").alias("composer_death_year"), "authors_partial", said.alias("authors"))


def q_assemble_authors(spark, sf_dir):
    author = lambda name, role: f"array(named_struct('name', concat({name!r}, o_custkey), 'roles', array({role!r}), 'birth_year', 1800, 'death_year', 1860))"
    chain = read(spark, sf_dir, "orders").select("o_orderkey", *(x(f"case when o_orderkey % {m} = 0 then {author(n, r)} end").alias(c) for c, m, n, r in (("isrc_authors", 4, "i", "lyricist"), ("work_authors", 3, "w", "composer"), ("search_authors", 2, "s", "composer"))), x("case when o_orderkey % 5 = 0 then 1900 end").alias("original_year"))
    return K.assemble_authors(chain).select("o_orderkey", "composer_match", "composer", F.array_join("sources", ",").alias("sources"))


def q_union_answers(spark, sf_dir):
    v = votes(spark, sf_dir).select("run_id", "clip_idx", "provider", "title", "album", "score")
    every = A.union_answers(v.filter("provider = 'acrcloud'").drop("album"), v.filter("provider = 'shazam'").drop("score"), v.filter("provider = 'audd'"))
    return every.select("run_id", "clip_idx", "provider", "title", "album", "score")


def q_frame_segments(spark, sf_dir):
    videos = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.lit(24.0).alias("fps"))
    return S.frame_segments(timed(spark, sf_dir), videos)


QUERIES = {k[2:]: f for k, f in list(globals().items()) if k.startswith("q_")}

_VOTES = f"""{_LN}, v AS (SELECT l_orderkey AS run_id, (rk - 1) // 3 AS clip_idx, (rk - 1) % 3 + 1 AS rk, CASE (rk - 1) % 3 WHEN 0 THEN 'acrcloud' WHEN 1 THEN 'shazam' ELSE 'audd' END AS provider, p_type, 'Some One ' || p_size AS artist,
  CASE (rk - 1) % 3 + 1 WHEN 1 THEN p_type WHEN 2 THEN p_type || ' (Live)' ELSE p_type || ' - Remastered 2011' END AS title, CASE WHEN l_suppkey % 3 = 0 THEN 'i' || (l_partkey % 20) END AS isrc, l_returnflag <> 'R' AS matched, p_brand AS album, 2 * l_quantity AS score
  FROM ln JOIN part ON l_partkey = p_partkey)"""
_SAVED = "s AS (SELECT o_custkey AS run_id, 'seg_' || o_orderkey AS segment_id, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS title, o_orderstatus AS artist, o_orderstatus = 'P' AS pending FROM orders)"
_AUTH = f"""{_LN}, a AS (SELECT l_orderkey, 1750 + l_partkey % 200 AS birth, CASE WHEN l_suppkey % 4 <> 0 THEN 1750 + l_partkey % 200 + 40 + 5 * l_linenumber END AS death, rk = 1 AND l_linestatus = 'F' AS pf FROM ln),
  g AS (SELECT l_orderkey AS run_id, max(death) AS latest, count(death) = count(*) AS authors_complete, bool_or(pf) AS part, count(*) - count(death) AS unk, max(birth) FILTER (death IS NULL) AS young FROM a GROUP BY 1),
  r AS (SELECT *, CASE WHEN 2026 - latest <= 70 THEN false WHEN part OR NOT authors_complete OR latest IS NULL THEN NULL ELSE true END AS public_domain,
        CASE WHEN part OR unk = 0 OR coalesce(2026 - latest <= 70, false) THEN NULL ELSE 2026 - young > 170 END AS pd_presumption FROM g)"""

SQL = {
    "vote_consensus": f"""WITH {_VOTES}, m AS (SELECT *, row_number() OVER (PARTITION BY run_id, clip_idx ORDER BY rk) AS i FROM v WHERE matched),
      w AS (SELECT run_id, clip_idx, {', '.join(f"max({c}) FILTER (i = {i}) AS {c}{i}" for c in ('p_type', 'title', 'isrc', 'album', 'provider') for i in (1, 2, 3))}, count(*) AS n FROM m GROUP BY ALL),
      s AS (SELECT *, coalesce(p_type1 = p_type2, false) OR coalesce(isrc1 = isrc2, false) AS s12, coalesce(p_type1 = p_type3, false) OR coalesce(isrc1 = isrc3, false) AS s13, coalesce(p_type2 = p_type3, false) OR coalesce(isrc2 = isrc3, false) AS s23 FROM w),
      k AS (SELECT *, CASE WHEN n < 2 THEN 0 WHEN s12 THEN 1 ELSE 2 END AS c2, CASE WHEN n < 3 THEN 0 WHEN s13 OR (s12 AND s23) THEN 1 WHEN NOT s12 AND s23 THEN 2 ELSE 3 END AS c3 FROM s),
      z AS (SELECT *, 1 + (c2 = 1)::INT + (c3 = 1)::INT AS n1, (c2 = 2)::INT + (c3 = 2)::INT AS n2, (c3 = 3)::INT AS n3 FROM k),
      f AS (SELECT *, CASE WHEN n1 >= n2 AND n1 >= n3 THEN 1 WHEN n2 >= n3 THEN 2 ELSE 3 END AS win FROM z),
      o AS (SELECT run_id, clip_idx, CASE win WHEN 1 THEN title1 WHEN 2 THEN title2 ELSE title3 END AS title, CASE win WHEN 1 THEN album1 WHEN 2 THEN album2 ELSE album3 END AS album, greatest(n1, n2, n3)::BIGINT AS agreement,
        coalesce(CASE WHEN win = 1 THEN isrc1 END, CASE WHEN c2 = win THEN isrc2 END, CASE WHEN c3 = win THEN isrc3 END) AS isrc,
        concat_ws(',', CASE WHEN win = 1 THEN provider1 END, CASE WHEN c2 = win THEN provider2 END, CASE WHEN c3 = win THEN provider3 END) AS providers FROM f)
      SELECT t.run_id, t.clip_idx, title, isrc, album, coalesce(agreement, 0) AS agreement, t.total, coalesce(providers, '') AS providers FROM (SELECT run_id, clip_idx, count(*) AS total FROM v GROUP BY ALL) t LEFT JOIN o USING (run_id, clip_idx)""",
    "norm_title": f"WITH {_VOTES} SELECT run_id, clip_idx, rk, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS title_key, lower(artist) AS artist_key FROM v",
    "alternatives": f"""WITH {_VOTES}, s AS (SELECT run_id // 16 AS run, run_id % 16 * 1000 + clip_idx AS clip, row_number() OVER (PARTITION BY run_id, clip_idx ORDER BY rk) AS pos, * EXCLUDE (run_id) FROM v WHERE matched),
      p AS (SELECT run, clip, provider, title, artist, isrc, album, min(pos) AS pos, first(score ORDER BY pos) AS score FROM s GROUP BY ALL),
      g AS (SELECT run, provider, title, artist, isrc, album, count(*) AS windows, max(score) AS score, min({{'c': clip, 'p': pos}}) AS seen FROM p GROUP BY ALL)
      SELECT run AS run_id, provider, title, artist, isrc, album, windows, score, row_number() OVER (PARTITION BY run ORDER BY seen) AS rank FROM g""",
    "date_rerank": f"""WITH {_LN}, c AS (SELECT l_orderkey AS run_id, rk, 'song ' || l_partkey AS title, year(l_shipdate) AS y, 2 * l_quantity AS score, 1992 + l_orderkey % 4 AS fy FROM ln),
      b AS (SELECT run_id, first(title ORDER BY score DESC, rk) AS bt, first(y ORDER BY score DESC, rk) AS b_y FROM c WHERE rk >= 2 AND y <= fy + 3 AND score >= 40 GROUP BY 1),
      f AS (SELECT c.*, bt, b_y, coalesce(y > fy + 3 AND bt IS NOT NULL, false) AS pick FROM c LEFT JOIN b USING (run_id) WHERE rk = 1)
      SELECT run_id, CASE WHEN pick THEN bt ELSE title END AS title, CASE WHEN pick THEN b_y ELSE y END AS release_year, pick AS temporal_pick FROM f""",
    "anachronistic": f"""WITH {_LN}, c AS (SELECT l_orderkey AS run_id, year(l_shipdate) AS y, CASE WHEN l_suppkey % 5 = 0 THEN 1990 + l_partkey % 12 END AS oy, CASE WHEN l_suppkey % 4 = 0 THEN 1993 + l_partkey % 8 END AS dy, l_suppkey % 2 = 0 AND l_orderkey % 6 = 0 AS own, 1992 + l_orderkey % 4 AS fy FROM ln WHERE rk = 1)
      SELECT run_id, CASE WHEN o_orderkey IS NULL THEN false WHEN oy IS NOT NULL THEN oy > fy + 3 ELSE y > fy + 3 AND coalesce(dy > fy, true) AND NOT own END AS anachronistic FROM c LEFT JOIN orders ON o_orderkey = run_id""",
    "rights_verdict": f"WITH {_AUTH} SELECT run_id, latest, authors_complete, public_domain, pd_presumption FROM r",
    "rights_label": f"""WITH {_AUTH} SELECT run_id, CASE WHEN public_domain THEN 'Public domain' WHEN NOT public_domain THEN 'Protected' ELSE 'Unverified' END AS label, latest + 71 AS free_from_year,
      CASE WHEN public_domain THEN 'all_dead_long_enough' WHEN NOT public_domain THEN 'died_within_term' WHEN pd_presumption THEN 'presumed_free' WHEN NOT pd_presumption THEN 'too_young_to_presume' ELSE 'dates_missing' END AS reason FROM r""",
    "work_authors": f"""WITH {_LN}, r AS (SELECT l_orderkey AS work_id, rk, CASE l_linenumber % 4 WHEN 0 THEN 'composer' WHEN 1 THEN 'lyricist' WHEN 2 THEN 'writer' ELSE 'publisher' END AS role, l_suppkey FROM ln),
      d AS (SELECT work_id, l_suppkey, role, min(rk) AS rk FROM r WHERE role <> 'publisher' GROUP BY ALL), f AS (SELECT work_id, l_suppkey, string_agg(role, '+' ORDER BY rk) AS roles, min(rk) AS rk FROM d GROUP BY ALL),
      l AS (SELECT f.*, CASE s_nationkey % 3 WHEN 0 THEN (1700 + s_nationkey * 5)::VARCHAR WHEN 2 THEN '1800' ELSE '-' END AS b, CASE s_nationkey % 3 WHEN 0 THEN CASE WHEN s_suppkey % 2 = 1 THEN (1760 + s_nationkey * 5)::VARCHAR ELSE '1870' END WHEN 2 THEN '1870' ELSE '-' END AS e FROM f JOIN supplier ON s_suppkey = l_suppkey)
      SELECT work_id, string_agg('Name ' || l_suppkey || '/' || roles || '/' || b || '/' || e || '/Q' || l_suppkey, '; ' ORDER BY rk) AS authors FROM l GROUP BY 1""",
    "author_chain": """WITH n AS (SELECT s_suppkey // 4 AS work, count(DISTINCT lower(s_name)) AS k FROM supplier GROUP BY 1)
      SELECT o_orderkey AS cue_id, CASE WHEN c_custkey IS NOT NULL THEN 'r' || c_custkey || '-1' END AS recording_id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey // 60 END::BIGINT AS work_id, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN k END, -1) AS n_authors
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN n ON work = c_custkey // 60""",
    "work_by_title": """WITH w AS (SELECT c_custkey, c_custkey % 50 AS t, lower(c_mktsegment) AS seg, 'n' || c_nationkey AS nat, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_custkey) AS r FROM customer),
      q AS (SELECT o_orderkey AS cue_id, c_custkey, r FROM orders JOIN w ON t = o_custkey % 50 WHERE r <= 4 AND CASE o_custkey % 3 WHEN 0 THEN seg = 'building' WHEN 1 THEN seg = 'machinery' OR nat = 'n4' ELSE nat = 'n7' END)
      SELECT cue_id, first(c_custkey ORDER BY r) AS work_id, 1::BIGINT AS score FROM q GROUP BY 1""",
    "author_fallback": """WITH c AS (SELECT c_custkey % 500 AS t, first(c_name ORDER BY c_custkey) AS composer FROM customer GROUP BY 1)
      SELECT o_orderkey AS cue_id, composer, composer IS NOT NULL AS authors_partial FROM orders LEFT JOIN c ON t = o_custkey % 600""",
    "original_year": """WITH d AS (SELECT c_custkey % 50 AS t, c_mktsegment AS p, CASE WHEN c_custkey % 3 <> 0 THEN 1900 + c_custkey % 80 ELSE 1890 + c_custkey % 90 END AS y FROM customer), m AS (SELECT t, p, min(y) AS y FROM d GROUP BY ALL)
      SELECT o_orderkey AS cue_id, min(y) AS original_year FROM orders JOIN customer ON o_custkey = c_custkey JOIN m ON t = o_custkey % 60 AND p IN (c_mktsegment, 'BUILDING') GROUP BY 1""",
    "enrich_once": """WITH f AS (SELECT o_custkey % 100 AS run_id, o_orderpriority AS k, min(o_orderkey) AS asked_by FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL)
      SELECT o_custkey % 100 AS run_id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 <> 0 THEN asked_by END AS asked_by FROM orders LEFT JOIN f ON run_id = o_custkey % 100 AND k = o_orderpriority""",
    "film_candidates": """WITH f AS (SELECT 'movie' AS media_type, s_suppkey AS id FROM supplier UNION ALL SELECT 'tv', c_custkey FROM customer), g AS (SELECT *, 'T' || (id // 3) AS title, 1990 + id % 10 AS year, CASE media_type WHEN 'movie' THEN 0 ELSE 1 END AS turn FROM f),
      h AS (SELECT o_orderkey AS hint_id, CASE WHEN o_orderkey % 4 IN (0, 1) THEN o_custkey END AS known, 'T' || (o_custkey // 3) AS title, CASE WHEN o_orderkey % 2 = 0 THEN 1990 + o_orderkey % 10 END AS wanted FROM orders),
      i AS (SELECT hint_id, 0 AS source, turn AS a, 0 AS b, media_type, id FROM h JOIN g ON known = id QUALIFY hint_id % 4 = 0 OR row_number() OVER (PARTITION BY hint_id ORDER BY turn) = 1),
      t AS (SELECT hint_id, media_type, id, turn, coalesce(wanted = year, true) AS ok, bool_or(coalesce(wanted = year, true)) OVER (PARTITION BY hint_id) AS any_ok FROM h JOIN g USING (title)),
      n AS (SELECT *, row_number() OVER (PARTITION BY hint_id, media_type ORDER BY id) AS nth FROM t WHERE ok OR NOT any_ok),
      l AS (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY nth, turn) AS p FROM n),
      u AS (SELECT * FROM i UNION ALL SELECT hint_id, 2, nth, turn, media_type, id FROM l WHERE p <= 10),
      o AS (SELECT *, row_number() OVER (PARTITION BY hint_id, media_type, id ORDER BY source, a, b) AS r FROM u)
      SELECT hint_id, row_number() OVER (PARTITION BY hint_id ORDER BY source, a, b, id) AS place, media_type, id FROM o WHERE r = 1""",
    "film_merge": """SELECT c_custkey AS film_id, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 <> 0 THEN 'second' ELSE 'third' END AS title, CASE WHEN c_custkey % 3 <> 0 THEN 1900 + c_nationkey ELSE 1950 END::BIGINT AS year,
      CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN c_mktsegment ELSE 'someone' END AS director, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN '0' END, CASE WHEN c_custkey % 3 <> 0 THEN '1' END, '2') AS sources FROM customer""",
    "crew_rank": f"""WITH {_LN}, c AS (SELECT l_orderkey AS film_id, rk, s_name, l_returnflag AS j, l_quantity::BIGINT AS n FROM ln JOIN supplier ON l_suppkey = s_suppkey),
      m AS (SELECT film_id, s_name, sum(n) AS n, min(rk) AS rk FROM c WHERE j = 'N' GROUP BY ALL), k AS (SELECT film_id, string_agg(s_name, ', ' ORDER BY rk) AS composers, string_agg(s_name, ', ' ORDER BY n DESC, rk) AS ranked FROM m GROUP BY 1),
      d AS (SELECT film_id, first(s_name ORDER BY rk) FILTER (j = 'A') AS director FROM c GROUP BY 1)
      SELECT film_id, director, coalesce(composers, '') AS composers, ranked FROM d LEFT JOIN k USING (film_id)""",
    "film_hint": "SELECT c_custkey, c_name AS title, (1950 + c_nationkey)::BIGINT AS year, c_mktsegment AS director, CASE WHEN c_custkey % 3 <> 0 THEN 'tt' || c_custkey END AS imdb_id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS tmdb_id FROM customer",
    "track_key": r"""SELECT doc_id, CASE WHEN text <> '' THEN trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(coalesce(source, '')), '[^\p{L}\p{N}_]+', ' ', 'g')) END AS track_key FROM documents""",
    "norm_name": r"""SELECT doc_id, trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce(text, '')), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9 ]', ' ', 'g')) AS name FROM documents""",
    "parse_year": "SELECT doc_id, nullif(regexp_extract(text, '[0-9]{4}'), '')::BIGINT AS year FROM documents",
    "clean_url": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN CASE WHEN lower(url) LIKE 'http://%' OR lower(url) LIKE 'https://%' THEN url END WHEN 1 THEN 'https://music.apple.com/us/album/x/' || page_id || '?i=' || page_id END AS url FROM pages",
    "tracks_report": r"""WITH c AS (SELECT conv_id AS run_id, turn AS seq, role AS title, trim(regexp_replace(lower(role), '[^\p{L}\p{N}_]+', ' ', 'g')) || '|a nyone' AS track_key, length(text) % 4 AS g, length(text) % 3 = 0 AS an, length(text) AS d FROM conversations WHERE role <> ''),
      t AS (SELECT run_id, track_key, first(title ORDER BY g DESC, seq) AS title, max(g) AS g, bool_and(an) AS anachronistic, count(*) AS n_cues, sum(d)::BIGINT AS duration_n, min(seq) AS first_seq FROM c GROUP BY ALL)
      SELECT run_id, track_key, row_number() OVER (PARTITION BY run_id ORDER BY first_seq) AS track_no, title, CASE WHEN g >= 3 THEN 'high' WHEN g = 2 THEN 'medium' ELSE 'low' END AS confidence, anachronistic, n_cues, duration_n, first_seq FROM t""",
    "answer_outcome": """WITH e AS (SELECT event_id, event_id % 3 AS p, value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
      SELECT event_id, CASE p WHEN 0 THEN CASE k % 5 WHEN 1 THEN 'auth_error' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'no_match' ELSE CASE WHEN value > 100 THEN 'match' ELSE 'no_match' END END
        WHEN 1 THEN CASE WHEN k % 7 = 0 OR k % 4 = 2 THEN 'rate_limited' WHEN k % 4 = 1 THEN 'auth_error' WHEN k % 4 = 0 THEN 'match' ELSE 'no_match' END
        ELSE CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'rate_limited' WHEN value > 100 THEN 'match' ELSE 'no_match' END END AS outcome FROM e""",
    "ranked_answers": f"""WITH {_LN}, f AS (SELECT l_orderkey AS run_id, least(count(*) OVER (PARTITION BY l_orderkey), 5) AS n, rk, 2 * l_quantity >= 20 AS ok, 'song ' || l_partkey AS title, 'Ann, ' || l_suppkey AS artist, 'album ' || l_linenumber AS album, year(l_shipdate) AS y, 'I' || (l_partkey % 20) AS isrc, 2 * l_quantity AS score FROM ln)
      SELECT run_id, n, CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN artist END AS artist, CASE WHEN ok THEN album END AS album, CASE WHEN ok THEN y END AS release_year, CASE WHEN ok THEN isrc END AS isrc, CASE WHEN ok THEN score END AS score FROM f WHERE rk = 1""",
    "single_answers": "SELECT p_partkey, p_name AS title, p_brand AS artist, (1950 + p_size)::BIGINT AS release_year, CASE p_partkey % 3 WHEN 0 THEN 'AP1' WHEN 1 THEN 'SP1' ELSE 'MB1' END AS isrc, 'm' || p_partkey AS musicbrainz_recording_id FROM part",
    "track_answers": "SELECT p_partkey, p_name AS title, p_brand AS artist, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS album, CASE WHEN p_partkey % 2 = 0 THEN 1950 + p_size END::BIGINT AS release_year, CASE WHEN p_partkey % 2 = 0 THEN 'US1' ELSE 'DE9' END AS isrc, CASE WHEN p_partkey % 2 = 0 THEN 'v' || p_partkey END AS youtube_link FROM part",
    "apply_edits": f"""WITH {_SAVED} SELECT run_id, segment_id, o_orderkey, CASE WHEN run_id % 3 = 0 AND run_id % 21 <> 0 AND l THEN 'new ' || o_orderkey ELSE title END AS title, artist, CASE WHEN run_id % 3 = 0 AND run_id % 21 <> 0 AND l THEN 'edited' END AS album, run_id % 3 = 0 AND run_id % 21 <> 0 AND l AS edited
      FROM (SELECT *, bool_or(o_orderkey % 5 <> 0) OVER (PARTITION BY run_id) AS l FROM s) WHERE run_id % 3 <> 0 OR run_id % 21 = 0 OR NOT l OR o_orderkey % 5 <> 0""",
    "resume_merge": f"WITH {_SAVED} SELECT run_id, o_orderkey, CASE WHEN pending AND o_orderkey % 3 = 0 THEN 'found ' || o_orderkey ELSE title END AS title, CASE WHEN pending AND o_orderkey % 3 = 0 THEN 'F' ELSE artist END AS artist, pending AND o_orderkey % 3 = 2 AS pending FROM s",
    "choose_song": f"""WITH {_SAVED} SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'first' WHEN 1 THEN 'second' WHEN 3 THEN CASE WHEN o_orderkey % 8 = 3 THEN 'typed' ELSE title END ELSE title END AS title,
      CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN NULL WHEN 3 THEN CASE WHEN o_orderkey % 8 = 3 THEN 'me' ELSE artist END ELSE artist END AS artist, o_orderkey % 4 = 2 OR o_orderkey % 8 = 7 AS untouched FROM s""",
    "migrate_results": """SELECT o_custkey AS run_id, CASE WHEN o_custkey % 6 < 2 AND bool_or(o_orderkey % 9 < 2) OVER w THEN bool_or(o_orderkey % 9 = 0) OVER w END AS isolation, 'seg_' || o_orderkey AS segment_id,
      CASE WHEN o_custkey % 6 = 0 THEN o_custkey % 4 < 2 AND o_orderstatus = 'P' END AS pending,
      CASE WHEN o_custkey % 6 = 5 OR (o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0) THEN CASE WHEN o_orderkey % 4 = 0 THEN 'saved/3' END
           WHEN o_orderkey % 3 <> 0 THEN 'acrcloud/' || o_orderpriority || '/1,acrcloud/other/1'
           ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'acrcloud/' || o_orderpriority || '/1,acrcloud/other/1' ELSE 'acrcloud/voted/1' END || CASE WHEN o_orderkey % 5 = 0 THEN ',audd/heard/1' ELSE '' END END AS alternatives
      FROM orders WINDOW w AS (PARTITION BY o_custkey)""",
    "display_year": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1900 + o_orderkey % 99 WHEN o_orderkey % 4 <> 0 THEN year(o_orderdate) END::BIGINT AS year, o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 AS is_hint FROM orders",
    "duration_text": "SELECT o_orderkey, CASE WHEN s >= 60 THEN floor(s / 60)::BIGINT || 'm ' ELSE '' END || printf('%.1fs', round(s - 60 * floor(s / 60) + 1e-9, 1)) AS said FROM (SELECT o_orderkey, (o_orderkey % 400000) / 4 AS s FROM orders)",
    "film_hint_clean": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS title, CASE WHEN c_custkey % 4 <> 0 THEN 1900 + c_nationkey END::BIGINT AS year, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS tmdb_id, CASE WHEN c_custkey % 2 <> 0 THEN 'tt' || c_custkey END AS imdb_id, CASE c_custkey % 3 WHEN 0 THEN 'tv' WHEN 1 THEN 'movie' END AS media_type FROM customer",
    "pending_cues": f"WITH {_SAVED} SELECT run_id, segment_id, segment_id || '.wav' AS audio_file FROM s WHERE pending AND o_orderkey % 3 <> 0",
    "hide_anachronistic": "SELECT o_custkey AS run_id, count(*) FILTER (o_orderkey % 7 <> 0) AS shown, count(*) FILTER (o_orderkey % 7 = 0) AS hidden FROM orders GROUP BY 1",
    "replace_composer": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'New Name' WHEN 1 THEN NULL ELSE o_orderpriority END AS composer, CASE WHEN o_orderkey % 4 >= 2 THEN 1860 END::BIGINT AS composer_death_year, o_orderkey % 4 < 2 AS authors_partial,
      CASE o_orderkey % 4 WHEN 0 THEN 'New Name:-,' WHEN 1 THEN '' ELSE o_orderpriority || ':1800,' END || o_orderstatus || ':1800' AS authors FROM orders""",
    "assemble_authors": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'isrc' WHEN o_orderkey % 3 = 0 THEN 'work' WHEN o_orderkey % 2 = 0 THEN 'search' END AS composer_match, CASE WHEN o_orderkey % 4 = 0 THEN 'i' WHEN o_orderkey % 3 = 0 THEN 'w' WHEN o_orderkey % 2 = 0 THEN 's' END || o_custkey AS composer,
      concat_ws(',', CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 'musicbrainz' END, CASE WHEN (o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0) OR o_orderkey % 5 = 0 THEN 'wikidata' END) AS sources FROM orders""",
    "union_answers": f"WITH {_VOTES} SELECT run_id, clip_idx, provider, title, CASE WHEN provider <> 'acrcloud' THEN album END AS album, CASE WHEN provider <> 'shazam' THEN score END AS score FROM v",
    "run_summary": "SELECT c_custkey AS run_id, c_name AS name, c_nationkey::BIGINT AS created_at, count(o_orderkey) AS total_cues, count(*) FILTER (o_orderstatus <> 'P') AS identified_cues, count(*) FILTER (o_orderstatus = 'P') AS pending_cues FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "export_flat": f"""WITH {_SAVED} SELECT run_id::VARCHAR AS run_id, segment_id, coalesce(title, '') AS "song.title", artist AS "song.artist", '["' || artist || '",' || coalesce('"' || title || '"', 'null') || ']' AS names FROM s""",
    "annotation_series": f"WITH {_SAVED} SELECT run_id, o_orderkey * 1100500 / 1e6 AS start_seconds, (o_orderkey * 1100500 + o_orderkey % 50 * 1000000 + 250000) / 1e6 AS end_seconds, CASE WHEN title IS NULL THEN 'Unidentified music' ELSE title || ' — ' || artist END AS annotations FROM s",
    "frame_segments": f"WITH {_SAVED} SELECT run_id, round_even(o_orderkey * 1100500 * 24.0 / 1e6, 0)::BIGINT AS start_frame, round_even((o_orderkey * 1100500 + o_orderkey % 50 * 1000000 + 250000) * 24.0 / 1e6, 0)::BIGINT AS end_frame, CASE WHEN title IS NULL THEN 'Unidentified music' ELSE title || ' — ' || artist END AS label FROM s JOIN customer ON c_custkey = run_id",
}
