"""Look-ups in catalogue tables: recordings, works, authors, artists and dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.text import entity_page_url, norm_name, parse_year

ROLES = ("composer", "lyricist", "writer")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def author_roles(rel: DataFrame) -> DataFrame:
    return rel.filter(F.col("role").isin(*ROLES))


def work_authors(relations: DataFrame, artists: DataFrame | None = None, lives: DataFrame | None = None) -> DataFrame:
    """work_id, authors: one entry per artist (its id, else its name), roles in order, life years topped up.

    relations: work_id, rank, role, artist_id, name. artists: artist_id, type, begin, end, wikidata_url.
    lives: artist_id, birth, death; asked for persons and unknown types with a date missing, never for groups."""
    key = F.coalesce("artist_id", F.lower("name"))
    rel = author_roles(relations).withColumn("_key", key)
    folded = rel.groupBy("work_id", "_key").agg(F.min_by("name", "rank").alias("name"), F.min_by("artist_id", "rank").alias("artist_id"), F.min("rank").alias("rank"),
                                                F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "role"))), lambda r: r["role"])).alias("roles"))
    birth, death, page = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("string")
    if artists is not None:
        folded = folded.join(artists.select("artist_id", "type", "begin", "end", "wikidata_url"), "artist_id", "left")
        person = F.col("type") == "Person"
        birth, death, page = F.when(person, parse_year(F.col("begin"))), F.when(person, parse_year(F.col("end"))), entity_page_url(F.col("wikidata_url"))
        if lives is not None:
            folded = folded.join(lives.select("artist_id", "birth", "death"), "artist_id", "left")
            ask = person | F.col("type").isNull()
            birth, death = F.coalesce(birth, F.when(ask, parse_year(F.col("birth")))), F.coalesce(death, F.when(ask, parse_year(F.col("death"))))
    entry = F.struct("rank", "name", "roles", birth.alias("birth_year"), death.alias("death_year"), page.alias("wikidata_url"))
    named = ("name", "roles", "birth_year", "death_year", "wikidata_url")
    return folded.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(*(e[n].alias(n) for n in named))).alias("authors"))


def author_chain(cues: DataFrame, recordings: DataFrame, recording_works: DataFrame, authors: DataFrame) -> DataFrame:
    """cues with work_id and authors by ISRC: first recording, its first performed work, that work's authors."""
    rec = first_by(recordings, ["isrc"], ["rank", "recording_id"]).select("isrc", "recording_id")
    work = first_by(recording_works.filter("rel_type = 'performance'"), ["recording_id"], ["rank", "work_id"]).select("recording_id", "work_id")
    return cues.join(rec, "isrc", "left").join(work, "recording_id", "left").join(authors, "work_id", "left")


def work_by_title(cues: DataFrame, works: DataFrame, authors: DataFrame, k: int = 4) -> DataFrame:
    """cue key, work_id, score: of the first k works of a title the one most of whose authors the artist names; at least one.

    An author counts if the last token of the name, or any token of five letters or more, is among the artist's tokens;
    a name or an artist without a token in ASCII counts for nothing."""
    tokens = lambda name: F.filter(F.split(norm_name(name), " "), lambda t: t != "")
    wanted = cues.filter("artist is not null").select("cue_id", norm_name(F.col("title")).alias("_t"), tokens(F.col("artist")).alias("_artist"))
    listed = works.withColumn("_t", norm_name(F.col("title"))).withColumn("_r", F.row_number().over(Window.partitionBy("_t").orderBy("rank", "work_id"))).filter(F.col("_r") <= k).select("_t", "work_id", "_r")
    names = authors.select("work_id", F.transform("authors", lambda a: tokens(a["name"])).alias("_names"))
    met = wanted.join(listed, "_t").join(names, "work_id")
    counts = lambda t: F.array_contains(F.col("_artist"), F.try_element_at(t, F.lit(-1))) | F.exists(t, lambda w: (F.length(w) >= 5) & F.array_contains(F.col("_artist"), w))
    scored = met.withColumn("score", F.size(F.filter("_names", counts))).filter("score >= 1")
    return first_by(scored, ["cue_id"], [F.desc("score"), "_r"]).select("cue_id", "work_id", "score")


def author_fallback(cues: DataFrame, composers: DataFrame) -> DataFrame:
    """Last resort: the first composer listed under the title; whether the artist fits is not asked, so the result is partial."""
    best = first_by(composers, ["title"], ["rank", "composer"]).select("title", "composer", "birth_year", "death_year")
    return cues.join(best, "title", "left").withColumn("authors_partial", F.col("composer").isNotNull())


def original_year(cues: DataFrame, dates: DataFrame, max_names: int = 4) -> DataFrame:
    """cue_id, original_year: earliest date of a work of the title whose composer or performer is one of the cue's names."""
    names = F.slice(F.array_distinct(F.filter("names", lambda n: F.nullif(n, F.lit("")).isNotNull())), 1, max_names)
    asked = cues.select("cue_id", "title", F.explode(names).alias("person")).distinct()
    edges = dates.select("title", "person", F.coalesce(parse_year(F.col("published")), parse_year(F.col("inception"))).alias("year")).distinct()
    return asked.join(edges, ["title", "person"]).groupBy("cue_id").agg(F.min("year").alias("original_year"))


def person_edges(composers: DataFrame, performers: DataFrame) -> DataFrame:
    """title, person, published, inception: the works' dates by composer and by performer, each edge once."""
    return composers.unionByName(performers).select("title", "person", "published", "inception").distinct()


def enrich_once(cues: DataFrame, lookup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Look every track up once, by its first cue, and give all its cues (with ISRC) the result; those without a track_key are one track.

    cues: run_id, seq, track_key, isrc. lookup takes the first cues and returns run_id, track_key and its fields."""
    asked = cues.filter(F.nullif(F.col("isrc"), F.lit("")).isNotNull())
    found = lookup(first_by(asked, ["run_id", "track_key"], ["seq"]))
    fields = [c for c in found.columns if c not in ("run_id", "track_key")]
    found = found.withColumnsRenamed({"run_id": "_run", "track_key": "_key"})
    joined = cues.join(found, (F.col("run_id") == F.col("_run")) & F.col("track_key").eqNullSafe(F.col("_key")), "left")
    return joined.select(*cues.columns, *(F.when(F.nullif(F.col("isrc"), F.lit("")).isNotNull(), F.col(f)).alias(f) for f in fields))


def assemble_authors(chain: DataFrame) -> DataFrame:
    """First of the ISRC chain, the title search and the last resort (columns isrc_authors, work_authors, search_authors).

    Adds composer_match, authors, the composer with life years, and sources; an original_year (column) without
    authors still makes a row of its own source."""
    level = F.when(F.size("isrc_authors") > 0, "isrc").when(F.size("work_authors") > 0, "work").when(F.size("search_authors") > 0, "search")
    told = chain.withColumn("composer_match", level).withColumn("authors", F.when(level == "isrc", F.col("isrc_authors")).when(level == "work", F.col("work_authors")).when(level == "search", F.col("search_authors")))
    primary = F.coalesce(F.get(F.filter("authors", lambda a: F.array_contains(a["roles"], "composer")), F.lit(0)), F.get("authors", F.lit(0)))
    dated = F.col("original_year").isNotNull() if "original_year" in chain.columns else F.lit(False)
    paged = F.exists("authors", lambda a: a["wikidata_url"].isNotNull()) if "wikidata_url" in str(dict(chain.dtypes)["isrc_authors"]) else F.lit(False)
    by_search = F.coalesce(level == "search", F.lit(False))
    sources = F.array_compact(F.array(F.when(level.isNotNull() & ~by_search, F.lit("musicbrainz")), F.when(by_search | dated | F.coalesce(paged, F.lit(False)), F.lit("wikidata"))))
    return told.withColumn("composer", primary["name"]).withColumn("composer_birth_year", primary["birth_year"]).withColumn("composer_death_year", primary["death_year"]).withColumn("sources", sources)
