"""Film hints, candidates, merging of film sources, and crew."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.text import missing, parse_year


def _tag(tags: Column, name: str) -> Column:
    """A tag by its name in capitals, else in small letters; blank is missing."""
    return F.coalesce(missing(F.trim(tags[name.upper()])), missing(F.trim(tags[name.lower()])))


def film_hint_from_tags(tags: Column) -> Column:
    """struct(title, year, director, imdb_id, tmdb_id) from a map of tags."""
    imdb, director = _tag(tags, "imdb"), _tag(tags, "director")
    named = F.coalesce(missing(F.regexp_extract(director, "^\\{(.*)\\}$", 1)), director)
    return F.struct(_tag(tags, "title").alias("title"), parse_year(_tag(tags, "day")).alias("year"), named.alias("director"), F.when(F.startswith(imdb, F.lit("tt")), imdb).alias("imdb_id"), _tag(tags, "tmdb").try_cast("bigint").alias("tmdb_id"))


def film_hint_clean(df: DataFrame) -> DataFrame:
    """Blank texts and unusable numbers are null; a media type is movie or tv. Needs title, year, tmdb_id, imdb_id, media_type (texts)."""
    kind = F.lower(F.trim("media_type"))
    return df.select(*(c for c in df.columns if c not in ("title", "year", "tmdb_id", "imdb_id", "media_type")), missing(F.trim("title")).alias("title"), F.trim("year").try_cast("int").alias("year"), F.trim("tmdb_id").try_cast("bigint").alias("tmdb_id"), missing(F.trim("imdb_id")).alias("imdb_id"), F.when(kind.isin("movie", "tv"), kind).alias("media_type"))


def film_candidates(hints: DataFrame, films: DataFrame, limit: int = 10) -> DataFrame:
    """hint_id, place, media_type, id: films by number, the one with the IMDb id (a film before a series), then up to `limit` title hits, film and series in turn.

    hints: hint_id, tmdb_id, imdb_id, title, year. films: media_type, id, imdb_id, title, year, rank. A title with a
    year that matches nothing is asked again without it. The first naming of a (media type, id) counts."""
    kind = F.when(F.col("media_type") == "movie", 0).otherwise(1)
    by_id = hints.filter("tmdb_id is not null").select("hint_id", F.col("tmdb_id").alias("id")).join(films, "id").select("hint_id", F.lit(0).alias("source"), kind.alias("turn"), F.lit(0).cast("long").alias("nth"), "media_type", "id")
    found = hints.filter("imdb_id is not null").select("hint_id", "imdb_id").join(films, "imdb_id")
    by_imdb = found.groupBy("hint_id").agg(F.min(F.struct(kind.alias("turn"), "rank", "id", "media_type")).alias("f")).select("hint_id", F.lit(1).alias("source"), "f.turn", F.lit(0).cast("long").alias("nth"), "f.media_type", "f.id")
    titled = hints.filter("title is not null").select("hint_id", "title", F.col("year").alias("wanted"))
    hits = titled.join(films, "title")
    exact = hits.filter(F.col("wanted").isNull() | (F.col("year") == F.col("wanted")))
    again = hits.join(exact.select("hint_id").distinct(), "hint_id", "left_anti")
    both = exact.unionByName(again).select("hint_id", "media_type", "id", "rank")
    nth = F.row_number().over(Window.partitionBy("hint_id", "media_type").orderBy("rank", "id"))
    by_title = both.withColumn("nth", nth.cast("long")).select("hint_id", F.lit(2).alias("source"), kind.alias("turn"), "nth", "media_type", "id")
    place = F.row_number().over(Window.partitionBy("hint_id").orderBy("nth", "turn"))
    by_title = by_title.withColumn("_p", place).filter(F.col("_p") <= limit).drop("_p")
    # within ids the media type decides, within title hits the turn: both are (nth, turn) or (turn, nth)
    every = by_id.unionByName(by_imdb).unionByName(by_title).withColumn("_a", F.when(F.col("source") < 2, F.col("turn").cast("long")).otherwise(F.col("nth"))).withColumn("_b", F.when(F.col("source") < 2, F.col("nth")).otherwise(F.col("turn").cast("long")))
    once = every.withColumn("_r", F.row_number().over(Window.partitionBy("hint_id", "media_type", "id").orderBy("source", "_a", "_b"))).filter("_r = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("hint_id").orderBy("source", "_a", "_b", "id")).cast("long")).select("hint_id", "place", "media_type", "id")


def film_merge(hints: DataFrame, sources: list[DataFrame], fields: list[str], key: str = "film_id") -> DataFrame:
    """The first source that knows the film leads; missing fields come from the next ones. Adds sources, the places used."""
    out = hints
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.lit(i).alias(f"_in{i}"), *(F.col(f).alias(f"_{f}{i}") for f in fields)), key, "left")
    merged = [F.coalesce(*(missing(F.col(f"_{f}{i}")) if dict(sources[i].dtypes)[f] == "string" else F.col(f"_{f}{i}") for i in range(len(sources)))).alias(f) for f in fields]
    used = F.array_compact(F.array(*(F.col(f"_in{i}") for i in range(len(sources)))))
    return out.select(*hints.columns, *merged, used.alias("sources"))


FILM = ("title", "year", "director", "director_death_year", "imdb_id", "tmdb_id", "media_type", "music_composer")
_FILM_KINDS = {"year": "int", "director_death_year": "int", "tmdb_id": "bigint"}


def cascade(asked: DataFrame, key: str, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """What the steps find for the asked rows, with found_by: each step sees only what the steps before left open."""
    found, rest = [], asked
    for name, step in steps:
        hit = step(rest).withColumn("found_by", F.lit(name))
        found.append(hit)
        rest = rest.join(hit.select(key), key, "left_anti")
    return reduce(DataFrame.unionByName, found)


def primary_film(hints: DataFrame, films: DataFrame) -> DataFrame:
    """hint_id, the film's fields and found_by (id, imdb or title): the first source's film of each hint that has one.

    hints: hint_id, tmdb_id, imdb_id, title, year, media_type. films: media_type, id, imdb_id, title, year, rank and the
    other fields. A given id is a film's unless the media type says series; the IMDb id and then the title (with the
    year, if given) are looked for among films before series, or in the given kind alone. A wrong id finds nothing, and
    the next is tried."""
    turn = F.when(F.col("media_type") == "movie", 0).otherwise(1)
    held = films.select(F.col("media_type").alias("_kind"), F.col("id").alias("_id"), "imdb_id", F.col("title").alias("_title"), F.col("year").alias("_year"), turn.alias("_turn"), F.col("rank").alias("_rank"))
    open_kind = F.col("media_type").isNull() | (F.col("media_type") == F.col("_kind"))

    def first(hits: DataFrame) -> DataFrame:
        return hits.groupBy("hint_id").agg(F.min(F.struct("_turn", "_rank", "_id", "_kind")).alias("_f")).select("hint_id", F.col("_f._kind").alias("_kind"), F.col("_f._id").alias("_id"))

    def by_id(rest: DataFrame) -> DataFrame:
        asked = rest.filter("tmdb_id is not null").select("hint_id", F.col("tmdb_id").alias("_id"), F.coalesce("media_type", F.lit("movie")).alias("_kind"))
        return first(asked.join(held, ["_id", "_kind"]))

    def by_imdb(rest: DataFrame) -> DataFrame:
        return first(rest.filter("imdb_id is not null").select("hint_id", "imdb_id", "media_type").join(held, "imdb_id").filter(open_kind))

    def by_title(rest: DataFrame) -> DataFrame:
        asked = rest.filter("title is not null").select("hint_id", F.col("title").alias("_title"), "year", "media_type")
        return first(asked.join(held, "_title").filter(open_kind & (F.col("year").isNull() | (F.col("year") == F.col("_year")))))

    found = cascade(hints, "hint_id", [("id", by_id), ("imdb", by_imdb), ("title", by_title)])
    full = films.select(F.col("media_type").alias("_kind"), F.col("id").alias("_id"), *(F.col("id" if f == "tmdb_id" else f).alias(f) for f in FILM))
    return found.join(full, ["_kind", "_id"]).select("hint_id", *FILM, "found_by")


def film_complete() -> Column:
    """A series is complete with title and year; a film has its director and the director's death year besides."""
    basic = F.col("title").isNotNull() & F.col("year").isNotNull()
    return basic & (F.coalesce(F.col("media_type") == "tv", F.lit(False)) | (F.col("director").isNotNull() & F.col("director_death_year").isNotNull()))


def film_resolve(hints: DataFrame, films: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """hint_id, the film's fields, sources, found_by: what is known of each hint's film, first non-null wins.

    The first source's film (primary_film), then for films that are still incomplete the second source, by IMDb id
    (the film's own, else the given one) or, without one, by title and year, then for those still incomplete the third,
    by IMDb id. Given ids come last, since they can be wrong. sources names those that added something.
    second, third: imdb_id, title, year, director, director_death_year (second: rank as well)."""
    none = lambda f: F.lit(None).cast(_FILM_KINDS.get(f, "string"))
    given = hints.select("hint_id", *(F.col(c).alias(f"_g_{c}") for c in ("tmdb_id", "imdb_id", "title", "year", "media_type")))
    told = given.join(primary_film(hints, films), "hint_id", "left").withColumn("sources", F.when(F.col("found_by").isNotNull(), F.array(F.lit("first"))).otherwise(F.array().cast("array<string>")))

    def filled(told: DataFrame, hits: DataFrame, tag: str) -> DataFrame:
        """hits: hint_id and some fields, at most a row for each hint."""
        fields = [f for f in FILM if f in hits.columns]
        more = told.join(hits.select("hint_id", *(F.col(f).alias(f"_n_{f}") for f in fields)), "hint_id", "left")
        added = reduce(lambda a, b: a | b, (F.col(f).isNull() & F.col(f"_n_{f}").isNotNull() for f in fields))
        more = more.withColumn("sources", F.when(added, F.array_append("sources", F.lit(tag))).otherwise(F.col("sources")))
        return more.withColumns({f: F.coalesce(f, f"_n_{f}") for f in fields}).drop(*(f"_n_{f}" for f in fields))

    key = F.coalesce("imdb_id", "_g_imdb_id")
    rest = told.filter(~film_complete()).select("hint_id", key.alias("_k"), F.coalesce("title", "_g_title").alias("_t"), F.coalesce("year", "_g_year").alias("_y"))
    ranked = second.withColumnRenamed("imdb_id", "_imdb").select(*(F.col(c).alias(f"_s{c}" if c != "_imdb" else c) for c in ("_imdb", "title", "year", "director", "director_death_year", "rank")))
    by_id = rest.filter("_k is not null").join(ranked, F.col("_k") == F.col("_imdb"))
    by_title = rest.filter("_k is null and _t is not null").join(ranked, F.col("_t") == F.col("_stitle")).filter("_y is null or _y = _syear")
    hits = by_id.unionByName(by_title).groupBy("hint_id").agg(F.min(F.struct("_srank", "_imdb", "_stitle", "_syear", "_sdirector", "_sdirector_death_year")).alias("s"))
    hits = hits.select("hint_id", F.col("s._imdb").alias("imdb_id"), *(F.col(f"s._s{c}").alias(c) for c in ("title", "year", "director", "director_death_year")))
    told = filled(told, hits, "second")
    rest = told.filter(~film_complete()).select("hint_id", F.coalesce("imdb_id", "_g_imdb_id").alias("_k")).filter("_k is not null")
    fields = ("title", "year", "director", "director_death_year")
    hits = rest.join(third, F.col("_k") == F.col("imdb_id")).groupBy("hint_id").agg(F.min(F.struct("imdb_id", *fields)).alias("s")).select("hint_id", "s.*")
    told = filled(told, hits, "third")
    return told.withColumns({c: F.coalesce(c, f"_g_{c}") for c in ("imdb_id", "tmdb_id", "media_type")}).select("hint_id", *(F.coalesce(f, none(f)).alias(f) for f in FILM), "sources", "found_by")


def crew_rank(crew: DataFrame, job: str) -> DataFrame:
    """film_id, names: those with most episodes in the job first, ties in source order, joined by a comma."""
    per = crew.filter(F.col("job") == job).groupBy("film_id", "name").agg(F.sum("episode_count").alias("n"), F.min("rank").alias("at"))
    return per.groupBy("film_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "at", "name"))), lambda x: x["name"]), ", ").alias("names"))


def film_credits(crew: DataFrame) -> DataFrame:
    """film_id, director (the first), composers (distinct, in order)."""
    composers = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("job") == "Original Music Composer", F.struct("rank", "name")))), lambda x: x["name"]))
    return crew.groupBy("film_id").agg(F.min(F.when(F.col("job") == "Director", F.struct("rank", "name")))["name"].alias("director"), F.array_join(composers, ", ").alias("composers"))
