"""Checks of an answer's date against the film's: re-ranking and the anachronism flag; derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.text import track_key

from .rights import rights_verdict

TOLERANCE, LEAST_SCORE = 3, 40.0


def with_film(cues: DataFrame, films: DataFrame) -> DataFrame:
    """Film fields on cues; one film a run, so Spark may broadcast it where it is small."""
    return cues.join(films, "run_id", "left")


def date_rerank(cues: DataFrame, fields: tuple[str, ...] = ("title", "release_year"), tolerance: int = TOLERANCE, min_score: float = LEAST_SCORE) -> DataFrame:
    """Where the answer is later than the film allows, take the best plausible candidate from the second on.

    Needs film_year, candidates (array of structs with the fields and score) and the fields; adds temporal_pick."""
    limit = F.col("film_year") + tolerance
    rest = F.filter(F.transform("candidates", lambda c, i: F.struct((-c["score"]).alias("minus"), i.alias("at"), c.alias("song"))), lambda r: (r["at"] >= 1) & (r["song"]["release_year"] > 0) & (r["song"]["release_year"] <= limit) & (r["song"]["score"] >= min_score))
    best = F.get(F.array_sort(F.transform(rest, lambda r: F.struct(r["minus"].alias("minus"), r["at"].alias("at"), r["song"].alias("song")))), F.lit(0))["song"]
    late = F.coalesce((F.col("film_year") > 0) & (F.size("candidates") >= 2) & (F.col("release_year") > limit), F.lit(False))
    told = cues.withColumn("_best", F.when(late, best))
    swapped = {f: F.when(F.col("_best").isNotNull(), F.col(f"_best.{f}")).otherwise(F.col(f)) for f in fields}
    return told.withColumn("temporal_pick", F.col("_best").isNotNull()).withColumns(swapped).drop("_best")


def is_anachronistic(film_year: Column, original: Column, release: Column, death: Column, film_composer: Column, artist: Column, composer: Column, tolerance: int = TOLERANCE) -> Column:
    """A known original year decides; else a release later than the film allows counts, unless the composer was dead or scored the film."""
    names = F.filter(F.transform(F.split(F.lower(F.coalesce(film_composer, F.lit(""))), ",|&|(?<![a-z0-9_])and(?![a-z0-9_])"), lambda n: F.trim(n)), lambda n: n != "")
    credited = F.lower(F.concat_ws(" ", F.coalesce(artist, F.lit("")), F.coalesce(composer, F.lit(""))))
    own = F.exists(names, lambda n: F.contains(credited, n))
    late = F.coalesce(release > film_year + tolerance, F.lit(False))
    alive = F.coalesce(death > film_year, F.lit(True))
    return F.when(film_year.isNull() | (film_year == 0), F.lit(False)).when(original > 0, original > film_year + tolerance).otherwise(late & alive & ~own)


def anachronistic(cues: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    cols = [F.col(c) for c in ("film_year", "original_year", "release_year", "composer_death_year", "music_composer", "artist", "composer")]
    return cues.withColumn("anachronistic", is_anachronistic(*cols, tolerance=tolerance))


def hide_anachronistic(cues: DataFrame, count: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The cues without anachronistic ones; with `count` also run_id, hidden: how many each run hides."""
    shown = cues.filter(~F.col("anachronistic"))
    return (shown, cues.filter("anachronistic").groupBy("run_id").agg(F.count(F.lit(1)).alias("hidden"))) if count else shown


def flag_alternatives(cues: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """anachronistic in every entry of alternatives (structs with release_year and artist), by its own release and the film."""
    none = F.lit(None).cast("int")
    names = [f.name for f in cues.schema["alternatives"].dataType.elementType.fields if f.name != "anachronistic"]
    late = lambda a: is_anachronistic(F.col("film_year"), none, a["release_year"], none, F.col("music_composer"), a["artist"], F.lit(None).cast("string"), tolerance)
    return cues.withColumn("alternatives", F.transform("alternatives", lambda a: F.struct(*(a[n].alias(n) for n in names), late(a).alias("anachronistic"))))


def refresh(cues: DataFrame, as_of_year: int) -> DataFrame:
    """All derived columns, always computed: rights, the anachronism flag of the cue and of its alternatives, the track key.

    Where authors is null, nothing can be assessed and a verdict that was saved stays."""
    verdict = {"latest_author_death_year": "int", "authors_complete": "boolean", "public_domain": "boolean", "pd_presumption": "boolean"}
    kept = cues.select("*", *((F.col(c) if c in cues.columns else F.lit(None).cast(t)).alias(f"_{c}") for c, t in verdict.items()))
    told = rights_verdict(kept, "authors", "authors_partial", as_of_year)
    told = told.withColumns({c: F.when(F.col("authors").isNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in verdict}).drop(*(f"_{c}" for c in verdict))
    told = anachronistic(told).withColumn("track_key", track_key(F.col("title"), F.col("artist")))
    return flag_alternatives(told) if "alternatives" in cues.columns else told
