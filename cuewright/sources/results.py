"""Saved results: reading with migration, writing, and the exports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from cuewright.functions.text import cue_label, track_key
from cuewright.operators.ranking import is_anachronistic
from cuewright.operators.rights import verdict

SONG = "title string, artist string, album string, release_year int, isrc string, genre string, photo_url string, youtube_link string, spotify_url string, apple_music_url string, song_link string, musicbrainz_recording_id string, musicbrainz_url string"
_PAIRS = SONG.replace(", ", ",").replace(" ", ":")
CANDIDATE = f"struct<{_PAIRS},score:double>"
VOTE = f"struct<provider:string,matched:boolean,error:string,{_PAIRS},score:double,candidates:array<{CANDIDATE}>>"
ALTERNATIVE = f"struct<provider:string,{_PAIRS},score:double,windows:int,anachronistic:boolean>"
AUTHOR = "struct<name:string,roles:array<string>,birth_year:int,death_year:int,wikidata_url:string>"
ENRICHMENT = f"struct<composer:string,composer_birth_year:int,composer_death_year:int,work_title:string,composer_match:string,authors:array<{AUTHOR}>,sources:array<string>,original_year:int,authors_partial:boolean,authors_complete:boolean,latest_author_death_year:int,public_domain:boolean,pd_presumption:boolean>"
#: A cue of the current version; then what older versions have besides.
CUE_NOW = f"segment_id:string,start:double,duration:double,audio_file:string,pending:boolean,provider:string,{_PAIRS},agreement:struct<count:int,total:int,providers:array<string>>,votes:array<{VOTE}>,candidates:array<{CANDIDATE}>,alternatives:array<{ALTERNATIVE}>,enrichment:{ENRICHMENT},temporal_pick:boolean,anachronistic:boolean,track_key:string"
CUE = f"struct<{CUE_NOW},conditioning:string>"
SETTINGS = "api:string,classifier:string,threshold:double,window:double,hop:double,bridge_gap:double,isolation:boolean,max_segment_duration:double"
RESULTS = f"version int, source string, video_name string, rate_limited boolean, film struct<title:string,year:int,director:string,director_death_year:int,imdb_id:string,tmdb_id:bigint,media_type:string,music_composer:string,sources:array<string>>, providers array<string>, settings struct<{SETTINGS}>, video struct<file:string,filmstrip:struct<count:int,thumb_width:int,thumb_height:int,duration:double>,fps:double>, cues array<{CUE}>"
TIMELINE = "waveform struct<samples:array<double>,duration:double>, classification array<struct<start:double,end:double,is_music:boolean,classes:map<string,double>>>, classification_windows array<struct<start:double,end:double,music:double,is_music:boolean>>"


def read_results(spark: SparkSession, glob: str) -> DataFrame:
    """One row per run: run_id (the folder's name) and the document, migrated. Unreadable documents are left out."""
    schema = StructType.fromDDL(RESULTS + ", _corrupt string")
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(glob)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return migrate_results(raw.withColumn("run_id", folder).filter("_corrupt is null").drop("_corrupt"))


def read_timeline(spark: SparkSession, timelines: str, results: str) -> DataFrame:
    """run_id, waveform, classification, classification_windows: from timeline.json, else from an old results.json."""
    def load(glob: str, tag: str) -> DataFrame:
        df = spark.read.schema(StructType.fromDDL(TIMELINE)).option("multiLine", True).json(glob)
        return df.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run_id"), *(F.col(c).alias(f"{c}{tag}") for c in df.columns))

    both = load(results, "_r").join(load(timelines, "_t"), "run_id", "full")
    return both.select("run_id", *(F.coalesce(f"{c}_t", f"{c}_r").alias(c) for c in ("waveform", "classification", "classification_windows")))


def migrate_results(df: DataFrame) -> DataFrame:
    """Documents of versions 1 to 5 brought to version 6; those of version 6 stay as they are.

    2: in a run that was limited, an untitled cue without the mark is pending. 3: the cues' conditionings become
    settings.isolation, true if any was vocals_removed; an existing value stays. 4 and 5: the run's rate_limited and
    the confidences are gone. 6: alternatives, from the votes or the candidates of the cue."""
    version = F.coalesce("version", F.lit(1))
    kinds = F.filter(F.transform("cues", lambda c: c["conditioning"]), lambda k: k.isNotNull())
    isolation = F.coalesce(F.col("settings.isolation"), F.when((version < 3) & (F.size(kinds) > 0), F.array_contains(kinds, "vocals_removed")))
    limited = F.coalesce("rate_limited", F.lit(False))
    song = [f.split(" ")[0] for f in SONG.split(", ")]
    same = ("provider", "title", "artist", "isrc", "album", "release_year")

    def named(c):
        entry = lambda provider, x: F.struct(provider.alias("provider"), *(x[n].alias(n) for n in (*song, "score")), F.lit(1).alias("windows"), F.lit(None).cast("boolean").alias("anachronistic"))
        own = lambda found: F.transform(found, lambda x: entry(c["provider"], x))
        of_vote = lambda v: F.when(F.size(v["candidates"]) > 0, F.transform(v["candidates"], lambda x: entry(v["provider"], x))).when((v["provider"] == "acrcloud") & (F.size(c["candidates"]) > 0), F.transform(c["candidates"], lambda x: entry(v["provider"], x))).otherwise(F.array(entry(v["provider"], v)))
        every = F.when(F.size(c["votes"]) > 0, F.flatten(F.transform(F.filter(c["votes"], lambda v: v["matched"]), of_vote))).otherwise(own(c["candidates"]))
        # each song once, as it was first named
        first = F.filter(every, lambda x, i: ~F.exists(F.slice(every, 1, i), lambda y: F.struct(*(x[k] for k in same)) == F.struct(*(y[k] for k in same))))
        return F.when((F.size(c["votes"]) > 0) | (F.size(c["candidates"]) > 0), first)

    def cue(c):
        pending = F.coalesce(c["pending"], F.when(version < 2, limited & F.coalesce(c["title"] == "", F.lit(True))))
        new = {"pending": pending, "alternatives": F.when(version < 6, F.coalesce(named(c), c["alternatives"])).otherwise(c["alternatives"])}
        return F.struct(*(new.get(n, c[n]).alias(n) for n in [f.name for f in StructType.fromDDL(CUE_NOW).fields]))

    settings = F.when(F.col("settings").isNotNull() | isolation.isNotNull(), F.struct(*((isolation if n == "isolation" else F.col(f"settings.{n}")).alias(n) for n in (f.partition(":")[0] for f in SETTINGS.split(",")))))
    return df.withColumn("_s", settings).withColumn("cues", F.transform("cues", cue)).withColumn("settings", F.col("_s")).withColumn("version", F.lit(6)).drop("_s", "rate_limited")


def cues_of(results: DataFrame) -> DataFrame:
    """One row per cue, its fields as columns."""
    return results.select("run_id", F.posexplode("cues").alias("seq", "c")).select("run_id", F.col("seq").cast("long").alias("seq"), "c.*")


def refresh_results(results: DataFrame, as_of_year: int) -> DataFrame:
    """What follows from a document, worked out again inside it: rights where authors are known (else kept), the
    anachronism flags of cues and alternatives, and track keys. One projection; no document is taken apart."""
    film_year, film_composer = F.col("film.year"), F.col("film.music_composer")
    named = lambda name: [f.name for f in StructType.fromDDL(f"x {name}").fields[0].dataType.fields]
    none = F.lit(None).cast("int")

    def again(x: Column, names: list[str], new: dict[str, Column]) -> Column:
        return F.struct(*(new.get(n, x[n]).alias(n) for n in names))

    def enrichment(e: Column) -> Column:
        told = verdict(e["authors"], e["authors_partial"], F.lit(as_of_year))
        return F.when(e.isNotNull(), again(e, named(ENRICHMENT), {n: F.when(e["authors"].isNull(), e[n]).otherwise(c) for n, c in told.items()}))

    def cue(c: Column) -> Column:
        e = c["enrichment"]
        late = is_anachronistic(film_year, e["original_year"], c["release_year"], e["composer_death_year"], film_composer, c["artist"], e["composer"])
        songs = F.transform(c["alternatives"], lambda a: again(a, named(ALTERNATIVE), {"anachronistic": is_anachronistic(film_year, none, a["release_year"], none, film_composer, a["artist"], none.cast("string"))}))
        return again(c, named(f"struct<{CUE_NOW}>"), {"enrichment": enrichment(e), "anachronistic": late, "alternatives": songs, "track_key": track_key(c["title"], c["artist"])})

    return results.withColumn("cues", F.transform("cues", cue))


def write_results(df: DataFrame, path: str) -> None:
    """Replace the written runs and no others, each as a whole, by the commit of the job. See publish_results for one commit over all."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def _commits(spark: SparkSession, path: str):
    """The folder of a store's commits, the number of the last one, and the version that it names (0 and None without)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    last = max((int(n) for n in names if n.isdigit()), default=0)
    return folder, last, spark.read.text(f"{path}/commits/{last:010d}").first()[0] if last else None


def publish_results(df: DataFrame, path: str, as_of_year: int | None = None) -> str:
    """Replace the documents of df's runs in a store, all of them by one rename; returns the new version.

    Documents are refreshed first (as_of_year), then written to a folder of their own version, then a manifest says for
    every run of the store which version holds it (the last manifest without the new runs, and those; both sides are
    distributed). Nothing of this is seen until the commit, a complete small file that names the version, is renamed
    to the next number. A writer that fails before leaves folders that no commit names; one that was overtaken by
    another's commit fails at the rename, which never replaces a file. df has one row for each run_id."""
    spark = df.sparkSession
    folder, last, before = _commits(spark, path)
    version = uuid.uuid4().hex
    documents = refresh_results(df, as_of_year) if as_of_year else df
    documents.write.parquet(f"{path}/data/stored={version}")
    runs = spark.read.parquet(f"{path}/data/stored={version}").select("run_id", F.lit(version).alias("held"))
    if before is not None:
        old = spark.read.parquet(f"{path}/manifest/{before}")
        runs = old.join(runs, "run_id", "left_anti").unionByName(runs)
    runs.write.parquet(f"{path}/manifest/{version}")
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    ready = hadoop.Path(folder, f"_{version}")
    out = folder.getFileSystem(conf).create(ready, False)
    out.write(bytearray(version.encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)  # no overwriting
    hadoop.FileContext.getFileContext(folder.toUri(), conf).rename(ready, hadoop.Path(folder, f"{last + 1:010d}"), none)
    return version


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store as of its last commit; a write that is under way or failed is not seen."""
    version = _commits(spark, path)[2]
    if version is None:
        raise ValueError(f"no commit in {path}")
    newest = spark.read.parquet(f"{path}/data/stored={version}").schema
    manifest = spark.read.parquet(f"{path}/manifest/{version}").withColumnRenamed("run_id", "_run")
    data = spark.read.schema(StructType([*newest.fields, *StructType.fromDDL("stored string").fields])).parquet(f"{path}/data")
    return data.join(manifest, (F.col("_run") == F.col("run_id")) & (F.col("held") == F.col("stored")), "left_semi").drop("stored")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables of a job, in the one that driver and executors share (spark.checkpoint.dir); a session within one process may do without."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-store-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested structs as `parent.child` columns, arrays and maps as JSON text, missing as empty text."""
    def walk(kind, column, name):
        if isinstance(kind, StructType):
            return [x for f in kind.fields for x in walk(f.dataType, column[f.name], f"{name}.{f.name}")]
        value = F.to_json(column) if isinstance(kind, (ArrayType, MapType)) else column.cast("string")
        return [F.coalesce(value, F.lit("")).alias(name)]

    return df.select(*(x for f in df.schema.fields for x in walk(f.dataType, F.col(f"`{f.name}`"), f.name)))


def export_csv(cues: DataFrame, path: str) -> None:
    flat_columns(cues).write.mode("overwrite").option("header", True).csv(path)


def annotation_series(cues: DataFrame) -> DataFrame:
    """run_id, start_seconds, end_seconds, annotations in time order within a run. Times are microseconds."""
    rows = cues.select("run_id", (F.col("start_n") / 1e6).alias("start_seconds"), ((F.col("start_n") + F.col("duration_n")) / 1e6).alias("end_seconds"), cue_label(F.col("title"), F.col("artist")).alias("annotations"))
    return rows.repartition("run_id").sortWithinPartitions("run_id", "start_seconds", "end_seconds", "annotations")


def export_annotations(cues: DataFrame, path: str) -> None:
    annotation_series(cues).write.mode("overwrite").parquet(path)


def frame_segments(cues: DataFrame, videos: DataFrame) -> DataFrame:
    """run_id, start_frame, end_frame, label: times in frames, rounded half to even."""
    frame = lambda n: F.bround(n * F.col("fps") / 1e6).cast("long")
    return cues.join(videos, "run_id").select("run_id", frame(F.col("start_n")).alias("start_frame"), frame(F.col("start_n") + F.col("duration_n")).alias("end_frame"), cue_label(F.col("title"), F.col("artist")).alias("label"))
