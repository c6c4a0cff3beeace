"""Hand edits, chosen songs and resumed answers, merged into saved cues by (run_id, segment_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions.text import missing

KEY = ["run_id", "segment_id"]


def apply_edits(saved: DataFrame, edited: DataFrame, fields: tuple[str, ...] = ("title", "artist", "album")) -> tuple[DataFrame, DataFrame]:
    """(cues, rejects). An edited list replaces a run's cues: unlisted ones go, analysis columns stay as saved.

    A run with an unknown or repeated segment is rejected whole and keeps its saved cues; likewise one with fields
    of the wrong type, if edited has `wrong` (typed_edits), their names."""
    wrong = F.max("wrong") if "wrong" in edited.columns else F.lit(None).cast("string")
    counted = edited.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), wrong.alias("_wrong"), *(F.min(f).alias(f"_{f}") for f in fields))
    checked = counted.join(saved.select(*KEY, F.lit(True).alias("_known")), KEY, "left")
    reason = F.when(F.col("_known").isNull(), "unknown segment").when(F.col("_n") > 1, "repeated segment").when(F.col("_wrong").isNotNull(), F.concat("_wrong", F.lit(" of the wrong type")))
    rejects = checked.withColumn("reason", reason).filter("reason is not null").select(*KEY, "reason")
    bad = rejects.select("run_id").distinct()
    good = checked.join(bad, "run_id", "left_anti").drop("_n", "_known", "_wrong")
    touched = edited.select("run_id").distinct().join(bad, "run_id", "left_anti")
    kept = saved.join(touched, "run_id", "left_anti").withColumn("edited", F.lit(False))
    new = saved.join(good, KEY).withColumn("edited", F.lit(True)).withColumns({f: F.col(f"_{f}") for f in fields}).drop(*(f"_{f}" for f in fields))
    return kept.unionByName(new), rejects


#: What a hand edit may change, and the kind that each must be.
EDITED_TYPES = {"title": "STRING", "artist": "STRING", "album": "STRING", "enrichment": "OBJECT"}


def typed_edits(edits: DataFrame, types: dict[str, str] = EDITED_TYPES) -> DataFrame:
    """run_id, segment_id, a text for each field that is one, new_composer, and wrong: the fields of another type, or null.

    edits: run_id, edit (VARIANT, or JSON text): a cue as it was typed, with its segment_id. A field that is absent or
    null is right; what cannot be read is a cue of an unknown segment. Nothing is cast that could fail: the kind of a
    field is that of the value in the document, so "5" is a text and 5 is none."""
    doc = F.try_parse_json("edit") if dict(edits.dtypes)["edit"] == "string" else F.col("edit")
    read = edits.select("run_id", doc.alias("_d"))
    kind = lambda f: F.regexp_extract(F.schema_of_variant(F.try_variant_get("_d", f"$.{f}", "variant")), "^[A-Z]+", 0)
    text = lambda f, path: F.when(kind(f) == ("STRING" if path == f else "OBJECT"), F.try_variant_get("_d", f"$.{path}", "string"))
    bad = F.array_compact(F.array(*(F.when(F.coalesce(~kind(f).isin(k, "VOID"), F.lit(False)), F.lit(f)) for f, k in types.items())))
    texts = [text(f, f).alias(f) for f, k in types.items() if k == "STRING"]
    return read.select("run_id", text("segment_id", "segment_id").alias("segment_id"), *texts, text("enrichment", "enrichment.composer").alias("new_composer"), F.when(F.size(bad) > 0, F.array_join(bad, ", ")).alias("wrong"))


def replace_composer(cues: DataFrame) -> DataFrame:
    """A hand-typed composer (column new_composer) replaces the composer among authors, without dates; the set becomes partial."""
    new = missing(F.trim("new_composer"))
    changed = F.col("new_composer").isNotNull() & ~new.eqNullSafe(F.col("composer"))
    others = F.filter("authors", lambda a: ~F.array_contains(a["roles"], "composer"))
    none = F.lit(None).cast("int")
    entry = F.array(F.struct(new.alias("name"), F.array(F.lit("composer")).alias("roles"), none.alias("birth_year"), none.alias("death_year")))
    authors = F.when(new.isNull(), others).otherwise(F.concat(entry, others))
    swap = lambda yes, no: F.when(changed, yes).otherwise(no)
    return cues.withColumns({"authors": swap(authors, F.col("authors")), "composer_birth_year": swap(none, F.col("composer_birth_year")), "composer_death_year": swap(none, F.col("composer_death_year")), "authors_partial": swap(F.lit(True), F.col("authors_partial")), "composer": swap(new, F.col("composer"))}).drop("new_composer")


def choose_song(cues: DataFrame, choices: DataFrame, fields: tuple[str, ...] = ("title", "artist")) -> tuple[DataFrame, DataFrame]:
    """(cues, rejects). choices: run_id, segment_id, idx (an alternative's place from 0), typed_title, typed_artist.

    All song fields are replaced, what the song lacks becomes null; temporal_pick is false and enrichment null."""
    asked = cues.join(choices, KEY)
    song = F.try_element_at("alternatives", F.col("idx") + 1)
    typed = missing(F.trim("typed_title"))
    ok = F.when(F.col("idx").isNotNull(), (F.col("idx") >= 0) & (F.col("idx") < F.size("alternatives"))).otherwise(typed.isNotNull())
    own = {"title": typed, "artist": missing(F.trim("typed_artist"))}
    new = {f: F.when(F.col("idx") >= 0, song[f]).otherwise(own.get(f, F.lit(None).cast(dict(cues.dtypes)[f]))) for f in fields}
    extra = {"temporal_pick": F.lit(False)} | ({"enrichment": F.lit(None).cast(dict(cues.dtypes)["enrichment"])} if "enrichment" in cues.columns else {})
    taken = asked.filter(ok).withColumns(new | extra).select(*dict.fromkeys([*cues.columns, "temporal_pick"]))
    missing_cue = choices.join(cues.select(*KEY), KEY, "left_anti").select(*KEY).withColumn("reason", F.lit("unknown segment"))
    rejects = asked.filter(~ok).select(*KEY).withColumn("reason", F.lit("no such song")).unionByName(missing_cue)
    rest = cues.join(asked.filter(ok).select(*KEY), KEY, "left_anti")
    return rest.unionByName(taken, allowMissingColumns=True), rejects


def resume_merge(saved: DataFrame, changes: DataFrame, fields: tuple[str, ...] = ("title", "artist")) -> DataFrame:
    """Answers of a resume into the cues as they are now. changes: key, outcome (answered, gone or failed), fields.

    Only cues that were asked again and are still pending change: one answered with a title takes the answer; one
    answered without, or whose audio is gone, is no longer pending and keeps what it has, a title typed meanwhile
    too; a failed one stays pending. What is no longer pending has no audio_file (if there is such a column).
    Applying the same changes twice changes nothing more."""
    told = saved.join(changes.select(*KEY, "outcome", *(F.col(f).alias(f"_{f}") for f in fields)), KEY, "left")
    done = F.coalesce(F.col("pending") & F.col("outcome").isin("answered", "gone"), F.lit(False))
    named = done & F.coalesce((F.col("outcome") == "answered") & missing("_title").isNotNull(), F.lit(False))
    cols = {f: F.when(named, F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}
    if "audio_file" in saved.columns:
        cols["audio_file"] = F.when(~done, F.col("audio_file"))
    return told.withColumns(cols | {"pending": F.col("pending") & ~done}).drop("outcome", *(f"_{f}" for f in fields))
