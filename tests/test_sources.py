"""Saved results: reading, migration, writing and exports; and the registry's contract."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cuewright.plans import registry
from cuewright.sources import results as S


def write(tmp_path, run, name, doc):
    (tmp_path / run).mkdir(exist_ok=True)
    (tmp_path / run / name).write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=1))


def test_read_migrate_and_skip_broken(spark, tmp_path):
    write(tmp_path, "a", "results.json", {"video_name": "v", "rate_limited": True, "cues": [{"segment_id": "seg_001", "start": 0.0, "duration": 5.0, "conditioning": "vocals_removed", "confidence": 0.5}, {"segment_id": "seg_002", "title": "t", "provider": "p", "candidates": [{"title": "t", "score": 80.0}, {"title": "u", "score": 60.0}, {"title": "t", "score": 80.0}]}]})
    write(tmp_path, "b", "results.json", {"version": 6, "cues": []})
    write(tmp_path, "c", "results.json", "{ broken")
    got = {r.run_id: r for r in S.read_results(spark, str(tmp_path / "*" / "results.json")).collect()}
    assert set(got) == {"a", "b"} and all(r.version == 6 for r in got.values())
    first, second = got["a"].cues
    assert first.pending and not second.pending and got["a"].settings.isolation is True
    assert [(x.title, x.score, x.windows) for x in second.alternatives] == [("t", 80.0, 1), ("u", 60.0, 1)]


def test_a_current_document_is_kept_whole(spark, tmp_path):
    cue = {"segment_id": "seg_001", "start": 1.5, "duration": 9.0, "pending": False, "provider": "acrcloud", "title": "T", "artist": "A", "agreement": {"count": 2, "total": 3, "providers": ["acrcloud", "audd"]},
           "candidates": [{"title": "T", "score": 80.0}, {"title": "U", "score": 70.0}], "alternatives": [{"provider": "audd", "title": "T", "score": None, "windows": 4}],
           "enrichment": {"composer": "C", "authors": [{"name": "C", "roles": ["composer"], "birth_year": 1800, "death_year": 1860}], "sources": ["musicbrainz"], "original_year": 1850}, "temporal_pick": False}
    write(tmp_path, "r", "results.json", {"version": 6, "rate_limited": True, "settings": {"isolation": False}, "cues": [cue]})
    S.write_results(S.read_results(spark, str(tmp_path / "*" / "results.json")), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).first().asDict(recursive=True)
    keep = lambda now, was: {k: [keep(a, b) if isinstance(b, dict) else a for a, b in zip(now[k], v, strict=True)] if isinstance(v, list) else keep(now[k], v) if isinstance(v, dict) else now[k] for k, v in was.items()}
    assert keep(back["cues"][0], cue) == cue and back["settings"]["isolation"] is False and back["version"] == 6


def test_alternatives_of_old_votes(spark, tmp_path):
    """A vote's own candidates, else for one source the cue's, else the vote; a song named twice counts once."""
    vote = {"provider": "acrcloud", "matched": True, "title": "v"}
    cues = [{"votes": [vote, {"provider": "audd", "matched": True, "title": "w"}, {"provider": "shazam", "matched": False, "title": "x"}], "candidates": [{"title": "c", "score": 1.0}, {"title": "c", "score": 2.0}]},
            {"votes": [vote | {"candidates": [{"title": "own"}]}], "candidates": [{"title": "c"}]}, {"votes": [vote]}, {"title": "alone"}]
    write(tmp_path, "r", "results.json", {"version": 4, "cues": [{"segment_id": f"s{i}", **c} for i, c in enumerate(cues)]})
    got = S.read_results(spark, str(tmp_path / "*" / "results.json")).first().cues
    assert [[(a.provider, a.title, a.score) for a in c.alternatives] if c.alternatives else None for c in got] == [[("acrcloud", "c", 1.0), ("audd", "w", None)], [("acrcloud", "own", None)], [("acrcloud", "v", None)], None]
    assert all(c.pending is None for c in got)


def test_timeline_from_either_document(spark, tmp_path):
    write(tmp_path, "a", "timeline.json", {"waveform": {"samples": [0.5], "duration": 1.0}})
    write(tmp_path, "a", "results.json", {"version": 6, "cues": []})
    write(tmp_path, "b", "results.json", {"version": 3, "cues": [], "waveform": {"samples": [0.1], "duration": 2.0}})
    got = {r.run_id: r for r in S.read_timeline(spark, str(tmp_path / "*" / "timeline.json"), str(tmp_path / "*" / "results.json")).collect()}
    assert got["a"].waveform.samples == [0.5] and got["b"].waveform.duration == 2.0


def test_writing_replaces_only_its_runs(spark, tmp_path):
    path = str(tmp_path / "out")
    S.write_results(spark.createDataFrame([("a", 1), ("b", 1)], "run_id string, n int"), path)
    S.write_results(spark.createDataFrame([("a", 2)], "run_id string, n int"), path)
    assert sorted((r.run_id, r.n) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("r", 12_500_000, 30_000_000, "T", "A"), ("r", 100_000_000, 5_000_000, None, None)], "run_id string, start_n long, duration_n long, title string, artist string")
    rows = S.annotation_series(df).collect()
    assert [(r.start_seconds, r.end_seconds, r.annotations) for r in rows] == [(12.5, 42.5, "T — A"), (100.0, 105.0, "Unidentified music")]
    frames = S.frame_segments(df, spark.createDataFrame([("r", 24.0)], "run_id string, fps double"))
    assert sorted((r.start_frame, r.end_frame) for r in frames.collect()) == [(300, 1020), (2400, 2520)]
    nested = spark.createDataFrame([(1, (2, None), [1, 2])], "a int, b struct<c:int,d:string>, e array<int>")
    S.export_csv(nested, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["a", "b.c", "b.d", "e"] and back.first()["e"] == "[1,2]"


def test_every_query_has_its_twin():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def whole_document():
    """Every field that a saved run can have."""
    song = {"title": "T", "artist": "A", "album": "L", "release_year": 1990, "isrc": "I1", "genre": "g", "photo_url": "p", "youtube_link": "y", "spotify_url": "s", "apple_music_url": "a", "song_link": "l", "musicbrainz_recording_id": "m", "musicbrainz_url": "u"}
    author = {"name": "C", "roles": ["composer"], "birth_year": 1800, "death_year": 1860, "wikidata_url": "w"}
    enrichment = {"composer": "C", "composer_birth_year": 1800, "composer_death_year": 1860, "work_title": "W", "original_year": 1850, "composer_match": "isrc", "authors": [author], "latest_author_death_year": 1860, "authors_complete": True, "authors_partial": False, "public_domain": True, "sources": ["musicbrainz"]}
    vote = {"provider": "acrcloud", "matched": True, "error": "e", **song, "score": 1.0, "candidates": [{**song, "score": 2.0}]}
    cue = {"segment_id": "seg_001", "start": 1.5, "duration": 9.0, "audio_file": "f.wav", "pending": False, "provider": "acrcloud", **song, "agreement": {"count": 2, "total": 3, "providers": ["acrcloud", "audd"]}, "votes": [vote], "candidates": [{**song, "score": 3.0}],
           "alternatives": [{"provider": "audd", **song, "score": 4.0, "windows": 4, "anachronistic": False}], "enrichment": enrichment, "temporal_pick": False, "anachronistic": False, "track_key": "t|a"}
    film = {"title": "F", "year": 1950, "director": "D", "director_death_year": 1990, "imdb_id": "tt1", "tmdb_id": 7, "media_type": "movie", "music_composer": "M", "sources": ["tmdb", "wikidata"]}
    settings = {"classifier": "K", "threshold": 0.2, "window": 10.23, "hop": 5.0, "bridge_gap": 0.0, "isolation": False, "max_segment_duration": 30.0}
    video = {"file": "v.mp4", "filmstrip": {"count": 24, "thumb_width": 160, "thumb_height": 90, "duration": 12.5}, "fps": 24.0}
    return {"version": 6, "source": "v.mp4", "video_name": "v_1", "film": film, "providers": ["acrcloud", "audd"], "settings": settings, "video": video, "cues": [cue]}


def bare(x):
    """Without the fields that are null."""
    return {k: bare(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [bare(v) for v in x] if isinstance(x, list) else x


def test_a_whole_document_survives(spark, tmp_path):
    doc = whole_document()
    write(tmp_path, "r", "results.json", doc)
    read = S.read_results(spark, str(tmp_path / "*" / "results.json"))
    assert bare(read.drop("run_id").first().asDict(recursive=True)) == doc
    S.publish_results(read, str(tmp_path / "store"))
    assert bare(S.read_published(spark, str(tmp_path / "store")).drop("run_id").first().asDict(recursive=True)) == doc


def test_settings_of_old_documents_keep_their_other_fields(spark, tmp_path):
    write(tmp_path, "r", "results.json", {"version": 2, "settings": {"hop": 5.0}, "cues": [{"title": "Song", "pending": False, "conditioning": "original"}]})
    got = S.read_results(spark, str(tmp_path / "*" / "results.json")).first()
    assert bare(got.settings.asDict()) == {"hop": 5.0, "isolation": False}


def test_publishing_is_one_commit(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    docs = lambda title, *runs: spark.createDataFrame([(r, title) for r in runs], "run_id string, title string")
    now = lambda: sorted((r.run_id, r.title) for r in S.read_published(spark, store).collect())
    with pytest.raises(ValueError):
        S.read_published(spark, store)
    S.publish_results(docs("one", "a", "b"), store)
    assert now() == [("a", "one"), ("b", "one")]
    S.publish_results(docs("two", "b", "c"), store)
    assert now() == [("a", "one"), ("b", "two"), ("c", "two")]
    # a write that fails half-way, after some of its documents are on disk
    broken = docs("three", "a", "b").unionByName(docs("x", "d").withColumn("title", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        S.publish_results(broken, store)
    assert now() == [("a", "one"), ("b", "two"), ("c", "two")]
    # a reader between the data and the commit, and a writer that another one overtakes
    seen, commits = [], S._commits
    def overtaken(session, path):
        folder, last, before = commits(session, path)
        monkeypatch.setattr(S, "_commits", commits)
        S.publish_results(docs("four", "a"), store)
        seen.append(now())
        return folder, last, before
    monkeypatch.setattr(S, "_commits", overtaken)
    with pytest.raises(Exception, match="exist"):
        S.publish_results(docs("five", "a"), store)
    assert seen == [[("a", "four"), ("b", "two"), ("c", "two")]] and now() == seen[0]


def test_refreshed_documents(spark, tmp_path):
    doc = whole_document()
    cue = doc["cues"][0]
    cue["enrichment"]["authors"][0]["death_year"] = 2000
    cue["enrichment"]["original_year"] = 1960
    cue["alternatives"][0]["release_year"] = 1952
    doc["cues"].append({**cue, "segment_id": "seg_002", "title": "Other!", "enrichment": {"public_domain": True}, "alternatives": None})
    write(tmp_path, "r", "results.json", doc)
    first, second = S.refresh_results(S.read_results(spark, str(tmp_path / "*" / "results.json")), 2026).first().cues
    assert (first.anachronistic, first.alternatives[0].anachronistic, first.enrichment.public_domain, first.enrichment.latest_author_death_year) == (True, False, False, 2000)
    assert (second.track_key, second.anachronistic, second.enrichment.public_domain, second.alternatives) == ("other|a", True, True, None)


def test_annotations_are_exported(spark, tmp_path):
    cues = spark.createDataFrame([("r", 5_000_000, 1_000_000, "t", None), ("r", 0, 2_500_000, None, None)], "run_id string, start_n long, duration_n long, title string, artist string")
    S.export_annotations(cues, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("r", 0.0, 2.5, "Unidentified music"), ("r", 5.0, 6.0, "t")]
