"""Golden values and naive sequential models of the operators."""

import collections
import random
import re
import time
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.operators import answers as A
from cuewright.operators import cues as C
from cuewright.operators import catalog as K
from cuewright.operators import edits as E
from cuewright.operators import films as M
from cuewright.operators import intervals as I  # noqa: E741
from cuewright.operators import ranking as R
from cuewright.operators import rights as L
from cuewright.operators import windows as S
from cuewright.operators.extension import score_with


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("n,w,step,starts", [(26, 10, 8, [0, 8, 16]), (5, 10, 8, []), (10, 10, 5, [0]), (25_100, 10_230, 5_000, [0, 5_000, 10_000, 14_870])])
def test_tail_windows(spark, n, w, step, starts):
    df = S.tail_windows(spark.createDataFrame([("r", n)], "run_id string, n long"), w, step)
    assert [r.start_n for r in df.orderBy("win_idx").collect()] == starts


def slots_of(spark, n, w, hop, hits, step=None):
    starts = [i * (step or hop) for i in range(len(hits))]
    data = [("r", s, s + w, 0.5 if h else 0.1, h) for s, h in zip(starts, hits, strict=True)]
    scored = spark.createDataFrame(data, "run_id string, start_n long, end_n long, score double, is_hit boolean")
    return S.slot_votes(scored, spark.createDataFrame([("r", n)], "run_id string, n long"), hop)


@pytest.mark.parametrize("n,w,hop,hits,want", [
    (20, 10, 5, [0, 1, 0], [0, 0, 0, 0]), (25, 10, 5, [0, 1, 1, 0], [0, 0, 1, 0, 0]),
    (200, 100, 25, [1, 1, 0, 1, 1], [1, 1, 0, 1, 1, 0, 1, 1]), (230, 100, 50, [1, 1, 1, 1], None)])
def test_slot_votes(spark, n, w, hop, hits, want):
    hits = [bool(h) for h in hits]
    if want is None:  # the last slot is the rest
        scored = spark.createDataFrame([("r", s, s + 100, 0.5, True) for s in (0, 50, 100, 130)], "run_id string, start_n long, end_n long, score double, is_hit boolean")
        out = S.slot_votes(scored, spark.createDataFrame([("r", n)], "run_id string, n long"), hop)
        assert max((r.start_n, r.end_n) for r in out.collect()) == (200, 230)
        return
    out = slots_of(spark, n, w, hop, hits)
    assert [r.is_hit for r in out.orderBy("slot").collect()] == [bool(x) for x in want]


@pytest.mark.parametrize("runs,w,want", [([(5, 25), (40, 60)], 15, [(5, 20), (10, 25), (40, 55), (45, 60)]), ([(5, 15)], 15, [(5, 15)]), ([(5, 35)], 15, [(5, 20), (20, 35)]), ([(5, 35)], None, [(5, 35)])])
def test_cut_runs(spark, runs, w, want):
    df = spark.createDataFrame([("r", a, b) for a, b in runs], "run_id string, start_n long, end_n long")
    assert rows(S.cut_runs(df, w), "start_n", "end_n") == want


def test_group_answers_keeps_the_rules(spark):
    """Random runs: groups are runs of neighbouring clips, as large as the rules allow and no larger."""
    rng, data = random.Random(3), []
    for run in range(600):
        t = 0
        for i in range(rng.randint(1, 14)):
            t += rng.choice([0, 0, 5, 12])
            title = rng.choice([None, "X", "Y", "X"])
            data.append((f"r{run}", i, t, t + 10, title, rng.choice([None, "a"]), title is None and rng.random() < 0.3))
            t += 10
    df = spark.createDataFrame(data, "run_id string, clip_idx long, start_n long, end_n long, title string, artist string, skipped boolean")
    groups = {}
    for r in C.group_answers(df, 10).orderBy("run_id", "clip_idx").collect():
        groups.setdefault(r.run_id, []).append(r)
    song = lambda c: (c.title, c.artist) if c.title else None
    joins = lambda a, b: song(a) == song(b) and b.start_n - a.end_n <= 10 and not a.skipped and not b.skipped
    assert sum(map(len, groups.values())) == len(data)
    bridged = 0
    for clips in groups.values():
        assert [c.clip_idx for c in clips] == list(range(len(clips)))
        numbers = [c.group_idx for c in clips]
        assert numbers == sorted(numbers)
        for a, b in zip(clips, clips[1:], strict=False):
            assert a.group_idx == b.group_idx or not joins(a, b)
        own = [[c for c in clips if c.group_idx == g] for g in sorted(set(numbers))]
        for group in own:
            named = [c for c in group if song(c)]
            if named:  # one song, from the first clip to the last, with gaps that the rule allows
                assert len({song(c) for c in named}) == 1 and song(group[0]) and song(group[-1])
                assert all(b.start_n - a.end_n <= 10 for a, b in zip(named, named[1:], strict=False))
                bridged += len(named) < len(group)
            else:
                assert all(joins(a, b) for a, b in zip(group, group[1:], strict=False))
        for a, b, c in zip(own, own[1:], own[2:], strict=False):  # nothing is left that could be bridged
            assert song(b[0]) or not song(a[0]) or song(a[0]) != song(c[0]) or c[0].start_n - a[-1].end_n > 10
    assert bridged > 5


def votes_df(spark, votes):
    return spark.createDataFrame([(1, 0, p, i + 1, t, a, isrc, t is not None, link) for i, (p, t, a, isrc, link) in enumerate(votes)], "run_id long, clip_idx long, provider string, prio int, title string, artist string, isrc string, matched boolean, link string")


@pytest.mark.parametrize("votes,count,title,isrc,link", [
    ([("acr", "A", "x", None, None), ("sh", "A (Live)", "x", None, None), ("au", "a", "X & y", None, None)], 3, "A", None, None),
    ([("acr", "B", "x", None, None), ("sh", "A", "x", None, "l"), ("au", "A", "x", "I1", None)], 2, "A", "I1", "l"),
    ([("acr", "A", "x", None, None), ("sh", "B", "x", None, None), ("au", "C", "x", None, None)], 1, "A", None, None),
    ([("acr", "A", "x", "q1", None), ("sh", "B", "y", " Q1 ", None), ("au", None, None, None, None)], 2, "A", "q1", None),
    ([("acr", None, None, None, None), ("sh", None, None, None, None)], 0, None, None, None)])
def test_vote_consensus(spark, votes, count, title, isrc, link):
    r = A.vote_consensus(votes_df(spark, votes), fields=("link",)).first()
    assert (r.agreement, r.title, r.isrc, r.link, r.total) == (count, title, isrc, link, len(votes))


@pytest.mark.parametrize("film,cands,want", [
    (1971, [("a", 2022, 90.0), ("b", 1817, 70.0)], "b"), (1971, [("a", 2022, 90.0), ("b", 1817, 10.0)], "a"), (1971, [("a", 2022, 90.0), ("b", 1900, 55.0), ("c", 1850, 80.0)], "c"),
    (1971, [("a", 2022, 90.0), ("b", 1974, 60.0)], "b"), (1971, [("a", 2022, 90.0), ("b", 1975, 60.0)], "a"), (None, [("a", 2022, 90.0), ("b", 1817, 70.0)], "a"), (1971, [("a", 1965, 90.0), ("b", 1817, 70.0)], "a")])
def test_date_rerank(spark, film, cands, want):
    df = spark.createDataFrame([(film, cands[0][0], cands[0][1], cands)], "film_year int, title string, release_year int, candidates array<struct<title:string,release_year:int,score:double>>")
    r = R.date_rerank(df).first()
    assert (r.title, r.temporal_pick) == (want, want != "a")


@pytest.mark.parametrize("authors,partial,now,domain,presumed", [
    ([(None, 1945), (None, 1946)], False, 2026, True, None), ([(None, 1948), (None, 1957)], False, 2026, False, None), ([(None, 1945), (None, None)], False, 2026, None, None),
    ([(None, 1956)], False, 2026, False, None), ([(None, 1956)], False, 2027, True, None), ([(1855, None)], False, 2026, None, True), ([(1856, None)], False, 2026, None, False),
    ([(1800, None), (1900, None)], False, 2026, None, False), ([(None, 1940), (1850, None)], False, 2026, None, True), ([(None, 1980), (1850, None)], False, 2026, False, None),
    ([(None, 1850)], True, 2026, None, None), ([(1800, None)], True, 2026, None, None), ([], False, 2026, None, None)])
def test_rights(spark, authors, partial, now, domain, presumed):
    df = spark.createDataFrame([(authors, partial)], "a array<struct<birth_year:int,death_year:int>>, p boolean")
    r = L.rights_verdict(df, "a", "p", now).first()
    assert (r.public_domain, r.pd_presumption) == (domain, presumed)


@pytest.mark.parametrize("film,orig,rel,death,composer,artist,want", [(1950, 1960, None, None, None, None, True), (1950, 1925, 2020, None, None, None, False), (1950, 1953, None, None, None, None, False), (1950, None, 2020, None, None, None, True), (1950, None, 1939, None, None, None, False), (1950, None, 2020, 1949, None, None, False), (1950, None, 2020, None, "Max Steiner and Bo", "Orchestra Max Steiner", False), (None, None, 2020, None, None, None, False)])
def test_anachronistic(spark, film, orig, rel, death, composer, artist, want):
    df = spark.createDataFrame([(film, orig, rel, death, composer, artist, None)], "film_year int, original_year int, release_year int, composer_death_year int, music_composer string, artist string, composer string")
    assert R.anachronistic(df).first().anachronistic is want


def test_text(spark):
    df = spark.createDataFrame([("La Cumparsita!", "Matos  Rodríguez", "Ernö Rapée", 'Cornfield Chase (From "X")', "No Time To Die - Remastered 2021", "from 1999-05", "https://music.apple.com/a/b?uo=1&i=7#t")], "t string, a string, n string, c string, d string, y string, u string")
    r = df.select(T.track_key(F.col("t"), F.col("a")).alias("k"), T.norm_name(F.col("n")).alias("n"), T.norm_title(F.col("c")).alias("c"), T.norm_title(F.col("d")).alias("d"), T.parse_year(F.col("y")).alias("y"), T.clean_url(F.col("u")).alias("u"), T.duration_text(F.lit(75.25)).alias("s"), T.entity_page_url(F.lit("http://x/Q42")).alias("q"), T.to_year_int(F.lit("x")).alias("b"), T.to_year_int(F.lit(" 1950 ")).alias("i")).first()
    assert (r.k, r.n, r.c, r.d, r.y, r.u) == ("la cumparsita|matos rodríguez", "erno rapee", "cornfield chase", "no time to die", 1999, "https://music.apple.com/a/b?i=7")
    assert (r.s, r.q, r.b, r.i) == ("1m 15.3s", "https://www.wikidata.org/wiki/Q42", None, 1950)


def test_name_of_every_character(spark):
    """Against Python's decomposition, for each character that has an ASCII form, each that has none, and each ASCII mark."""
    chars = [chr(c) for c in (*range(0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x2190), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), 0x300, 0x416, 0x4E2D, 0x1F600)]
    forms = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in chars}
    chars = [c for c in chars if len(forms[c]) < 2 or forms[c].isalpha()]  # fractions and other marks of several characters are dropped
    chars += [f"x{''.join(chars)}Y", "\u0132 \u2122\ufb03", "  A-b\n", ""]
    want = [re.sub("[^a-z0-9 ]", " ", "".join(forms.get(c, c) for c in t).lower()).strip(" ") for t in chars]
    got = [r.n for r in spark.createDataFrame(list(enumerate(chars)), "i int, t string").select("i", T.norm_name(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == want
    assert spark.createDataFrame([(None,)], "t string").select(T.norm_name(F.col("t"))).first()[0] == ""


def test_name_costs_no_look_through_a_list_for_each_character(spark):
    """Long texts, some with accents and a ligature: no more than three times one replacement of the marks."""
    text = "Some plain words, and then a few more of them. " * 400
    df = spark.createDataFrame([(text + end,) for end in ["", "é", "\u2019", "\ufb01"] * 50], "t string").coalesce(1).cache()
    df.count()

    def seconds(column):
        def once():
            began = time.perf_counter()
            df.select(column.alias("n")).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - began

        return min(once() for _ in range(4))

    assert seconds(T.norm_name(F.col("t"))) < 3 * seconds(F.regexp_replace(F.lower("t"), "[^a-z0-9 ]", " "))
    df.unpersist()


def test_peaks(spark):
    x = [0.0] * 4000
    x[250], x[3999] = -0.5, 0.25
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(x)], "run_id string, idx long, x double")
    got = {r.point_idx: r.peak for r in S.peak_envelope(df, 1000).collect()}
    assert len(got) == 20 and got[1] == 1.0 and got[19] == 0.5


def test_intervals(spark):
    df = spark.createDataFrame([("r", 0, 10, "a"), ("r", 10, 15, "a"), ("r", 20, 30, "b"), ("r", 22, 25, "a")], "run_id string, start_n long, end_n long, title string")
    assert rows(I.interval_union(df), "start_n", "end_n") == [(0, 15), (20, 30)]
    assert rows(I.coalesce_titles(df, 3), "start_n", "end_n", "title") == [(0, 15, "a"), (20, 30, "b"), (22, 25, "a")]


def test_edits_reject_whole_runs(spark):
    saved = spark.createDataFrame([("r", "s1", "t", None, None), ("r", "s2", "t", None, None), ("q", "s1", "t", None, None)], "run_id string, segment_id string, title string, artist string, album string")
    edited = spark.createDataFrame([("r", "s1", "new", None, None), ("q", "zz", "x", None, None)], saved.schema)
    cues, rejects = E.apply_edits(saved, edited)
    assert rows(cues, "run_id", "segment_id", "title") == [("q", "s1", "t"), ("r", "s1", "new")]
    assert rows(rejects, "run_id", "segment_id", "reason") == [("q", "zz", "unknown segment")]


def test_composer_edit(spark):
    df = spark.createDataFrame([("Old", 1800, 1850, False, [Row(name="Old", roles=["composer"], birth_year=1800, death_year=1850), Row(name="Co", roles=["lyricist"], birth_year=1, death_year=2)], "New")], "composer string, composer_birth_year int, composer_death_year int, authors_partial boolean, authors array<struct<name:string,roles:array<string>,birth_year:int,death_year:int>>, new_composer string")
    r = E.replace_composer(df).first()
    assert [a.name for a in r.authors] == ["New", "Co"] and r.composer_death_year is None and r.authors_partial


def test_scorer(spark):
    df = spark.createDataFrame([("r", 0, 10)], "run_id string, start_n long, end_n long")
    r = score_with(df, lambda: lambda b: pd.DataFrame({"score": b["end_n"] * 0.1, "probs": [[0.5, 0.5]] * len(b)})).first()
    assert r.score == 1.0 and r.probs == [0.5, 0.5]


@pytest.fixture(scope="module")
def stretches(spark):
    """Random intervals of one long run and of short ones, some reaching over many others, with titles and verdicts."""
    rng, data = random.Random(8), []
    for run, n in (("long", 3000), ("a", 1), ("b", 40)):
        t = 0
        for i in range(n):
            t += rng.choice([1, 1, 1, 2, 9])
            data.append((run, t, t + (rng.randint(100, 400) if rng.random() < 0.01 else rng.randint(1, 8)), rng.choice(["x", "x", "x", "x", "y", None]), rng.random() < 0.8))
    return spark.createDataFrame(data, "run_id string, start_n long, end_n long, title string, is_hit boolean").repartition(6).cache()


@pytest.mark.parametrize("chunk", [1, 7, 50, 100_000])
def test_chunks_equal_one_window(stretches, chunk):
    same = lambda a, b: (a.exceptAll(b.select(*a.columns)).count(), a.count()) == (0, b.count())
    assert same(S.hit_runs(stretches, 2), S.hit_runs(stretches, 2, chunk))
    assert same(S.verdict_spans(stretches), S.verdict_spans(stretches, chunk))
    assert same(I.interval_union(stretches), I.interval_union(stretches, chunk))
    assert same(I.coalesce_titles(stretches, 1), I.coalesce_titles(stretches, 1, chunk))


def test_one_long_run_uses_all_tasks(spark):
    """Ten million slots of one run: no task of the two-phase form sorts more than a few chunks."""
    slots = spark.range(10_000_000).select(F.lit("r").alias("run_id"), F.col("id").alias("start_n"), (F.col("id") + 1).alias("end_n"), (F.pmod(F.hash("id"), F.lit(1000)) > 0).alias("is_hit"))
    runs = S.hit_runs(slots, 0, 100_000)
    want = slots.filter("not is_hit").count()
    got = runs.agg(F.count(F.lit(1)).alias("n"), F.sum("n_slots").alias("s"), F.sum(F.col("end_n") - F.col("start_n")).alias("len")).first()
    assert abs(got.n - want) <= want * 0.01 and got.s == got.len == 10_000_000 - want
    dealt = slots.filter("is_hit").groupBy("run_id", S.chunk_of("start_n", 100_000)).count().repartition(8, "run_id", "floor((start_n / 100000))")
    assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() == 8


def test_dyadic_postings(spark):
    rng = random.Random(4)
    spans = [("r", i, a, a + rng.choice([1, 5, 60, 5_000, 10**7]), rng.randint(0, 2)) for i, a in enumerate(rng.randrange(-10**6, 10**6) for _ in range(300))] + [("r", 900, 5, 5, 0)]
    points = [("r" if i % 9 else "s", i, rng.randrange(-10**6, 10**6)) for i in range(500)]
    s = spark.createDataFrame(spans, "run_id string, held_by long, start_n long, end_n long, priority long")
    p = spark.createDataFrame(points, "run_id string, point_id long, t long")
    most = I.postings(s, 10).groupBy("held_by", "start_n", "end_n").count().collect()
    assert all(r["count"] <= 2 * np.log2((r.end_n - r.start_n) / 10 + 2) + 1 for r in most) and len(most) == 300
    got = {r.point_id: r.held_by for r in I.stab_lookup(p, s, 10).collect()}
    best = lambda run, t: min(((x[4], x[2], x[3], x[1]) for x in spans if x[0] == run and x[2] <= t < x[3]), default=(None,) * 4)
    ties = collections.Counter((x[4], x[2], x[3]) for x in spans)
    assert set(got) == {i for _, i, _ in points}
    assert all(got[i] == best(run, t)[3] or ties[best(run, t)[:3]] > 1 for run, i, t in points) and sum(v is not None for v in got.values()) > 100
    assert I.stab_lookup(p, s.limit(0), 10).filter("held_by is not null").count() == 0


@pytest.mark.parametrize("fine", [4, 64])
def test_peaks_of_stretches(spark, fine):
    """Blocks smaller and larger than a stretch, and a remainder that is dropped."""
    rng, data = random.Random(6), []
    for run, n in (("a", 1), ("b", 37), ("c", 1000), ("d", 5003)):
        data += [(run, i, rng.uniform(-1, 1)) for i in range(n)]
    want = {}
    for run in "abcd":
        x = [abs(v) for r, _, v in data if r == run]
        points = min(60_000, max(1, round(len(x) / 100 * 5)), len(x))
        block = max(1, len(x) // points)
        tops = [max(x[i * block : (i + 1) * block]) for i in range(len(x) // block)]
        want |= {(run, i): round(t / max(tops), 3) for i, t in enumerate(tops)}
    got = {(r.run_id, r.point_idx): r.peak for r in S.peak_envelope(spark.createDataFrame(data, "run_id string, idx long, x double").repartition(5), 100, fine=fine).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 0.0011 for k in want)


FILM_SOURCE = "media_type string, id long, rank long, imdb_id string, title string, year int, director string, director_death_year int, music_composer string"


def test_film_cascade_asks_only_for_what_is_open(spark):
    films = spark.createDataFrame([("movie", 1, 1, "tt1", "One", 1950, "D", 1980, None), ("tv", 1, 1, "tt9", "One", 1960, None, None, "M"), ("movie", 2, 2, "tt2", "Two", 1951, None, None, None), ("tv", 3, 3, "tt2", "Two", None, None, None, None)], FILM_SOURCE)
    hints = spark.createDataFrame([(1, 1, "tt2", "Two", None, None), (2, 77, "tt2", "One", None, None), (3, 77, "tt77", "One", None, None), (4, None, None, "One", 1960, None), (5, 1, None, None, None, "tv"), (6, 2, "tt2", "Two", None, "tv"), (7, None, "tt77", "None", None, None)],
                                  "hint_id long, tmdb_id long, imdb_id string, title string, year int, media_type string")
    got = {r.hint_id: (r.found_by, r.media_type, r.tmdb_id) for r in M.primary_film(hints, films).collect()}
    assert got == {1: ("id", "movie", 1), 2: ("imdb", "movie", 2), 3: ("title", "movie", 1), 4: ("title", "tv", 1), 5: ("id", "tv", 1), 6: ("imdb", "tv", 3)}
    seen = {}
    def step(name, ids):
        def run(rest):
            seen[name] = sorted(r.hint_id for r in rest.collect())
            return rest.filter(F.col("hint_id").isin(ids)).select("hint_id")
        return name, run
    found = M.cascade(hints, "hint_id", [step("a", [1, 2]), step("b", [2, 3]), step("c", [7])])
    assert seen == {"a": [1, 2, 3, 4, 5, 6, 7], "b": [3, 4, 5, 6, 7], "c": [4, 5, 6, 7]}
    assert sorted((r.hint_id, r.found_by) for r in found.collect()) == [(1, "a"), (2, "a"), (3, "b"), (7, "c")]


def test_film_resolve(spark):
    films = spark.createDataFrame([("movie", 1, 1, "tt1", "One", 1950, "D", 1980, "M"), ("movie", 2, 2, "tt2", "Two", None, None, None, None), ("tv", 3, 3, "tt3", "Three", 1999, None, None, None)], FILM_SOURCE)
    second = spark.createDataFrame([("tt1", "wrong", 1, "x", 1, 1), ("tt2", "wrong", 1951, "E", None, 2), ("tt3", "x", 1, "x", 1, 3), ("tt5", "Five", 1955, "F", 1990, 4)], "imdb_id string, title string, year int, director string, director_death_year int, rank long")
    third = spark.createDataFrame([("tt2", "third", 1, "x", 1970), ("tt5", "third", 1, "x", 1), ("tt6", "Six", 1956, None, None)], "imdb_id string, title string, year int, director string, director_death_year int")
    hints = spark.createDataFrame([(1, 1, None, None, None, None), (2, 2, None, None, None, None), (3, 3, None, None, None, "tv"), (5, None, None, "Five", None, None), (6, 66, "tt6", None, None, "movie"), (7, 8, "tt8", "Lost", None, None)], "hint_id long, tmdb_id long, imdb_id string, title string, year int, media_type string")
    got = {r.hint_id: tuple(r)[1:-2] + (",".join(r.sources),) for r in M.film_resolve(hints, films, second, third).collect()}
    assert got == {
        1: ("One", 1950, "D", 1980, "tt1", 1, "movie", "M", "first"), 2: ("Two", 1951, "E", 1970, "tt2", 2, "movie", None, "first,second,third"), 3: ("Three", 1999, None, None, "tt3", 3, "tv", None, "first"),
        5: ("Five", 1955, "F", 1990, "tt5", None, None, None, "second"), 6: ("Six", 1956, None, None, "tt6", 66, "movie", None, "third"), 7: (None, None, None, None, "tt8", 8, None, None, "")}


@pytest.mark.parametrize("said,want", [(["match", "auth_error"], "auth_error"), (["no_match", "match", "error"], "match"), (["no_match", "rate_limited"], "no_match"), (["error", "rate_limited"], "rate_limited"), (["error", "error"], "error"), ([None], "error")])
def test_clip_outcomes(spark, said, want):
    r = A.clip_outcomes(spark.createDataFrame([("r", 0, o) for o in said], "run_id string, clip_idx long, outcome string")).first()
    assert (r.outcome, r.asked, r.answered) == (want, len(said), sum(o in ("match", "no_match") for o in said))


@pytest.mark.parametrize("clips,want", [
    (["match", "no_match"], ("complete", 2, 0, None, None)), (["match", "error", "match"], ("partial", 2, 1, None, None)), (["match", "rate_limited", "match", "auth_error"], ("limited", 1, 3, 1, None)),
    (["match", "auth_error", "rate_limited"], ("failed", 0, 0, None, 1)), (["rate_limited"], ("limited", 0, 1, 0, None))])
def test_run_outcomes(spark, clips, want):
    df = spark.createDataFrame([("r", i, o) for i, o in enumerate(clips)], "run_id string, clip_idx long, outcome string")
    assert tuple(A.run_outcomes(df).first())[1:] == want


def test_typed_edits(spark):
    docs = ['{"segment_id": "s1", "title": "x", "artist": null}', '{"segment_id": "s2", "title": 5, "album": [1]}', '{"segment_id": "s3", "enrichment": {"composer": "N"}}', '{"segment_id": "s4", "enrichment": "n"}', "[1]", "broken {", '{"segment_id": 7}']
    got = [tuple(r) for r in E.typed_edits(spark.createDataFrame([("r", d) for d in docs], "run_id string, edit string")).collect()]
    assert got == [("r", "s1", "x", None, None, None, None), ("r", "s2", None, None, None, None, "title, album"), ("r", "s3", None, None, None, "N", None), ("r", "s4", None, None, None, None, "enrichment"), *[("r", None, None, None, None, None, None)] * 3]
    saved = spark.createDataFrame([("r", "s2", "old", None, None), ("q", "s1", "old", None, None)], "run_id string, segment_id string, title string, artist string, album string")
    edits = E.typed_edits(spark.createDataFrame([("r", docs[1]), ("q", docs[0])], "run_id string, edit string").select("run_id", F.parse_json("edit").alias("edit")))
    cues, rejects = E.apply_edits(saved, edits)
    assert rows(cues, "run_id", "segment_id", "title") == [("q", "s1", "x"), ("r", "s2", "old")]
    assert rows(rejects, "run_id", "segment_id", "reason") == [("r", "s2", "title, album of the wrong type")]


def test_resume_keeps_what_was_typed_meanwhile(spark):
    saved = spark.createDataFrame([("r", s, "typed by hand", "me", True, "f.wav") for s in ("answered", "empty", "gone", "failed", "other")], "run_id string, segment_id string, title string, artist string, pending boolean, audio_file string")
    changes = spark.createDataFrame([("r", "answered", "answered", "T", None), ("r", "empty", "answered", None, None), ("r", "gone", "gone", None, None), ("r", "failed", "failed", "x", "x")], "run_id string, segment_id string, outcome string, title string, artist string")
    once = E.resume_merge(saved, changes)
    want = {"answered": ("T", None, False, None), "empty": ("typed by hand", "me", False, None), "gone": ("typed by hand", "me", False, None), "failed": ("typed by hand", "me", True, "f.wav"), "other": ("typed by hand", "me", True, "f.wav")}
    for merged in (once, E.resume_merge(once, changes)):
        assert {r.segment_id: (r.title, r.artist, r.pending, r.audio_file) for r in merged.collect()} == want


def test_names_without_letters_count_for_nothing(spark):
    works = spark.createDataFrame([(1, "W", 1), (2, "W", 2)], "work_id long, title string, rank long")
    authors = spark.createDataFrame([(1, [("Дмитрий",)]), (2, [("Ann Bo",)])], "work_id long, authors array<struct<name:string>>")
    cues = spark.createDataFrame([(1, "W", "Ann & Bob"), (2, "W", "Bo, Ann"), (3, "W", "&"), (4, "W", "Дмитрий")], "cue_id long, title string, artist string")
    assert rows(K.work_by_title(cues, works, authors), "cue_id", "work_id", "score") == [(2, 2, 1)]


@pytest.mark.parametrize("title,want", [("A feat. B", "a"), ("A Feather Song", "a"), ("defeat", "defeat"), ("a_feat b", "a feat b"), ("A feat\nb", "a feat b"), ("A\nfeat b", "a"), ("a feat b\n", "a"), ("A - Remastered 2011", "a"), ("[a (b] c)", "a"), ("été feat x", "t"), (None, "")])
def test_norm_title(spark, title, want):
    assert spark.createDataFrame([(title,)], "t string").select(T.norm_title(F.col("t"))).first()[0] == want


def test_look_up_of_cues_without_a_track(spark):
    cues = spark.createDataFrame([("r", 1, None, "i1"), ("r", 2, None, "i2"), ("r", 3, "k", None), ("r", 4, "k", "i4"), ("q", 5, None, None)], "run_id string, seq long, track_key string, isrc string")
    asked = []
    def lookup(first):
        asked.extend(sorted(r.seq for r in first.collect()))
        return first.select("run_id", "track_key", F.col("isrc").alias("found"))
    got = {r.seq: r.found for r in K.enrich_once(cues, lookup).collect()}
    assert asked == [1, 4] and got == {1: "i1", 2: "i1", 3: None, 4: "i4", 5: None}


def test_a_scorer_is_loaded_once_a_worker(spark, tmp_path):
    """Sixty tasks, at most one load for each Python worker with a name; without one, one for each task."""
    folder = str(tmp_path)
    def load():
        import os
        import uuid
        open(f"{folder}/{os.getpid()}-{uuid.uuid4()}", "w").close()
        return lambda b: pd.DataFrame({"score": b["start_n"] * 1.0, "probs": [[1.0]] * len(b)})
    df = spark.range(0, 600, 1, 60).select(F.lit("r").alias("run_id"), F.col("id").alias("start_n"))
    assert score_with(df, load, "model 1").agg(F.sum("score")).first()[0] == 600 * 599 / 2
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert 1 <= len(loads) == len(set(loads)) <= 24
    score_with(df, load).count()
    score_with(df, load).agg(F.sum("score")).first()
    assert len(list(tmp_path.iterdir())) >= len(loads) + 60


def test_songs_of_clips_without_votes(spark):
    song = "struct<title:string,artist:string,isrc:string,album:string,release_year:int,score:double>"
    data = [("r", "s", 0, "own", "t", None, None, None, None, None, [], [("c", None, None, None, None, 1.0)]), ("r", "s", 1, "own", "t", None, None, None, None, None, None, None), ("r", "s", 2, "own", None, None, None, None, None, None, [], [])]
    vote = f"array<struct<provider:string,matched:boolean,title:string,artist:string,isrc:string,album:string,release_year:int,score:double,candidates:array<{song}>>>"
    df = spark.createDataFrame(data, f"run_id string, segment_id string, clip_idx long, provider string, title string, artist string, isrc string, album string, release_year int, score double, votes {vote}, candidates array<{song}>")
    assert rows(C.named_songs(df), "clip_idx", "provider", "title", "score") == [(0, "own", "c", 1.0), (1, "own", "t", None)]
