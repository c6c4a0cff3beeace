"""Operators 11 to 13 against plain versions, with the edge cases of each."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from cuewright.llm import divergence, resample, url_rules

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n long, weight long, score long"
WORDS = "Alpha beta GAMMA délta été ночь 東京 x1 42 the The of a b c d e".split()


def corpus():
    rng = random.Random(9)
    texts = [None, "", " .,- ", "one", "w" * 70 + " " + "Q" * 1000 + "-" + "é" * 200, "Ünï" * 300, "a_b\x00c\x7fd"] + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(160)]
    texts.append(" ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(40_000)))
    texts += [texts[20]] * 12
    return [(i, t, rng.choice(["en", "en", "de", None, ""]), "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", "é", None, "z"]), i, i, i) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("reach", [1, 2, 7, 64])
def test_position_crc(reach):
    data = np.random.default_rng(3).integers(0, 256, 20_000, dtype=np.uint8)
    rng = random.Random(2)
    spans = [(a, a + rng.choice([1, 2, 7, 8, 63, 64, 65, 128, 129, 4000])) for a in (rng.randrange(15_000) for _ in range(200))]
    got = resample.PositionCrc(reach)(data, *map(np.array, zip(*spans, strict=True)))
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in spans]


def plain_features(text, runs):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("runs,buckets,slice_", [(1, 10_000, 1 << 20), (3, 97, 50)])
def test_resampling(spark, docs, monkeypatch, runs, buckets, slice_):
    monkeypatch.setattr(resample, "SLICE", slice_)
    target = ["the ночь 東京 delta", None, "", "the of alpha"]
    told = {i: plain_features(t, runs) for i, t, *_ in corpus()}
    count = lambda lists: collections.Counter(zlib.crc32(f.encode()) % buckets for x in lists for f in x)
    s, t = count(f for _, f in told.values()), count(plain_features(x, runs)[1] for x in target)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    want = {}
    for i, (n, f) in told.items():
        weight = sum(gain(zlib.crc32(x.encode()) % buckets) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        want[i] = (n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))))
    able = sorted((-x[3], i) for i, x in want.items() if x[0] >= 20)
    rank = {i: r + 1 for r, (_, i) in enumerate(able[: 10 * len(able) // 100])}
    got = resample.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), buckets=buckets, runs=runs).collect()
    assert len(rank) > 3 and {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in got} == {i: (*x[1:], rank.get(i)) for i, x in want.items()}


def test_resampling_edges(spark, empty):
    twice = "a b c d e f g h i j " * 3
    rows = [(5, twice, None, None, 0, 0, 0)] * 30 + [(None, twice, None, None, 0, 0, 0)] * 10 + [(7, None, None, None, 0, 0, 0)]
    got = resample.resample(spark.createDataFrame(rows, SCHEMA), empty).collect()
    assert len(got) == 41 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    assert {(r.n_features, r.weight, r["rank"]) for r in got if r.doc_id == 7} == {(0, 0, None)}
    assert resample.resample(empty, empty).count() == 0


URLS = [None, "", "no scheme", "http://", "http://net", "http://a.net/", "https://A.Example.NET/en/x?u=/de/", "http://example.net/EN/", "http://notexample.net/en/", "http://example.com/de/#/fr/", "http://example.org/fr/a", "http://org/fr/", "http://x.org/fr",
        "http://u@spam-farm.example.com/", "http://SPAM-x.com:80/ADS/y", "http://ads.com/ads/", "http://b.com/banner", "http://b.com/bannerx", "http://b.com/a/click1.html", "http://casino-museum.com/", "http://x.com/about/ads/1", "http://x-casino.com/a\nb", "a://b://c.net/", "http://é.net/ß", "http://free-bets.com", "http://cheap-pills.com?x=.^"]


def plain_judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
    fits = [(h + p, a) for a, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits, key=lambda x: len(x[0])), None
    own = []
    for action, pattern in url_rules.PATTERNS:
        regex = "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}.get(c, re.escape(c)) for c in pattern.removeprefix("||").removesuffix("|"))
        if host and re.search((r"\A(?:[^/]*\.)?" if pattern.startswith("||") else "") + regex + (r"\Z" if pattern.endswith("|") else ""), host + path, re.S | re.I):
            own.append((action, -len(pattern), pattern))
    best = min(own, default=("allow", 0, None))
    return host, path, None, best[0], best[2]


@pytest.mark.parametrize("small,salt", [(200_000, 1_000_000), (0, 3)])
def test_url_rules(spark, monkeypatch, small, salt):
    """By broadcast, and by shuffle with salted tokens; some rows are repeated, other columns clash."""
    monkeypatch.setattr(url_rules, "SALT_ROWS", salt)
    urls = URLS * 4
    pages = spark.createDataFrame([(i // 2, u, "h", "t", i) for i, u in enumerate(urls)], "page_id long, url string, host string, token string, rank long").repartition(3)
    got = url_rules.judge(pages, url_rules.rule_table(spark), small=small).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, ((r.page_id, r.host, r.path, r.rule, r.verdict, r.pattern) for r in got)), key=key) == sorted(((i // 2, *plain_judge(u)) for i, u in enumerate(urls)), key=key)
    assert {r.verdict for r in got} == {"allow", "block"} and {r.pattern for r in got} >= {"/ads/*", "^banner^", "/about/ads/*", "||spam-*.*^", "-casino.", None}


def test_url_rules_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (None, "http://b.com/y")], "page_id long, url string")
    assert {(r.page_id, r.verdict) for r in url_rules.judge(pages, url_rules.rule_table(spark, (), ())).collect()} == {(1, "allow"), (None, "allow")}
    assert url_rules.judge(pages.limit(0), url_rules.rule_table(spark)).count() == 0
    # a rule without a literal token is asked of every address; one without pattern and host of none
    odd = spark.createDataFrame([("*y*", "block", 1, None, None, "*y*"), ("none", "block", 0, None, None, None), ("a.com", "allow", 0, "a.com", None, None)], "rule string, action string, tier int, host string, path string, pattern string")
    assert {(r.page_id, r.verdict, r.rule, r.pattern) for r in url_rules.judge(pages, odd).collect()} == {(1, "allow", "a.com", None), (None, "block", None, "*y*")}


def test_rules_are_posted_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://www.shop{i}.com/en/item") for i in range(50)] + [(99, "http://www.rare.com/en/item")], "page_id long, url string")
    table = url_rules.compile_rules(url_rules.rule_table(spark, (("block", "www.rare.com", "/en/"),), (("block", "/en/rareish*"), ("block", "||*.com/en/"))))
    addresses = pages.select(url_rules.tokens_of(pages.url).alias("tokens"))
    assert {r.rule: r.token for r in url_rules.postings(table, addresses).collect()} == {"www.rare.com/en/": "rare", "/en/rareish*": "en", "||*.com/en/": "com"}


def plain_audit(rows, least, top):
    seen, docs_of, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))
        groups.add((lang, source))
        seen[lang, source].update(found)
        docs_of[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs_of[lang].items() if n >= least]
        own = sorted(s for x, s in groups if x == lang)
        whole = {t: sum(seen[lang, s][t] for s in own) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(seen[lang, s]) for s in own}, share(whole)
        for s in own:
            far = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            out |= {(lang, s, "pair", o, -v, r + 1) for r, (v, _, o) in enumerate(far)}
            more = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if seen[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, r + 1) for r, (v, _, t) in enumerate(more[:top])}
    return out


@pytest.mark.parametrize("least,top,terms,piece", [(30, 50, 400_000, 1 << 20), (3, 4, 10, 16), (10**6, 50, 400_000, 1 << 20)])
def test_divergence(docs, monkeypatch, least, top, terms, piece):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "PIECE", piece)
    got = {tuple(r) for r in divergence.audit(docs, least, top).collect()}
    want = plain_audit(corpus(), least, top)
    assert got == want and any(x[2] == "pair" for x in want)


@pytest.mark.parametrize("block,terms", [(1, 3), (2, 5), (64, 1024)])
def test_distances_in_blocks(docs, block, terms):
    counts, groups = divergence.prepared(docs, 5)
    got = {tuple(r) for r in divergence.pair_ranks(counts, groups, block, terms).collect()}
    assert got == {(lang, s, o, v, r) for lang, s, part, o, v, r in plain_audit(corpus(), 5, 1) if part == "pair"}


def test_divergence_ties_and_edges(spark, empty):
    """A thousand terms of one value: the first fifty in UTF-8 order; a language with one source has no pairs."""
    text = " ".join(f"w{a}{b}é" for a in "abcdefghijklmnopqrstuvwxyzéü" for b in "abcdefghijklmnopqrstuvwxyzß日")
    rows = [(i, text, "en", "one", 0, 0, 0) for i in range(3)] + [(9, "other " * 50 + "wéaé", "en", "two", 0, 0, 0)] * 3 + [(8, "x", "de", "only", 0, 0, 0)]
    got = {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA), 3).collect()}
    assert got == plain_audit(rows, 3, 50) and len(got) > 51
    assert divergence.audit(empty).count() == 0
