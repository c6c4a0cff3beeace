"""Scalar functions over titles, names, years and links; every one is Column -> Column and stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _ascii_forms() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition leaves ASCII: those that leave one character, and ligatures of Latin letters."""
    single, several = {}, {}
    for c in map(chr, (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x2190), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F))):
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single[c] = plain
        elif plain.isalpha():
            several[c] = plain
    return single, several


_SINGLE, _SEVERAL = _ascii_forms()
#: What each character of a name becomes in one pass: letters and digits in lower case, every other ASCII mark a space.
_NAME = {c: p.lower() if p.isalnum() else " " for c, p in {**{c: c for c in map(chr, range(128))}, **_SINGLE}.items()}
#: A ligature. The range comes first: most characters are not in it and skip the slow look through the list.
_LIGATURE = f"[{min(_SEVERAL)}-{max(_SEVERAL)}&&[{''.join(_SEVERAL)}]]"


def missing(c: Column | str) -> Column:
    """Null for the empty string."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def parse_year(c: Column) -> Column:
    """The first four digits in a row, as a year."""
    return missing(F.regexp_extract(c.cast("string"), "[0-9]{4}", 0)).cast("int")


def to_year_int(c: Column) -> Column:
    """A hand-typed year; null if it is no whole number."""
    return F.trim(c.cast("string")).try_cast("int")


def _plain(c: Column, keep: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), keep, " "))


def track_key(title: Column, artist: Column) -> Column:
    """Title and artist without case and punctuation, joined by a bar; null without a title. Accents stay."""
    part = lambda c: _plain(c, "[^\\p{L}\\p{N}_]+")
    return F.when(missing(title).isNotNull(), F.concat_ws("|", part(title), part(artist)))


def norm_title(c: Column) -> Column:
    """Comparison form of a title: no bracketed parts, guest credits or remaster notes; ASCII letters and digits only."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "\\([^)]*\\)", " "), "\\[[^\\]]*\\]", " ")
    # any word that begins with feat, as the original has it ("Feather" too); neither cut goes beyond the end of a line
    t = F.regexp_replace(t, "(?<![\\p{L}\\p{N}_])feat[^\\n]*(?=\\n?\\z)", " ")
    t = F.regexp_replace(t, "(?U)-\\s*remaster[^\\n]*(?=\\n?\\z)", " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def norm_artist(c: Column) -> Column:
    """Comparison form of the first-named artist."""
    a = F.lower(F.coalesce(c, F.lit("")))
    for mark in (",", "&", " feat"):
        a = F.substring_index(a, mark, 1)
    return F.trim(F.regexp_replace(a, "[^a-z0-9]+", " "))


def norm_name(c: Column) -> Column:
    """Accents and compatibility forms folded to ASCII, lower case, every other mark a space; what has no ASCII form is dropped."""
    c = F.coalesce(c, F.lit(""))
    spelled = c
    for ligature, letters in _SEVERAL.items():
        spelled = F.replace(spelled, F.lit(ligature), F.lit(letters))
    plain = lambda x: F.translate(x, "".join(_NAME), "".join(_NAME.values()))
    folded = F.regexp_replace(plain(F.when(c.rlike(_LIGATURE), spelled).otherwise(c)), "[^\\x00-\\x7F]+", "")
    return F.trim(F.when(c.rlike("[^\\x00-\\x7F]"), folded).otherwise(plain(c)))


def isrc_key(c: Column) -> Column:
    return missing(F.upper(F.trim(c)))


def cue_label(title: Column, artist: Column) -> Column:
    return F.when(missing(title).isNull(), F.lit("Unidentified music")).when(missing(artist).isNull(), title).otherwise(F.concat_ws(" — ", title, artist))


def display_year(original: Column, release: Column) -> Column:
    """struct(year, is_hint): the original year, else the release year as a hint."""
    return F.struct(F.coalesce(original, release).alias("year"), (original.isNull() & release.isNotNull()).alias("is_hint"))


def clean_url(c: Column) -> Column:
    """Only http(s) links; an Apple Music link keeps its origin, path and `i` parameter."""
    web = F.when(F.lower(c).rlike("^https?://"), c)
    origin = F.regexp_extract(c, "^[^/]+//[^/?#]+[^?#]*", 0)
    song = F.regexp_extract(c, "[?&]i=([^&#]*)", 1)
    apple = F.when(song != "", F.concat(origin, F.lit("?i="), song)).otherwise(origin)
    return F.when(F.lower(c).rlike("^https?://music\\.apple\\.com/"), apple).otherwise(web)


def duration_text(seconds: Column) -> Column:
    """`Xm Y.Ys`, or `Y.Ys` under a minute."""
    minutes = F.floor(seconds / 60)
    rest = F.format_string("%.1fs", seconds - minutes * 60)
    return F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), rest)).otherwise(rest)


def entity_page_url(c: Column) -> Column:
    """Page of an entity URI that ends in Q and digits."""
    q = missing(F.regexp_extract(c, "(Q[0-9]+)$", 1))
    return F.when(q.isNotNull(), F.concat(F.lit("https://www.wikidata.org/wiki/"), q))


def confidence_class(title: Column, count: Column) -> Column:
    return F.when(missing(title).isNull() | count.isNull(), F.lit(None)).when(count >= 3, "high").when(count == 2, "medium").otherwise("low")


def softmax(logits: Column) -> Column:
    """Probabilities, shifted by the largest logit."""
    powers = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda s, x: s + x))


def label_score(probs: Column, label_ids: list[int]) -> Column:
    """Summed probability of the wanted labels."""
    return sum((F.coalesce(F.get(probs, F.lit(i)), F.lit(0.0)) for i in label_ids), F.lit(0.0))


def top_classes(probs: Column, k: int, labels: Column | None = None) -> Column:
    """The k most likely labels with their probabilities (4 digits), most likely first, ties by label number."""
    ranked = F.slice(F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("minus"), i.alias("label_id")))), 1, k)
    name = (lambda i: F.get(labels, i)) if labels is not None else (lambda i: i)
    return F.transform(ranked, lambda r: F.struct(name(r["label_id"]).alias("label"), F.round(-r["minus"], 4).alias("prob")))
