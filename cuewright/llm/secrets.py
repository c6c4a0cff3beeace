"""Operator 2, secret scan with a randomness test battery. DataFrame functions only.

Base kinds are found by pattern: assign, access and hex. The method adds kind `random`: runs of 24 or more
characters of [A-Za-z0-9+/_-] and their padding which behave like random draws from their encoding's alphabet.
An equals sign is padding at a run's end only; inside name=value it parts two runs. For each run the encoding
is inferred (digits, hex, base32, base36, base62, base64, and mixed for what fits no narrower one, so that no
run is left untested) and three tests of "drawn at random" give p-values: chi-squared
uniformity over the alphabet (exact mean and variance of the multinomial, Wilson-Hilferty), runs above and
below the alphabet's middle, and serial correlation at lag 1; Fisher's method joins them. False discoveries
are held at level FDR on both sides, by Benjamini-Hochberg within each length class, so a short run, where
tests are weak, is not judged by the long ones' p-values:

* runs wrongly called structured, by the battery's joint p-value; runs called so are not reported;
* runs wrongly reported, that is names, paths and other written text, by a p-value under the text model below.
  A run that the battery rejects, that touches a base span, is too short for its alphabet, or is of letters
  alone or of one letter case only counts there with p = 1, so the level holds for what is reported.

The text model is a Markov chain of letters within words, counted over all documents (words of the runs
themselves left out, so a key repeated in a third of all rows does not teach the model; pairs are smoothed by
PAIR_PRIOR and EVEN). A run is read as pieces: lower-case, capitalised and upper-case words, numbers and separators, each kind
equally likely; a number goes on with probability 1/2. With P the run's probability as text and Q as independent
draws from its alphabet (all ALPHABETS equally likely), P(Q/P >= s) <= 1/s for text, so P/Q is a p-value; it needs
no approximation and holds for repeated and dependent runs too. Text that the chain fits badly, such as names without
vowels, lies outside that promise.

The Benjamini-Hochberg thresholds come from a histogram of p-values (1/20 of a decade, up to 1e-95) per length class, a
table of bounded size, so nothing is ranked or gathered; a threshold is a whole histogram step.

Positions are code points, end exclusive: each match is kept with the length of the gap before it, and a
running sum over a text's matches gives the places, so the work is linear in the text however dense its
matches are. A random span that touches a base span is left out: it is found already.

Defined cases: a null text counts as empty; a text without hits has zeros, the hash of the empty string and no
spans; very long texts and runs are searched and tested whole; rows with equal or null doc_ids get a row each;
an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

FDR = 0.01
_ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
_ACCESS = "AKIA[A-Z0-9]{16,}"
_HEX = "[0-9a-f]{24,}"
_RUN = "[A-Za-z0-9+/_-]{24,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the narrowest: name, pattern of the whole run, alphabet, least length that can be told from words.
ENCODINGS = (
    ("digits", "^[0-9]+$", _DIGITS, 32),
    ("hex", "^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdef", 24),
    ("base32", "^[A-Z2-7]+=*$", _UPPER + "234567", 32),
    ("base36", "^[a-z0-9]+$", _DIGITS + _UPPER.lower(), 24),
    ("base62", "^[A-Za-z0-9]+$", _DIGITS + _UPPER + _UPPER.lower(), 24),
    ("base64", "^[A-Za-z0-9+/]+={0,2}$", _UPPER + _UPPER.lower() + _DIGITS + "+/", 24),
    ("base64url", "^[A-Za-z0-9_-]+={0,2}$", _UPPER + _UPPER.lower() + _DIGITS + "-_", 24),
    ("mixed", "^[A-Za-z0-9+/_-]+=*$", _UPPER + _UPPER.lower() + _DIGITS + "+/-_", 24),
)


KINDS = ("assign", "access", "hex", "random")
#: Alphabets a key may be drawn from: the encodings', hex in two cases.
ALPHABETS = len(ENCODINGS) + 1
#: Added to each pair's count: this much, and this share of the mean count after the same letter.
PAIR_PRIOR, EVEN = 0.5, 0.25
LAST_STEP = 1900
_WORD = "[A-Z][a-z]+|[a-z]+|[A-Z]+(?![a-z])"
#: Symbols of the text model: a border of words, the letters, a digit, a separator.
_SYMBOLS = "^" + _UPPER.lower() + "0-"


def found(text: Column, pattern: str, rank: int) -> Column:
    """array<struct<rank, gap, value>> of the leftmost non-overlapping matches, in order; gap: characters since the match before."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda g, h: F.struct(F.lit(rank).alias("rank"), F.length(g).alias("gap"), h.alias("value")))
    return F.when(text.rlike(pattern), F.filter(pairs, lambda p: p["value"].isNotNull())).otherwise(F.array().cast("array<struct<rank:int,gap:int,value:string>>"))


def placed(hits: DataFrame) -> DataFrame:
    """row_no, rank, start, end, value of every match. hits: row_no, hits."""
    each = hits.filter(F.size("hits") > 0).select("row_no", F.posexplode("hits").alias("pos", "h")).select("row_no", "pos", "h.rank", "h.gap", "h.value")
    upto = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("row_no", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return each.select("row_no", "rank", (upto - F.length("value")).alias("start"), upto.alias("end"), "value")


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution (Abramowitz and Stegun 26.2.17, error under 1e-7; a bound far out)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(runs: DataFrame) -> DataFrame:
    """Adds encoding, p_chi, p_runs, p_serial and log_p (log10 of the joint p-value) to a table with column value."""
    core = F.regexp_replace("value", "=+$", "")
    encoding, alphabet, least = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, pattern, letters, shortest in reversed(ENCODINGS):
        fits = F.col("value").rlike(pattern)
        encoding, alphabet, least = (F.when(fits, new).otherwise(old) for new, old in ((F.lit(name), encoding), (F.lit(letters), alphabet), (F.lit(shortest), least)))
    told = runs.select("*", encoding.alias("encoding"), alphabet.alias("alphabet"), least.alias("least"), core.alias("core"))
    text = F.when(F.col("encoding") == "hex", F.lower("core")).otherwise(F.col("core"))
    told = told.withColumn("x", F.transform(F.split(text, ""), lambda c: F.instr(F.col("alphabet"), c) - 1))
    told = told.withColumn("x", F.filter("x", lambda v: v >= 0)).withColumn("n", F.size("x").cast("double")).withColumn("k", F.length("alphabet").cast("double"))  # every run has 24 symbols at least; a filter here would be pushed down into the lambda
    total = lambda of, f: F.aggregate(of, F.lit(0.0), lambda s, v: s + f(v))
    n, k = F.col("n"), F.col("k")
    # chi-squared from the squared counts, scaled to its exact variance, then Wilson-Hilferty
    squares = F.aggregate(F.array_distinct("x"), F.lit(0.0), lambda s, v: s + F.pow(F.size(F.filter("x", lambda u: u == v)).cast("double"), F.lit(2.0)))
    chi = (squares * k / n - n - (k - 1)) / F.sqrt((n - 1) / n) + (k - 1)
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
    # Wald-Wolfowitz runs above and below the middle of the alphabet
    above = total("x", lambda v: (v * 2 >= k).cast("double"))
    below = n - above
    pairs = F.zip_with(F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.size("x") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    turns = F.aggregate(pairs, F.lit(1.0), lambda s, p: s + ((p["a"] * 2 >= k) != (p["b"] * 2 >= k)).cast("double"))
    expected = 2 * above * below / n + 1
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    z_runs = F.when((above == 0) | (below == 0), F.lit(8.0)).otherwise(F.abs(turns - expected) / spread)
    # serial correlation at lag 1
    mean = total("x", lambda v: v.cast("double")) / n
    told = told.select("*", z_chi.alias("z_chi"), z_runs.alias("z_runs"), mean.alias("mean"), pairs.alias("pairs"))
    variance = total("x", lambda v: F.pow(v - F.col("mean"), F.lit(2.0)))
    moved = F.aggregate("pairs", F.lit(0.0), lambda s, p: s + (p["a"] - F.col("mean")) * (p["b"] - F.col("mean")))
    z_serial = F.when(variance == 0, F.lit(8.0)).otherwise(F.abs((moved / variance + 1 / n) * F.sqrt(n)))
    floor = lambda p: F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-30))
    told = told.select("*", floor(upper_tail(F.col("z_chi"))).alias("p_chi"), floor(2 * upper_tail(F.col("z_runs"))).alias("p_runs"), floor(2 * upper_tail(z_serial)).alias("p_serial"))
    # Fisher: -2 ln(p1 p2 p3) has a chi-squared distribution with six degrees of freedom, whose tail is closed
    half = -(F.log("p_chi") + F.log("p_runs") + F.log("p_serial"))
    return told.select("*", ((F.log(1 + half + half * half / 2) - half) / F.log(F.lit(10.0))).alias("log_p")).drop("x", "pairs", "mean", "alphabet", "core")


def word_pairs(docs: DataFrame) -> DataFrame:
    """pair, n: two neighbouring letters, or a letter and a word's border (^), over all words of all texts outside the runs.

    A word weighs as many as its count has binary digits, so that the commonest words and copied texts don't rule.
    At most 728 rows. Outside the runs a word has 23 letters at most."""
    words = docs.select(F.explode(F.regexp_extract_all(F.regexp_replace(F.coalesce("text", F.lit("")), _RUN, " "), F.lit(f"({_WORD})"), F.lit(1))).alias("word"))
    counted = words.groupBy(F.lower("word").alias("word")).agg(F.length(F.bin(F.count(F.lit(1)))).alias("n"))
    framed = counted.select(F.concat(F.lit("^"), "word", F.lit("^")).alias("word"), "n")
    pairs = framed.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("pair"), "n")
    return pairs.groupBy("pair").agg(F.sum("n").alias("n"))


def text_costs(pairs: dict[str, int]) -> list[float]:
    """ln of the text model's probability of each symbol after each, row by row over _SYMBOLS; 0 for what cannot follow."""
    letters, size = _SYMBOLS[:27], len(_SYMBOLS)
    table = [0.0] * size * size
    for i, a in enumerate(letters):
        seen = [(j, pairs.get(a + b, 0)) for j, b in enumerate(letters) if (a, b) != ("^", "^")]
        even = PAIR_PRIOR + EVEN * sum(n for _, n in seen) / len(seen)
        follow = [(j, n + even) for j, n in seen]
        whole = sum(n for _, n in follow)
        for j, n in follow:
            table[i * size + j] = math.log(n / whole) - (math.log(5) if i == 0 else 0)  # five kinds of pieces
    table[27] = -math.log(5 * 10)
    table[28] = -math.log(5 * 4)
    table[27 * size + 27] = -math.log(2 * 10)
    table[27 * size] = -math.log(2)
    return table


def log_text(core: Column, costs: list[float]) -> Column:
    """ln of the probability of a run's characters under the text model."""
    marked = F.lower(F.regexp_replace(core, f"({_WORD}|[0-9]+|[+/_-])", "^$1"))
    plain = F.translate(marked, "123456789+/_", "000000000---")
    x = F.transform(F.split(plain, ""), lambda c: F.instr(F.lit(_SYMBOLS), c) - 1)
    x = F.filter(x, lambda v: v >= 0)
    steps = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.get(F.lit(costs), a * len(_SYMBOLS) + b))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def thresholds(tested: DataFrame, level: float = FDR) -> DataFrame:
    """length_class, cut: the null hypothesis is rejected for runs whose p-value lies in this histogram step or below."""
    # at most 64 length classes of at most 1,900 steps
    steps = tested.groupBy("length_class", "step").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("length_class")
    ranked = steps.select("length_class", "step", F.sum("n").over(w.orderBy(F.desc("step"))).alias("upto"), F.sum("n").over(w).alias("m"))
    # step s holds p in (10^(-(s+1)/20), 10^(-s/20)]: its upper end is compared
    return ranked.filter(F.pow(F.lit(10.0), -F.col("step") / 20) <= F.col("upto") * level / F.col("m")).groupBy("length_class").agg(F.min("step").alias("cut"))


def scan_secrets(docs: DataFrame, level: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: one row per row of docs (needs doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(*(found(text, pattern, rank) for rank, pattern in enumerate((_ASSIGN, _ACCESS, _HEX, _RUN))))
    rows = stage(docs.select("doc_id", F.monotonically_increasing_id().alias("row_no"), every.alias("hits")), "secret-hits")  # the matches only: a small part of the texts
    spans = placed(rows.select("row_no", "hits")).filter((F.col("rank") > 0) | (F.length(F.regexp_extract("value", _ASSIGN, 2)) >= 6))
    # the base spans that end last before a run and start first after it
    base, text_of = F.col("rank") < 3, Window.partitionBy("row_no")
    ended = F.max(F.when(base, F.col("end"))).over(text_of.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    begun = F.min(F.when(base, F.col("start"))).over(text_of.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    spans = stage(spans.select("*", (F.coalesce(ended <= F.col("start"), F.lit(True)) & F.coalesce(begun >= F.col("end"), F.lit(True))).alias("clear")), "secret-spans")
    costs = text_costs({r.pair: r.n for r in word_pairs(docs.select("text")).collect()})  # at most 728 rows
    runs = stage(battery(spans.filter(~base)).withColumn("log_text", log_text(F.regexp_replace("value", "=+$", ""), costs)).select(
        "row_no", "start", "end", F.floor(2 * F.log2("n")).cast("int").alias("length_class"), F.floor(-20 * F.col("log_p")).cast("int").alias("step"),
        ((F.col("n") * F.log("k") + F.log(F.lit(ALPHABETS)) + F.col("log_text")) / F.log(F.lit(10.0))).alias("log_q"),
        (F.col("clear") & (F.col("n") >= F.col("least")) & F.col("value").rlike("[0-9]") & (F.col("value").rlike("[A-Za-z]") | (F.col("encoding") == "digits"))).alias("eligible")), "secret-runs")
    structured = stage(thresholds(runs, level), "secret-structured")  # at most 64 rows, as the next
    drawn = F.col("eligible") & (F.col("step") < F.coalesce("cut", F.lit(1 << 30)))
    text_step = F.when(drawn, F.greatest(F.lit(0.0), F.least(F.floor(-20 * F.col("log_q")).cast("double"), F.lit(float(LAST_STEP))))).otherwise(0).cast("int")
    judged = stage(runs.join(F.broadcast(structured), "length_class", "left").select("row_no", "start", "end", "length_class", text_step.alias("step")), "secret-judged")
    unwritten = stage(thresholds(judged, level), "secret-unwritten")
    random = judged.join(F.broadcast(unwritten), "length_class").filter(F.col("step") >= F.col("cut"))
    kept = spans.filter(base).select("row_no", "rank", "start", "end").unionByName(random.select("row_no", F.lit(3).alias("rank"), "start", "end"))
    listed = kept.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("all"), *(F.count_if(F.col("rank") == r).alias(f"n_{k}") for r, k in enumerate(KINDS)))  # a text's own spans
    names = F.array(*map(F.lit, KINDS))
    said = lambda found: F.array_join(F.transform(found, lambda h: F.concat_ws(":", F.get(names, h["rank"]), h["start"].cast("string"), h["end"].cast("string"))), ",")
    told = listed.select("row_no", *(f"n_{k}" for k in KINDS), said(F.filter("all", lambda h: h["rank"] < 3)).alias("base"), said(F.col("all")).alias("spans"))
    told = stage(told, "secret-told")
    joined = rows.select("doc_id", "row_no").join(told, "row_no", "left")
    n = {k: F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS}
    blank = lambda c: F.coalesce(c, F.lit(""))
    return joined.select("doc_id", n["assign"], n["access"], n["hex"], F.sha2(blank("base").cast("binary"), 256).alias("base_sha256"), blank("spans").alias("spans"), n["random"])


def op2_secret_battery(spark, sf_dir: str) -> DataFrame:
    """Contract query over documents."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
