"""Operator 12, URL filters: pattern rules found by their rarest literal token.

A rule is a row (rule, action, tier, host, path, pattern): either a host with a path's beginning, which fits the host
and all its subdomains, or a pattern over `host + path` in the usual filter notation: `||` is the start of the host or
of one of its labels, a bar the start or end, `*` anything, `^` any character but a letter, a digit, `_`, `-`, `.` or
`%`, or the end. Both become one regular expression. A literal token is a run of a-z and 0-9 that the pattern bounds on both
sides, so every address that fits has it as a whole token; the tokens of all addresses are counted, and each rule
is posted under the one that they have least. An address asks for the rules of its own tokens, and only those are
run as regular expressions. Rules without a literal token are posted under the empty token, which every address has.

Everything is DataFrame work: one count of the tokens that rules have, one join of the addresses' tokens with the
postings (by broadcast up to BROADCAST_ROWS rules; beyond, by shuffle, the frequent tokens dealt over salts), and
one grouping by row, which needs a row for each address after its map-side part. The rules are one bounded or
distributed table; nothing of the addresses reaches the driver.

Precedence: the lowest tier that fits; within it the longest rule, then the longest host, then the text. The order
within `PATTERNS`' tier is allow before block.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no host rule, and is allowed; a
null pattern and host is a rule that fits nothing; rows that repeat a page_id or url stay rows of their own; an
empty table of pages gives an empty result, an empty table of rules allows all. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stage

#: Fixed values of the contract: action, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The method's own rules, which speak where no rule of the contract fits: junk hosts and paths by pattern, with exceptions.
PATTERNS = (
    ("block", "||spam-*.*^"), ("block", "||cheap-pills.*^"), ("block", "||casino-*.*^"), ("block", "||adult-*.*^"), ("block", "||free-bets.*^"), ("block", "||ads-track*.*^"),
    ("block", "-casino."), ("block", "/ads/*"), ("block", "^banner^"), ("block", "/*/click*.html|"), ("allow", "/about/ads/*"), ("allow", "||casino-museum.*^"),
)
#: Rows of one token that go to one salt where the rules are joined by shuffle.
SALT_ROWS = 1_000_000

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next slash, question mark, hash or the end, in small letters."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _SMALL), F.lit("[a-z0-9]+"), F.lit(0))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9\s])", r"\\$1")


def compile_rules(rules: DataFrame) -> DataFrame:
    """rank, rule, action, tier, regex, literals: the regular expression and the bounded literal tokens of every rule.

    rules: rule, action, tier, host, path, pattern; host rules respect the case of the path, patterns no case."""
    by_host = F.concat(F.lit(r"(?s)\A(?:[^/]*\.)?"), _quoted(F.col("host")), F.when(F.coalesce("path", F.lit("")) == "", F.lit(r"(?=/|\z)")).otherwise(_quoted(F.col("path"))))
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("pattern"), r"\A\|\|", "\u0001"), r"\A\|", "\u0002"), r"\|\z", "\u0003")
    text = F.regexp_replace(marked, r"([^A-Za-z0-9\s*^\u0001\u0002\u0003])", r"\\$1")
    for sign, regex in (("*", ".*"), ("^", r"(?:[^A-Za-z0-9_.%-]|\z)"), ("\u0001", r"\A(?:[^/]*\.)?"), ("\u0002", r"\A"), ("\u0003", r"\z")):
        text = F.replace(text, F.lit(sign), F.lit(regex))
    # a token is bounded by the start, the end or a sign that is neither a token's character nor a star
    literal = F.coalesce(F.concat(F.lit("."), F.col("host"), F.when(F.coalesce("path", F.lit("")) == "", F.lit("/")).otherwise(F.concat(F.col("path"), F.lit("*")))), marked)
    literals = F.regexp_extract_all(F.translate(literal, _UPPER, _SMALL), F.lit(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), F.lit(0))
    told = rules.select("rule", "action", F.col("tier").cast("int").alias("tier"), "host", F.coalesce(by_host, F.concat(F.lit("(?is)"), text)).alias("regex"), F.array_distinct(literals).alias("literals")).filter("regex is not null")
    # a number for each rule in order of precedence
    parts = Window.orderBy("tier", F.when(F.col("host").isNull(), F.col("action")), F.desc(F.length("rule")), F.desc(F.length("host")), "rule", "action")
    return told.withColumn("rank", F.row_number().over(parts).cast("long")).drop("host")  # the rules are one small table, ordered once


def postings(rules: DataFrame, addresses: DataFrame) -> DataFrame:
    """rules with token and n: the literal token that the fewest of the addresses' tokens are, and their number."""
    asked = rules.select(F.explode("literals").alias("token")).distinct()
    counts = addresses.select(F.explode("tokens").alias("token")).join(_side(asked), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = rules.select("rank", F.explode("literals").alias("token")).join(counts, "token", "left")
    rarest = each.groupBy("rank").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r"))
    return rules.join(rarest, "rank", "left").select("rank", "rule", "action", "tier", "regex", F.coalesce("r.token", F.lit("")).alias("token"), F.col("r.n").alias("n"))


def _side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def judge(pages: DataFrame, rules: DataFrame, small: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern: the verdict of the rule that speaks first, else allow.

    pages: page_id, url. rules: as in compile_rules; tier 0 is told as rule, others as pattern."""
    urls = pages.select("page_id", F.monotonically_increasing_id().alias("row_no"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = stage(urls.withColumn("tokens", F.array_distinct(tokens_of(F.concat("host", "path")))), "url-tokens")
    table = stage(compile_rules(rules), "url-rules")
    posted = stage(postings(table, urls), "url-postings")
    bounded = posted.limit(small + 1).count() <= small
    asked = urls.select("row_no", "page_id", "host", "path", F.explode(F.array_append("tokens", F.lit(""))).alias("token"))
    entries = posted.select("token", F.col("rank").alias("found"), "regex", "n")
    if bounded:
        met = asked.join(F.broadcast(entries.drop("n")), "token", "left")
    else:  # a token that many addresses have is dealt over salts, its few rules to each
        spread = entries.groupBy("token").agg(F.max(F.coalesce("n", F.lit(SALT_ROWS))).alias("n")).select("token", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")).filter("salts > 1")
        entries = entries.join(spread, "token", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("salts", F.lit(1)), F.lit(1)) - 1))).drop("salts", "n")
        asked = asked.join(_side(spread), "token", "left").withColumn("salt", F.pmod(F.col("row_no"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        met = asked.join(entries, ["token", "salt"], "left")
    fits = F.when(F.col("regex").isNotNull() & (F.col("host") != ""), F.expr("concat(host, path) rlike regex"))
    best = met.groupBy("row_no", "page_id", "host", "path").agg(F.min(F.when(fits, F.col("found"))).alias("rank"))
    named = posted.select("rank", "tier", F.col("rule").alias("_rule"), "action")
    told = best.join(F.broadcast(named) if bounded else named, "rank", "left")
    return told.select("page_id", "host", "path", F.when(F.col("tier") == 0, F.col("_rule")).alias("rule"), F.coalesce("action", F.lit("allow")).alias("verdict"), F.when(F.col("tier") > 0, F.col("_rule")).alias("pattern"))


def rule_table(spark: SparkSession, hosts=RULES, patterns=PATTERNS) -> DataFrame:
    """The rules of a list of (action, host, path) and one of (action, pattern)."""
    rows = [(h + p, action, 0, h, p, None) for action, h, p in hosts] + [(p, action, 1, None, None, p) for action, p in patterns]
    return spark.createDataFrame(rows, "rule string, action string, tier int, host string, path string, pattern string")


def op12_url_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query over pages."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rule_table(spark))


#: DuckDB twin of op12_url_rules: every rule tried on every page.
SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fit AS (SELECT *, '.' || host AS h, host || path AS a FROM u),
ruled AS (SELECT *, CASE WHEN ends_with(h, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN ends_with(h, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                         WHEN ends_with(h, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN ends_with(h, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM fit),
own AS (SELECT *, CASE
  WHEN host = '' THEN NULL
  WHEN regexp_matches(a, '(?is)^(?:[^/]*\.)?casino-museum\..*(?:[^a-z0-9_.%-]|$)') THEN '||casino-museum.*^'
  WHEN contains(lower(a), '/about/ads/') THEN '/about/ads/*'
  WHEN regexp_matches(a, '(?is)^(?:[^/]*\.)?cheap-pills\..*(?:[^a-z0-9_.%-]|$)') THEN '||cheap-pills.*^'
  WHEN regexp_matches(a, '(?is)/.*/click.*\.html$') THEN '/*/click*.html|'
  WHEN regexp_matches(a, '(?is)^(?:[^/]*\.)?ads-track.*\..*(?:[^a-z0-9_.%-]|$)') THEN '||ads-track*.*^'
  WHEN regexp_matches(a, '(?is)^(?:[^/]*\.)?free-bets\..*(?:[^a-z0-9_.%-]|$)') THEN '||free-bets.*^'
  WHEN regexp_matches(a, '(?is)^(?:[^/]*\.)?casino-.*\..*(?:[^a-z0-9_.%-]|$)') THEN '||casino-*.*^'
  WHEN regexp_matches(a, '(?is)^(?:[^/]*\.)?adult-.*\..*(?:[^a-z0-9_.%-]|$)') THEN '||adult-*.*^'
  WHEN regexp_matches(a, '(?is)^(?:[^/]*\.)?spam-.*\..*(?:[^a-z0-9_.%-]|$)') THEN '||spam-*.*^'
  WHEN contains(lower(a), '-casino.') THEN '-casino.'
  WHEN regexp_matches(a, '(?is)(?:[^a-z0-9_.%-]|$)banner(?:[^a-z0-9_.%-]|$)') THEN '^banner^'
  WHEN contains(lower(a), '/ads/') THEN '/ads/*' END AS p FROM ruled)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN p IN ('/about/ads/*', '||casino-museum.*^') THEN 'allow' WHEN p IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN p END AS pattern
FROM own
"""
