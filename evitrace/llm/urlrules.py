"""URL verdicts: given host and path rules first, mined association rules for all other URLs.

URLs that a given rule decides are the labelled transactions. FP-growth finds token combinations
that are frequent among them; those with enough confidence for one verdict become rules, which
the remaining URLs meet through an inverted index. Only Spark functions and Spark's own FP-growth
are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evitrace.session import cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


#: The given rules.
RULES = (
    Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"),
)


@dataclass(frozen=True)
class Mining:
    """Bounds of mined rules: share of the labelled URLs that hold the tokens with the verdict,
    share of the URLs with the tokens that have the verdict, and tokens per rule."""

    support: float = 0.005
    confidence: float = 0.9
    tokens: int = 3


def host_of(url: Column) -> Column:
    """The part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
    empty for null or where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Distinct tokens of host labels (``h:``) and path segments (``p:``) that hold a letter.

    Tokens of the given rules are left out: which URLs are labelled follows from them, so among
    the labelled ones they say nothing about the others.
    """
    known = sorted({f"h:{x}" for r in rules for x in r.host.split(".") if x}
                   | {f"p:{x}" for r in rules for x in r.path.split("/") if x})
    def part(text: Column, mark: str) -> Column:
        words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda x: x.rlike("\\p{L}"))
        return F.transform(words, lambda x: F.concat(F.lit(mark), x))
    both = F.array_distinct(F.concat(part(host, "h:"), part(path, "p:")))
    return F.array_except(both, F.array(*[F.lit(x) for x in known])) if known else both


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(tokens, verdict, confidence) from rows of (tokens, verdict); one row per labelled URL.

    The verdict joins the tokens as an item of its own, so a rule is a frequent set with that item.
    """
    items = labelled.select(F.array_append("tokens", F.concat(F.lit("="), F.col("verdict"))).alias("items"))
    if items.isEmpty():
        return items.sparkSession.createDataFrame([], "tokens array<string>, verdict string, confidence double")
    model = FPGrowth(itemsCol="items", minSupport=mining.support, minConfidence=mining.confidence).fit(items)
    verdict = F.get("consequent", F.lit(0))
    return model.associationRules.filter(
        verdict.startswith("=") & (F.size("antecedent") <= mining.tokens)
        & ~F.exists("antecedent", lambda x: x.startswith("="))
    ).select(F.sort_array("antecedent").alias("tokens"), F.substring(verdict, 2, 1 << 20).alias("verdict"), "confidence")


def verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, verdict) of every URL of (url, tokens) that a mined rule meets.

    A rule is listed under one of its tokens only, the one that fewest rules are listed under in
    text order, so a URL meets each rule once; the other tokens are checked on the spot. The most
    confident verdict wins; block only if it beats allow.
    """
    held = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rare = rules.select("*", F.explode("tokens").alias("token")).join(held, "token").groupBy("tokens", "verdict", "confidence").agg(
        F.min(F.struct("n", "token"))["token"].alias("token"))
    index = rare.select("token", F.col("tokens").alias("needed"), "verdict", "confidence")
    met = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token").filter(
        F.size(F.array_except("needed", "tokens")) == 0)
    best = met.groupBy("url").agg(
        F.max(F.when(F.col("verdict") == "block", F.col("confidence"))).alias("b"),
        F.max(F.when(F.col("verdict") == "allow", F.col("confidence"))).alias("a"))
    return best.select("url", F.when(F.col("b") > F.coalesce("a", F.lit(0.0)), "block").otherwise("allow").alias("mined"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
          rules: tuple[Rule, ...] = RULES, mining: Mining = Mining()) -> DataFrame:
    """Host, path, rule and verdict of every row.

    Mining and matching work on distinct URLs, so copies of one URL weigh once and meet in no
    task. Nulls and texts without ``://`` have no host and path, fit no rule and are allowed, as is
    every URL without a mined block rule. Repeated rows are judged each for itself; an empty table
    gives no rows and mines nothing; other columns are ignored whatever their names.
    """
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"))
    parsed = base.select("_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.withColumn("_given", given_rule(F.col("host"), F.col("path"), rules))
    single = cut_lineage(ruled.filter(F.col("url").isNotNull()).select(
        "url", "host", "path", F.col("_given.verdict").alias("verdict")).distinct().select(
        "url", "verdict", tokens_of(F.col("host"), F.col("path"), rules).alias("tokens")))
    mined = cut_lineage(mine(single.filter(F.col("verdict").isNotNull()).select("tokens", "verdict"), mining))
    blocked = verdicts(single.filter(F.col("verdict").isNull()), mined).filter(F.col("mined") == "block").select(
        F.col("url").alias("_url"), "mined")
    return ruled.join(blocked, F.col("url") == F.col("_url"), "left").select(
        F.col("_id").alias(id_col), "host", "path", F.col("_given.rule").alias("rule"),
        F.coalesce(F.col("_given.verdict"), F.col("mined"), F.lit("allow")).alias("verdict"))


ORACLE = r"""
WITH parsed AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parsed),
told AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS given FROM ruled),
single AS (
  SELECT url, given, list_filter(list_distinct(list_concat(
           list_transform(list_filter(regexp_split_to_array(lower(host), '[^\p{L}\p{N}]+'), lambda x: regexp_matches(x, '\p{L}')), lambda x: 'h:' || x),
           list_transform(list_filter(regexp_split_to_array(lower(path), '[^\p{L}\p{N}]+'), lambda x: regexp_matches(x, '\p{L}')), lambda x: 'p:' || x))),
         lambda x: x NOT IN ('h:net', 'h:example', 'h:com', 'h:org', 'p:en', 'p:de', 'p:fr')) AS tokens
  FROM (SELECT DISTINCT url, host, path, given FROM told WHERE url IS NOT NULL)),
flat AS (SELECT url, given, unnest(tokens) AS t FROM single),
sets AS (
  SELECT url, given, [t] AS s FROM flat
  UNION ALL SELECT a.url, a.given, [a.t, b.t] FROM flat a JOIN flat b ON a.url = b.url AND a.t < b.t
  UNION ALL SELECT a.url, a.given, [a.t, b.t, c.t] FROM flat a JOIN flat b ON a.url = b.url AND a.t < b.t JOIN flat c ON a.url = c.url AND b.t < c.t),
counted AS (SELECT s, count(*) AS n, count(*) FILTER (given = 'block') AS b, count(*) FILTER (given = 'allow') AS a FROM sets WHERE given IS NOT NULL GROUP BY s),
least AS (SELECT ceil(0.005::DOUBLE * count(*)) AS m FROM single WHERE given IS NOT NULL),
rules AS (
  SELECT s, CASE WHEN b >= m THEN b / n END AS b, CASE WHEN a >= m THEN a / n END AS a FROM counted, least WHERE b >= m OR a >= m),
best AS (
  SELECT url, max(CASE WHEN rules.b >= 0.9 THEN rules.b END) AS b, max(CASE WHEN rules.a >= 0.9 THEN rules.a END) AS a
  FROM sets JOIN rules USING (s) WHERE given IS NULL GROUP BY url)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN b > coalesce(a, 0) THEN 'block' END, 'allow') AS verdict
FROM told LEFT JOIN best ON told.url = best.url
"""
