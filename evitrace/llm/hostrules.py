"""Quality rules per document and per host.

Every document is measured by whole-text rules. Failures are then counted per host, each host's
failure rate is shrunk towards the corpus by a beta prior fitted to all hosts, and the verdict on
a host is joined back to its documents. Only Spark functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evitrace.functions.let import let
from evitrace.llm.common import BLANKS, split_words
from evitrace.session import cut_lineage

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window that is looked for again.
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """Bounds of the rules. A host is rejected if its shrunken failure rate, less ``host_doubt``
    standard deviations, is above ``host_rate``: few documents reject no host."""

    min_words: int = 20
    repeat_percent: int = 30
    host_rate: float = 0.5
    host_doubt: float = 2.0


def _windows(words: Column, make) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), make)


def _covered(words: Column) -> Column:
    """Words inside windows that occur twice: windows sorted with their place, equal neighbours
    marked, and each marked place adds what the one before it does not cover."""
    ordered = F.sort_array(_windows(words, lambda i: F.struct(
        F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("p"))))

    def places(s: Column) -> Column:
        def place(i):
            here = F.get(s, i)
            twin = (F.get(s, i - 1)["w"] == here["w"]) | (F.get(s, i + 1)["w"] == here["w"])
            return F.when(F.coalesce(twin, F.lit(False)) | (F.get(s, i + 1)["w"] == here["w"]), here["p"])

        return F.sort_array(F.array_compact(F.transform(F.sequence(F.lit(0), F.size(s) - 1), place)))

    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(
        let(ordered, places), start,
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )


def repeat_words(words: Column) -> Column:
    """Number of words in windows of eight found twice or more, the first finding included.

    Hashes decide whether any window repeats at all; the places of repeats compare the words.
    """
    none = F.lit(0).cast("long")
    hashes = _windows(words, lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))
    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) <= WINDOW, none).when(repeats, _covered(words)).otherwise(none)


def measures(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """The rule measures of every document; a null text has no words.

    A line counts as repeated when it holds a word and equals an earlier line of its text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    gaps = "".join(BLANKS)
    bare = F.translate(text, gaps, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, gaps, "") != "")
    return docs.select(
        F.col(id_col), *keep,
        let(split_words(F.col(text_col)), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(
        id_col, *keep, F.col("_words.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("_words.n_repeat_words").alias("n_repeat_words"),
    )


def host_verdicts(measured: DataFrame, host_col: str, failed: Column, limits: Limits) -> DataFrame:
    """One row per host: documents, failures, shrunken rate and whether the host is rejected.

    The prior has the mean and variance of the hosts' rates, each host weighing alike; with fewer
    than two hosts, or no spread, it is as strong as the mean number of documents of a host.
    Documents without a host belong to none.
    """
    hosts = measured.filter(F.col(host_col).isNotNull()).groupBy(host_col).agg(
        F.count(F.lit(1)).alias("host_docs"), F.count_if(failed).alias("host_failed"))
    hosts = cut_lineage(hosts)
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(
        (F.sum("host_failed") / F.sum("host_docs")).alias("mean"), F.var_samp(rate).alias("var"),
        F.avg("host_docs").alias("docs")).first()
    mean = prior["mean"] or 0.0
    spread = prior["var"] or 0.0
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else prior["docs"] or 1.0
    strength = max(strength, 1e-6)
    shrunk = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    doubt = F.lit(limits.host_doubt) * F.sqrt(shrunk * (F.lit(1.0) - shrunk) / (F.col("host_docs") + F.lit(strength + 1)))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", shrunk - doubt > limits.host_rate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          limits: Limits = Limits()) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` for every document.

    Nulls: a null text has no words and fails; a null host has no verdict, so only the base rules
    count. Repeated rows are judged each for itself; a table without rows gives none; other
    columns of ``docs`` are ignored whatever their names. The texts are read once and never
    shuffled: measures are written as narrow rows, which the host counts and the join then share.
    """
    host = "_host"
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(host_col).cast("string").alias(host))
    failed = (F.col("n_words") < limits.min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(limits.repeat_percent) * F.col("n_words"))
    measured = cut_lineage(measures(base, "_id", "_text", host).withColumn("base_failed", failed))
    verdicts = host_verdicts(measured, host, F.col("base_failed"), limits)
    rejected = verdicts.filter("host_rejected").select(host, F.lit(True).alias("_bad"))
    return measured.join(rejected, host, "left").select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & F.col("_bad").isNull()).alias("kept"),
    )


ORACLE = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
grams AS (
  SELECT rid, p, array_to_string(words[p + 1:p + 8], ' ') AS g
  FROM (SELECT rid, words, unnest(range(0, len(words) - 7)) AS p FROM texts WHERE len(words) > 7)),
twice AS (SELECT rid, p FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (
  SELECT rid, sum(least(8, coalesce(p - prev, 8)))::BIGINT AS n
  FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS prev FROM twice) GROUP BY rid),
lines AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
base AS (
  SELECT texts.rid, doc_id, source, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM texts JOIN lines USING (rid) LEFT JOIN covered ON covered.rid = texts.rid),
ruled AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS d, count(*) FILTER (base_failed) AS f FROM ruled WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT sum(f) / sum(d) AS m, var_samp(f / d) AS v, avg(d) AS docs FROM hosts),
prior AS (SELECT m, greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE docs END, 1e-6) AS s FROM moments),
shrunk AS (SELECT source, (f + m * s) / (d + s) AS r, d + s + 1 AS n FROM hosts, prior),
bad AS (SELECT source FROM shrunk WHERE r - 2 * sqrt(r * (1 - r) / n) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM ruled
"""
