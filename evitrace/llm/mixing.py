"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets share a budget of words over the sources by weight, no target above a multiple of its
source. A source is taken in complete epochs first; what is left of its target is drawn without
replacement: every document gets an exponential key divided by its quality weight, and the
documents with the smallest keys are taken until their words fill the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evitrace.llm.common import split_words, unused
from evitrace.session import cut_lineage

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Documents of a bucket of the key order, about.
BUCKET_DOCS = 500


def word_count(text: Column) -> Column:
    return F.size(split_words(text)).cast("long")


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 13 hexadecimal digits of the key's MD5."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, share: float = 1.5, ceiling: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) with the target of each source.

    Water filling in closed form: sources ordered by ceiling over weight reach their ceiling
    first; the k-th level spreads what those before it leave over the weights that remain. Sources
    without words get nothing. One row per source passes through one window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("_w", F.get(pattern, (F.row_number().over(order) - 1) % len(weights)).cast("double"))
    ranked = ranked.withColumn("_cap", (F.lit(ceiling) * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    levelled = ranked.withColumn("_level", left / weight)
    # The first source that its level leaves below its ceiling fixes the level of all after it.
    below = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level"))))
    level = below.over(whole)["_level"]
    return levelled.withColumn("_final", level).select(
        "source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap"))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", share: float = 1.5, split_last: bool = True, row_col: str | None = None) -> DataFrame:
    """Per document: id, size, source_size, target, taken and ``copies``, the number of times the
    document is taken, a part counted as one; ``row_col`` is carried along as ``_row``.

    ``quality`` has one weight above zero per id (missing or null: 1). ``split_last``: the
    document at the edge of the rest gives only the words that are missing, so a source's taken
    words are its target without the fraction; otherwise it is taken whole if at least half of it
    is missing, else left. Nulls: a null text has no words; a null source is a source of its own,
    last in order; a null id draws like the empty text. Repeated rows draw the same key, so which
    of them is taken first does not show. An empty table gives no rows. Other columns are ignored.

    The order inside a source is never sorted in one task: a monotone function of the key spreads
    it over buckets whose number grows with the source; bucket sums are prefix-summed, and only
    the bucket that holds the edge sorts its rows.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(row_col or id_col).alias("_row"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col)).alias("size"))
    if quality is not None:
        # The ids are made unique before the join, so that no document is doubled by it.
        weigh = quality.groupBy(F.col(quality.columns[0]).alias("_id")).agg(F.max(quality.columns[1]).alias("_q"))
        base = base.join(weigh, "_id", "left")
    else:
        base = base.withColumn("_q", F.lit(None).cast("double"))
    weight = F.when(F.col("_q") > 0, F.col("_q").cast("double")).otherwise(F.lit(1.0))
    keyed = cut_lineage(base.select("_id", "_row", "source", "size", weight.alias("_weight"), (-F.log(uniform(F.col("_id"))) / weight).alias("_key")))
    per = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"), F.avg("_weight").alias("_mean"))
    per = cut_lineage(per)
    plan = targets(per.select("source", "source_size"), share).join(
        per.select(F.col("source").alias("_s"), "_docs", "_mean"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = cut_lineage(plan.withColumn("_epochs", epochs).withColumn(
        "_rest", (F.floor("target") - F.col("_epochs") * F.col("source_size")).cast("long")).withColumn(
        "_buckets", (F.floor(F.col("_docs") / BUCKET_DOCS) + 1).cast("long")))
    bucket = F.least(F.floor((1 - F.exp(-F.col("_key") * F.col("_mean"))) * F.col("_buckets")), F.col("_buckets") - 1).cast("long")
    joined = keyed.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_bucket", bucket)
    placed = cut_lineage(joined.select("_id", "_row", "source", "size", "_key", "source_size", "target", "_epochs", "_rest", "_bucket"))
    sums = placed.groupBy("source", "_rest", "_bucket").agg(F.sum("size").alias("_sum"))
    run = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(run), F.lit(0)))
    edges = edges.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_before", "_sum")
    ranked = placed.join(edges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    inside = F.col("_before") + F.col("_sum") <= F.col("_rest")
    cut = ~inside & (F.col("_before") < F.col("_rest"))
    order = Window.partitionBy("source").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = ranked.filter(cut).withColumn("_missing", F.col("_rest") - F.col("_before") - F.coalesce(F.sum("size").over(order), F.lit(0)))
    if split_last:
        part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_missing")))
    else:
        part = F.when(2 * F.col("_missing") >= F.col("size"), F.col("size")).otherwise(0)
        part = F.when(F.col("_missing") > 0, part).otherwise(0)
    rest = ranked.filter(~cut).withColumn("_part", F.when(inside, F.col("size")).otherwise(0))
    taken = within.withColumn("_part", part).drop("_missing").unionByName(rest)
    return taken.select(
        F.col("_id").alias(id_col), "_row", "size", "source_size", "target",
        (F.col("_epochs") * F.col("size") + F.col("_part")).cast("long").alias("taken"),
        (F.col("_epochs") + (F.col("_part") > 0).cast("long")).alias("copies"))


def sample(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source", share: float = 1.5) -> DataFrame:
    """The mix itself: every document as often as it is taken, whole, with all its columns.

    Documents without words weigh nothing and are taken with their source's complete epochs, at
    least once: leaving them out would be a filter, which a mix is not. Null texts have no words, a
    null source is a source of its own, repeated rows are drawn one by one; columns may have any
    names; an empty table stays empty.
    """
    row, times = unused(docs, "_row"), unused(docs, "_copies")
    rows = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    mixed = mix(rows, quality, id_col, text_col, source_col, share, split_last=False, row_col=row)
    copies = F.when(F.col("size") == 0, F.greatest("copies", F.lit(1))).otherwise(F.col("copies"))
    plan = mixed.select(F.col("_row").alias(row), copies.cast("int").alias(times)).filter(F.col(times) > 0)
    repeated = rows.join(plan, row).withColumn(unused(docs, "_copy"), F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from labelled quality: good documents draw twice as often as unlabelled
    ones, bad ones half as often."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(
        "doc_id", F.when(F.col("quality") == 1, F.lit(2.0)).otherwise(F.lit(0.5)).alias("weight"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
weights AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) AS w
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
keyed AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
           / coalesce(w, 1.0) AS k
  FROM sized LEFT JOIN weights USING (doc_id)),
per AS (
  SELECT source, sum(size)::DOUBLE AS s, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM keyed GROUP BY source),
levels AS (
  SELECT source, s, w, 2 * s AS cap,
         (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(2 * s) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM per WINDOW before AS (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fixed AS (SELECT arg_min(level, cap / w) AS level FROM levels WHERE level * w <= cap),
aims AS (
  SELECT source, s::BIGINT AS source_size, least(cap, coalesce(fixed.level * w, cap)) AS target,
         CASE WHEN s > 0 THEN floor(least(cap, coalesce(fixed.level * w, cap)) / s)::BIGINT ELSE 0 END AS epochs
  FROM levels, fixed),
drawn AS (
  SELECT doc_id, size, source_size, target, epochs,
         floor(target)::BIGINT - epochs * source_size - coalesce(sum(size) OVER (
           PARTITION BY keyed.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS missing
  FROM keyed JOIN aims ON keyed.source IS NOT DISTINCT FROM aims.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, missing)))::BIGINT AS taken FROM drawn
"""
