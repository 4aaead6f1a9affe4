"""Coverage of sources by entries, readiness, and source drift of stored edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evitrace.functions.analyze import fold_name
from evitrace.operators.graph import local_name
from evitrace.vocab import HEURISTIC, LANES


def lanes_by_type(entries: DataFrame, by: str = "metadata_type") -> DataFrame:
    """One row per type, one column per lane; the lanes are listed, so no pass discovers them."""
    return entries.groupBy(by).pivot("lane", list(LANES)).count().na.fill(0)


def sampled(rows: DataFrame, by: str, order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows per group together with the group's true count.

    The cap is a group limit Spark applies before the shuffle; the counts are a plain
    aggregate. The count is always the whole population.
    """
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(
        F.col("rank") <= cap
    )
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    return first.join(counts, by).drop("rank")


def missing_entries(components: DataFrame, entries: DataFrame, cap: int = 50) -> DataFrame:
    """Components (type, name) without an entry: a sample per type with the true count."""
    gaps = components.select("metadata_type", "name").join(
        entries.select("metadata_type", F.col("full_name").alias("name")), ["metadata_type", "name"], "left_anti"
    )
    return sampled(gaps, "metadata_type", ["name"], cap)


def unprofiled_types(components: DataFrame, profiles: list[str]) -> DataFrame:
    """Types found in the source that no profile describes."""
    return (
        components.filter(~F.col("metadata_type").isin(profiles))
        .groupBy("metadata_type").agg(F.count(F.lit(1)).alias("components"))
    )


def readiness(components: DataFrame, entries: DataFrame) -> DataFrame:
    """Per type: components, entries per lane, components without entry, entries undescribed."""
    joined = components.select("metadata_type", "name").join(
        entries.select("metadata_type", F.col("full_name").alias("name"), "lane", "purpose"),
        ["metadata_type", "name"], "left",
    )
    blank = F.trim(F.coalesce("purpose", F.lit("")))
    return joined.groupBy("metadata_type").agg(
        F.count(F.lit(1)).alias("components"),
        *[F.count_if(F.col("lane") == lane).alias(lane.replace("-", "_")) for lane in LANES],
        F.count_if(F.col("lane").isNull()).alias("no_entry"),
        F.count_if(F.col("lane").isNotNull() & ((blank == "") | blank.startswith("<AGENT_"))).alias("undescribed"),
    )


def stored_edge_health(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Stored edge targets against live component names: gone, undecidable or fine.

    Only names the local tree alone can create are decided; a bare name that came from a
    heuristic edge and matches nothing may be an object, a field or no component at all.
    ``live``: name. One key lookup answers both full and member names.
    """
    object_name = F.substring_index("target", ".", 1)
    member = F.when(F.col("target").contains("."), F.substr("target", F.char_length(object_name) + 2))
    parts = edges.select(
        "source", "kind", "target", "assurance",
        F.explode(F.array_compact(F.array(
            F.when(local_name(object_name), object_name),
            F.when(local_name(object_name) & local_name(member), F.col("target")),
        ))).alias("component"),
    ).withColumn("key", fold_name(F.col("component")))
    name = fold_name(F.col("name"))
    keys = live.select(
        F.explode(F.array_distinct(F.array_compact(F.array(
            name, F.when(name.contains("."), F.substring_index(name, ".", -1))
        )))).alias("key")
    ).groupBy("key").agg(F.lit(True).alias("alive"))
    joined = parts.join(keys, "key", "left")
    bare = ~F.col("target").contains(".") & (F.col("assurance") == HEURISTIC)
    verdict = F.when(F.col("alive"), "fine").when(bare, "undecidable").otherwise("gone")
    return joined.select("source", "kind", "target", "component", verdict.alias("verdict"))
