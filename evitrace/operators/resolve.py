"""Selected paths and names to components: a cascade of equi-joins, never a guess.

Prefix tests become key lookups: a component is listed under each of its folders, and a selected
path under each of its own, so neither side is compared with the other row by row.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evitrace.functions.let import let
from evitrace.functions.analyze import fold_name, fold_names
from evitrace.session import cut_lineage

EXPANSION_CAP = 25
INPUT_CAP = 50
BUNDLE_TYPES = ("LightningComponentBundle", "AuraDefinitionBundle")
ROOT = "force-app"
_META = "-meta.xml"


def normalize_path(raw: Column) -> Column:
    """Slashes folded, ``./`` dropped, kept from the source root down; null when not under it."""
    folded = F.regexp_replace(F.regexp_replace(F.trim(raw), r"\\", "/"), "/+", "/")

    def under_root(text):
        lowered = F.lower(text)
        inside = F.locate(f"/{ROOT}/", lowered)
        return (
            F.when(text.rlike(r"(^|/)\.\.(/|$)") | (text == ""), F.lit(None).cast("string"))
            .when((lowered == ROOT) | lowered.startswith(ROOT + "/"), text)
            .when(inside > 0, F.substr(text, inside + 1))
            .when(lowered.endswith("/" + ROOT), F.lit(ROOT))
        )

    return let(F.regexp_replace(F.rtrim(folded, F.lit("/")), r"^(\./)+", ""), under_root)


def folders(path: Column) -> Column:
    """Every proper ancestor folder of a path."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )


def aliases(name: Column, ident: Column, path: Column) -> Column:
    base = F.substring_index(path, "/", -1)
    return F.array_distinct(fold_names(F.array(
        name, ident, base, F.regexp_replace(base, r"\.[A-Za-z0-9]+-meta\.xml$", ""),
        F.regexp_replace(base, r"\.[A-Za-z0-9]+$", ""),
    )))


def resolve(inputs: DataFrame, components: DataFrame, generic_paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Selections and their matches.

    ``inputs``: kind ('path' or 'name'), input. ``components``: component_id, metadata_type,
    name, path. Returns ``(selections, matches)``: one row per input with its resolution and
    the number of components, and one row per input and component of the winning tier.
    """
    key = F.when(F.col("kind") == "path", fold_name(normalize_path(F.col("input")))).otherwise(fold_name(F.trim("input")))
    # Written once: five joins read it.
    asked = cut_lineage(inputs.select("kind", "input").distinct().withColumn("key", key))
    paths = asked.filter(F.col("kind") == "path")
    names = asked.filter(F.col("kind") == "name")
    # Both sides grow with their tables and their files are far smaller than their rows: every join
    # is by shuffle, so that no side is ever sent to the driver whole.
    known = components.withColumn("pkey", fold_name(F.col("path")))

    # Tiers of one path: itself, its content file, its description file.
    spelled = paths.filter(F.col("key").isNotNull()).select("kind", "input", F.explode(F.array(
        F.struct(F.lit(1).alias("tier"), F.col("key").alias("k")),
        F.struct(F.lit(2).alias("tier"), F.when(F.col("key").endswith(_META), F.regexp_replace("key", _META + "$", "")).alias("k")),
        F.struct(F.lit(3).alias("tier"), F.concat("key", F.lit(_META)).alias("k")),
    )).alias("t")).select("kind", "input", "t.tier", F.col("t.k").alias("k"))
    exact = spelled.join(known.select(F.col("pkey").alias("k"), "component_id", "path").hint("merge"), "k")
    generic = None
    if generic_paths is not None:
        generic = paths.join(generic_paths.select(fold_name(F.col("path")).alias("key")).distinct().hint("merge"), "key").select(
            "kind", "input", F.lit(4).alias("tier"), F.lit(None).cast("string").alias("component_id"), F.lit(None).cast("string").alias("path")
        )
    homes = known.filter(F.col("metadata_type").isin(*BUNDLE_TYPES)).select(
        F.expr("left(pkey, char_length(pkey) - char_length(substring_index(pkey, '/', -1)) - 1)").alias("k"), "component_id", "path"
    )
    in_bundle = paths.select("kind", "input", F.lit(5).alias("tier"), F.explode(folders(F.col("key"))).alias("k")).join(homes.hint("merge"), "k")
    under = known.select(F.explode(folders(F.col("pkey"))).alias("k"), "component_id", "path")
    at_folder = paths.select("kind", "input", F.lit(6).alias("tier"), F.col("key").alias("k"))
    called = known.select(F.explode(aliases(F.col("name"), F.col("component_id"), F.col("path"))).alias("k"), "component_id", "path")
    by_name = names.select("kind", "input", F.lit(7).alias("tier"), F.col("key").alias("k")).join(called.hint("merge"), "k")

    shape = ["kind", "input", "tier", "component_id", "path"]
    found = exact.select(*shape)
    for more in (in_bundle, by_name):
        found = found.unionByName(more.select(*shape))
    if generic is not None:
        found = found.unionByName(generic)
    # Counts per tier, then the first tier that has any: only counts reach the grouping. A
    # component meets an input at most once per tier, and several files show as unequal ends.
    # Folders are counted before they meet their inputs: one that holds all components is one row.
    measures = (F.count("component_id").alias("matches"), (F.min("path") != F.max("path")).alias("scattered"))
    per_folder = under.groupBy("k").agg(*measures)
    per_tier = found.groupBy("kind", "input", "tier").agg(*measures).unionByName(
        at_folder.join(per_folder.hint("merge"), "k").drop("k")
    )
    won = per_tier.groupBy("kind", "input").agg(F.min_by(F.struct("tier", "matches", "scattered"), "tier").alias("w")).select(
        "kind", "input", "w.*"
    )
    joined = asked.join(won.hint("merge"), ["kind", "input"], "left")
    blank = F.trim("input") == ""
    resolution = (
        F.when(blank, "unsupported")
        .when((F.col("kind") == "path") & F.col("key").isNull(), "unsupported")
        .when(F.col("tier") == 4, "unsupported")
        .when(F.col("matches").isNull(), "unmatched")
        .when(F.col("matches") == 1, "resolved")
        .when((F.col("kind") == "name") & F.col("scattered"), "ambiguous")
        .when(F.col("matches") > EXPANSION_CAP, "unsupported")
        .otherwise("expanded")
    )
    selections = joined.select(
        "kind", "input", resolution.alias("resolution"), F.coalesce("matches", F.lit(0)).alias("matches"), "tier"
    )
    listed = selections.filter(F.col("resolution").isin("resolved", "expanded", "ambiguous")).select("kind", "input", "tier")
    # Components are listed for the folders that are served alone.
    few = at_folder.join(listed.hint("merge"), ["kind", "input", "tier"]).join(under.hint("merge"), "k").select(*shape)
    matches = found.join(listed.hint("merge"), ["kind", "input", "tier"]).select(*shape).unionByName(few).select("kind", "input", "component_id")
    return selections, matches


@F.pandas_udf(T.DoubleType())
def _ratio(names: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(names, wanted)], dtype="float64")


def suggestions(unmatched: list[str], components: DataFrame, n: int = 3, cutoff: float = 0.6) -> DataFrame:
    """Close names for inputs nothing matched.

    The inputs are the caller's own arguments, at most fifty, so they travel with the task; the
    pool of names stays distributed, and only names that can reach the cutoff are compared in
    full. The best of each slice are ranked together.
    """
    if len(unmatched) > INPUT_CAP:
        raise ValueError(f"at most {INPUT_CAP} inputs per call")

    base = F.substring_index("path", "/", -1)
    pool = components.select(F.explode(F.array_distinct(F.array(
        "name", "component_id", base, F.regexp_replace(base, r"\.[A-Za-z0-9]+-meta\.xml$", ""),
        F.regexp_replace(base, r"\.[A-Za-z0-9]+$", ""),
    ))).alias("alias")).distinct()
    # Two upper bounds of the ratio are exact column expressions: by lengths and by shared letters.
    size = F.char_length("alias")

    def bounds(wanted: str) -> Column:
        shared = F.lit(0)
        for letter in sorted(set(wanted)):
            held = size - F.char_length(F.replace("alias", F.lit(letter), F.lit("")))
            shared = shared + F.least(held, F.lit(wanted.count(letter)))
        total = F.greatest(size + len(wanted), F.lit(1)).cast("double")
        near = (2 * F.least(size, F.lit(len(wanted))) / total >= cutoff) & (2 * shared / total >= cutoff)
        return F.when(near, F.lit(wanted))

    asked = sorted(set(unmatched))
    if not asked:
        return pool.sparkSession.createDataFrame([], "input string, suggestion string, ratio double, rank int")
    pairs = pool.select(F.col("alias").alias("suggestion"), F.explode(F.array_compact(F.array(*[bounds(w) for w in asked]))).alias("input"))
    scored = pairs.select("input", "suggestion", _ratio("suggestion", "input").alias("ratio")).filter(F.col("ratio") >= cutoff)
    best = Window.partitionBy("input").orderBy(F.desc("ratio"), F.desc("suggestion"))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
