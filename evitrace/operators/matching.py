"""One-to-one matching of the identities of two sources by a cascade of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evitrace.session import cut_lineage


def match(left: DataFrame, right: DataFrame, tiers: list[str]) -> DataFrame:
    """Every row of both sides with what became of it: side, id, status, tier, partner, component.

    ``left``, ``right``: id, unique on its side, and a string column per tier, the surest first.
    Tier by tier, the two rows that alone hold a key on their sides are ``matched`` and leave, so
    what was contested may be clear at a later tier. Rows left over that still share a key with
    the other side are ``contested``; those connected by shared keys, of any tier, form a component
    named by its smallest row. The others are ``alone``. Null and empty keys say nothing, rows
    without an id are nobody's and left out, repeated rows count once, empty sides match nothing.

    A tier is one aggregate by key, from which the pairs come without a join; no pairs of a
    contested key are formed, so a key that most rows share costs its rows alone.
    """
    both = [df.filter(F.col("id").isNotNull()).select(F.lit(side).alias("side"), F.col("id").cast("string").alias("id"),
            *[F.nullif(F.col(t).cast("string"), F.lit("")).alias(t) for t in tiers]) for side, df in (("left", left), ("right", right))]
    rest = cut_lineage(both[0].unionByName(both[1]).distinct())
    on = lambda side: F.col("side") == side
    matched = None
    for tier in tiers:
        held = rest.filter(F.col(tier).isNotNull()).groupBy(tier).agg(
            F.count_if(on("left")).alias("l"), F.count_if(on("right")).alias("r"),
            F.min(F.when(on("left"), F.col("id"))).alias("left_id"), F.min(F.when(on("right"), F.col("id"))).alias("right_id"))
        sides = F.array(*[F.struct(F.lit(a).alias("side"), F.col(f"{a}_id").alias("id"), F.col(f"{b}_id").alias("partner"))
                          for a, b in (("left", "right"), ("right", "left"))])
        taken = held.filter("l = 1 AND r = 1").select(F.explode(sides).alias("s"), F.lit(tier).alias("tier")).select("s.*", "tier")
        taken = cut_lineage(taken)
        matched = taken if matched is None else matched.unionByName(taken)
        rest = cut_lineage(rest.join(taken, ["side", "id"], "left_anti"))
    grouped = _components(rest, tiers)
    found = rest.select("side", "id").join(grouped, ["side", "id"], "left").select(
        "side", "id", F.when(F.col("component").isNotNull(), "contested").otherwise("alone").alias("status"),
        F.lit(None).cast("string").alias("tier"), F.lit(None).cast("string").alias("partner"), "component")
    return found.unionByName(matched.select(
        "side", "id", F.lit("matched").alias("status"), "tier", "partner", F.lit(None).cast("string").alias("component")))


def _components(rest: DataFrame, tiers: list[str]) -> DataFrame:
    """(side, id, component) of the rows that share keys with the other side.

    The smallest name goes from rows to keys and back until nothing changes: as many rounds as the
    longest chain of keys has links, each written out.
    """
    keys = F.array_compact(F.array(*[F.when(F.col(t).isNotNull(), F.concat(F.lit(f"{n}:"), F.col(t))) for n, t in enumerate(tiers)]))
    held = rest.select("side", "id", F.explode(keys).alias("key"))
    shared = held.groupBy("key").agg(F.count_distinct("side").alias("sides")).filter("sides = 2").select("key")
    links = cut_lineage(held.join(shared, "key", "left_semi"))
    labels = cut_lineage(links.select("side", "id", F.concat_ws(":", "side", "id").alias("component")).distinct())
    while True:
        smallest = links.join(labels, ["side", "id"]).groupBy("key").agg(F.min("component").alias("least"))
        spread = links.join(smallest, "key").groupBy("side", "id").agg(F.min("least").alias("least"))
        after = cut_lineage(labels.join(spread, ["side", "id"]).select(
            "side", "id", F.col("least").alias("component"), (F.col("least") != F.col("component")).alias("moved")))
        moved = after.agg(F.coalesce(F.bool_or("moved"), F.lit(False)).alias("m")).first()["m"]
        labels = after.drop("moved")
        if not moved:
            return labels
