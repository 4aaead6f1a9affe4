"""Bounded breadth-first walks and evidence closure, level by level as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evitrace.functions.analyze import fold_name
from evitrace.operators.graph import resolve_targets
from evitrace.session import cut_lineage
from evitrace.vocab import CONTAINMENT, CURRENT_LANE, DEPTH_LIMITS, EXACT, HEURISTIC

_STEP = "struct<src:string,kind:string,dst:string,via:string,assurance:string,owner_ward:boolean>"


def _hops(frontier: DataFrame, edges: DataFrame, entries: DataFrame, direction: str, names: DataFrame | None = None) -> DataFrame:
    """Every edge that leaves the frontier: to, kind, via, assurance, owner_ward.

    The frontier is a written table, so a small one meets the edges as they are scanned. Only
    the targets of the frontier's own edges are resolved.
    """
    own = edges.filter(F.col("kind") == CONTAINMENT) if direction == "incoming" else edges
    followed = cut_lineage(own.withColumnRenamed("source", "node").join(frontier, "node"))
    keys = followed.select("target_key").distinct()
    resolved = resolve_targets(entries, followed, few=keys, names=names).select("target_key", "target_identity")
    carried = ["anchor", "node", "path", "min_assurance"]
    forward = followed.join(resolved, "target_key", "left").select(
        *carried, F.coalesce("target_identity", "target").alias("to"), "kind",
        F.col("target").alias("via"), "assurance", F.lit(direction == "incoming").alias("owner_ward"),
    )
    if direction != "incoming":
        return forward
    own_names = frontier.select(
        *carried,
        F.explode(F.array_distinct(F.array_compact(F.array("node", F.nullif(F.col("full_name"), F.lit("")))))).alias("name"),
    ).withColumn("target_key", fold_name(F.col("name")))
    pointing = edges.select("target_key", "source", "kind", "assurance").join(own_names, "target_key").select(
        *carried, F.col("source").alias("to"), "kind", F.col("name").alias("via"), "assurance",
        F.lit(False).alias("owner_ward"),
    )
    return pointing.unionByName(forward)


def walk(edges: DataFrame, entries: DataFrame, anchors: DataFrame, depth: int,
         direction: str = "incoming", lanes=(CURRENT_LANE,), include_heuristic: bool = False,
         stop_at: list[str] | None = None, distinct_nodes: bool = False, names: DataFrame | None = None) -> DataFrame:
    """Rows ``(anchor, node, hop, lifecycle, resolved, path, min_assurance)``.

    A level offers one row per edge, and nodes count as visited once their level is complete,
    so a node reached by two edges of one level appears twice; ``distinct_nodes`` keeps the
    first chain of each. Nodes without an entry stay, unresolved. ``anchors`` has a ``node``
    column; several anchors walk side by side.

    Each level is written to the checkpoint folder: while its file is small the edges are
    scanned with it at hand and nothing of theirs is shuffled; a large one is joined by shuffle.
    Edges and entries are scanned once or twice per level, so they should be stored tables;
    ``names`` are the entries' stored name keys.
    """
    stop = sorted(stop_at or [])
    known = entries.select(F.col("identity").alias("to"), F.col("lane").alias("lifecycle"), F.col("full_name").alias("to_name"))

    def described(nodes: DataFrame) -> DataFrame:
        """Entries of the given nodes, filtered at the scan."""
        return known.join(nodes.select("to").distinct(), "to", "left_semi")

    start = anchors.select(
        F.col("node").alias("anchor"), F.col("node").alias("to"),
        F.array().cast(f"array<{_STEP}>").alias("path"), F.lit(EXACT).alias("min_assurance"),
    )
    frontier = cut_lineage(start.join(described(start), "to", "left").select(
        "anchor", F.col("to").alias("node"), "path", "min_assurance", F.col("to_name").alias("full_name")
    ))
    visited = start.select("anchor", "to")
    levels = []
    for level in range(1, depth + 1):
        hops = _hops(frontier, edges, entries, direction, names)
        if not include_heuristic:
            hops = hops.filter(F.col("assurance") == EXACT)
        # Visited nodes are one row per node and anchor; the first level has its anchor only.
        if level == 1:
            hops = hops.filter(F.col("to") != F.col("anchor"))
        else:
            hops = hops.join(visited, ["anchor", "to"], "left_anti")
        fresh = cut_lineage(hops)
        reached = fresh.join(described(fresh), "to", "left").filter(
            F.col("lifecycle").isNull() | F.col("lifecycle").isin(*lanes)
        )
        step = F.struct(
            F.col("node").alias("src"), "kind", F.col("to").alias("dst"), "via", "assurance", "owner_ward"
        )
        halted = F.coalesce(F.col("to").isin(stop) | F.col("to_name").isin(stop), F.lit(False)) if stop else F.lit(False)
        rows = reached.select(
            "anchor", F.col("to").alias("node"), F.lit(level).alias("hop"), "lifecycle",
            F.col("lifecycle").isNotNull().alias("resolved"),
            F.concat("path", F.array(step)).alias("path"),
            F.when((F.col("assurance") == HEURISTIC) | (F.col("min_assurance") == HEURISTIC), HEURISTIC)
            .otherwise(EXACT).alias("min_assurance"),
            F.col("to_name").alias("full_name"), halted.alias("halted"),
        )
        if distinct_nodes:
            first = rows.groupBy("anchor", "node").agg(F.min_by(F.struct(*rows.columns[2:]), F.to_json("path")).alias("r"))
            rows = first.select("anchor", "node", "r.*")
        levels.append(rows)
        if level < depth:
            visited = visited.unionByName(rows.select("anchor", F.col("node").alias("to"))).distinct()
            frontier = cut_lineage(rows.filter(~F.col("halted")).select("anchor", "node", "path", "min_assurance", "full_name"))
    out = levels[0]
    for rows in levels[1:]:
        out = out.unionByName(rows)
    return out.drop("full_name")


def path_text(path) -> "F.Column":
    """``kind>node`` per step; an owner-ward step is marked with a caret."""
    return F.array_join(
        F.transform(path, lambda s: F.concat(F.when(s["owner_ward"], "^").otherwise(""), s["kind"], F.lit(">"), s["dst"])),
        " ",
    )


def impact(edges: DataFrame, entries: DataFrame, anchor: str, direction: str = "incoming",
           depth: int = DEPTH_LIMITS["impact"], lanes=(CURRENT_LANE,), include_heuristic: bool = False,
           top: int | None = None, names: DataFrame | None = None) -> DataFrame:
    """The walk from one anchor, ordered by hop and node; a depth beyond the limit is refused."""
    if not 1 <= depth <= DEPTH_LIMITS["impact"]:
        raise ValueError(f"depth must be 1 to {DEPTH_LIMITS['impact']}, not {depth}")
    spark = edges.sparkSession
    start = spark.createDataFrame([(anchor,)], "node string")
    rows = walk(edges, entries, start, depth, direction, lanes, include_heuristic, names=names)
    ordered = rows.select("node", "hop", "lifecycle", "resolved", path_text("path").alias("path"), "min_assurance").orderBy("hop", "node", "path")
    return ordered.limit(top) if top else ordered


def closure(starts: DataFrame, depends: DataFrame) -> DataFrame:
    """Everything each start transitively depends on, cycles included: ``(start, id)``.

    Only what the starts reach is ever written: a round extends the pairs of the round before by one
    step, so there are as many rounds as the longest of the shortest paths has steps. Each round is
    written out, so lost executors re-read files instead of replaying the rounds; the levels are
    put together now and then, which keeps the plan short.
    """
    steps = cut_lineage(depends.select("id", "depends_on").filter("id IS NOT NULL AND depends_on IS NOT NULL").distinct())
    fresh = known = cut_lineage(starts.select("start", F.col("start").alias("id")).distinct())
    since = 0
    while True:
        onward = fresh.join(steps, "id").select("start", F.col("depends_on").alias("id")).distinct()
        fresh = cut_lineage(onward.join(known, ["start", "id"], "left_anti"))
        if fresh.isEmpty():
            return known
        known, since = known.unionByName(fresh), since + 1
        if since == 8:
            known, since = cut_lineage(known), 0
