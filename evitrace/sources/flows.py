"""Flows: declared error surfaces and the decisions that lead to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evitrace.session import cut_lineage

START = "$start"


def _kid(name: str):
    return F.try_element_at("kids", F.lit(name))


def connectors(nodes: DataFrame) -> DataFrame:
    """Declared connections: path, source, target, hop (a decision's outcome, else null), fault."""
    flows = nodes.filter(F.col("metadata_type") == "Flow")
    tops = flows.filter(F.col("parent") == 0).select(
        "path", F.col("ord").alias("top"), F.when(F.col("tag") == "start", START).otherwise(_kid("name")).alias("source"), F.col("tag").alias("top_tag")
    )
    rules = flows.filter(F.col("tag") == "rules").select("path", F.col("ord").alias("parent"), _kid("name").alias("outcome"))
    links = flows.filter(
        F.col("tag").isin("connector", "nextValueConnector", "noMoreValuesConnector", "faultConnector", "defaultConnector") & _kid("targetReference").isNotNull()
    ).select("path", "parent", "top", "tag", _kid("targetReference").alias("target"))
    joined = links.join(tops, ["path", "top"]).join(rules, ["path", "parent"], "left").filter(F.col("source").isNotNull())
    decided = F.col("top_tag") == "decisions"
    hop = F.when(decided & F.col("outcome").isNotNull(), F.concat("source", F.lit("="), "outcome")).when(
        decided & (F.col("tag") == "defaultConnector"), F.concat("source", F.lit("=default"))
    )
    usable = (decided & (F.col("tag").isin("connector", "defaultConnector"))) | (~decided & (F.col("tag") != "defaultConnector"))
    return joined.filter(usable).select("path", "source", "target", hop.alias("hop"), (F.col("tag") == "faultConnector").alias("fault"))


def decision_paths(links: DataFrame, goals: DataFrame) -> DataFrame:
    """(path, node, paths): the decision hops that lead from the start to each goal.

    ``links``: :func:`connectors`; ``goals``: path, node. All goals go back one connection per round,
    and a trail never returns to an element it has passed, so the rounds end by themselves. Every
    distinct hop list is kept, short ones first, then by their text; elements the start does not
    reach have none.
    """
    step = links.select("path", F.col("target").alias("at"), F.col("source").alias("before"), "hop").distinct()
    frontier = goals.select("path", "node").distinct().select(
        "path", "node", F.col("node").alias("at"), F.array("node").alias("trail"), F.array().cast("array<string>").alias("hops")
    )
    done = []
    while True:
        moved = frontier.join(step, ["path", "at"]).filter(~F.array_contains("trail", F.col("before")))
        moved = cut_lineage(moved.select(
            "path", "node", F.col("before").alias("at"), F.array_append("trail", F.col("before")).alias("trail"),
            F.when(F.col("hop").isNull(), F.col("hops")).otherwise(F.array_prepend("hops", F.col("hop"))).alias("hops"),
        ))
        done.append(moved.filter(F.col("at") == START).select("path", "node", "hops"))
        frontier = moved.filter(F.col("at") != START)
        if frontier.isEmpty():
            break
    reached = done[0]
    for rows in done[1:]:
        reached = reached.unionByName(rows)
    sized = F.sort_array(F.collect_list(F.struct(F.size("hops").alias("n"), "hops")))
    return reached.distinct().groupBy("path", "node").agg(F.transform(sized, lambda h: h["hops"]).alias("paths"))


def error_surfaces(nodes: DataFrame) -> DataFrame:
    """Custom errors, screen validations and fault paths, each with all decision paths before it."""
    flows = nodes.filter(F.col("metadata_type") == "Flow")
    tops = flows.filter((F.col("parent") == 0) & _kid("name").isNotNull()).select(
        "path", F.col("ord").alias("top"), _kid("name").alias("node"), _kid("label").alias("label"), F.col("tag").alias("top_tag")
    )
    inner = flows.select("path", "top", "ord", "parent", "tag", "kids").join(tops, ["path", "top"])
    fields = flows.filter(F.col("tag") == "fields").select("path", F.col("ord").alias("parent"), _kid("name").alias("field_name"))
    inner = inner.join(fields, ["path", "parent"], "left")
    kind = (
        F.when((F.col("top_tag") == "customErrors") & (F.col("tag") == "customErrorMessages"), "custom-error")
        .when((F.col("top_tag") == "screens") & (F.col("tag") == "validationRule") & _kid("errorMessage").isNotNull(), "screen-validation")
        .when((F.col("tag") == "faultConnector") & (F.col("parent") == F.col("top")), "fault-path")
    )
    surfaces = inner.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        "path", "kind", "node", "label",
        F.when(F.col("kind") == "screen-validation", F.coalesce("field_name", "node")).otherwise(F.col("node")).alias("component"),
        F.when(F.col("kind") != "fault-path", _kid("errorMessage")).alias("message"),
        _kid("fieldSelection").alias("field_selection"), _kid("formulaExpression").alias("condition"),
        F.when(F.col("kind") == "fault-path", _kid("targetReference")).alias("fault_target"),
    )
    routes = decision_paths(connectors(nodes), surfaces)
    found = surfaces.join(routes, ["path", "node"], "left")
    return found.select(*surfaces.columns, F.coalesce("paths", F.array().cast("array<array<string>>")).alias("paths"))


def resolved_messages(surfaces: DataFrame, labels: DataFrame) -> DataFrame:
    """Messages with their label replaced by its text; unknown labels stay as written.

    ``labels``: name, value. A message names few labels; each is looked up by name.
    """
    pattern = r"\{!\$Label\.([A-Za-z][A-Za-z0-9_]*)\}|\$Label\.([A-Za-z][A-Za-z0-9_]*)"
    keyed = surfaces.withColumn("surface", F.xxhash64("message"))
    names = keyed.select("surface", "message").distinct().select("surface", F.explode(F.array_distinct(F.regexp_extract_all("message", F.lit(pattern), F.lit(0)))).alias("token")).withColumn(
        "name", F.regexp_extract("token", r"\$Label\.([A-Za-z][A-Za-z0-9_]*)", 1)
    )
    texts = names.join(labels, "name").groupBy("surface").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("texts"))
    replaced = F.aggregate(F.map_entries("texts"), F.col("message"), lambda m, e: F.replace(m, e["key"], e["value"]))
    return keyed.join(texts, "surface", "left").withColumn("resolved", F.when(F.col("texts").isNotNull(), replaced)).drop("surface", "texts")
