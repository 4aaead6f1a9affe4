"""Field references read out of formulas and code: all inferred, none guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evitrace.functions.let import let
from evitrace.session import cut_lineage

# Relationship chains and bare field names in formulas.
_CHAIN = r"\b([A-Za-z][A-Za-z0-9_]*__r(?:\.[A-Za-z][A-Za-z0-9_]*__r)*)\.([A-Za-z][A-Za-z0-9_]*)\b"
_FIELD = r"\b([A-Za-z][A-Za-z0-9_]*__c)\b"

# Inline queries, what compares a field, words that are no fields.
_BLOCK = r"(?is)\[\s*(SELECT\b[^\]]*?)\]"
_FROM = r"(?i)\bFROM\s+([A-Za-z][A-Za-z0-9_]*)"
_COMPARED = r"(?<!\.)\b([A-Za-z][A-Za-z0-9_]*)\s*(?:=|!=|<>|<=|>=|<|>)"
_OPERATED = r"(?i)(?<!\.)\b([A-Za-z][A-Za-z0-9_]*)\s+(?:LIKE|IN|NOT\s+IN|INCLUDES|EXCLUDES)\b"
KEYWORDS = (
    "SELECT", "FROM", "WHERE", "AND", "OR", "NOT", "NULL", "TRUE", "FALSE", "LIKE", "IN", "ORDER", "BY", "GROUP",
    "HAVING", "LIMIT", "OFFSET", "ASC", "DESC", "NULLS", "FIRST", "LAST", "TODAY", "YESTERDAY", "TOMORROW",
    "THIS_WEEK", "LAST_WEEK", "NEXT_WEEK", "THIS_MONTH", "LAST_MONTH", "NEXT_MONTH", "THIS_YEAR", "LAST_YEAR",
    "NEXT_YEAR", "INCLUDES", "EXCLUDES", "WITH", "SECURITY_ENFORCED", "USER_MODE", "SYSTEM_MODE", "FOR", "UPDATE",
    "VIEW", "REFERENCE", "ALL", "ROWS", "TYPEOF", "END", "WHEN", "THEN", "ELSE",
)
# Declarations of variables, loop variables, and member accesses.
_DECLARED = r"\b[A-Z][A-Za-z0-9_]*\s+[a-z][A-Za-z0-9_]*\s*[=;]"
_LOOPED = r"\bfor\s*\(\s*[A-Z][A-Za-z0-9_]*\s+[a-z][A-Za-z0-9_]*\s*:"
_MEMBER = r"\b[A-Za-z][A-Za-z0-9_]*\.[A-Za-z][A-Za-z0-9_]*\b(?!\s*\()"
_CUSTOM = r"\b([A-Za-z][A-Za-z0-9_]*__(?:c|mdt|e|x|b))\b"


def relationship_targets(nodes: DataFrame) -> DataFrame:
    """(object, stem, target) of every lookup: ``X__r`` on the object leads to the target."""
    looked = nodes.filter((F.col("metadata_type") == "CustomField") & (F.col("tag") == "referenceTo")).select("path", F.col("text").alias("target"))
    named = nodes.filter((F.col("metadata_type") == "CustomField") & (F.col("parent") == -1)).select(
        "path", F.col("object_name").alias("object"), F.coalesce(F.try_element_at("kids", F.lit("fullName")), F.col("stem")).alias("field")
    ).filter(F.col("field").endswith("__c"))
    return named.join(looked.groupBy("path").agg(F.min("target").alias("target")), "path").select(
        "object", F.regexp_replace("field", "__c$", "").alias("stem"), "target"
    )


def chain_ends(chains: DataFrame, targets: DataFrame) -> DataFrame:
    """Where chains of lookups lead: (start, chain, end); a chain with an unknown hop has no row.

    ``chains``: start (an object) and chain (``A__r.B__r``), of any length. Distinct chains go one hop
    a round, each round written out, and leave once they have ended: as many rounds as the longest
    chain has hops.
    """
    step = cut_lineage(targets.select(F.col("object").alias("at"), F.concat("stem", F.lit("__r")).alias("hop"), F.col("target").alias("next")).distinct())
    going = cut_lineage(chains.filter(F.col("start").isNotNull()).distinct().select("start", "chain", F.col("start").alias("at"), F.split("chain", r"\.").alias("hops")))
    ended = going.limit(0).select("start", "chain", F.col("at").alias("end"))
    while not going.isEmpty():
        moved = going.withColumn("hop", F.get("hops", F.lit(0))).join(step, ["at", "hop"]).select(
            "start", "chain", F.col("next").alias("at"), F.slice("hops", 2, F.greatest(F.size("hops") - 1, F.lit(0))).alias("hops"))
        moved = cut_lineage(moved)
        ended = ended.unionByName(moved.filter(F.size("hops") == 0).select("start", "chain", F.col("at").alias("end")))
        going = moved.filter(F.size("hops") > 0)
    return ended


def formula_references(formulas: DataFrame, targets: DataFrame) -> DataFrame:
    """Fields a formula names: ``(component_id, target)``.

    ``formulas``: component_id, object_name, formula. A chain resolves hop by hop against the
    lookups; when a hop is unknown the whole chain is dropped. Bare names belong to the
    formula's own object.
    """
    spans = formulas.select("component_id", F.col("object_name").alias("start"), F.explode(
        F.array_distinct(F.regexp_extract_all("formula", F.lit(_CHAIN), F.lit(0)))
    ).alias("span")).select(
        "component_id", "start", F.regexp_extract("span", _CHAIN, 1).alias("chain"), F.regexp_extract("span", _CHAIN, 2).alias("field"))
    # Both the chains and the join below read the spans: formulas are searched once.
    spans = cut_lineage(spans)
    ends = chain_ends(spans.select("start", "chain"), targets)
    chained = spans.join(ends, ["start", "chain"]).select("component_id", F.concat_ws(".", "end", "field").alias("target"))
    bare = formulas.select("component_id", "object_name", F.explode(
        F.array_distinct(F.regexp_extract_all(F.regexp_replace("formula", _CHAIN, " "), F.lit(_FIELD), F.lit(1)))
    ).alias("field")).select("component_id", F.concat_ws(".", "object_name", "field").alias("target"))
    return chained.unionByName(bare).distinct()


def _block_fields(block: Column) -> Column:
    """``Object.Field`` of one inline query; parentheses are taken out before FROM is looked for."""
    flat = F.regexp_replace(F.regexp_replace(block, r"\s+", " "), r"\([^)]*\)", " ")

    def fields(text):
        owner = F.regexp_extract(text, _FROM, 1)
        listed = F.transform(F.split(F.regexp_extract(text, r"(?i)^\s*SELECT\s+(.*?)\bFROM\b", 1), ","), lambda t: F.trim(t))
        rest = F.regexp_extract(text, r"(?i)\bFROM\s+[A-Za-z][A-Za-z0-9_]*(.*)$", 1)
        tested = F.concat(F.regexp_extract_all(rest, F.lit(_COMPARED), F.lit(1)), F.regexp_extract_all(rest, F.lit(_OPERATED), F.lit(1)))
        kept = F.filter(F.concat(listed, tested), lambda t: t.rlike(r"^[A-Za-z][A-Za-z0-9_]*$") & ~F.upper(t).isin(*KEYWORDS))
        return F.when(owner == "", F.array().cast("array<string>")).otherwise(F.transform(kept, lambda t: F.concat_ws(".", owner, t)))

    return let(flat, fields)


def soql_fields(code: DataFrame) -> DataFrame:
    """Fields named in inline queries. ``code``: component_id, source."""
    blocks = F.regexp_extract_all("source", F.lit(_BLOCK), F.lit(1))
    return code.select("component_id", F.explode(F.array_distinct(F.flatten(F.transform(blocks, _block_fields)))).alias("target"))


def variable_fields(code: DataFrame) -> DataFrame:
    """Fields reached through locally declared records. ``code``: component_id, source, object_name.

    A declaration counts only when the same file already shows its type to be an object.
    """
    every = lambda pattern, group=0: F.regexp_extract_all("source", F.lit(pattern), F.lit(group))
    known = F.concat(every(_CUSTOM, 1), every(r"(?i)\bSELECT\b[\s\S]{0,600}?\bFROM\s+([A-Za-z][A-Za-z0-9_]*)", 1), F.array_compact(F.array("object_name")))
    declared = code.select("component_id", known.alias("known"), F.explode(F.array_distinct(F.concat(every(_DECLARED), every(_LOOPED)))).alias("d")).select(
        "component_id", "known", F.regexp_extract("d", r"([A-Z][A-Za-z0-9_]*)\s+([a-z][A-Za-z0-9_]*)\s*[=;:]$", 1).alias("type"),
        F.regexp_extract("d", r"([A-Z][A-Za-z0-9_]*)\s+([a-z][A-Za-z0-9_]*)\s*[=;:]$", 2).alias("variable"),
    ).filter(F.array_contains("known", F.col("type"))).select("component_id", "type", "variable").distinct()
    members = code.select("component_id", F.explode(F.array_distinct(every(_MEMBER))).alias("m")).select(
        "component_id", F.substring_index("m", ".", 1).alias("variable"), F.substring_index("m", ".", -1).alias("field")
    )
    return members.join(declared, ["component_id", "variable"]).select("component_id", F.concat_ws(".", "type", "field").alias("target")).distinct()
