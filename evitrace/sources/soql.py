"""Composed object queries as opaque text: what they read, and whether they may run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quoted literals, the object after FROM, and the accepted length.
_LITERAL = r"'(?:\\.|[^'\\])*'"
_FROM = r"(?i)\bFROM\s+([A-Za-z][A-Za-z0-9_]*)\b"
MIN_LENGTH, MAX_LENGTH = 8, 4000


def from_objects(query: Column) -> Column:
    """Distinct objects named after FROM, sorted; quoted text is not looked into."""
    bare = F.regexp_replace(query, _LITERAL, "''")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(_FROM), F.lit(1))))


def gate(queries: DataFrame, allowed: list[str] | None = None, text: str = "query") -> DataFrame:
    """Adds ``from_objects`` and ``verdict``; ``allowed=None`` restricts no object."""
    named = queries.withColumn("from_objects", from_objects(F.col(text)))
    size = F.char_length(text)
    verdict = F.when(
        F.col(text).isNull() | (size < MIN_LENGTH) | (size > MAX_LENGTH) | F.col(text).contains("${"), "QUERY_VALIDATION_DENIED"
    )
    if allowed is not None:
        inside = F.forall("from_objects", lambda o: o.isin(allowed))
        verdict = verdict.when(~inside, "OBJECT_NOT_ALLOWLISTED")
    return named.withColumn("verdict", verdict.otherwise("OK"))


def probe_problems(probes: DataFrame) -> DataFrame:
    """Problems of probe definitions: (label, problem).

    ``probes``: label, kind, query, own_object. A sample needs a trailing limit of at most 50,
    every probe reads its own object alone, paths have at most two hops, labels are unique.
    """
    objects = from_objects(F.col("query"))
    limit = F.regexp_extract("query", r"(?i)\bLIMIT\s+(\d+)\s*$", 1)
    hops = F.exists(F.regexp_extract_all("query", F.lit(r"\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+"), F.lit(0)), lambda p: F.size(F.split(p, r"\.")) > 3)
    checks = F.array_compact(F.array(
        F.when(~((F.size(objects) == 1) & (F.get(objects, F.lit(0)) == F.col("own_object"))), F.lit("reads another object")),
        F.when(limit == "", F.lit("no trailing limit")),
        F.when((F.col("kind") == "record-sample") & (limit.try_cast("int") > 50), F.lit("sample too large")),
        F.when(hops, F.lit("path too long")),
    ))
    each = probes.select("label", F.explode(checks).alias("problem"))
    twice = probes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("label", F.lit("label used twice").alias("problem"))
    return each.unionByName(twice)
