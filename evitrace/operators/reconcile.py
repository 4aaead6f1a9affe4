"""Two sources describing the same things: what agrees, what is contested, what one side lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evitrace.functions.digest import digest


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], traits: list[str],
              family: str | None = None) -> DataFrame:
    """Full outer comparison, null-safe per trait.

    A trait is contested only when both sides report the row and differ; it is then null rather
    than taken from either side. A row one side lacks is kept with its coverage.
    """
    compared = traits + ([family] if family else [])
    side = lambda df, tag: df.select(
        *keys, *[F.col(t).alias(f"{tag}_{t}") for t in compared], F.lit(True).alias(f"has_{tag}")
    )
    joined = side(left, "a").join(side(right, "b"), keys, "full_outer")
    both = F.col("has_a").isNotNull() & F.col("has_b").isNotNull()
    differs = lambda t: both & ~F.col(f"a_{t}").eqNullSafe(F.col(f"b_{t}"))
    agreed = [
        F.when(differs(t), F.lit(None)).when(F.col("has_a").isNotNull(), F.col(f"a_{t}"))
        .otherwise(F.col(f"b_{t}")).alias(t)
        for t in traits
    ]
    if family:
        agreed.append(F.coalesce(f"a_{family}", f"b_{family}", F.lit("other:unknown")).alias(family))
    contested = F.array_compact(F.array(*[F.when(differs(t), F.lit(t)) for t in compared]))
    coverage = lambda tag: F.when(F.col(f"has_{tag}").isNotNull(), "available").otherwise("missing")
    return joined.select(
        *keys, *agreed, F.array_sort(contested).alias("contested"),
        coverage("a").alias("left_coverage"), coverage("b").alias("right_coverage"),
    )


def summary(reconciled: DataFrame, by: list[str]) -> DataFrame:
    """Fields, contested properties, one-sided fields and a status per object."""
    contested = F.size("contested")
    return reconciled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fields"),
        F.coalesce(F.sum(contested.cast("bigint")), F.lit(0)).alias("contested_properties"),
        F.count_if(F.col("left_coverage") == "missing").alias("right_only"),
        F.count_if(F.col("right_coverage") == "missing").alias("left_only"),
        F.when(F.max(contested) > 0, "MISMATCH").otherwise("MATCH").alias("status"),
    )


def schema_digest(fields: DataFrame, object_col: str, name: str, family: str, max_fields: int = 500) -> DataFrame:
    """Digest of an object's sorted (name, family) list.

    Objects with more fields than the review allows get the truncated status instead; they are
    set aside by count before anything is gathered, so no list is longer than ``max_fields``.
    """
    counts = fields.groupBy(object_col).agg(F.count(F.lit(1)).alias("fields"))
    small = fields.join(counts.filter(F.col("fields") <= max_fields).select(object_col), object_col, "left_semi")
    listed = small.groupBy(object_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col(name).cast("string").alias("name"), F.col(family).alias("typeFamily")))).alias("l")
    ).select(object_col, digest(F.to_json("l")).alias("schema_digest"))
    return counts.join(listed, object_col, "left").withColumn(
        "status", F.when(F.col("fields") > max_fields, "RESULT_TRUNCATED").otherwise("VERIFIED")
    )


def compare_lists(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset difference of two equally shaped lists: rows whose counts differ.

    One aggregate over both sides instead of two ``exceptAll`` passes.
    """
    a = left.withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0))
    b = right.withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1))
    counted = a.unionByName(b).groupBy(*left.columns).agg(F.sum("_l").alias("left_count"), F.sum("_r").alias("right_count"))
    return counted.filter(F.col("left_count") != F.col("right_count"))


def list_status(left: DataFrame, right: DataFrame, max_rows: int | None = None) -> DataFrame:
    """VERIFIED, MISMATCH or RESULT_TRUNCATED for two package lists, with both sizes."""
    a = left.withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0))
    b = right.withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1))
    counted = a.unionByName(b).groupBy(*left.columns).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    totals = counted.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.count_if(F.col("l") != F.col("r")).alias("differing"),
    )
    status = F.when(F.col("differing") > 0, "MISMATCH").otherwise("VERIFIED")
    if max_rows:
        status = F.when(F.greatest("left_rows", "right_rows") >= max_rows, "RESULT_TRUNCATED").otherwise(status)
    return totals.withColumn("status", status)


def envelope_status(left_ok: Column, right_ok: Column, blocked: Column) -> Column:
    """Status of a review in which a source failed."""
    return (
        F.when(left_ok & right_ok, "VERIFIED").when(blocked, "BLOCKED").otherwise("INCOMPLETE")
    )


# Type names of the describe source by family.
_DESCRIBE = {
    "text": ("string", "textarea", "email", "phone", "url", "encryptedstring", "combobox"),
    "number": ("double", "int", "currency", "percent"),
    "reference": ("reference", "masterrecord"),
}
_SAME_NAME = ("picklist", "multipicklist", "boolean", "date", "datetime", "time", "base64", "address", "location", "id")


def describe_family(type_name: Column) -> Column:
    name = F.lower(F.coalesce(type_name, F.lit("")))
    out = F
    for family, members in _DESCRIBE.items():
        out = out.when(name.isin(*members), family)
    return out.when(name.isin(*_SAME_NAME), name).otherwise(F.concat(F.lit("other:"), name))


# Patterns of the catalog source's type labels, tried in this order.
_CATALOG = (
    (r"^(text|long text area|rich text|html|encrypted text|email|phone|url|auto number)", "text"),
    (r"^(number|currency|percent|formula \((number|currency|percent))", "number"),
    (r"^lookup\(\s*\)$", "id"),
    (r"^(lookup|master-detail|hierarchy|external lookup|indirect lookup)", "reference"),
    (r"^name$", "text"),
    (r"^multi-select picklist", "multipicklist"),
    (r"^picklist", "picklist"),
    (r"^(checkbox|formula \(checkbox)", "boolean"),
    (r"^(date/time|formula \(date/time)", "datetime"),
    (r"^(date|formula \(date)", "date"),
    (r"^(time|formula \(time)", "time"),
    (r"^geolocation", "location"),
    (r"^address", "address"),
    (r"^base64", "base64"),
    (r"^id$", "id"),
)


def catalog_family(label: Column) -> Column:
    raw = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    out = F
    for pattern, family in _CATALOG:
        out = out.when(raw.rlike(pattern), family)
    return out.otherwise(F.concat(F.lit("other:"), F.regexp_replace(raw, r"\s+", "-")))


def reference_list(targets: Column) -> Column:
    """Sorted targets; an empty list and an absent one are the same null."""
    held = F.array_sort(F.filter(targets, lambda t: t.isNotNull() & (t != "")))
    return F.when(F.size(held) > 0, held)


# What must not leave a review, by key and by value.
_SENSITIVE_KEY = r"(?i)(password|secret|token|session|authorization|credential|private_?key)"


def sensitive_map(values: Column) -> Column:
    """Whether a string map holds a sensitive key or a bearer-like value."""
    keys = F.exists(F.map_keys(values), lambda k: k.rlike(_SENSITIVE_KEY))
    return keys | F.exists(F.map_values(values), lambda v: v.rlike(r"(?i)\bbearer\s+\S{8,}|-----BEGIN "))
