"""Probe derivers: durable facts from the result of one observation query."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evitrace.vocab import SUPPRESSION_FLOOR

API_PATH = r"^[A-Za-z][A-Za-z0-9_]*(\.[A-Za-z][A-Za-z0-9_]*)*$"


class ProbeDropped(ValueError):
    """The observation does not have the shape its kind requires."""


def iso_utc(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """ISO text to an instant: a ``Z`` or an offset with or without a colon; none means UTC."""
    colon = F.regexp_replace(F.btrim(text), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.try_to_timestamp(colon)


def object_shape(df: DataFrame, created: str, modified: str | None = None) -> DataFrame:
    """One row: count and normalised date span."""
    return df.agg(
        F.count(F.lit(1)).alias("record_count"),
        iso_utc(F.min(created)).alias("created_first"),
        iso_utc(F.max(created)).alias("created_last"),
        iso_utc(F.max(modified or created)).alias("last_modified_max"),
    )


def distribution(df: DataFrame, key: str, floor: int = SUPPRESSION_FLOOR, top: int | None = None) -> DataFrame:
    """Group counts with small groups folded into one bucket: ``(key, record_count, groups)``.

    Groups are formed on the whole key and cut to 80 characters afterwards. The folded bucket
    has a null key and states how many groups it holds.
    """
    counts = df.groupBy(F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return suppress(counts, floor, top)


def suppress(counts: DataFrame, floor: int = SUPPRESSION_FLOOR, top: int | None = None) -> DataFrame:
    """Shown groups, all or the ``top`` largest of them, and the folded rest."""
    shown = counts.filter(F.col("n") >= floor).select(
        F.coalesce(F.substring("k", 1, 80), F.lit("(null)")).alias("key"),
        F.col("n").alias("record_count"),
        F.lit(1).cast("bigint").alias("groups"),
    )
    if top is not None:
        shown = shown.orderBy(F.desc("record_count"), "key").limit(top)
    folded = counts.filter(F.col("n") < floor).agg(
        F.lit(None).cast("string").alias("key"),
        F.sum("n").alias("record_count"),
        F.count(F.lit(1)).alias("groups"),
    ).filter(F.col("groups") > 0)
    return shown.unionByName(folded)


def _wide_to_long(df: DataFrame, measures: dict[str, Column], value: str, top: int | None = None) -> DataFrame:
    """One aggregate row with a total to one row per field, in name order."""
    rows = df.agg(
        F.array(*[
            F.struct(F.lit(name).alias("field"), measures[name].alias(value),
                     F.count(F.lit(1)).alias("total_count"))
            for name in sorted(measures)[:top]
        ]).alias("r")
    )
    return rows.select(F.inline("r"))


def field_fill(df: DataFrame, fields: list[str]) -> DataFrame:
    return _wide_to_long(df, {f: F.count(f) for f in fields}, "filled_count")


def field_cardinality(df: DataFrame, fields: list[str]) -> DataFrame:
    """Exact distinct counts per field: values are counted per field, then the groups are."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in sorted(fields)
    ])).alias("p")).groupBy("p.field", "p.v").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("field").agg(
        F.count("v").alias("distinct_count"), F.sum("n").alias("total_count")
    )


def lookup_shape(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Fill of lookup fields with the object each points at; every field needs a target."""
    missing = [f for f, t in targets.items() if not t]
    if missing:
        raise ProbeDropped(f"no target object for {', '.join(missing)}")
    filled = _wide_to_long(df, {f: F.count(f) for f in targets}, "filled_count")
    target = F.element_at(F.create_map(*[F.lit(x) for f, t in targets.items() for x in (f, t)]), F.col("field"))
    return filled.withColumn("target_object", target)


def recency_window(df: DataFrame, moment: str, days: int, at: datetime, declared: int | None = None) -> DataFrame:
    """Rows of the last ``days`` days before an instant."""
    if declared is not None and declared != days:
        raise ProbeDropped(f"declared window of {declared} days, query asks for {days}")
    cutoff = F.lit(at) - F.make_dt_interval(days=F.lit(days))
    return df.filter((F.col(moment) >= cutoff) & (F.col(moment) <= F.lit(at))).agg(
        F.lit(days).alias("window_days"), F.count(F.lit(1)).alias("record_count")
    )


def flatten(schema: T.StructType, prefix: str = "") -> list[tuple[str, Column]]:
    """Dotted leaf columns of nested records; ``attributes`` blocks are noise and skipped."""
    out = []
    for field in schema.fields:
        if field.name == "attributes":
            continue
        path = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            out += flatten(field.dataType, path + ".")
        else:
            quoted = ".".join(f"`{p}`" for p in path.split("."))
            out.append((path, F.col(quoted)))
    return out


def structures(schema: T.StructType, prefix: str = "") -> list[str]:
    out = []
    for field in schema.fields:
        if field.name == "attributes" or not isinstance(field.dataType, T.StructType):
            continue
        path = f"{prefix}{field.name}"
        out += [path] + structures(field.dataType, path + ".")
    return out


def strip_attributes(df: DataFrame) -> DataFrame:
    """Drops the ``attributes`` blocks of every level, driven by the schema."""
    def rebuild(schema: T.StructType, path: str) -> list[Column]:
        kept = []
        for field in schema.fields:
            if field.name == "attributes":
                continue
            full = f"{path}`{field.name}`"
            column = F.col(full)
            if isinstance(field.dataType, T.StructType):
                inner = rebuild(field.dataType, full + ".")
                column = F.when(column.isNotNull(), F.struct(*inner))
            kept.append(column.alias(field.name))
        return kept

    return df.select(*rebuild(df.schema, ""))


def record_sample(sample: DataFrame, max_rows: int = 50, top: int | None = None) -> DataFrame:
    """Populated counts per flattened path of a small sample.

    The sample is the probe's own bounded query result; one above ``max_rows`` is dropped by
    filtering the answer out, so nothing is counted on the driver.
    """
    import re

    leaves = [(p, c) for p, c in sorted(flatten(sample.schema)) if re.match(API_PATH, p)]
    if not leaves:
        raise ProbeDropped("no conforming sampled columns")
    kinds = dict(sample.select(*[c.alias(p) for p, c in leaves]).dtypes)

    def populated(path: str, column: Column) -> Column:
        return column.isNotNull() & (column != "") if kinds[path] == "string" else column.isNotNull()

    rows = sample.agg(
        F.count(F.lit(1)).alias("size"),
        F.array(*[
            F.struct(F.lit(p).alias("field"), F.count_if(populated(p, c)).alias("populated_count"))
            for p, c in leaves[:top]
        ]).alias("r"),
    ).filter(F.col("size").between(1, max_rows))
    return rows.select(F.inline("r"), F.col("size").alias("sample_size"))


def record_structure(sample: DataFrame, type_of: str = "attributes.type") -> DataFrame:
    """Nested paths of a sample: how often populated and which object types were observed."""
    rows = []
    for path in structures(sample.schema):
        quoted = ".".join(f"`{p}`" for p in path.split("."))
        observed = F.col(f"{quoted}.{type_of}")
        rows.append(F.struct(
            F.lit(path).alias("path"),
            F.sort_array(F.collect_set(observed)).alias("types"),
            F.count(F.col(quoted)).alias("populated"),
            F.count(F.lit(1)).alias("sample_size"),
        ))
    if not rows:
        raise ProbeDropped("no nested records in the sample")
    return sample.agg(F.array(*rows).alias("r")).select(F.inline("r")).select(
        "path", F.get("types", F.lit(0)).alias("target_object"), "populated", "sample_size",
        F.get("types", F.lit(1)).alias("polymorphic_type"),
    )


DERIVERS = {
    "object-shape": object_shape,
    "record-type-distribution": distribution,
    "picklist-distribution": distribution,
    "field-fill": field_fill,
    "field-cardinality": field_cardinality,
    "lookup-shape": lookup_shape,
    "recency-window": recency_window,
    "record-sample": record_sample,
}
