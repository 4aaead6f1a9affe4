"""Row-set profiles: facts about a table that carry counts and shapes, never its content.

Each takes any DataFrame and returns a small DataFrame. Values are counted before they are
ranked, so a value held by a third of the rows is combined before it is shuffled.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evitrace.functions.digest import digest
from evitrace.functions.text import value_shape
from evitrace.operators.ordered import adjacent_overlaps
from evitrace.vocab import AUDIT_FIELDS, MAX_GROUPS, MAX_SHAPES, RECORD_ID, SENSITIVE_NAME


def _blank(df: DataFrame, name: str) -> Column:
    """Null, or an empty string; other types are only blank when null."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.col(name).isNull() | (F.col(name) == "")
    return F.col(name).isNull()


def _unfilled(df: DataFrame, name: str) -> Column:
    """As blank, and an empty list counts too."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.col(name).isNull() | (F.size(name) == 0)
    return _blank(df, name)


def _falsy(df: DataFrame, name: str) -> Column:
    """Relationship parents: zero and false count as empty as well."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.col(name).isNull() | (F.col(name) == 0)
    if isinstance(kind, T.BooleanType):
        return F.col(name).isNull() | ~F.col(name)
    return _unfilled(df, name)


def object_baseline(df: DataFrame, dates: list[str], count_field: str | None = None) -> DataFrame:
    """Row count and the span of all date columns together.

    ``count_field`` names a pre-aggregated count; it is used only when there is a single row.
    """
    total = F.count(F.lit(1))
    if count_field:
        total = F.when(total == 1, F.coalesce(F.sum(F.col(count_field).cast("bigint")), F.lit(0))).otherwise(total)
    low = [F.min(c) for c in dates]
    high = [F.max(c) for c in dates]
    return df.agg(
        total.alias("observed_rows"),
        (F.least(*low) if len(low) > 1 else low[0]).alias("earliest"),
        (F.greatest(*high) if len(high) > 1 else high[0]).alias("latest"),
    )


def field_fill(df: DataFrame, fields: list[str]) -> DataFrame:
    """Filled and total per field, in one pass."""
    rows = df.agg(
        F.array(*[
            F.struct(F.lit(f).alias("field"), F.count_if(~_unfilled(df, f)).alias("filled"),
                     F.count(F.lit(1)).alias("total"))
            for f in fields
        ]).alias("r")
    )
    return rows.select(F.inline("r"))


def field_cardinality(df: DataFrame, field: str) -> DataFrame:
    """Exact distinct string forms, filled rows, empty rows."""
    counts = df.groupBy(
        F.when(~_blank(df, field), F.col(field).cast("string")).alias("value")
    ).agg(F.count(F.lit(1)).alias("n"))
    held = F.col("value").isNotNull()
    return counts.agg(
        F.lit(field).alias("field"),
        F.count_if(held).alias("distinct_values"),
        F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(~held, F.col("n"))), F.lit(0)).alias("null_or_empty"),
    )


def categorical_distribution(df: DataFrame, field: str, top: int = MAX_GROUPS) -> DataFrame:
    """The most frequent values (cut to 120 characters), with the number of groups in all."""
    value = F.when(_blank(df, field), F.lit("«null»")).otherwise(
        F.substring(F.col(field).cast("string"), 1, 120)
    )
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    groups = counts.agg(F.count(F.lit(1)).alias("g")).scalar()
    return (
        counts.orderBy(F.desc("count"), "value").limit(top)
        .select("value", "count", groups.alias("distinct_observed"), (groups > top).alias("truncated"))
    )


def key_integrity(df: DataFrame, keys: list[str]) -> DataFrame:
    """Missing and duplicate counts of a candidate key."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | _blank(df, k)
    counts = df.groupBy(
        missing.alias("missing"),
        *[F.when(~missing, F.col(k).cast("string")).alias(f"k{i}") for i, k in enumerate(keys)],
    ).agg(F.count(F.lit(1)).alias("n"))
    whole, repeated = ~F.col("missing"), ~F.col("missing") & (F.col("n") > 1)
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("missing_key"),
        F.count_if(whole).alias("distinct_keys"),
        F.count_if(repeated).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
    )


def relationship_shape(df: DataFrame, field: str) -> DataFrame:
    """Fill and fan-out of a relationship; the median is the upper one.

    The exact median keeps a count per distinct fan-out, and distinct fan-outs number at most
    the square root of twice the rows. Ordered downwards, the discrete median is the upper one.
    """
    fan_out = df.groupBy(
        F.when(~_falsy(df, field), F.col(field).cast("string")).alias("parent")
    ).agg(F.count(F.lit(1)).alias("n"))
    held = F.col("parent").isNotNull()
    n = F.when(held, F.col("n"))
    rows = fan_out.select("n", n.alias("kids"), held.alias("held"))
    return rows.agg(
        F.coalesce(F.sum("kids"), F.lit(0)).alias("filled"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count_if("held").alias("distinct_parents"),
        F.coalesce(F.min("kids"), F.lit(0)).alias("fan_out_min"),
        F.coalesce(F.max("kids"), F.lit(0)).alias("fan_out_max"),
        F.coalesce(
            F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY kids DESC)"), F.lit(0)
        ).cast("bigint").alias("fan_out_median"),
    )


def config_effectivity(df: DataFrame, start: str, end: str, at: datetime | Column) -> DataFrame:
    """Active, future, expired and unbounded windows at an instant, and neighbours that meet.

    An open end is replaced by the smallest or the largest timestamp.
    """
    at = at if isinstance(at, Column) else F.lit(at)
    open_ended = F.col(start).isNull() & F.col(end).isNull()
    low = F.coalesce(F.col(start), F.lit(datetime(1, 1, 1)).cast(df.schema[start].dataType))
    high = F.coalesce(F.col(end), F.lit(datetime(9999, 12, 31)).cast(df.schema[end].dataType))
    buckets = df.agg(
        F.count_if(~open_ended & ~(low > at) & ~(high < at)).alias("active"),
        F.count_if(~open_ended & (low > at)).alias("future"),
        F.count_if(~open_ended & ~(low > at) & (high < at)).alias("expired"),
        F.count_if(open_ended).alias("unbounded"),
    )
    windows = df.filter(~open_ended).select(low.alias("low"), high.alias("high"))
    overlaps = adjacent_overlaps(windows, "low", "high").select("overlaps").scalar()
    return buckets.withColumn("overlapping_windows", overlaps)


def sample_shape(df: DataFrame, top: int = MAX_SHAPES) -> DataFrame:
    """Per field, the most frequent structural shapes."""
    shapes = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(f.name).alias("field"), value_shape(F.col(f"`{f.name}`"), f.dataType).alias("shape"))
            for f in df.schema.fields if f.name != "attributes"
        ])).alias("s")
    ).groupBy("s.field", "s.shape").agg(F.count(F.lit(1)).alias("count"))
    from pyspark.sql import Window

    order = Window.partitionBy("field").orderBy(F.desc("count"), "shape")
    return shapes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def churn_profile(df: DataFrame, created: str, modified: str, window_days: int, at: datetime) -> DataFrame:
    """Rows created or modified since ``window_days`` before an instant; nothing bounds it above."""
    cutoff = F.lit(at) - F.make_dt_interval(days=F.lit(window_days))
    return df.agg(
        F.count(F.lit(1)).alias("observed_rows"),
        F.count_if(F.col(created) >= cutoff).alias("created_in_window"),
        F.count_if(F.col(modified) >= cutoff).alias("modified_in_window"),
        F.lit(window_days).alias("window_days"),
    )


def precedence_collision(df: DataFrame, scope: list[str], order: str | None = None) -> DataFrame:
    """Scopes held by several rows, and those whose order values tie.

    Order values are counted per scope first, so that a scope with most of the rows never has
    its values gathered.
    """
    keys = [F.col(s).cast("string").alias(f"s{i}") for i, s in enumerate(scope)]
    names = [f"s{i}" for i in range(len(scope))]
    if order:
        # The string form of a null is one more value, and equals itself.
        per_value = df.groupBy(*keys, F.col(order).cast("string").alias("o")).agg(F.count(F.lit(1)).alias("n"))
        groups = per_value.groupBy(*names).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    else:
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("most", F.lit(None).cast("bigint"))
    colliding = F.col("n") > 1
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(colliding).alias("colliding_groups"),
        F.coalesce(F.sum(F.when(colliding, F.col("n"))), F.lit(0)).alias("colliding_rows"),
        (F.count_if(colliding & (F.col("most") > 1)) if order else F.lit(None).cast("bigint")).alias("undecidable_groups"),
    )


def safe_snapshot(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Allowlisted columns only; what may not be served is replaced by a reason and a digest."""
    import re

    out = []
    for name in allowed:
        if name in AUDIT_FIELDS:
            continue
        column, kind = F.col(name), df.schema[name].dataType
        withheld = lambda why: F.concat(F.lit(why + " "), digest(_json(column, kind)))
        text = column.cast("string") if not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else None
        if re.search(SENSITIVE_NAME, name):
            shown = withheld("sensitive-field")
        elif text is None:
            shown = withheld("non-scalar")
        elif isinstance(kind, T.StringType):
            shown = F.when(text.rlike(RECORD_ID), withheld("salesforce-id")).otherwise(text)
        else:
            shown = text
        out.append(F.when(column.isNotNull(), shown).alias(name))
    return df.select(*out)


def _json(column: Column, kind: T.DataType) -> Column:
    """Canonical JSON of one value."""
    inner = F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(inner, F.lit(6), F.char_length(inner) - 6)


def withheld_counts(snapshot: DataFrame) -> DataFrame:
    """Withheld values per column of a snapshot."""
    rule = r"^(sensitive-field|salesforce-id|non-scalar) sha256:"
    return snapshot.agg(
        F.array(*[
            F.struct(F.lit(c).alias("field"), F.count_if(F.coalesce(F.col(c).rlike(rule), F.lit(False))).alias("withheld"))
            for c in snapshot.columns
        ]).alias("r")
    ).select(F.inline("r"))


def refused_fields(allowed: list[str]) -> list[str]:
    return sorted(set(allowed) & set(AUDIT_FIELDS))


# Profile kinds by name. An unknown kind is an error, never a fallback.
DERIVERS = {
    "object-baseline": object_baseline,
    "field-fill": field_fill,
    "field-cardinality": field_cardinality,
    "categorical-distribution": categorical_distribution,
    "key-integrity": key_integrity,
    "relationship-shape": relationship_shape,
    "config-effectivity": config_effectivity,
    "sample-shape": sample_shape,
    "churn-profile": churn_profile,
    "precedence-collision": precedence_collision,
}


def derive(kind: str, df: DataFrame, *args, **options) -> DataFrame:
    if kind not in DERIVERS:
        raise ValueError(f"unknown profile kind {kind!r}; one of {', '.join(DERIVERS)}")
    return DERIVERS[kind](df, *args, **options)


def policy_digest(version: int = 1) -> str:
    """Ties a receipt to the derivation rules in force."""
    import hashlib
    import json

    rules = {
        "version": version, "derivers": sorted(DERIVERS), "auditFields": sorted(AUDIT_FIELDS),
        "sensitivePattern": SENSITIVE_NAME, "maxGroups": MAX_GROUPS,
    }
    text = json.dumps(rules, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()
