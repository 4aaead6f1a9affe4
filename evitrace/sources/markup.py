"""Pages and component bundles: edges read from markup and scripts by pattern, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns over page and component markup, with edge kind and whether inferred.
PAGE_PATTERNS = (
    ("apex-controller", r"(?i)\bcontroller\s*=\s*[\"']([A-Za-z][A-Za-z0-9_]*)[\"']", False),
    ("operates-on", r"(?i)standardController\s*=\s*\"([^\"]+)\"", False),
    ("uses-label", r"\$Label\.(?:c\.)?([A-Za-z][A-Za-z0-9_]*)", False),
    ("embeds-component", r"<c:([A-Za-z][A-Za-z0-9_]*)", False),
    ("object-token", r"\b([A-Za-z][A-Za-z0-9_]*__(?:c|mdt|e|x|b))\b", True),
)
# The same for script and template files of web components.
BUNDLE_PATTERNS = (
    ("apex-method", r"@salesforce/apex/([A-Za-z0-9_]+\.[A-Za-z0-9_]+)", False),
    ("schema", r"@salesforce/schema/([A-Za-z0-9_.]+)", False),
    ("uses-label", r"@salesforce/label/c\.([A-Za-z0-9_]+)", False),
    ("operates-on", r"object-api-name\s*=\s*\"([A-Za-z][A-Za-z0-9_]*)\"", False),
    ("references-field", r"['\"]([A-Z][A-Za-z0-9_]*(?:__c)?\.[A-Za-z][A-Za-z0-9_]*)['\"]", True),
)
_KEBAB = r"<c-([a-z][a-z0-9-]*)"
_FIELDS = (
    ("writes-field", r"(?i)<apex:inputField[^>]*value\s*=\s*\"\{!([A-Za-z0-9_.]+)\}\""),
    ("reads-field", r"(?i)<apex:outputField[^>]*value\s*=\s*\"\{!([A-Za-z0-9_.]+)\}\""),
)


def camel(kebab: Column) -> Column:
    """``case-tile`` to ``caseTile``."""
    joined = F.replace(F.initcap(F.replace(kebab, F.lit("-"), F.lit(" "))), F.lit(" "), F.lit(""))
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substr(joined, F.lit(2)))


def object_field(token: Column, page_object: Column) -> Column:
    """``Object.Field`` of a two-part token whose head is the page's object or a custom one."""
    parts = F.split(token, r"\.")
    head = F.get(parts, F.lit(0))
    known = F.coalesce(head == page_object, F.lit(False)) | head.rlike(r"^[A-Za-z][A-Za-z0-9_]*__(c|mdt|e|x|b)$")
    return F.when((F.size(parts) == 2) & known, token)


def flow_field(token: Column, object_name: Column, variables: Column) -> Column:
    """``Object.Field`` of a flow token: ``$Record`` or a typed variable, one hop only."""
    parts = F.split(token, r"\.")
    head, member = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    owner = F.when(head.isin("$Record", "$Record__Prior"), object_name).otherwise(F.try_element_at(variables, head))
    return F.when((F.size(parts) == 2) & owner.isNotNull(), F.concat_ws(".", owner, member))


def _found(source: str, patterns) -> list[Column]:
    return [
        F.transform(F.array_distinct(F.regexp_extract_all(source, F.lit(pattern), F.lit(1))), lambda v: F.struct(
            F.lit(kind).alias("kind"), v.alias("target"), F.lit(flag).alias("flag")
        ))
        for kind, pattern, flag in patterns
    ]


def page_edges(files: DataFrame) -> DataFrame:
    """Edges of page and component markup. ``files``: component_id, source."""
    page_object = F.nullif(F.regexp_extract("source", PAGE_PATTERNS[1][1], 1), F.lit(""))
    fields = [
        F.filter(F.transform(F.array_distinct(F.regexp_extract_all("source", F.lit(pattern), F.lit(1))), lambda t: F.struct(
            F.lit(kind).alias("kind"), object_field(t, page_object).alias("target"), F.lit(False).alias("flag")
        )), lambda e: e["target"].isNotNull())
        for kind, pattern in _FIELDS
    ]
    return files.select("component_id", F.explode(F.concat(*_found("source", PAGE_PATTERNS), *fields)).alias("e")).select("component_id", "e.*").distinct()


def bundle_edges(files: DataFrame) -> DataFrame:
    """Edges of bundle files, which count for their bundle as a whole."""
    embeds = F.transform(F.array_distinct(F.regexp_extract_all("source", F.lit(_KEBAB), F.lit(1))), lambda v: F.struct(
        F.lit("embeds-component").alias("kind"), camel(v).alias("target"), F.lit(False).alias("flag")
    ))
    rows = files.select("component_id", F.explode(F.concat(*_found("source", BUNDLE_PATTERNS), embeds)).alias("e"))
    return rows.select("component_id", "e.*").distinct()


def component_objects(components: DataFrame, edges: DataFrame, object_kinds: tuple[str, ...]) -> DataFrame:
    """Objects a component touches: by folder, by name convention, by edges of object kinds.

    ``components``: component_id, metadata_type, name, path. ``edges``: source, kind, target.
    """
    folder = F.regexp_extract("path", r"/objects/([^/]+)/", 1)
    named = components.select("component_id", F.explode(F.array_compact(F.array(
        F.nullif(folder, F.lit("")), F.when(F.col("metadata_type") == "Layout", F.substring_index("name", "-", 1))
    ))).alias("object_name"))
    objects = components.filter(F.col("metadata_type") == "CustomObject").select(F.col("name").alias("object_name"))
    tabs = components.filter(F.col("metadata_type") == "CustomTab").select("component_id", F.col("name").alias("object_name")).join(objects, "object_name", "left_semi")
    touched = edges.filter(F.col("kind").isin(*object_kinds)).select(F.col("source").alias("component_id"), F.substring_index("target", ".", 1).alias("object_name"))
    return named.unionByName(tabs.select("component_id", "object_name")).unionByName(touched).filter(F.col("object_name") != "").distinct()
